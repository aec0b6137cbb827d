import pytest

from quarry.operators import control_flow as C


@pytest.mark.parametrize(
    ("body", "complexity"),
    [
        ("", 1),
        (None, 1),
        ("a(); b();", 1),
        ("if (x) { a(); } b();", 2),
        ("if (x) a(); else if (y) b(); else c();", 3),
        ("while (x) { a(); }", 2),
        ("for (int i = 0; i < 3; i++) { if (i == 1) continue; a(i); }", 3),
        ("do { a(); } while (x);", 2),
        ("switch (x) { case 1: a(); break; case 2: b(); default: c(); }", 3),
        ("switch (x) { case 1: a(); }", 2),
        ("return x;", 1),
        ('String s = "if (x) { while (y) {} }"; // if (z)', 1),
    ],
)
def test_complexity(body, complexity):
    assert C.read(body).complexity() == complexity


def lost(body):
    flow = C.read(body)
    return [flow.nodes[k][2] for k in range(2, len(flow.nodes)) if k not in flow.reachable()]


def test_unreachable_statements():
    assert lost("a(); return; b();") == ["b()"]
    assert lost("while (x) { break; a(); } b();") == ["a()"]
    assert lost("if (x) { return; } else { throw e; } c();") == ["c()"]
    assert lost("try { a(); } catch (E e) { return; } finally { b(); } c();") == []
    assert lost("synchronized (l) { a(); } for (;;) { b(); }") == []


def test_nesting():
    assert C.read("if (a) { for (;;) { while (b) { c(); } } }").deepest == 3


def flows(body):
    flow = C.read(body)
    return {(v, flow.nodes[d][1], flow.nodes[u][1]) for v, d, u in C.reaching(flow)}


def test_reaching_definitions():
    assert flows("int x = 1;\nif (c) {\nx = 2;\n}\nuse(x);") == {("x", 1, 5), ("x", 3, 5)}
    assert flows("int x = 1;\nx = 2;\nuse(x);") == {("x", 2, 3)}
    assert flows("int i = 0;\nwhile (i < 3) {\ni++;\n}") == {("i", 1, 2), ("i", 3, 2), ("i", 1, 3), ("i", 3, 3)}


@pytest.fixture(scope="module")
def methods(spark):
    rows = [
        ("f", "sql", 'String id = request.getParameter("id");\nString q = "SELECT " + id;\nif (x) {\nq = clean(q);\n}\nstatement.execute(q);'),
        ("f", "safe", "String id = request.getParameter(n);\nid = escape(id);\nstatement.execute(id);"),
        ("f", "plain", "a();"),
        ("f", "none", None),
    ]
    return spark.createDataFrame(rows, "file string, name string, body string")


def test_taint_along_paths(methods):
    found = C.tainted(methods, r"getParameter", r"execute", r"escape|clean")
    assert [tuple(r) for r in found.collect()] == [("f", "sql", 1, 6)]


def test_metrics_and_graphs(methods):
    by = {r["name"]: r for r in C.flow_metrics(methods).collect()}
    assert (by["sql"]["complexity"], by["none"]["nodes"], by["none"]["edges"]) == (2, 2, 1)
    assert C.flow_edges(methods).count() == sum(r["edges"] for r in by.values())
    assert C.flow_nodes(methods).filter("not reachable").count() == 0
    assert ("q", 2, 6) in {(r["variable"], r["def_line"], r["use_line"]) for r in C.value_flows(methods).filter("name = 'sql'").collect()}
