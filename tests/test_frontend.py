from quarry.operators import frontend as E
from quarry.operators import review as V


def test_flows_into_the_page(spark):
    one = "const a = event.target.value;\nlet b = 1;\nel.innerHTML = a;"
    clean = "const a = event.target.value;\nel.innerHTML = escapeHtml(a);"
    unsure = "use(props.name);\nel.innerHTML = 'x';"
    rows = spark.createDataFrame([("1", one), ("2", clean), ("3", unsure), ("4", None), ("5", "")], "path string, content string")
    assert [(r["path"], r["source_line"], r["sink_line"], r["variable"]) for r in E.xss_flows(rows).collect()] == [("1", 1, 3, "a")]


def test_imports_by_suffix_and_folder(spark):
    files = spark.createDataFrame([("/w/a.tsx", "import x from './b'; import y from 'c'; import z from 'none'"), ("/w/b.js", ""), ("/w/c/index.ts", None)], "path string, content string")
    got = {r["name"]: r["target"] for r in E.resolved(E.imports(files), files).collect()}
    assert got == {"b": "/w/b.js", "c": "/w/c/index.ts"}


def test_answers(spark):
    rows = spark.createDataFrame([(1, 'x {"issues": [{"ruleKey": "A"}, {"severity": "MAJOR"}]} y'), (2, '[{"ruleKey": "B", "line": 4}]'), (3, "{broken"), (4, None), (5, '{"message": "m"}')], "k int, answer string")
    got = [(r["k"], r["rule_key"], r["severity"], r["line"]) for r in V.answered(rows, "answer").orderBy("k", "rule_key").collect()]
    assert got == [(1, "A", "MINOR", 0), (1, "AI_REVIEW", "MAJOR", 0), (2, "B", "MINOR", 4), (5, "AI_REVIEW", "MINOR", 0)]
