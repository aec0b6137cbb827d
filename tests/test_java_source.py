import pytest

from quarry.operators import java_source as J
from quarry.operators import layers as L

SOURCE = '''package a.b;
import java.util.*;
import static x.Y.z;
import org.c.Helper;
/** First sentence. Second. */
@Service("x") @Deprecated
public abstract class Foo<T extends Bar<T>> extends Base<T> implements One, Two<Map<String, List<T>>> {
  static { int i = 0; }
  private final Map<String, List<Integer>> m = new HashMap<>() {{ put("a", List.of(1)); }}, other;
  int[] xs = {1, 2, 3};
  @Autowired private Helper helper;
  public Foo(@Qualifier("q") Helper h, final int... n) throws IOException, X { super(); this.helper = h; }
  @Override public <R> R go(Function<? super T, R> f, String s) {
     // if (x) comment
     if (s == null && f != null) throw new RuntimeException("if (a) { }");
     for (int i = 0; i < 3; i++) { helper.run(i, s); }
     for (String q : m.keySet()) { do { s = q; } while (s.length() > 2); }
     try { Helper.of(s).then(x -> x.y()); new Foo.Inner().call(); } catch (Exception e) { return null; }
     switch (s) { case "a": break; default: return f.apply(null); }
  }
  abstract int left(int a);
  class Inner { void call() { synchronized(this) { left(2); } } }
  enum E { A(1) { int q() { return 1; } }, B; E(int... k) {} }
  @interface Note { String value() default "x"; }
}
record P(int a, String b) { int sum() { return a; } }
'''


@pytest.fixture(scope="module")
def rows():
    return {r["address"]: r for r in J.read_file(SOURCE)}


def test_types_and_members(rows):
    assert [(a, r["kind"], r["parent"]) for a, r in rows.items()] == [("a.b.Foo", "CLASS", None), ("a.b.Foo$Inner", "CLASS", "a.b.Foo"), ("a.b.Foo$E", "ENUM", "a.b.Foo"), ("a.b.Foo$Note", "ANNOTATION", "a.b.Foo"), ("a.b.P", "RECORD", None)]
    foo = rows["a.b.Foo"]
    assert foo["extends"] == ["Base<T>"] and foo["implements"] == ["One", "Two<Map<String, List<T>>>"]
    assert [(f["name"], f["type"]) for f in foo["fields"]] == [("m", "Map<String, List<Integer>>"), ("other", "Map<String, List<Integer>>"), ("xs", "int[]"), ("helper", "Helper")]
    assert [m["name"] for m in foo["methods"]] == ["<init>", "go", "left"]
    assert foo["description"] == "First sentence." and foo["annotations"][0] == {"name": "Service", "value": '"x"'}
    assert foo["methods"][0]["throws"] == ["IOException", "X"] and foo["methods"][2]["body"] is None


def test_bodies(rows):
    go = rows["a.b.Foo"]["methods"][1]
    assert go["complexity"] == 4  # an if, a loop over elements and a catch; neither the counting loop nor the one with its test behind it
    assert {(c["scope"], c["name"], c["target"]) for c in go["calls"]} >= {("helper", "run", "org.c.Helper"), ("s", "length", "java.lang.String"), ("Helper", "of", "org.c.Helper"), ("Helper.of(s)", "then", None)}
    assert [s["text"] for s in go["statements"] if s["type"] == "CONDITION"] == ["s == null && f != null"]
    assert go["structure"].startswith("IF;THROW;FOR;VAR(int);CALL(run);FOREACH;VAR(String);CALL(keySet);DO;WHILE")


@pytest.mark.parametrize("text", [None, "", "}", "class", "class A { void f( {", "public class A { int x = ; String", '"', "@", "enum {", "/* open", "a.b.c.d(((("])
def test_broken_files_are_read_as_far_as_they_go(text):
    assert isinstance(J.read_file(text), list)


def test_signature_does_not_depend_on_order(spark):
    one = "package p; import b.B; import a.A; public final class C implements Y, X { int b; int a; void g() { f(1); } int f(int x) { return x; } }"
    two = "package p; import a.A; import b.B; final public class C implements X, Y { int a; int b; int f(int x) { return x; } void g() { f(2); } }"
    other = "package p; import a.A; import b.B; final public class C implements X, Y { int a; int b; int f(int x) { return x; } void g() { if (true) f(2); } }"
    files = spark.createDataFrame([("1", one), ("2", two), ("3", other), ("4", None)], "path string, content string")
    got = [r["hash"] for r in J.signature(J.classes(files).orderBy("path")).collect()]
    assert len(got) == 3 and len(set(got)) == 2


def test_navigation_and_issue_source(spark):
    known = spark.createDataFrame([("a.b.Foo", "Foo"), ("c.Foo", "Foo"), ("a.Bar", "Bar")], "address string, name string")
    wanted = spark.createDataFrame([("x", "c.Foo"), ("x", "Foo<T>"), ("x", "b.Foo"), ("x", "None"), (None, None)], "source string, type string")
    assert {r["type"]: r["address"] for r in L.navigated(wanted, known).collect()} == {"c.Foo": "c.Foo", "Foo<T>": "a.b.Foo", "b.Foo": "a.b.Foo", "None": None, None: None}


def test_parameter_flow_ends_in_a_cycle(spark):
    files = spark.createDataFrame([("a", "package p; class A { B b; void f(int x) { b.g(x); } }"), ("b", "package p; class B { A a; void g(int y) { a.f(y); } }")], "path string, content string")
    got = sorted((r["start"], r["target"], r["depth"]) for r in L.parameter_flow(J.classes(files)).collect())
    assert got == [("p.A#f", "p.A#f", 2), ("p.A#f", "p.B#g", 1), ("p.B#g", "p.A#f", 1), ("p.B#g", "p.B#g", 2)]
