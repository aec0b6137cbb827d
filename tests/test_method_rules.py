"""Each rule fires on its own snippet and none on clean code."""

import pytest
from pyspark.sql import Row

from quarry.operators.method_rules import METHOD_RULES, SUBJECT, method_issues, rx

CLEAN = 'log.info("order {} saved", id);\nreturn repository.save(order);'

POSITIVE = {
    "RSPEC-108": "try { a(); } catch (Exception e) { }",
    "RSPEC-4973": 'if (name == "x") { a(); }',
    "RSPEC-1764": "if (count == count) { a(); }",
    "RSPEC-1217": "worker.run();",
    "RSPEC-3067": "lock.wait();",
    "RSPEC-2384": ("return items;", {"return_type": "java.util.List"}),
    "RSPEC-1111": ("super.x();", {"name": "finalize"}),
    "RSPEC-2259": "String s = null; s.length();",
    "RSPEC-1854": "int total = 5;",
    "RSPEC-3047": "assert i++ > 0;",
    "RSPEC-135": "for (int i : xs) { if (i > 3) continue; }",
    "RSPEC-1874": "Integer i = new Integer (5); use(i);",
    "RSPEC-2677": "if (a[0].equals(b)) x();",
    "RSPEC-2111": "x(new BigDecimal(0.1));",
    "RSPEC-2225": ("return null;", {"name": "toString"}),
    "RSPEC-3078": "x(getClass().getClassLoader());",
    "RSPEC-1696": "try { a(); } catch (IOException e) { throw e; }",
    "RSPEC-4970": "try { a(); } catch (RuntimeException e) { b(e); }",
    "RSPEC-2095": "x(new FileInputStream(path));",
    "RSPEC-2142": "try { a(); } catch (InterruptedException e) { b(); }",
    "RSPEC-2184": "x((int) someLong);",
    "RSPEC-2276": "x((int) Integer.valueOf(3));",
    "RSPEC-1132": 'for (String s : xs) { r = r + "," + s; }',
    "RSPEC-1186": "{ }",
    "RSPEC-2166": "if (ready == true) { a(); }",
    "RSPEC-2253": "x(a.toLowerCase().equals(b));",
    "RSPEC-2254": ("return password;", {"name": "toString"}),
    "RSPEC-2675": ("return x;", {"return_type": "boolean", "name": "ready"}),
    "RSPEC-2676": ("x();", {"name": "a" * 41}),
    "RSPEC-2925": "Thread.sleep(5);",
    "RSPEC-3415": "x(4711);",
    "RSPEC-3553": ("x();", {"parameter_types": ["java.util.Optional"]}),
    "RSPEC-3658": "x(found.get());",
    "RSPEC-4248": "xs.stream().map(f);",
    "RSPEC-4423": "x(SSLServerSocket.class);",
    "RSPEC-4426": 'KeyPairGenerator g = of("RSA"); g.initialize(1024);',
    "RSPEC-4434": "DocumentBuilder b = f.make(); b.parse(x);",
    "RSPEC-4517": "while (x()) { y(new DecimalFormat(p)); }",
    "RSPEC-4719": "try { a(); } catch (Throwable t) { b(t); }",
    "RSPEC-4738": "if (o.isPresent()) x(o.get());",
    "RSPEC-5332": 'x("TLSv1.1");',
    "RSPEC-5411": "for (String s : xs) { Map<String, Long> m = n(); m.put(s, 1L); }",
    "RSPEC-5547": 'MessageDigest.getInstance("MD5");',
    "RSPEC-5659": "x(Jwts.builder().sign());",
    "RSPEC-5860": 'x("(?=a)");',
    "RSPEC-6202": 'x("(.*)*");',
    "RSPEC-6303": "int token = new Random(7).nextInt(); use(token);",
    "RSPEC-6347": "a.size(); if (a == null) return;",
    "RSPEC-6437": 'log.info("x" + y);',
    "RSPEC-6535": "digest(password);",
    "RSPEC-6544": "x(new Cookie(a, b));",
    "RSPEC-6546": "x(new Cookie(a, b));",
    "RSPEC-6549": 'h("X-Content-Type-Options", x);',
    "RSPEC-6557": "BigDecimal d = a(); d.doubleValue();",
    "RSPEC-6568": "f.setReadable(true);",
    "RSPEC-2068": 'String Password = "abc"; use(Password);',
    "RSPEC-2077": 'q("SELECT * FROM t WHERE id = " + id);',
    "RSPEC-1313": 'x("10.1.2.3");',
    "RSPEC-5145": 'x("http://example.org");',
    "RSPEC-2245": "x(Math.random());",
    "RSPEC-2186": "in.readObject();",
    "RSPEC-5131": "Runtime.getRuntime().exec(c);",
    "RSPEC-5167": 'x("HmacMD5");',
    "RSPEC-5247": "f.setAccessible(true);",
    "RSPEC-5324": 'x(new SecretKeySpec("k".getBytes(), a));',
    "RSPEC-5764": "HttpServletRequest r = q(); login(r);",
    "RSPEC-5883": "File.createTempFile(a, b);",
    "RSPEC-6280": 'x("ldap://h/" + name);',
    "RSPEC-6422": "x(new File(input));",
    "RSPEC-6432": "r.sendRedirect(q.getParameter(u));",
    "RSPEC-6477": "TransformerFactory t = x(); t.go();",
    "RSPEC-6478": "XPathFactory f = x(); f.of(q.getParameter(a));",
    "RSPEC-6509": 'h("Access-Control-Allow-Origin", "*");',
    "RSPEC-138": ("x();", {"line_count": 31}),
    "RSPEC-107": ("x();", {"parameter_types": ["int"] * 8}),
    "RSPEC-1142": "return a; return b; return c; return d; return e; return f;",
    "RSPEC-3776": "if (a) x(); " * 16,
    "RSPEC-1148": "e.printStackTrace();",
    "RSPEC-159": ("x();", {"description": None}),
    "RSPEC-106": "System.out.println(x);",
    "RSPEC-012": "x();;",
    "RSPEC-1481": "int left = 5;",
    "RSPEC-1192": 'x("abcd"); y("abcd"); z("abcd");',
    "RSPEC-1166": 'try { a(); } catch (IOException x) { throw new StateException("m"); }',
    "RSPEC-4502": "http.csrf().disable();",
    "RSPEC-4433": 'new InitialContext().lookup("jdbc/x");',
}


@pytest.fixture(scope="module")
def fired(spark):
    def subject(file, body, **other):
        base = {"file": file, "class_name": "C", "name": "work", "body": body, "modifiers": ["public"], "return_type": "void", "parameter_types": [], "line_start": 1, "line_count": 3, "description": "Works."}
        return Row(**(base | other))

    rows = [subject("clean", CLEAN), subject("empty", "")]
    for key, sample in POSITIVE.items():
        body, other = sample if isinstance(sample, tuple) else (sample, {})
        rows.append(subject(key, body, **other))
    out = {}
    for r in method_issues(spark.createDataFrame(rows, SUBJECT)).collect():
        out.setdefault(r["file"], set()).add(r["rule_key"])
    return out


def test_each_rule_has_a_sample():
    assert set(POSITIVE) == {r.key for r in METHOD_RULES} and len(POSITIVE) == len(METHOD_RULES)


@pytest.mark.parametrize("key", sorted(POSITIVE))
def test_fires(fired, key):
    assert key in fired.get(key, set())


def test_clean_code_has_no_issues(fired):
    assert "clean" not in fired and "empty" not in fired


def test_disabled_rules_do_not_fire(spark):
    rows = spark.createDataFrame([("f", "C", "m", "e.printStackTrace();", [], "void", [], 1, 1, "d")], SUBJECT)
    assert method_issues(rows, ("RSPEC-1148",)).collect() == []
    assert [r["rule_key"] for r in method_issues(rows).collect()] == ["RSPEC-1148"]


def test_plain_part_is_looked_for_first_and_loses_nothing(spark):
    bodies = spark.createDataFrame([("if (a != a) x();",), ("y = z | z;",), ("a && a",), ("b / b",), ("c",)], "body string")
    pattern = r"(\w+)\s*(?:==|!=|&&|/)\s*\1\b"
    got = bodies.select(rx(pattern).alias("plain"), rx(pattern, held=("==", "!=", "&&", "/")).alias("held")).collect()
    assert [r.plain for r in got] == [r.held for r in got] == [True, False, True, True, False]
