"""Catalogue of rules over methods of Java sources.

Subjects have name, body, modifiers, return_type, parameter_types, line_count and
description; every rule is a predicate over these columns, evaluated for all rules
in one pass by quarry.operators.rules.evaluate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.rules import Rule, evaluate, first_of_key

BODY = lambda: F.col("body")


def has(*tokens: str) -> Column:
    """Any of the tokens stands in the body."""
    out = F.lit(False)
    for token in tokens:
        out |= BODY().contains(token)
    return out


def lacks(*tokens: str) -> Column:
    return ~has(*tokens)


def rx(*patterns: str, held: tuple[str, ...] = ()) -> Column:
    """Any of the patterns is found in the body; one of `held` stands in all that they find and is looked for first, as that is cheap."""
    out = F.lit(False)
    for pattern in patterns:
        out |= BODY().rlike(pattern)
    return has(*held) & out if held else out


def modifier(name: str) -> Column:
    return F.array_contains("modifiers", name)


def captured(pattern: str, holds: Callable[[Column], Column]) -> Column:
    """Some name that the pattern's first group finds has the property."""
    return F.exists(F.array_distinct(F.regexp_extract_all("body", F.lit(pattern), F.lit(1))), holds)


def used_after(pattern: str, then: str, held: tuple[str, ...] = ()) -> Column:
    """Pattern finds a name in group 1 that `then`, in which {} stands for it, finds later in the body."""
    return rx(f"(?s){pattern}.*?{then.format(chr(92) + '1')}", held=held)


def count_of(pattern: str) -> Column:
    return F.regexp_count("body", F.lit(pattern))


LOOP = lambda: has("for (", "while (")
CONCAT = lambda: has('+ "', '" +')
DECLARED = r"(?:final\s+)?(?:\w+(?:<[^>]+>)?\s+)(\w+)\s*="


def _never_used_again() -> Column:
    """A declared name of two letters or more that does not occur after its declaration."""
    return rx(r"(?s)(?:final\s+)?(?:\w+(?:<[^>]+>)?\s+)\b(?!(?:null|this|true|false)\b)(\w{2,})\s*=(?!.*\b\1\b)", held=("=",))


# Keys, ratings, titles, tokens and patterns of the rules.
METHOD_RULES = (
    Rule("RSPEC-108", "MAJOR", "BUG", "Empty catch block should not be used", lambda: rx(r"catch\s*\([^)]*\)\s*\{(\s*//[^\n]*|\s*/\*[^*]*\*/\s*)*\}", r"catch\s*\([^)]*\)\s*\{\s*\}", held=("catch",))),
    Rule("RSPEC-4973", "CRITICAL", "BUG", "Strings should not be compared using ==", lambda: rx(r'"[^"]*"\s*[!=]=\s*\w+', r'\w+\s*[!=]=\s*"[^"]*"', held=("==", "!="))),
    Rule("RSPEC-1764", "MAJOR", "BUG", "Identical expressions on both sides of operator", lambda: rx(r"(\w+(?:\.\w+)*)\s*(?:==|!=|&&|\|\||\+|-|\*|/)\s*\1\b", held=("==", "!=", "&&", "||", "+", "-", "*", "/"))),
    Rule("RSPEC-1217", "MAJOR", "BUG", "Thread.run() should not be called directly", lambda: rx(r"\w+\.run\s*\(") & lacks(".start()")),
    Rule("RSPEC-3067", "CRITICAL", "BUG", "wait/notify must be in synchronized context", lambda: (has(".wait(", ".notify(", ".notifyAll(") | rx(r"\bwait\s*\(", held=("wait",))) & ~modifier("synchronized")),
    Rule(
        "RSPEC-2384",
        "MAJOR",
        "BUG",
        "Mutable members should not be returned directly",
        lambda: F.col("return_type").rlike(r"List|Map|Set|Collection|\[\]") & lacks("Collections.unmodifiable", ".clone()", "new ArrayList", "new HashMap", "toArray") & captured(r"return\s+(\w+)\s*;", lambda v: ~v.isin("null", "this")),
    ),
    Rule("RSPEC-1111", "MAJOR", "BUG", "finalize() should not be used", lambda: F.trim("name") == "finalize"),
    Rule(
        "RSPEC-2259",
        "CRITICAL",
        "BUG",
        "Null pointers should not be dereferenced",
        lambda: has("null") & captured(r"(\w+)\s*=\s*null\s*;", lambda v: F.rlike(BODY(), F.concat(F.lit(r"\b"), v, F.lit(r"\s*\.\w+\s*\("))) & ~F.rlike(BODY(), F.concat(F.lit(r"if\s*\(\s*"), v, F.lit(r"\s*!?=?\s*null\s*\)")))),
    ),
    Rule("RSPEC-1854", "MINOR", "BUG", "Dead stores should be removed", _never_used_again),
    Rule("RSPEC-3047", "MAJOR", "BUG", "Assertions should not contain side effects", lambda: has("assert ") & rx(r"assert\s+.*\b=\b", r"assert\s+.*\+\+|assert\s+.*--")),
    Rule("RSPEC-135", "MINOR", "BUG", "Loop should not branch to update statement", lambda: has("for (", "for(") & has("continue;")),
    Rule("RSPEC-1874", "MINOR", "BUG", "Deprecated code should not be used", lambda: rx(r"new Thread().stop\(", r"new Date\s*\([^)]\)", r"new Integer\s*\(", r"new Double\s*\(", r"new Float\s*\(", r"new Long\s*\(", r"new Boolean\s*\(", r"new Short\s*\(", r"new Byte\s*\(", held=("new ",))),
    Rule("RSPEC-2677", "MAJOR", "BUG", "Arrays should not be compared using equals", lambda: has("].equals(") | (has("==") & has("new") & has("["))),
    Rule("RSPEC-2111", "MAJOR", "BUG", "BigDecimal(double) should not be used", lambda: rx(r"new\s+BigDecimal\s*\(\s*\d+\.\d+", held=("BigDecimal",))),
    Rule("RSPEC-2225", "MAJOR", "BUG", "toString() should not return null", lambda: (F.col("name") == "toString") & rx(r"return\s+null\s*;")),
    Rule("RSPEC-3078", "MINOR", "BUG", "Use Thread.currentThread().getContextClassLoader()", lambda: has(".getClassLoader()") & lacks("Thread.currentThread().getContextClassLoader()")),
    Rule("RSPEC-1696", "MINOR", "BUG", "Exception caught and rethrown without handling", lambda: rx(r"catch\s*\([^)]*\)\s*\{\s*throw\s+\w+\s*;\s*\}", held=("catch",))),
    Rule("RSPEC-4970", "MAJOR", "BUG", "Unchecked exceptions should not be caught", lambda: rx(r"catch\s*\(\s*(?:RuntimeException|NullPointerException|IndexOutOfBoundsException|IllegalArgumentException)\s+", held=("catch",))),
    Rule("RSPEC-2095", "CRITICAL", "BUG", "Resources should be closed", lambda: has("new FileInputStream(", "new FileOutputStream(", "new BufferedReader(", "new Socket(") & lacks("try (", "finally", ".close()")),
    Rule("RSPEC-2142", "MAJOR", "BUG", "InterruptedException should not be ignored", lambda: has("InterruptedException") & lacks("Thread.currentThread().interrupt()", "throw", "log.", "LOG.")),
    Rule("RSPEC-2184", "MAJOR", "BUG", "Long should not be cast to int", lambda: rx(r"\(\s*int\s*\)\s*\w*[Ll]ong", held=("int",))),
    Rule("RSPEC-2276", "MINOR", "CODE_SMELL", "Primitive wrappers should not be cast to primitives", lambda: rx(r"\(\s*int\s*\)\s*Integer|\(\s*long\s*\)\s*Long|\(\s*double\s*\)\s*Double")),
    Rule("RSPEC-1132", "MAJOR", "CODE_SMELL", "String concatenation in loops should be avoided", lambda: LOOP() & CONCAT() & lacks("StringBuilder", "StringBuffer")),
    Rule("RSPEC-1186", "MINOR", "CODE_SMELL", "Empty method bodies should be removed or documented", lambda: BODY().rlike(r"^\s*\{?\s*\}?\s*$") & modifier("public") & ~modifier("abstract") & ~modifier("native")),
    Rule("RSPEC-2166", "MINOR", "CODE_SMELL", "Boolean literals should not be redundant", lambda: rx(r"if\s*\(\s*\w+\s*==\s*(true|false)\s*\)", held=("==",))),
    Rule("RSPEC-2253", "MINOR", "CODE_SMELL", "Use equalsIgnoreCase for case-insensitive comparison", lambda: has(".toLowerCase().equals(", ".toUpperCase().equals(")),
    Rule("RSPEC-2254", "MAJOR", "CODE_SMELL", "toString() should not return sensitive information", lambda: (F.col("name") == "toString") & has("password", "secret", "token", "key")),
    Rule(
        "RSPEC-2675",
        "MINOR",
        "CODE_SMELL",
        "Boolean methods should be named is/has/can/should",
        lambda: (F.col("return_type") == "boolean") & ~F.col("name").isin("equals", "hashCode", "canEqual") & ~F.col("name").rlike(r"^(is|has|can|should|was|will|are|contains|matches|exists|isValid|isEmpty|isEnabled|isPresent|supports|allows)"),
    ),
    Rule("RSPEC-2676", "MINOR", "CODE_SMELL", "Method names should not be too long", lambda: F.length("name") > 40),
    Rule("RSPEC-2925", "MINOR", "CODE_SMELL", "Thread.sleep should not be used in production code", lambda: has("Thread.sleep(") & ~F.lower("name").contains("test")),
    Rule("RSPEC-3415", "MINOR", "CODE_SMELL", "Magic numbers should not be used", lambda: captured(r"[^a-zA-Z_](\d{3,})[^a-zA-Z_]", lambda v: ~v.isin("100", "200", "404", "500"))),
    Rule("RSPEC-3553", "MINOR", "CODE_SMELL", "Optional should not be used in method parameters", lambda: F.exists("parameter_types", lambda p: p.contains("Optional"))),
    Rule("RSPEC-3658", "MAJOR", "CODE_SMELL", "Optional.get() should not be called without isPresent check", lambda: has(".get()") & lacks(".isPresent()", ".orElse", ".orElseGet", ".ifPresent")),
    Rule("RSPEC-4248", "MAJOR", "BUG", "Stream should be consumed or collected", lambda: has(".stream()", ".parallelStream()") & lacks(".collect(", ".forEach(", ".count(", ".findFirst(", ".anyMatch(")),
    Rule("RSPEC-4423", "MAJOR", "SECURITY", "SSL Server socket should use strong protocols", lambda: has("SSLServerSocket", 'SSLContext.getInstance("SSL")', '"TLSv1"', '"SSLv3"')),
    Rule("RSPEC-4426", "CRITICAL", "SECURITY", "RSA keys should be at least 2048 bits", lambda: has("KeyPairGenerator") & has("1024", "512")),
    Rule("RSPEC-4434", "MAJOR", "SECURITY", "XML parsers should not be vulnerable to XXE", lambda: has("DocumentBuilder") & lacks("setFeature", "http://javax.xml.XMLConstants")),
    Rule("RSPEC-4517", "MAJOR", "CODE_SMELL", "Allocation of expensive objects in loops should be avoided", lambda: LOOP() & has("new SimpleDateFormat(", "new Pattern[", "new BigDecimal(", "new DecimalFormat(")),
    Rule("RSPEC-4719", "MAJOR", "CODE_SMELL", "Error should not be caught", lambda: has("catch (Error ", "catch (Throwable ")),
    Rule("RSPEC-4738", "MINOR", "CODE_SMELL", "Use Optional chaining instead of isPresent + get", lambda: has(".isPresent()") & has(".get()")),
    Rule("RSPEC-5332", "MAJOR", "SECURITY", "TLS should use secure protocol versions", lambda: has('TLSv1"', 'TLSv1.1"', 'SSLv3"')),
    Rule("RSPEC-5411", "MINOR", "CODE_SMELL", "Autoboxing/unboxing in loops is expensive", lambda: LOOP() & has("Map<") & has("Long", "Integer")),
    Rule("RSPEC-5547", "MAJOR", "SECURITY", "MD5 and SHA1 should not be used for security", lambda: has('MessageDigest.getInstance("MD5")', 'MessageDigest.getInstance("SHA-1")', 'MessageDigest.getInstance("SHA1")')),
    Rule("RSPEC-5659", "MAJOR", "SECURITY", "JWT should have an expiration time", lambda: has("Jwts.builder()") & lacks("setExpiration", "exp")),
    Rule("RSPEC-5860", "MINOR", "CODE_SMELL", "Regex lookaround should not be used", lambda: has("(?=", "(?!", "(?<=", "(?<!")),
    Rule("RSPEC-6202", "MAJOR", "CODE_SMELL", "Regex with catastrophic backtracking should not be used", lambda: has("(.*)*", "(.*).*")),
    Rule("RSPEC-6303", "CRITICAL", "BUG", "java.util.Random should not be used for security", lambda: has("new Random(", "Random().nextInt") & has("password", "token", "secret", "key", "session")),
    Rule("RSPEC-6347", "MAJOR", "BUG", "Null check should be done before dereferencing", lambda: used_after(r"\b(\w+)\.\w+\s*\(", r"if\s*\(\s*{}\s*==\s*null\s*\)", held=("null",))),
    Rule("RSPEC-6437", "MINOR", "CODE_SMELL", "Log injection should be prevented", lambda: has("log.info(", "log.warn(", "log.error(") & has("+ ") & lacks("replace", "escape")),
    Rule("RSPEC-6535", "MAJOR", "SECURITY", "Hashing without salt is insecure", lambda: has("MessageDigest", "digest(") & has("password", "Password") & lacks("salt")),
    Rule("RSPEC-6544", "MAJOR", "SECURITY", "Cookies should have Secure flag", lambda: has("new Cookie(") & lacks("setSecure(true)", "secure")),
    Rule("RSPEC-6546", "MINOR", "SECURITY", "Cookies should have HttpOnly flag", lambda: has("new Cookie(") & lacks("setHttpOnly(true)")),
    Rule("RSPEC-6549", "MAJOR", "SECURITY", "Content-Type sniffing should be prevented", lambda: has("X-Content-Type-Options") & lacks("nosniff")),
    Rule("RSPEC-6557", "MAJOR", "BUG", "BigDecimal operations should not lose precision", lambda: has("BigDecimal") & has("divide(", ".doubleValue()", ".floatValue()")),
    Rule("RSPEC-6568", "MAJOR", "SECURITY", "File permissions should not be overly permissive", lambda: has("setReadable(true, false)", "setWritable(true, false)", "setReadable(true)", "setWritable(true)")),
    Rule("RSPEC-2068", "CRITICAL", "SECURITY", "Hard-coded credentials are security-sensitive", lambda: rx(r'(?i)(password|passwd|secret|apiKey|token|privateKey|accessKey|secretKey|pwd)\s*=\s*"[^"]+"', held=('"',))),
    Rule("RSPEC-2077", "CRITICAL", "SECURITY", "SQL queries should not be constructed dynamically", lambda: has("SELECT", "INSERT", "UPDATE", "DELETE") & has('+ "', '" +', "String.format", "MessageFormat.format")),
    Rule("RSPEC-1313", "MINOR", "SECURITY", "Hard-coded IP addresses should not be used", lambda: rx(r"\b(?:\d{1,3}\.){3}\d{1,3}\b") & lacks("127.0.0.1", "0.0.0.0")),
    Rule("RSPEC-5145", "MINOR", "SECURITY", "HTTP requests should use HTTPS", lambda: has("http://") & lacks("https://", "localhost", "127.0.0.1")),
    Rule("RSPEC-2245", "MAJOR", "SECURITY", "java.util.Random should not be used cryptographically", lambda: has("new Random()", "Math.random()")),
    Rule("RSPEC-2186", "CRITICAL", "SECURITY", "ObjectInputStream should not be used to deserialize untrusted data", lambda: has("ObjectInputStream", "readObject()")),
    Rule("RSPEC-5131", "CRITICAL", "SECURITY", "Runtime.exec should not be used with user input", lambda: has("Runtime.getRuntime().exec(", "ProcessBuilder(")),
    Rule("RSPEC-5167", "MAJOR", "SECURITY", "MAC should use strong algorithms", lambda: has("HmacMD5", "HmacSHA1")),
    Rule("RSPEC-5247", "MAJOR", "SECURITY", "Reflection should not be used to increase accessibility", lambda: has("setAccessible(true)")),
    Rule("RSPEC-5324", "CRITICAL", "SECURITY", "Secret keys should not be hard-coded", lambda: has("SecretKeySpec", "KeyGenerator") & has('"')),
    Rule("RSPEC-5764", "MAJOR", "SECURITY", "Session ID should be changed after login", lambda: has("HttpServletRequest") & has("login", "authenticate", "Login") & lacks("changeSessionId", "invalidate()")),
    Rule("RSPEC-5883", "MINOR", "SECURITY", "Temporary files should not be created insecurely", lambda: has("createTempFile(") & lacks("deleteOnExit")),
    Rule("RSPEC-6280", "CRITICAL", "SECURITY", "LDAP queries should not be constructed dynamically", lambda: has("ldap://") & has('+ "', '" +', "String.format")),
    Rule("RSPEC-6422", "MAJOR", "SECURITY", "Path traversal should be prevented", lambda: has("new File(", "Paths.get(") & lacks("getCanonicalPath()", "normalize()") & has("request.getParameter", "input")),
    Rule("RSPEC-6432", "MAJOR", "SECURITY", "Open redirect should be prevented", lambda: has("sendRedirect(") & has("getParameter", '+ "') & lacks("allowed", "whitelist")),
    Rule("RSPEC-6477", "MAJOR", "SECURITY", "TransformerFactory should be secured against XXE", lambda: has("TransformerFactory") & lacks("ACCESS_EXTERNAL_DTD", "setFeature")),
    Rule("RSPEC-6478", "MAJOR", "SECURITY", "XPath queries should not be constructed dynamically", lambda: has("XPathFactory", "compile(") & has('+ "', "getParameter") & lacks("sanitize")),
    Rule("RSPEC-6509", "MAJOR", "SECURITY", "CORS should not allow all origins", lambda: has("Access-Control-Allow-Origin") & has("*")),
    Rule("RSPEC-138", "MAJOR", "CODE_SMELL", "Methods should not be too long", lambda: F.col("line_count") > 30),
    Rule("RSPEC-107", "MAJOR", "CODE_SMELL", "Methods should not have too many parameters", lambda: F.size("parameter_types") > 7),
    Rule("RSPEC-1142", "MINOR", "CODE_SMELL", "Jump statements should not occur too frequently", lambda: count_of(r"\breturn\b") > 5),
    Rule("RSPEC-3776", "MAJOR", "CODE_SMELL", "Cognitive Complexity should not be too high", lambda: 1 + sum((count_of(rf"\b{w}\b") for w in ("if", "else if", "for", "while", "case", "&&", r"\|\|", "catch", "switch")), F.lit(0)) > 15),
    Rule("RSPEC-1148", "MINOR", "CODE_SMELL", "Throwable.printStackTrace() should not be called", lambda: has(".printStackTrace()")),
    Rule("RSPEC-159", "MINOR", "CODE_SMELL", "Methods should have documentation comments", lambda: (F.coalesce("description", F.lit("")) == "") & modifier("public") & (F.col("name") != "<init>")),
    Rule("RSPEC-106", "MINOR", "CODE_SMELL", "System.out.println should not be used for logging", lambda: has("System.out.print", "System.err.print")),
    Rule("RSPEC-012", "MINOR", "CODE_SMELL", "Empty statements should be removed", lambda: rx(r";\s*;")),
    Rule("RSPEC-1481", "MINOR", "CODE_SMELL", "Unused local variables should be removed", _never_used_again),
    Rule("RSPEC-1192", "MINOR", "CODE_SMELL", "String literals should not be duplicated", lambda: rx(r'(?s)"([^"]{4,})".*"\1".*"\1"', held=('"',))),
    Rule("RSPEC-1166", "MAJOR", "CODE_SMELL", "Exception handlers should preserve the original exception", lambda: rx(r"catch\s*\([^)]*\)\s*\{\s*throw\s+new\s+\w+Exception\s*\([^)]*\)\s*;\s*\}", held=("catch",)) & lacks("e)", "cause", "initCause")),
    Rule("RSPEC-4502", "CRITICAL", "SECURITY", "CSRF should not be disabled", lambda: has("csrf().disable()", "CsrfConfigurer")),
    Rule("RSPEC-4433", "MINOR", "CODE_SMELL", "JDBC connections should not be retrieved from JNDI", lambda: has("InitialContext") & has("lookup(") & has("jdbc")),
)

SUBJECT = "file string, class_name string, name string, body string, modifiers array<string>, return_type string, parameter_types array<string>, line_start int, line_count int, description string"


def method_issues(methods: DataFrame, disabled: tuple[str, ...] = ()) -> DataFrame:
    """Issues of all methods; of those that agree in rule, file, line and method the first rule of the catalogue stays. A method without a body has no issues."""
    rules = [r for r in METHOD_RULES if r.key not in disabled]
    found = evaluate(methods.filter(F.length("body") > 0), rules)
    columns = ["rule_key", "severity", "category", "message", "file", "class_name", F.col("name").alias("method"), F.col("line_start").alias("line"), "seq"]
    return first_of_key(found.select(*columns), ["rule_key", "file", "line", "method"], ["seq"]).drop("seq")
