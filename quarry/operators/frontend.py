"""Front-end sources: flows of user input into the page, complexity, imports and a pack of rules.

Files are rows of path and content; a null content has no lines, flows or issues.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.rules import Rule, evaluate

# What brings user input, and how sure that is.
SOURCES = (
    (r"window\.location\.search", "URL parameter", 0.9),
    (r"window\.location\.hash", "URL hash", 0.9),
    (r"URLSearchParams", "URL parameter", 0.85),
    (r"new URL\(", "URL parameter", 0.85),
    (r"event\.target\.value", "DOM event value", 0.8),
    (r"event\.target\.textContent", "DOM event textContent", 0.7),
    (r"document\.cookie", "document.cookie", 0.8),
    (r"fetch\(", "fetch response", 0.7),
    (r"axios\.", "axios response", 0.7),
    (r"\.json\(\)", "JSON response", 0.6),
    (r"\.text\(\)", "text response", 0.6),
    (r"localStorage\.getItem", "localStorage", 0.75),
    (r"sessionStorage\.getItem", "sessionStorage", 0.75),
    (r"postMessage", "postMessage", 0.8),
    (r"message\.data", "message data", 0.85),
    (r"querySelector.*\.value", "input value", 0.7),
    (r"getElementById.*\.value", "input value", 0.7),
    (r"getElementsByName", "form data", 0.7),
    (r"props\.\w+", "React prop", 0.5),
    (r"state\.\w+", "React state", 0.5),
)
# What writes into the page, and how bad that is.
SINKS = (
    (r"\.innerHTML\s*=", "innerHTML assignment", "CRITICAL"),
    (r"\.outerHTML\s*=", "outerHTML assignment", "CRITICAL"),
    (r"document\.write\(", "document.write()", "CRITICAL"),
    (r"document\.writeln\(", "document.writeln()", "CRITICAL"),
    (r"dangerouslySetInnerHTML", "dangerouslySetInnerHTML", "CRITICAL"),
    (r"insertAdjacentHTML\(", "insertAdjacentHTML()", "MAJOR"),
    (r"\.replaceWith\(", "replaceWith() with HTML", "MAJOR"),
    (r"DOMPurify\.sanitize", "DOMPurify.sanitize", "INFO"),
    (r"eval\(", "eval()", "CRITICAL"),
    (r"new Function\(", "new Function()", "CRITICAL"),
    (r"setTimeout\(.*string", "setTimeout with string", "MAJOR"),
    (r"setInterval\(.*string", "setInterval with string", "MAJOR"),
)
# What makes input harmless.
SANITIZERS = ("DOMPurify.sanitize", "sanitizeHtml", "escapeHtml", "he.encode", "escape", "encodeURIComponent", "String.raw", "xss", "sanitize")


def _frame(before: int, after: int) -> Column:
    """The lines round pos, from `before` above it to the one `after` below, as a text."""
    low = F.greatest(F.col("pos") - before, F.lit(0))
    return F.array_join(F.slice("lines", low + 1, F.least(F.col("pos") + after, F.size("lines")) - low), "\n")


def _holds_any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out |= text.contains(w)
    return out


def xss_flows(files: DataFrame) -> DataFrame:
    """path, sink_line, sink, severity, source_line, source, variable: for each sink that nothing near it makes harmless the first source above it that is related to it."""
    lines = files.filter("content is not null").select("path", F.split("content", "\n").alias("lines"))
    each = lines.select("path", "lines", F.posexplode("lines").alias("pos", "line"))

    def marked(table: tuple[tuple, ...], names: tuple[str, str]) -> DataFrame:
        found = F.array_compact(F.array(*(F.when(F.col("line").rlike(p), F.struct(F.lit(i).alias("seq"), F.lit(a).alias(names[0]), F.lit(b).alias(names[1]))) for i, (p, a, b) in enumerate(table))))
        return each.withColumn("m", F.explode(found)).select("path", "lines", "pos", "line", "m.*")

    near = _frame(10, 10)
    sinks = marked(SINKS, ("sink", "severity")).filter(~_holds_any(F.col("line"), SANITIZERS) & ~_holds_any(near, SANITIZERS))
    sinks = sinks.select("path", "pos", F.col("seq").alias("sink_seq"), "sink", "severity", _frame(9, 3).alias("context"))
    named = F.coalesce(F.nullif(F.regexp_extract("line", r"(?:const|let|var)\s+(\w+)\s*=", 1), F.lit("")), F.nullif(F.regexp_extract("line", r"(\w+)\s*=\s*\w+\.\w+", 1), F.lit("")), F.lit("unknown"))
    sources = marked(SOURCES, ("source", "confidence")).select("path", F.col("pos").alias("at"), "seq", "source", "confidence", named.alias("variable"))
    met = sinks.join(sources, "path").filter("at < pos")  # a file's sources and sinks, both few
    context, source = F.col("context"), F.col("source")
    held = (F.col("variable") != "unknown") & context.contains(F.col("variable"))
    url = (source.contains("URL") & context.contains("url")) | context.contains("URL")
    answer = (source.contains("fetch") | source.contains("axios")) & context.rlike(r"\b(data|response|result|res|json)\b")
    own = source.contains("prop") | source.contains("state")
    related = held | url | answer | F.when(own, context.contains(F.col("variable")) | context.contains(source)).otherwise(F.col("confidence") >= 0.7)
    first = met.filter(related).groupBy("path", "pos", "sink_seq", "sink", "severity").agg(F.min(F.struct("at", "seq", "source", "variable")).alias("s"))
    return first.select("path", (F.col("pos") + 1).alias("sink_line"), "sink", "severity", (F.col("s.at") + 1).alias("source_line"), F.col("s.source").alias("source"), F.col("s.variable").alias("variable"))


# Places where control flow parts.
DECISIONS = (r"\bif\s*\(", r"\belse\s+if\s*\(", r"\bfor\s*\(", r"\bwhile\s*\(", r"\bcase\s+", r"\bcatch\s*\(", "&&", r"\|\|", r"\?\.")


def complexity(text: Column) -> Column:
    """One more than the places where control flow parts; an `else if` counts as an `if` as well."""
    return 1 + sum((F.regexp_count(text, F.lit(p)) for p in DECISIONS), F.lit(0))


# Suffixes of files that an import may mean, in the order in which they are tried.
SUFFIXES = (".tsx", ".jsx", ".vue", ".svelte", ".ts", ".js")


def imports(files: DataFrame) -> DataFrame:
    """path, name: what a file imports, in order, without ./ before it."""
    return files.select("path", F.posexplode(F.regexp_extract_all("content", F.lit(r"""from\s+['"]([^'"]+)['"]"""), F.lit(1))).alias("seq", "name")).select("path", "seq", F.regexp_replace("name", r"^\./", "").alias("name"))


def resolved(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """wanted: path, seq, name. target: the first file by path that ends with the name and a suffix, with or without /index."""
    bare = F.regexp_replace("name", "/index$", "")
    candidates = F.array_distinct(F.flatten(F.array(*(F.array(F.concat("name", F.lit(s)), F.concat("name", F.lit("/index" + s)), F.concat(bare, F.lit(s))) for s in SUFFIXES))))
    ends = files.select(F.col("path").alias("target"), F.explode(F.transform(F.sequence(F.lit(1), F.length("path")), lambda i: F.substr(F.col("path"), i))).alias("end"))
    met = wanted.withColumn("end", F.explode(candidates)).join(ends, "end")
    return met.groupBy("path", "seq", "name").agg(F.min("target").alias("target"))


# Keys, ratings and patterns of rules that one pattern decides.
RULES = (
    Rule("FE-A11Y-003", "MINOR", "ACCESSIBILITY", "autofocus should not be used", lambda: F.col("content").rlike("autofocus")),
    Rule("FE-A11Y-008", "MINOR", "ACCESSIBILITY", "Avoid positive tabindex values", lambda: F.col("content").rlike(r"""tabindex\s*=\s*["'][1-9]\d*["']""")),
    Rule("FE-ARCH-009", "MAJOR", "ARCHITECTURE", "Hardcoded API endpoint detected", lambda: F.col("content").rlike(r"""['"]https?:\/\/[^'"]*(api|v\d+|graphql|rest)[^'"]*['"]""")),
    Rule("FE-ARCH-011", "INFO", "ARCHITECTURE", "Hardcoded color value detected", lambda: F.col("content").rlike(r"#[0-9a-fA-F]{6}\b|#[0-9a-fA-F]{3}\b")),
    Rule("FE-BUNDLE-003", "MAJOR", "BUNDLE_OPTIMIZATION", "Large library fully imported instead of modular", lambda: F.col("content").rlike(r"""from\s+['"]lodash['"]""")),
    Rule("FE-BUNDLE-004", "MINOR", "BUNDLE_OPTIMIZATION", "Import prevents tree shaking", lambda: F.col("content").rlike(r"""import\s+\*\s+as\s+\w+\s+from\s+['"]""")),
)


def issues(files: DataFrame, left_out: tuple[str, ...] = ()) -> DataFrame:
    """path, rule_key, severity, category, message of all rules over all files in one pass."""
    return evaluate(files.filter("content is not null").select("path", "content"), [r for r in RULES if r.key not in left_out]).drop("content", "seq")


def metrics(files: DataFrame) -> DataFrame:
    """path, lines, complexity, functions, anys (uses of the type any) of every file."""
    text = F.coalesce("content", F.lit(""))
    return files.select("path", F.size(F.split(text, "\n")).alias("lines"), complexity(text).alias("complexity"), F.regexp_count(text, F.lit(r"\bfunction\b|=>")).alias("functions"), F.regexp_count(text, F.lit(r":\s*any\b")).alias("anys"))
