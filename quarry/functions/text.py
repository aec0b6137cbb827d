"""Scalar functions over source text, paths, names, vectors and ranks, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_lines(text: Column) -> Column:
    """Lines without the trailing empty ones."""
    return F.split(F.regexp_replace(text, r"\n+$", ""), "\n")


def line_count(text: Column) -> Column:
    return F.size(text_lines(text))


def line_count_where(text: Column, holds: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(text_lines(text), holds))


def code_lines(text: Column) -> Column:
    """Lines that are neither blank nor start as a comment."""
    return line_count_where(text, lambda x: (F.trim(x) != "") & ~F.trim(x).startswith("//") & ~F.trim(x).startswith("*") & ~F.trim(x).startswith("/*"))


def round_half_up(x: Column, digits: int = 0) -> Column:
    """floor(x + 0.5), as opposed to rounding half away from zero."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def estimated_tokens(text: Column) -> Column:
    """Half a token for a CJK character, a quarter for any other, each sum rounded down."""
    cjk = F.length(F.regexp_replace(text, "[^一-鿿]", ""))
    return F.floor(cjk / 2) + F.floor((F.length(text) - cjk) / 4)


def term_frequency(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences, without case."""
    return (F.length(text) - F.length(F.replace(F.lower(text), F.lower(term), F.lit("")))) / F.length(term)


def query_terms(text: Column) -> Column:
    """Terms joined by ' & ': lower case, other signs dropped."""
    clean = F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9_\s]", " "))
    return F.regexp_replace(clean, r"\s+", " & ")


# Words that the shingle tokenizer drops.
STOP_WORDS = ("the", "and", "for", "with", "that", "this", "from", "are", "was", "not", "you")


def shingle_tokens(text: Column) -> Column:
    words = F.split(F.lower(F.regexp_replace(text, r"[^A-Za-z0-9_]", " ")), " ")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS))


def shingle_keys(tokens: Column, n: int) -> Column:
    """A hash for each run of n tokens, from the hashes of its tokens; none for a shorter list. Each token is hashed once."""

    def runs(own: Column) -> Column:
        at = F.when(F.size(own) >= n, F.sequence(F.lit(1), F.size(own) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(F.slice(own, i, n)))

    hashes = F.transform(tokens, lambda t: F.xxhash64(t))
    return F.element_at(F.transform(F.array(hashes), runs), 1)  # the hashes are made once, not for every run


def without_comments(text: Column) -> Column:
    text = F.regexp_replace(text, r"(?s)/\*.*?\*/", "")
    text = F.regexp_replace(text, r"//[^\n]*", "")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def fingerprint(text: Column, digits: int = 16) -> Column:
    return F.left(F.sha2(without_comments(text), 256), F.lit(digits))


def hamming(a: Column, b: Column) -> Column:
    """Differing places of the common prefix; the largest integer for a null."""
    n = F.least(F.length(a), F.length(b))
    same = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + (F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1))).cast("int"))
    return F.when(a.isNull() | b.isNull(), F.lit(2147483647)).when(n == 0, F.lit(0)).otherwise(same)


def cosine(a: Column, b: Column) -> Column:
    """Over the common length, in double precision; 0 for a null or a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.coalesce((p * q).cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(a.isNull() | b.isNull() | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def reciprocal_rank(*ranks: Column, k: int = 60) -> Column:
    return sum((F.coalesce(1 / (k + r), F.lit(0.0)) for r in ranks[1:]), F.coalesce(1 / (k + ranks[0]), F.lit(0.0)))


def location_key(file: Column, line: Column, method: Column) -> Column:
    """file:line:method; a null method is left out."""
    return F.concat_ws(":", file, line.cast("string"), method)


def relative_path(path: Column) -> Column:
    """An absolute path from the source root on."""
    at = F.instr(path, "/src/main/java/")
    return F.when(path.startswith("/") & (at > 1), F.substr(path, at + 1)).otherwise(path)


def issue_key(rule: Column, cls: Column, method: Column, message: Column) -> Column:
    return F.concat_ws("|", rule, F.coalesce(cls, F.lit("")), F.coalesce(method, F.lit("")), F.left(message, F.lit(50)))


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "CRITICAL", 0).when(severity == "MAJOR", 1).when(severity == "MINOR", 2).otherwise(3)


def downgraded(severity: Column) -> Column:
    return F.when(severity == "CRITICAL", "MAJOR").when(severity == "MAJOR", "MINOR").otherwise("INFO")


def confidence_level(score: Column) -> Column:
    return F.when(score >= 0.9, "HIGH").when(score >= 0.7, "MEDIUM").when(score >= 0.5, "LOW").otherwise("FILTERED")


def camel(name: Column) -> Column:
    """snake_case to CamelCase."""
    return F.array_join(F.transform(F.split(F.lower(name), "_"), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))), "")


def simple_name(address: Column) -> Column:
    return F.substring_index(address, ".", -1)


def package_name(address: Column) -> Column:
    return F.left(address, F.greatest(F.length(address) - F.length(simple_name(address)) - 1, F.lit(0)))


def html_escaped(text: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def trend(new: Column, fixed: Column) -> Column:
    return F.when(new == fixed, "STABLE").when(new > fixed, "DEGRADING").otherwise("IMPROVING")


def vector_literal(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: F.round(x.cast("double"), 3).cast("string")), ","), F.lit("]"))
