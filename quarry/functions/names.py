"""Classification by ordered conditions, names and digests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_of(*cases: tuple[str, Column], other: str) -> Column:
    """The name of the first case that holds."""
    name, holds = cases[0]
    out = F.when(holds, name)
    for name, holds in cases[1:]:
        out = out.when(holds, name)
    return out.otherwise(other)


def tags(*cases: tuple[str, Column]) -> Column:
    """The names of all cases that hold, in order."""
    return F.array_compact(F.array(*(F.when(holds, name) for name, holds in cases)))


def camel_words(name: Column) -> Column:
    """Words and numbers of a CamelCase name, in lower case."""
    return F.transform(F.regexp_extract_all(name, F.lit("[A-Z][a-z]+|[0-9]+"), F.lit(0)), F.lower)


# Tags by what a method's name holds. In each group the first that holds counts.
METHOD_TAGS = (
    (("Query", "get|find|select|query|list|search|fetch"), ("Create", "add|create|insert|save|register"), ("Update", "update|modify|edit|change|set"), ("Delete", "delete|remove|drop|clear")),
    (("Locking", "sync|lock|unlock|mutex"), ("Async", "async|future|callback|executor"), ("Atomic", "atomic|cas")),
    (("Lifecycle", "init|start|stop|destroy|close|open"), ("Config", "config|property|setting"), ("Utility", "util|helper|convert|parse|format")),
    (("Validation", "validate|check|verify|assert"), ("ErrorHandling", "error|catch|rollback|retry")),
)


def method_tags(name: Column) -> Column:
    """What a method does by its name, at most one tag of each group."""
    lower = F.lower(name)
    return F.array_compact(F.array(*(F.nullif(first_of(*((tag, lower.rlike(words)) for tag, words in group), other=""), F.lit("")) for group in METHOD_TAGS)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is made once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def digest_bytes(text: Column) -> Column:
    """The 16 bytes of the MD5 digest, unsigned."""
    return let(F.md5(text), lambda hexed: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.conv(F.substr(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("double")))


def hash_embedding(text: Column, size: int = 768) -> Column:
    """A vector of unit length that depends on the text alone: the digest's bytes, taken as signed, over 128 less one, repeated."""
    raw = F.transform(digest_bytes(text), lambda b: F.when(b > 127, b - 256).otherwise(b) / 128 - 1)
    places = F.sequence(F.lit(0), F.lit(size - 1))
    at = lambda own, i: F.element_at(own, (i % 16 + 1).cast("int"))
    norm = lambda own: F.sqrt(F.aggregate(places, F.lit(0.0), lambda s, i: s + at(own, i) * at(own, i)))
    return let(raw, lambda own: let(norm(own), lambda length: F.transform(places, lambda i: (at(own, i) / length).cast("float"))))


# Content types by suffix.
CONTENT_TYPES = {"html": "text/html", "json": "application/json", "css": "text/css", "js": "application/javascript", "md": "text/markdown", "png": "image/png", "svg": "image/svg+xml"}


def content_type(path: Column) -> Column:
    return first_of(*((kind, F.lower(path).endswith("." + suffix)) for suffix, kind in CONTENT_TYPES.items()), other="application/octet-stream")
