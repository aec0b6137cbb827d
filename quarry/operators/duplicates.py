"""Token shingles, duplicate reports and line taint over source text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T


def shingle_rows(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, pos, key (64 bits of its words) for every run of `size` tokens."""
    return docs.select("doc_id", F.posexplode(T.shingle_keys(T.shingle_tokens(F.col("text")), size)).alias("pos", "key"))


def reported_duplicates(docs: DataFrame, size: int) -> DataFrame:
    """One report for each document that holds the first place of a repeated shingle: its first such place and how often that occurs.

    Shingles are counted, never collected: a very common one is a single row after the map side."""
    repeated = shingle_rows(docs, size).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "pos")).alias("at")).filter("n >= 2")
    first = repeated.groupBy("at.doc_id").agg(F.min(F.struct("at.pos", "n")).alias("r"))
    return first.select("doc_id", F.col("r.pos").cast("long").alias("pos"), F.col("r.n").alias("occurrences"))


def tainted_sinks(docs: DataFrame, source: str, sink: str, sanitizer: str) -> DataFrame:
    """Per document the first sink line that follows a source line with no sanitizer between the first source and it."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    marked = lines.select("doc_id", "pos", F.col("line").contains(source).alias("s"), F.col("line").contains(sink).alias("k"), F.col("line").contains(sanitizer).alias("z")).filter("s or k or z")
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    first = F.min(F.when(F.col("s"), F.col("pos"))).over(before)
    cleaned = F.max(F.when(F.col("z"), F.col("pos"))).over(before)
    found = marked.withColumns({"first": first, "cleaned": cleaned}).filter("k and first is not null and (cleaned is null or cleaned <= first)")
    return found.groupBy("doc_id").agg(F.min("pos").cast("long").alias("sink"))
