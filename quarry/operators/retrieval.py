"""Retrieval: text rank over an inverted index, vector rank, and their fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.graph import cut


def inverted_index(docs: DataFrame) -> DataFrame:
    """doc_id, term, tf."""
    terms = F.split(F.trim(F.regexp_replace(F.lower("text"), r"[^a-z0-9_]+", " ")), " ")
    return docs.select("doc_id", F.explode(terms).alias("term")).filter("term != ''").groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def ranked(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """All rows with their places from 1 in the whole order, sorted in ranges: no task sees all rows, the driver a count for each range."""
    rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()))
    part, before = F.shiftright(name, 33), 0  # a row's range is in the upper bits of its id, its place there in the lower
    offsets = []
    for p, size in sorted(tuple(r) for r in rows.groupBy(part.alias("part")).count().collect()):
        offsets.append((p, before))
        before += size
    shifts = df.sparkSession.createDataFrame(offsets, "part long, before long")
    return rows.join(F.broadcast(shifts), part == F.col("part")).withColumn(name, F.col(name).bitwiseAND((1 << 33) - 1) + F.col("before") + 1).drop("part", "before")  # a row for each range


def text_search(docs: DataFrame, query: str, k: int) -> DataFrame:
    """doc_id, score, rank: documents with all terms, by the sum of their frequencies."""
    terms = sorted(set(query.lower().split()))
    hits = inverted_index(docs).filter(F.col("term").isin(terms)).groupBy("doc_id").agg(F.sum("tf").alias("score"), F.count(F.lit(1)).alias("found"))
    best = hits.filter(F.col("found") == len(terms)).orderBy(F.desc("score"), "doc_id").limit(k)
    return best.select("doc_id", "score", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).cast("long").alias("rank"))


def vector_search(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """vec_id, score, rank by cosine."""
    wanted = F.array(*map(F.lit, query)).cast("array<float>")
    scored = vectors.select("vec_id", T.cosine(F.col("embedding"), wanted).alias("score"))
    best = scored.orderBy(F.desc("score"), "vec_id").limit(k)
    return best.select("vec_id", "score", F.row_number().over(Window.orderBy(F.desc("score"), "vec_id")).cast("long").alias("rank"))


def fused(one: DataFrame, two: DataFrame, k: int) -> DataFrame:
    """key, score: reciprocal ranks added, a missing rank counting nothing. Both sides hold at most a few k rows."""
    both = one.select("key", F.col("rank").alias("a")).join(two.select("key", F.col("rank").alias("b")), "key", "full")
    return both.select("key", T.reciprocal_rank(F.col("a"), F.col("b")).alias("score")).orderBy(F.desc("score"), "key").limit(k)
