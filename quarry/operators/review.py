"""Retrieval-backed review: queries, ranks, index, prompts, answers, degradation, and what reports and caches make of issues."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import names as N
from quarry.functions import text as T
from quarry.operators.graph import shared_folder
from quarry.operators.retrieval import inverted_index


def one_line(text: Column) -> Column:
    return F.regexp_replace(text, r"[\r\n]", "_")


def safe_path(path: Column, root: str) -> Column:
    """Whether a path stays below root and names nothing above it."""
    return path.startswith(root) & ~path.contains("..")


def retrieval_query(said: Column) -> Column:
    """The words of a description; nothing of a null one."""
    return F.coalesce(F.regexp_replace(F.trim(F.regexp_replace(said, r"[^a-zA-Z0-9_\s]", " ")), r"\s+", " "), F.lit(""))


def summary_query(class_name: Column, method: Column) -> Column:
    return F.trim(F.concat_ws(" ", F.substring_index(class_name, ".", -1), method))


def vector_literal(numbers: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(numbers, ","), F.lit("]"))


# The weight of an unlabelled term, and the sum over its places at most.
_WEIGHT = 0.1 * 6.079271


def text_rank(docs: DataFrame, said: str) -> DataFrame:
    """doc_id, score of documents with all terms: for each term its weight, more with the logarithm of how often it stands there, over the number of terms' places. An own formula that orders as a text rank does."""
    terms = sorted(set(said.lower().split()))
    hits = inverted_index(docs).filter(F.col("term").isin(terms))
    scored = hits.groupBy("doc_id").agg(F.sum(_WEIGHT * (1 + F.log("tf")) / 10).alias("score"), F.count(F.lit(1)).alias("found"))
    return scored.filter(F.col("found") == len(terms)).select("doc_id", "score")


_ISSUE = "struct<ruleKey:string,severity:string,category:string,filePath:string,className:string,methodName:string,line:int,message:string,confidence:double,aiSuggestion:string>"


def answered(answers: DataFrame, column: str) -> DataFrame:
    """A row for each issue that an answer holds, from its first { to its last }: those that it lists, or the one that it is. Defaults as a report has them."""
    text = F.regexp_extract(column, r"(?s)(\{.*\})", 1)
    whole = F.regexp_extract(column, r"(?s)^\s*(\[.*\])\s*$", 1)
    listed = F.coalesce(F.from_json(F.nullif(whole, F.lit("")), f"array<{_ISSUE}>"), F.from_json(F.get_json_object(text, "$.issues"), f"array<{_ISSUE}>"))
    one = F.when(F.json_object_keys(text).isNotNull() & ~F.array_contains(F.json_object_keys(text), "issues"), F.array(F.from_json(text, _ISSUE)))
    kept = [c for c in answers.columns if c != column]
    rows = answers.select(*kept, F.explode(F.coalesce(listed, one)).alias("i"))
    either = lambda name, other: F.coalesce(f"i.{name}", F.lit(other))
    return rows.select(*kept, either("ruleKey", "AI_REVIEW").alias("rule_key"), either("severity", "MINOR").alias("severity"), either("category", "DESIGN").alias("category"), either("filePath", "").alias("file"), F.col("i.methodName").alias("method"), either("line", 0).alias("line"), either("message", "").alias("message"), F.col("i.confidence").alias("confidence"), F.col("i.aiSuggestion").alias("suggestion"))


def dictionary(content: str) -> dict[str, str]:
    """A dictionary from JSON, its keys in lower case."""
    return {k.lower(): v for k, v in json.loads(content).items()}


def translated(words: Column, by: dict[str, str]) -> Column:
    if not by:
        return words
    table = F.create_map(*(F.lit(x) for pair in by.items() for x in pair))
    return F.transform(words, lambda w: F.coalesce(F.element_at(table, w), w))


def project_index(files: DataFrame) -> DataFrame:
    """content: a list of projects, an object with the list as projects, or an object by name. A row for each project, other columns kept."""
    kind = "array<struct<name:string,path:string>>"
    named = F.from_json("content", "map<string,struct<path:string>>")
    by_name = F.transform(F.map_entries(named), lambda e: F.struct(e["key"].alias("name"), e["value"]["path"].alias("path")))
    is_list = F.col("content").rlike(r"^\s*\[")
    listed = F.when(is_list, F.from_json("content", kind)).otherwise(F.coalesce(F.from_json(F.get_json_object("content", "$.projects"), kind), F.when(~is_list, by_name)))
    return files.select(*(c for c in files.columns if c != "content"), F.explode(listed).alias("p")).select("*", "p.*").drop("p")


# What follows after so many failures, and how often is tried again.
RETRIES = 3


def degraded(failures: Column) -> Column:
    return F.when(failures < RETRIES, "RETRY").when(failures == RETRIES, "REDUCE_CONTEXT").when(failures == RETRIES + 1, "STATIC_ONLY").otherwise("EMPTY")


def wait_seconds(failures: Column) -> Column:
    """1, 2, 4 seconds before a retry."""
    return F.when(failures < RETRIES, F.pow(F.lit(2), failures).cast("int"))


def indexed(slices: DataFrame, key: list[str], order: str) -> DataFrame:
    """The slices with searchable and embedding; of a key the last by order. The vector is the one that needs no model."""
    searchable = F.concat_ws(" ", "class_name", "code")
    own = slices.groupBy(*key).agg(F.max_by(F.struct(*slices.columns), order).alias("r")).select("r.*")
    return own.withColumn("searchable", searchable).withColumn("embedding", N.hash_embedding(F.col("searchable")))


def reviewed(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """item_id, doc_id, rank, prompt, severity: for a few stated queries the k best documents by text and by vector, fused, each with a prompt and what the reviewer without a model says of it."""
    out = None
    for q in queries.collect():  # stated queries
        words = [w for w in q["text"].lower().split() if w.isalnum()][:2]
        near = T.cosine(N.hash_embedding(F.col("text"), 64), N.hash_embedding(F.lit(q["text"]), 64))
        by_vector = docs.select("doc_id", near.alias("near")).orderBy(F.desc("near"), "doc_id").limit(2 * k)
        by_text = text_rank(docs, " ".join(words)).orderBy(F.desc("score"), "doc_id").limit(2 * k)
        met = by_vector.withColumn("a", F.rank().over(_order("near"))).join(by_text.withColumn("b", F.rank().over(_order("score"))), "doc_id", "full")
        best = met.select("doc_id", T.reciprocal_rank(F.col("a"), F.col("b")).alias("fused")).orderBy(F.desc("fused"), "doc_id").limit(k)
        found = best.withColumn("rank", F.row_number().over(_order("fused"))).join(docs, "doc_id")
        prompt = F.concat(F.lit(f"Review for: {q['item_id']}\n"), F.left("text", F.lit(2000)))
        rows = found.select(F.lit(q["item_id"]).alias("item_id"), "doc_id", "rank", prompt.alias("prompt"), F.when(F.col("text").rlike("(token|password|secret)"), "CRITICAL").otherwise("INFO").alias("severity"))
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else docs.sparkSession.createDataFrame([], "item_id long, doc_id long, rank int, prompt string, severity string")


def _order(column: str):
    from pyspark.sql import Window

    return Window.orderBy(F.desc(column), "doc_id")  # over at most 2k rows


def markdown_report(issues: DataFrame) -> DataFrame:
    """severity, report: a section for each severity with a table of its rules. Rules are a catalogue of a fixed number of rows."""
    counted = issues.groupBy("severity", "rule_key").agg(F.count(F.lit(1)).alias("n"))
    row = F.struct("rule_key", F.format_string("| %s | %d |", "rule_key", "n").alias("row"))
    listed = counted.groupBy("severity").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    head = F.concat(F.lit("## "), "severity", F.lit("\n\n| rule | issues |\n|---|---|\n"))
    return listed.select("severity", F.concat(head, F.array_join(F.transform("rows", lambda r: r["row"]), "\n")).alias("report"))


def appended(rows: DataFrame, table: str) -> str:
    """Append rows with a generated id to a table below the shared folder, in one job commit; returns its path."""
    path = f"{shared_folder(rows.sparkSession)}/{table}-{uuid.uuid4().hex[:10]}"
    rows.withColumn("id", F.monotonically_increasing_id()).write.mode("append").parquet(path)
    return path


def stale(now: DataFrame, cached: DataFrame, key: str, version: str) -> DataFrame:
    """key, reason of what must be read again: changed, version or new."""
    met = now.alias("n").join(cached.alias("c"), key, "left")
    reason = F.when(F.col("c.hash").isNull(), "new").when(F.col("c.hash") != F.col("n.hash"), "changed").when(F.col("c.version") != version, "version")
    return met.select(key, reason.alias("reason")).filter("reason is not null")


def in_force(events: DataFrame, loads: DataFrame, at: str) -> DataFrame:
    """The events with the values of the last load before them. loads: since and values; a few rows, one for each reload."""
    held = loads.agg(F.array_sort(F.collect_list(F.struct(*loads.columns))).alias("loads"))
    last = F.element_at(F.filter("loads", lambda x: x["since"] <= F.col(at)), -1)
    return events.join(F.broadcast(held)).withColumn("load", last).select(*events.columns, *(F.col(f"load.{c}").alias(c) for c in loads.columns))  # a single row
