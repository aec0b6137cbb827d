"""Relations of the engine over the star schema, event, document and page tables.

`assets` reads a document as one source unit, `issues` applies a rule pack to all
documents, `reviewed` is the second issue stream, `edges` the dependency graph.
Each has its twin in SQL in quarry.plans.oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import java_source as J
from quarry.operators import rules as R
from quarry.sources import code_tables as C
from quarry.sources import parsers as P


#: Java files that one task reads, in some seconds.
FILES_A_TASK = 2500


class Tables:
    """The tables of one folder, read when first used; only the columns that a plan needs are scanned."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def assets(self) -> DataFrame:
        d = self["documents"]
        return d.select(
            F.format_string("org.%s.%s.Doc%d", "source", "lang", "doc_id").alias("address"),
            "doc_id",
            F.when(F.col("lang") == "fr", "INTERFACE").when(F.col("lang") == "de", "ENUM").otherwise("CLASS").alias("kind"),
            F.col("source").alias("module"),
            F.concat_ws(".", F.lit("org"), "source", "lang").alias("package"),
            F.concat(F.lit("/repo/"), "source", F.lit("/src/main/java/"), "lang", F.lit("/Doc"), F.col("doc_id").cast("string"), F.lit(".java")).alias("source_file"),
            F.col("text").alias("body"),
            T.line_count(F.col("text")).alias("lines_of_code"),
            T.line_count_where(F.col("text"), lambda x: x.contains("|")).alias("comment_lines"),
            F.regexp_count("text", F.lit(r"[.!?]")).cast("double").alias("cyclomatic_complexity"),
            (F.col("doc_id") % 2).cast("int").alias("inheritance_depth"),
            (F.col("n_chars") / 500).cast("int").alias("method_count"),
        )

    def issues(self) -> DataFrame:
        """Static issues: one for each rule and document that it fires on."""
        d = self["documents"].select("doc_id", "text", "n_chars", "lang", "source")
        found = R.evaluate(d, R.DOCUMENT_RULES)
        return found.select(
            "rule_key",
            "severity",
            "category",
            F.concat(F.lit("/repo/"), "source", F.lit("/src/main/java/"), "lang", F.lit("/Doc"), F.col("doc_id").cast("string"), F.lit(".java")).alias("file"),
            F.concat(F.lit("Doc"), F.col("doc_id").cast("string")).alias("class_name"),
            F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("m"), (F.col("doc_id") % 7).cast("string"))).alias("method"),
            (F.col("doc_id") % 200 + 1).alias("line"),
            F.concat("message", F.lit(" in "), "source").alias("message"),
            "doc_id",
        )

    def reviewed(self) -> DataFrame:
        """The second stream: one issue for each labelled document that is toxic or of low quality, with a confidence."""
        joined = self["labels"].join(self["documents"].select("doc_id", "lang", "source"), "doc_id").filter("toxic = 1 or quality = 0")
        return joined.select(
            F.concat(F.lit("src/main/java/"), "lang", F.lit("/Doc"), F.col("doc_id").cast("string"), F.lit(".java")).alias("file"),
            (F.col("doc_id") % 200 + 1).alias("line"),
            F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("m"), (F.col("doc_id") % 7).cast("string"))).alias("method"),
            F.when(F.col("toxic") == 1, "CRITICAL").otherwise("MAJOR").alias("severity"),
            F.when(F.col("doc_id") % 11 != 0, (F.col("doc_id") % 10) / 10).alias("confidence"),
            F.concat(F.lit("review "), F.col("doc_id").cast("string")).alias("suggestion"),
            "doc_id",
        )

    def edges(self) -> DataFrame:
        """Weighted edges supplier to part."""
        return self["lineitem"].groupBy(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).agg(F.count(F.lit(1)).alias("value"))

    def java(self) -> DataFrame:
        """All types of the code base that is written out of the parts. A part is a few bytes and its file takes long to read, so parts are dealt out by their number, whatever files they stand in."""
        part = self["part"]
        return J.classes(C.java_files(part.repartition(1 + part.count() // FILES_A_TASK, "p_partkey")))

    def project(self, kind: str) -> DataFrame:
        """The parsed project files of a kind, one for each supplier."""
        return P.PARSERS[kind](C.project_files(self["supplier"], kind))

    def chain(self) -> DataFrame:
        """Edges among all customers, sparse and with cycles: each customer calls two others. Targets go round at the number of customers, or at 500 where there are fewer."""
        n = self["customer"].select(F.col("c_custkey").alias("k"))
        size = F.lit(max(500, n.count()))
        one = n.select(F.col("k").alias("src"), ((F.col("k") * 7 + 3) % size).alias("dst"))
        two = n.select(F.col("k").alias("src"), ((F.col("k") * 13 + 5) % size).alias("dst"))
        return one.union(two).distinct()
