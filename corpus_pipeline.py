"""From raw documents to token ids: five stages, each over all that the one before it kept.

quality: documents that the classifier rejects go. near_duplicates: of each group
one document stays. decontamination: documents that hold a benchmark item go.
mixing: documents are taken as often as their source's target wants. tokens: the
ids are written and read back; a row for each document taken.

Each stage takes nulls in any column, empty and very long texts, repeated rows and columns
of any name: quality scores a null text as an empty one; near_duplicates lets documents
without words all stay and keeps one of the rows that agree in id and text; decontamination
leaves null and empty texts alone; mixing takes nothing of a document without words, and
counts a null source as the last one; tokens gives an empty text its end id, null ids first.
An empty table passes through all stages and gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarry.llm.decontam import drop_leaking
from quarry.llm.jaccard_join import keep_one
from quarry.llm.mixing import mix_documents
from quarry.llm.quality_cnn import keep_good, train
from quarry.llm.scratch import materialise
from quarry.llm.token_store import store_and_read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_leaking(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return store_and_read(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("tokens", tokens),
]

#: A trained network, connected components and Newton steps have no equivalent in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
