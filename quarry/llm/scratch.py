"""Intermediate tables in the folder that the driver and all executors share.

Lineage is cut with written Parquet tables only, so that a lost executor costs
a re-read and never a recomputation of what came before.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no spark.checkpoint.dir and runs in one process, as in local tests.
LOCAL_ROOT = "file:///tmp/checkpoints"

_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder of this application below spark.checkpoint.dir."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        _roots[app] = f"{(named or LOCAL_ROOT).rstrip('/')}/quarry-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_forget, spark, _roots[app])
    return _roots[app]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex[:10]}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df once and return a reader of what was written."""
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame) -> DataFrame:
    """With leave to broadcast if its rows, of a few numbers, are counted to be few."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def discard(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _forget(spark: SparkSession, root: str) -> None:
    try:
        discard(spark, root)
    except Exception:  # the JVM may already have gone at interpreter exit; the folder is then left to the cluster's own cleaning
        pass


#: Of an Arrow batch. One value for all operators, so a result does not depend on which query was built last.
ARROW_BYTES = 4 << 20


def arrow_bytes(spark: SparkSession) -> None:
    """Bound Arrow batches by their bytes, as long texts make large ones."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{ARROW_BYTES}b")


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Rows of an Arrow batch while this lasts, for results that are written meanwhile."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def reclaim(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of stages whose results have been written."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def freed_at_once(spark: SparkSession) -> Iterator[None]:
    """While this lasts, the shuffle files of a query go as soon as it ends. The cleaner gets to them at some later time."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def give_back() -> None:
    """Return to the system what this Python worker has freed; idle workers count as their executor's memory for a minute."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


_held: dict[str, dict] = {}


def held(name: str) -> dict:
    """What a Python worker holds from task to task, until one comes that does not use it."""
    return _held.setdefault(name, {})


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], uses: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map over batches whose worker returns what the task before left, and what it has freed itself after each batch."""

    def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            del batch  # while the next one is read
            give_back()

    def kept_small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, what in _held.items():
            if name != uses:
                what.clear()
        give_back()
        yield from run(one_by_one(batches))
        give_back()

    return kept_small


def lean_group(run: Callable[[tuple, pa.Table], pa.Table]) -> Callable[[tuple, pa.Table], pa.Table]:
    """The same for a map over groups."""

    def kept_small(key: tuple, table: pa.Table) -> pa.Table:
        out = run(key, table)
        give_back()
        return out

    return kept_small


def spare(name: str, taken: list[str]) -> str:
    """A column name that none of those taken has, in whatever case."""
    lower = {c.lower() for c in taken}
    while (name := f"_{name}").lower() in lower:
        pass
    return name


#: Rows of keys that may be broadcast: a few numbers each, so some tens of megabytes.
BROADCAST_ROWS = 500_000


def only(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows of df that have a key; df is not shuffled where the keys are counted to be few. Nulls equal one another."""
    return _match(df, keys, {c: F.col(c) for c in on}, "left_semi")


def without(df: DataFrame, keys: DataFrame, by: dict[str, Column]) -> DataFrame:
    """The rows of df that have no key, where by says how the keys' columns follow from a row."""
    return _match(df, materialise(keys.distinct(), "keys"), by, "left_anti")


def _match(df: DataFrame, keys: DataFrame, by: dict[str, Column], how: str) -> DataFrame:
    names = {c: spare(f"key_{c}", df.columns) for c in by}
    keys = keys.select(*(F.col(c).alias(name) for c, name in names.items())).distinct()
    few = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    same = [value.eqNullSafe(F.col(names[c])) for c, value in by.items()]
    return df.join(F.broadcast(keys) if few else keys, reduce(and_, same), how)
