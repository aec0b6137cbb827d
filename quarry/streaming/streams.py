"""Stateful operators over event streams; each takes a streaming or a batch DataFrame where that makes sense."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def trend(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events by day and type, closed by a watermark when streaming."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.to_date("w.start").alias("day"), "event_type", "n")


def windowed_limit(events: DataFrame, most: int, seconds: int = 60) -> DataFrame:
    """Per key and window aligned to the epoch: the events and how many of them are allowed."""
    counted = events.groupBy("user_id", F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("user_id", F.col("w.start").cast("timestamp").alias("start"), "n", F.least(F.col("n"), F.lit(most).cast("long")).alias("allowed"))


def anchored_limit(events: DataFrame, most: int, seconds: int = 60) -> DataFrame:
    """event_id, allowed: a window opens with a key's first event and lasts `seconds`; `most` events of it are allowed. Batch; one key's events are read in order, a batch at a time."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["ts", "event_id"])
        opened, held, out = None, 0, []
        for ts in group["ts"]:
            if opened is None or (ts - opened).total_seconds() >= seconds:
                opened, held = ts, 0
            held += 1
            out.append(held <= most)
        return pd.DataFrame({"event_id": group["event_id"], "allowed": out})

    return events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")).groupBy("user_id").applyInPandas(run, "event_id long, allowed boolean")


def anchored_limit_stream(events: DataFrame, most: int, seconds: int = 60) -> DataFrame:
    """The same on a stream: the open window of each key is its state."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, held = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for ts in rows["ts"]:
            at = ts.timestamp()
            if opened is None or at - opened >= seconds:
                opened, held = at, 0
            held += 1
            out.append(held <= most)
        state.update((opened, held))
        yield pd.DataFrame({"event_id": rows["event_id"], "allowed": out})

    return events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")).groupBy("user_id").applyInPandasWithState(run, "event_id long, allowed boolean", "opened double, held int", "append", GroupStateTimeout.NoTimeout)


def last_status(events: DataFrame) -> DataFrame:
    """The status machine: the last event of each key."""
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"))


def progress(events: DataFrame, total: int) -> DataFrame:
    """Per key the share of `total` seen so far, in percent rounded down."""
    return events.groupBy("user_id").agg(F.floor(F.count(F.lit(1)) * 100 / total).cast("long").alias("percent"))
