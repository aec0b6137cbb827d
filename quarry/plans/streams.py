"""Queries of the stateful operators, over the event table as a bounded stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.registry import query
from quarry.sources.tables import Tables
from quarry.streaming import streams as S


@query("str_01_progress", "SELECT user_id, CAST(floor(count(*) * 100 / 1000) AS BIGINT) AS percent FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return S.progress(t["events"], 1000)


@query("str_03_windowed_limit", "SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, least(count(*), 2) AS allowed FROM events GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return S.windowed_limit(t["events"], 2, 3600)


@query("str_03_anchored_limit")
def _(t: Tables) -> DataFrame:
    return S.anchored_limit(t["events"], 1, 3600)


@query("str_04_hits", "SELECT user_id, event_type, count(*) - 1 AS hits FROM events GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return t["events"].groupBy("user_id", "event_type").agg((F.count(F.lit(1)) - 1).alias("hits"))


@query("str_07_job_status", "SELECT user_id, event_type AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def _(t: Tables) -> DataFrame:
    return S.last_status(t["events"])


@query("str_08_stage_times", "SELECT event_id, round(date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) / 1000000, 3) AS seconds FROM events")
def _(t: Tables) -> DataFrame:
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(before.cast("timestamp"))
    return t["events"].select("event_id", F.round(micros / 1000000, 3).alias("seconds"))


@query("str_10_trend", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return S.trend(t["events"].withColumn("ts", F.col("ts").cast("timestamp")))
