"""Operators on issue streams: merge, validation, suppression, delta, gates and debt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T

# Minutes to mend an issue, by severity, and what a line costs.
MINUTES = {"CRITICAL": 30, "MAJOR": 15, "MINOR": 5, "INFO": 1}
OTHER_MINUTES = 5
COST_PER_LINE, COST_PER_HOUR = 0.06, 50


def last_of_location(issues: DataFrame, order: str) -> DataFrame:
    """The last row of each location: an aggregation, so a location with many rows stays on the map side."""
    key = T.location_key(F.col("file"), F.col("line"), F.col("method"))
    row = F.struct(*issues.columns)
    return issues.withColumn("location", key).groupBy("location").agg(F.max_by(row, F.col(order)).alias("r")).select("location", "r.*")


def merge(static: DataFrame, reviewed: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Full outer merge by location: what both report is merged and takes the review's confidence; what only the review reports needs the threshold."""
    s, r = static.alias("s"), reviewed.alias("r")
    both = s.join(r, F.col("s.location") == F.col("r.location"), "full")
    origin = F.when(F.col("s.location").isNull(), "ai").when(F.col("r.location").isNull(), "static").otherwise("merged")
    confidence = F.when(F.col("r.location").isNull(), 1.0).otherwise(F.col("r.confidence"))
    out = both.select(
        F.coalesce("s.location", "r.location").alias("location"),
        origin.alias("origin"),
        F.coalesce("s.severity", "r.severity").alias("severity"),
        F.coalesce("s.category", F.lit("OTHER")).alias("category"),
        "s.rule_key",
        confidence.alias("confidence"),
        "r.suggestion",
    )
    hidden = F.when(F.col("origin") == "static", False).otherwise(F.coalesce(F.col("confidence") < threshold, F.lit(False)))
    return out.filter((F.col("origin") != "ai") | (F.col("confidence") >= threshold)).withColumn("auto_filtered", hidden)


def decision(origin: Column, severity: Column, confidence: Column) -> Column:
    """What the validation loop does with an issue."""
    return (
        F.when((origin == "merged") & (confidence >= 0.8), "ACCEPT")
        .when((origin == "ai") & (confidence.isNull() | (confidence < 0.5)), "FLAG")
        .when((origin == "ai") & (confidence < 0.7), "DOWNGRADE")
        .when((severity == "CRITICAL") & (confidence < 0.6), "RETRY")
        .otherwise("ACCEPT")
    )


def not_suppressed(issues: DataFrame, baseline: DataFrame) -> DataFrame:
    key = T.issue_key(F.col("rule_key"), F.col("class_name"), F.col("method"), F.col("message"))
    return issues.withColumn("key", key).join(baseline.select("key"), "key", "left_anti")


def delta(issues: DataFrame, current: Column, baseline: Column) -> DataFrame:
    """key, rule_key, change of the keys that are new (current and not in the baseline) or fixed (the other way): both anti joins as one aggregation, so the issues are read once."""
    key = T.issue_key(F.col("rule_key"), F.col("class_name"), F.col("method"), F.col("message"))
    seen = issues.groupBy(key.alias("key"), "rule_key").agg(F.bool_or(current).alias("now"), F.bool_or(baseline).alias("before"))
    return seen.filter("now != before").select("key", "rule_key", F.when(F.col("now"), "new").otherwise("fixed").alias("change"))


def minutes(severity: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, value in MINUTES.items():
        out = F.coalesce(out, F.when(severity == name, value))
    return F.coalesce(out, F.lit(OTHER_MINUTES))


def rating(ratio: Column) -> Column:
    return F.when(ratio <= 5, "A").when(ratio <= 10, "B").when(ratio <= 20, "C").when(ratio <= 50, "D").otherwise("E")


def gate(critical: Column, major: Column, minor: Column, ratio: Column) -> Column:
    """Why a quality gate fails; empty if it passes."""
    reasons = F.array(
        F.when(critical > 0, "critical issues"),
        F.when(major > 0, "major issues"),
        F.when(critical + major + minor > 10, "too many issues"),
        F.when(ratio > 5, "debt ratio"),
    )
    return F.array_join(F.array_compact(reasons), ", ")
