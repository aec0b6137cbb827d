"""Operators on small hand-made inputs, against plain Python."""

import datetime as dt
import random

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import duplicates as D
from quarry.operators import graph as G
from quarry.operators import issues as I
from quarry.operators import retrieval as S
from quarry.operators import rules as R
from quarry.streaming import streams


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_trailing_empty_lines_do_not_count(spark):
    assert value(spark, T.line_count(F.lit("a\nb\n\n"))) == 2


def test_half_is_rounded_up(spark):
    assert value(spark, T.round_half_up(F.lit(-2.5))) == -2
    assert value(spark, T.round_half_up(F.lit(2.45), 1)) == 2.5


def test_cosine_of_zero_and_null(spark):
    a = F.array(F.lit(1.0), F.lit(0.0))
    assert value(spark, T.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0
    assert value(spark, T.cosine(a, F.lit(None).cast("array<double>"))) == 0
    assert value(spark, T.cosine(a, F.array(F.lit(2.0)))) == 1.0


def test_location_key_leaves_out_a_null(spark):
    assert value(spark, T.location_key(F.lit("f"), F.lit(3), F.lit(None).cast("string"))) == "f:3"


def test_hamming(spark):
    assert value(spark, T.hamming(F.lit("abcd"), F.lit("abxx"))) == 2
    assert value(spark, T.hamming(F.lit(None).cast("string"), F.lit("a"))) == 2147483647


def test_without_comments(spark):
    assert value(spark, T.without_comments(F.lit("a /* x\n y */ b // c\n  d"))) == "a b d"


def test_camel(spark):
    assert value(spark, T.camel(F.lit("user_order_item"))) == "UserOrderItem"


def test_merge_of_issue_streams(spark):
    static = spark.createDataFrame([("f", 1, "m", "MINOR", "BUG", "R1"), ("f", 1, "m", "MAJOR", "BUG", "R2"), ("g", 2, None, "INFO", None, "R3")], "file string, line int, method string, severity string, category string, rule_key string")
    ai = spark.createDataFrame([("f", 1, "m", "CRITICAL", 0.3, "x", 1), ("h", 9, None, "MAJOR", 0.4, "y", 2), ("i", 9, None, "MAJOR", 0.5, "z", 3), ("g", 2, None, "MAJOR", None, "w", 4)], "file string, line int, method string, severity string, confidence double, suggestion string, doc_id int")
    out = {r["location"]: r for r in I.merge(I.last_of_location(static, "rule_key"), I.last_of_location(ai, "doc_id")).collect()}
    assert set(out) == {"f:1:m", "g:2", "i:9"}
    assert (out["f:1:m"]["origin"], out["f:1:m"]["rule_key"], out["f:1:m"]["auto_filtered"]) == ("merged", "R2", True)
    assert (out["g:2"]["category"], out["g:2"]["auto_filtered"]) == ("OTHER", False)
    assert out["i:9"]["origin"] == "ai"


def test_rules_fire_in_one_pass(spark):
    d = spark.createDataFrame([(1, "SHOUTING!! now", 14), (2, "calm", 4)], "doc_id int, text string, n_chars int")
    assert {(r["doc_id"], r["rule_key"]) for r in R.evaluate(d, R.DOCUMENT_RULES).collect()} == {(1, "DOC-SHOUT"), (1, "DOC-SHORT"), (2, "DOC-SHORT")}


def test_ten_token_runs_are_duplicates_and_nine_are_not(spark):
    ten = " ".join(f"word{i}" for i in range(10))
    nine = " ".join(f"other{i}" for i in range(9))
    d = spark.createDataFrame([(1, f"x1 {ten}"), (2, f"{ten} y2"), (3, nine), (4, nine), (5, None)], "doc_id long, text string")
    assert [tuple(r) for r in D.reported_duplicates(d, 10).collect()] == [(1, 1, 2)]


def test_components_against_union_find(spark):
    draw = random.Random(4)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r["node"]: r["component"] for r in G.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: root(x) for x in parent}


def test_paths_stop_at_a_repeated_node(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (2, 4)], "src long, dst long")
    got = {r["path"] for r in G.chains(spark, e, spark.createDataFrame([(1,)], "node long"), 5).collect()}
    assert got == {"1>2>3>1", "1>2>4"}


def test_cycles_once_each(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (2, 1), (5, 5)], "src long, dst long")
    assert {r["cycle"] for r in G.short_cycles(e).collect()} == {"1>2", "1>2>3"}


def test_fusion_is_symmetric(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "key long, rank long")
    b = spark.createDataFrame([(2, 1), (3, 2)], "key long, rank long")
    assert S.fused(a, b, 5).collect() == S.fused(b, a, 5).collect()


def limit(events, most, seconds):
    out, opened = {}, {}
    for event, ts, user in sorted(events, key=lambda e: (e[1], e[0])):
        at, held = opened.get(user, (None, 0))
        if at is None or (ts - at).total_seconds() >= seconds:
            at, held = ts, 0
        opened[user] = (at, held + 1)
        out[event] = held < most
    return out


def test_anchored_limit_batch_and_stream(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    events = [(i, start + dt.timedelta(seconds=s), u) for i, (s, u) in enumerate([(0, 1), (59, 1), (61, 1), (62, 1), (119, 1), (121, 1), (5, 2), (5, 2), (5, 2)])]
    df = spark.createDataFrame(events, "event_id long, ts timestamp, user_id long")
    expected = limit(events, 2, 60)
    assert {r["event_id"]: r["allowed"] for r in streams.anchored_limit(df, 2).collect()} == expected
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run = streams.anchored_limit_stream(source, 2).writeStream.format("memory").queryName("limits").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    run.awaitTermination(120)
    assert {r["event_id"]: r["allowed"] for r in spark.table("limits").collect()} == expected


def test_trend_stream_equals_batch(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    events = [(i, start + dt.timedelta(hours=7 * i), "ab"[i % 2]) for i in range(30)]
    df = spark.createDataFrame(events, "event_id long, ts timestamp, event_type string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run = streams.trend(source).writeStream.outputMode("complete").format("memory").queryName("trends").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    run.awaitTermination(120)
    assert sorted(spark.table("trends").collect()) == sorted(streams.trend(df).collect())
