"""Queries that once did less than the whole job, against brute force over whole tables."""

import random

import pytest

from quarry.operators import graph as G
from quarry.plans.catalogue import QUERIES
from quarry.sources.tables import Tables


@pytest.fixture(scope="module")
def larger():
    return "/root/testdata/sf0.01"


def test_the_graph_has_all_customers(spark, larger):
    keys = [r["c_custkey"] for r in spark.read.parquet(f"{larger}/customer.parquet").collect()]
    got = {tuple(r) for r in Tables(spark, larger).chain().select("src", "dst").collect()}
    assert len(keys) > 500 and got == {(k, (k * a + b) % len(keys)) for k in keys for a, b in ((7, 3), (13, 5))}


def test_call_chains_from_all_sources(spark, folder):
    after = {}
    for r in Tables(spark, folder).chain().collect():
        after.setdefault(r["src"], []).append(r["dst"])

    def walk(path):
        if len(path) == 5 or path[-1] not in after or path[-1] in path[:-1]:
            return [path]
        return [p for x in after[path[-1]] for p in walk([*path, x])]

    got = sorted((r["start"], r["path"]) for r in QUERIES["gr_07_call_chains"](spark, folder).collect())
    assert got == sorted((s, ">".join(map(str, p))) for s in after for p in walk([s]))


def test_taint_from_all_sources_to_all_sinks(spark, larger):
    customers = spark.read.parquet(f"{larger}/customer.parquet").collect()
    after, expected = {}, set()
    for r in Tables(spark, larger).chain().collect():
        after.setdefault(r["src"], []).append(r["dst"])
    sinks = {c["c_custkey"] for c in customers if c["c_acctbal"] < 0}
    for start in (c["c_custkey"] for c in customers if c["c_mktsegment"] == "BUILDING"):
        front, depth = {start}, {}
        for d in range(1, 6):
            front = {x for node in front for x in after.get(node, ())}
            for x in front:
                depth.setdefault(x, d)
        expected |= {(start, x, d) for x, d in depth.items() if x in sinks}
    got = [(r["start"], r["sink"], r["depth"]) for r in QUERIES["gr_18_taint_reach"](spark, larger).collect()]
    assert len(got) == len(expected) and set(got) == expected


def test_every_suffix_is_matched(spark, larger):
    address = {r["doc_id"]: r["address"] for r in Tables(spark, larger).assets().select("doc_id", "address").collect()}
    got = {r["k"]: r["address"] for r in QUERIES["join_04_suffix_match"](spark, larger).collect()}
    assert got == {k: address[k * 3] for k in address if k * 3 in address} and max(got) >= 200


def test_whole_pages_are_escaped(spark, larger):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{larger}/pages.parquet").collect()}
    got = {r["page_id"]: r["escaped"] for r in QUERIES["fn_35_html_escape"](spark, larger).collect()}
    assert got == {k: v.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;") for k, v in pages.items()}


def test_whole_bodies_are_searchable(spark, larger):
    assets = Tables(spark, larger).assets().select("doc_id", "address", "kind", "body").collect()
    got = {r["doc_id"]: r["searchable"] for r in QUERIES["fn_06_search_text"](spark, larger).collect()}
    assert got == {r["doc_id"]: f"{r['address']} {r['kind']} {r['body']}" for r in assets}


def test_reciprocal_ranks_of_all_orders(spark, folder):
    orders = [(r["o_orderkey"], r["o_totalprice"]) for r in spark.read.parquet(f"{folder}/orders.parquet").collect()]
    a = {k: i for i, (k, _) in enumerate(sorted(orders, key=lambda x: (-x[1], x[0])), 1)}
    b = {k: i for i, (k, _) in enumerate(sorted(orders), 1)}
    got = {r["o_orderkey"]: r["score"] for r in QUERIES["fn_02_reciprocal_ranks"](spark, folder).collect()}
    assert got == {k: pytest.approx(1 / (60 + a[k]) + 1 / (60 + b[k]), abs=1e-9) for k in a} and len(got) > 100


def test_all_reviewed_issues_are_sorted(spark, larger):
    rows = [(r["doc_id"], r["confidence"]) for r in Tables(spark, larger).reviewed().collect()]
    got = [tuple(r) for r in QUERIES["srt_06_by_confidence"](spark, larger).collect()]
    assert got == sorted(rows, key=lambda x: (-(x[1] or 0), x[0])) and len(got) > 40


def test_a_deep_graph_is_reached_whole(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 31)], "src long, dst long")
    got = {r["node"]: r["depth"] for r in G.reached(e, spark.createDataFrame([(1,)], "node long")).collect()}
    assert got == {i: i - 1 for i in range(1, 32)}


def test_reachable_has_no_level_bound(spark, larger):
    after = {}
    for r in Tables(spark, larger).chain().collect():
        after.setdefault(r["src"], []).append(r["dst"])
    depth, front = {1: 0}, [1]
    while front:
        front = [x for x in dict.fromkeys(y for node in front for y in after.get(node, ())) if depth.setdefault(x, -1) == -1]
        level = max(depth.values()) + 1
        depth |= dict.fromkeys(front, level)
    got = {r["node"]: r["depth"] for r in QUERIES["gr_05_reachable"](spark, larger).collect()}
    assert got == depth and max(depth.values()) > 12


def test_cycles_of_any_length(spark):
    draw = random.Random(5)
    pairs = [(1, 2), (2, 3), (3, 4), (4, 5), (5, 1), (5, 6), (6, 7), (8, 8), (9, 10), (10, 9), (7, 9)] + [(draw.randrange(20, 60), draw.randrange(20, 60)) for _ in range(45)]
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)

    def beyond(node):
        seen, front = set(), [node]
        while front:
            front = [y for x in front for y in after.get(x, ()) if y not in seen and not seen.add(y)]
        return seen

    reach = {x: beyond(x) for x in {n for p in pairs for n in p}}
    expected = {x: min(y for y in reach[x] if x in reach[y]) for x in reach if x in reach[x]}
    got = {r["node"]: r["component"] for r in G.cyclic(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == expected and got[4] == 1


def test_longest_path_from_any_node(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 10)] + [(3, 3), (2, 20)], "src long, dst long")
    assert G.longest_path(chain, 7) == 10
    assert G.longest_path(spark.createDataFrame([(1, 2), (2, 1), (5, 1)], "src long, dst long"), 7) == 3
