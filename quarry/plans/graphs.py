"""Graph and retrieval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import graph as G
from quarry.operators import retrieval as S
from quarry.plans.oracle import CHAIN, EDGES, recursive, using
from quarry.plans.registry import query
from quarry.sources.tables import Tables

n = lambda: F.count(F.lit(1))


@query("gr_01_degrees", using(EDGES) + "SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return G.degrees(t.edges())


_REACH = recursive(CHAIN, "u AS (SELECT src, dst FROM chain UNION SELECT dst, src FROM chain)", "r AS (SELECT DISTINCT src AS node, src AS seen FROM u UNION SELECT r.node, u.dst FROM r JOIN u ON r.seen = u.src)")


@query("gr_02_components", _REACH + "SELECT node, min(seen) AS component FROM r GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return G.components(t.chain())


@query("gr_03_component_count", _REACH + "SELECT count(DISTINCT c) AS components FROM (SELECT min(seen) AS c FROM r GROUP BY node)")
def _(t: Tables) -> DataFrame:
    return G.components(t.chain()).agg(F.countDistinct("component").alias("components"))


@query("gr_04_cyclomatic", _REACH + "SELECT (SELECT count(*) FROM chain) - (SELECT count(DISTINCT node) FROM r) + 2 * (SELECT count(DISTINCT c) FROM (SELECT min(seen) AS c FROM r GROUP BY node)) AS complexity")
def _(t: Tables) -> DataFrame:
    e = t.chain()
    c = G.components(e).agg(n().alias("nodes"), F.countDistinct("component").alias("p"))
    return e.agg(n().alias("edges")).join(c).select((F.col("edges") - F.col("nodes") + 2 * F.col("p")).alias("complexity"))  # two single rows


@query("gr_05_reachable", recursive(CHAIN, "r AS (SELECT 1::BIGINT AS node, 0 AS depth UNION SELECT c.dst, r.depth + 1 FROM r JOIN chain c ON r.node = c.src WHERE r.depth < (SELECT count(*) FROM customer))") + "SELECT node, min(depth) AS depth FROM r GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return G.reached(t.chain(), t.spark.createDataFrame([(1,)], "node long"))


@query("gr_05_unreachable", recursive(CHAIN, "r AS (SELECT 1::BIGINT AS node UNION SELECT c.dst FROM r JOIN chain c ON r.node = c.src)") + "SELECT DISTINCT src AS node FROM chain WHERE src NOT IN (SELECT node FROM r)")
def _(t: Tables) -> DataFrame:
    e = t.chain()
    return e.select(F.col("src").alias("node")).distinct().join(G.reached(e, t.spark.createDataFrame([(1,)], "node long")), "node", "left_anti")


@query("gr_07_call_chains", recursive(CHAIN, "w AS (SELECT src AS start, src AS node, [src] AS path, 0 AS depth, false AS over FROM (SELECT DISTINCT src FROM chain) UNION ALL SELECT w.start, c.dst, list_append(w.path, c.dst), w.depth + 1, list_contains(w.path, c.dst) FROM w JOIN chain c ON w.node = c.src WHERE w.depth < 4 AND NOT w.over)") + "SELECT start, array_to_string(path, '>') AS path FROM w WHERE over OR depth = 4 OR node NOT IN (SELECT src FROM chain)")
def _(t: Tables) -> DataFrame:
    e = t.chain()
    return G.chains(t.spark, e, e.select(F.col("src").alias("node")).distinct(), 4)


@query("gr_08_short_cycles", using(CHAIN) + "SELECT a.src || '>' || a.dst AS cycle FROM chain a JOIN chain b ON a.dst = b.src AND b.dst = a.src WHERE a.src < a.dst UNION ALL SELECT a.src || '>' || a.dst || '>' || b.dst FROM chain a JOIN chain b ON a.dst = b.src JOIN chain c ON b.dst = c.src AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst AND a.dst <> b.dst")
def _(t: Tables) -> DataFrame:
    return G.short_cycles(t.chain())


@query("gr_08_cycles")
def _(t: Tables) -> DataFrame:
    return G.cyclic(t.chain())


@query("gr_10_no_outgoing", using(CHAIN) + "SELECT DISTINCT dst AS node FROM chain WHERE dst NOT IN (SELECT src FROM chain)")
def _(t: Tables) -> DataFrame:
    e = t.chain()
    return e.select(F.col("dst").alias("node")).distinct().join(e.select(F.col("src").alias("node")), "node", "left_anti")


@query("gr_11_min_degree", using(EDGES) + ", d AS (SELECT node FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1 HAVING count(*) >= 30) SELECT src, dst, value FROM edges WHERE src IN (SELECT node FROM d) AND dst IN (SELECT node FROM d)")
def _(t: Tables) -> DataFrame:
    e = t.edges()
    return G.induced(e, G.degrees(e).filter("degree >= 30")).select("src", "dst", "value")


@query("gr_12_contraction", using(EDGES) + "SELECT src, dst, CAST(sum(value) AS BIGINT) AS value FROM (SELECT CASE WHEN src LIKE '%7' THEN 'util' ELSE src END AS src, CASE WHEN dst LIKE '%7' THEN 'util' ELSE dst END AS dst, value FROM edges) WHERE src <> dst GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return G.contracted(t.edges(), lambda c: c.endswith("7"), "util")


@query("gr_13_external_clusters", using(EDGES) + "SELECT src, dst, CAST(sum(value) AS BIGINT) AS value FROM (SELECT src, CASE WHEN length(dst) > 4 THEN 'external' ELSE dst END AS dst, value FROM edges) GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return G.contracted(t.edges(), lambda c: c.startswith("p") & (F.length(c) > 4), "external")


@query("gr_14_pipeline", using(EDGES) + ", d AS (SELECT node FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1 ORDER BY count(*) DESC, node LIMIT 60) SELECT src, dst, value FROM edges WHERE src IN (SELECT node FROM d) AND dst IN (SELECT node FROM d)")
def _(t: Tables) -> DataFrame:
    e = t.edges()
    return G.induced(e, G.degrees(e).orderBy(F.desc("degree"), "node").limit(60)).select("src", "dst", "value")


@query("gr_18_taint_reach", recursive(CHAIN, "r AS (SELECT c_custkey AS start, c_custkey AS node, 0 AS depth FROM customer WHERE c_mktsegment = 'BUILDING' UNION SELECT r.start, c.dst, r.depth + 1 FROM r JOIN chain c ON r.node = c.src WHERE r.depth < 5)") + "SELECT start, node AS sink, min(depth) AS depth FROM r WHERE node IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AND depth > 0 GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    e = G.cut(t.chain())
    c = t["customer"].select(F.col("c_custkey").alias("node"), "c_mktsegment", "c_acctbal")
    walk = c.filter("c_mktsegment = 'BUILDING'").select(F.col("node").alias("start"), "node", F.lit(0).alias("depth")).distinct()
    every = walk
    for _ in range(5):
        walk = G.cut(walk.join(e, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth")).distinct())
        every = every.union(walk)
    return every.filter("depth > 0").join(c.filter("c_acctbal < 0"), "node", "left_semi").groupBy("start", F.col("node").alias("sink")).agg(F.min("depth").alias("depth"))


_TERMS = "terms AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(string_split(trim(regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g')), ' ')) AS term FROM documents) WHERE term <> '' GROUP BY 1, 2)"


@query("rag_05_text_search", using(_TERMS) + "SELECT doc_id, CAST(sum(tf) AS BIGINT) AS score, row_number() OVER (ORDER BY sum(tf) DESC, doc_id) AS rank FROM terms WHERE term IN ('the', 'of') GROUP BY doc_id HAVING count(*) = 2 ORDER BY rank LIMIT 20")
def _(t: Tables) -> DataFrame:
    return S.text_search(t["documents"], "the of", 20)


_QUERY = [round(0.1 * ((k * 7) % 11 - 5), 1) for k in range(64)]
_COSINE = f"list_sum(list_transform(list_zip(embedding, {_QUERY}::FLOAT[]), lambda p: CAST(p[1] * p[2] AS DOUBLE))) / (sqrt(list_sum(list_transform(embedding, lambda x: CAST(x * x AS DOUBLE)))) * sqrt(list_sum(list_transform({_QUERY}::FLOAT[], lambda x: CAST(x * x AS DOUBLE)))))"


@query("srt_01_vector_top_k", f"SELECT vec_id, round({_COSINE}, 4) AS score, row_number() OVER (ORDER BY {_COSINE} DESC, vec_id) AS rank FROM embeddings ORDER BY rank LIMIT 10")
def _(t: Tables) -> DataFrame:
    return S.vector_search(t["embeddings"], _QUERY, 10).withColumn("score", F.round("score", 4))


@query("rag_06_hybrid", using(_TERMS) + f", a AS (SELECT doc_id AS key, row_number() OVER (ORDER BY sum(tf) DESC, doc_id) AS r FROM terms WHERE term IN ('the', 'of') GROUP BY doc_id HAVING count(*) = 2 ORDER BY r LIMIT 40), b AS (SELECT vec_id AS key, row_number() OVER (ORDER BY {_COSINE} DESC, vec_id) AS r FROM embeddings ORDER BY r LIMIT 40) SELECT coalesce(a.key, b.key) AS key, round(coalesce(1 / (60 + a.r), 0) + coalesce(1 / (60 + b.r), 0), 8) AS score FROM a FULL JOIN b ON a.key = b.key ORDER BY coalesce(1 / (60 + a.r), 0) + coalesce(1 / (60 + b.r), 0) DESC, 1 LIMIT 20")
def _(t: Tables) -> DataFrame:
    one = S.text_search(t["documents"], "the of", 40).withColumnRenamed("doc_id", "key")
    two = S.vector_search(t["embeddings"], _QUERY, 40).withColumnRenamed("vec_id", "key")
    return S.fused(one, two, 20).withColumn("score", F.round("score", 8))


@query("rag_09_context", "SELECT source, count(*) AS slices, CAST(sum(floor(length(text) / 4)) AS BIGINT) AS tokens FROM documents GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t["documents"].groupBy("source").agg(n().alias("slices"), F.sum(T.estimated_tokens(F.col("text"))).alias("tokens"))
