"""Further joins, aggregations, functions and graph operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import names as N
from quarry.functions import text as T
from quarry.operators import graph as G
from quarry.operators import layers as L
from quarry.operators import retrieval as S
from quarry.operators import issues as I
from quarry.plans.oracle import ASSETS, CHAIN, EDGES, ISSUES, REVIEWED, recursive, using
from quarry.plans.registry import query
from quarry.plans.relational import merged, _MERGED
from quarry.sources.tables import Tables

n = lambda: F.count(F.lit(1))


@query("agg_08_package_graph", "SELECT split_part(l_shipmonth, '-', 1) AS src, l_returnflag AS dst, count(*) AS weight FROM (SELECT strftime(l_shipdate, '%Y-%m') AS l_shipmonth, l_returnflag FROM lineitem) GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return t["lineitem"].groupBy(F.date_format("l_shipdate", "yyyy").alias("src"), F.col("l_returnflag").alias("dst")).agg(n().alias("weight"))


@query("agg_09_module_prefix", using(ASSETS) + "SELECT array_to_string(list_slice(string_split(address, '.'), 1, 3), '.') AS module, count(*) AS n FROM assets GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.assets().groupBy(F.substring_index("address", ".", 3).alias("module")).agg(n().alias("n"))


@query("agg_10_layer_graph", using(EDGES) + ", l AS (SELECT CASE WHEN CAST(substr(src, 2) AS BIGINT) % 3 = 0 THEN 'A' ELSE 'B' END AS a, CASE WHEN CAST(substr(dst, 2) AS BIGINT) % 3 = 0 THEN 'A' ELSE 'B' END AS b FROM edges) SELECT a, b, count(*) AS n FROM l GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    def layer(c: str):
        return F.when(F.substr(F.col(c), F.lit(2)).cast("long") % 3 == 0, "A").otherwise("B")

    return t.edges().groupBy(layer("src").alias("a"), layer("dst").alias("b")).agg(n().alias("n"))


@query("agg_12_debt_breakdown", _MERGED + "SELECT coalesce(CASE WHEN category = 'OTHER' THEN NULL ELSE category END, 'UNKNOWN') AS category, CAST(sum(CASE severity WHEN 'CRITICAL' THEN 30 WHEN 'MAJOR' THEN 15 WHEN 'MINOR' THEN 5 WHEN 'INFO' THEN 1 ELSE 5 END) AS BIGINT) AS minutes FROM merged GROUP BY 1")
def _(t: Tables) -> DataFrame:
    category = F.coalesce(F.nullif(F.col("category"), F.lit("OTHER")), F.lit("UNKNOWN"))
    return merged(t).groupBy(category.alias("category")).agg(F.sum(I.minutes(F.col("severity"))).alias("minutes"))


@query("agg_13_hours", using(ISSUES) + "SELECT rule_key, floor(sum(CASE severity WHEN 'CRITICAL' THEN 60 WHEN 'MAJOR' THEN 30 WHEN 'MINOR' THEN 15 ELSE 5 END) / 60 * 10 + 0.5) / 10 AS hours FROM issues GROUP BY 1")
def _(t: Tables) -> DataFrame:
    s = F.col("severity")
    minutes = F.when(s == "CRITICAL", 60).when(s == "MAJOR", 30).when(s == "MINOR", 15).otherwise(5)
    return t.issues().groupBy("rule_key").agg(T.round_half_up(F.sum(minutes) / 60, 1).alias("hours"))


@query("agg_15_thresholds", using(ISSUES) + "SELECT count(*) FILTER (WHERE severity = 'CRITICAL') <= 0 AS critical_ok, count(*) FILTER (WHERE severity = 'MAJOR') <= 10 AS major_ok, count(*) FILTER (WHERE severity = 'MINOR') <= 5000 AS minor_ok FROM issues")
def _(t: Tables) -> DataFrame:
    s = F.col("severity")
    return t.issues().agg((F.count_if(s == "CRITICAL") <= 0).alias("critical_ok"), (F.count_if(s == "MAJOR") <= 10).alias("major_ok"), (F.count_if(s == "MINOR") <= 5000).alias("minor_ok"))


@query("agg_16_conditional_metrics", "SELECT source, round(100.0 * count(*) FILTER (WHERE lang = 'en') / count(*), 4) AS coverage, round(avg(n_chars), 4) AS mean_size, max(n_chars) AS largest, greatest(0, 100 - 5 * count(*) FILTER (WHERE n_chars < 200)) AS score FROM documents GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t["documents"].groupBy("source").agg(F.round(100.0 * F.count_if(F.col("lang") == "en") / n(), 4).alias("coverage"), F.round(F.avg("n_chars"), 4).alias("mean_size"), F.max("n_chars").alias("largest"), F.greatest(F.lit(0), 100 - 5 * F.count_if(F.col("n_chars") < 200)).alias("score"))


@query("agg_28_alternate_grade", using(ISSUES) + "SELECT doc_id, CASE WHEN count(*) FILTER (WHERE severity = 'CRITICAL') > 0 THEN 'D' WHEN count(*) FILTER (WHERE severity = 'MAJOR') > 2 THEN 'C' WHEN count(*) FILTER (WHERE severity = 'MINOR') > 5 THEN 'C' WHEN count(*) FILTER (WHERE severity IN ('MAJOR', 'MINOR')) > 0 THEN 'B' ELSE 'A' END AS grade FROM issues GROUP BY 1")
def _(t: Tables) -> DataFrame:
    s = F.col("severity")
    grade = F.when(F.count_if(s == "CRITICAL") > 0, "D").when(F.count_if(s == "MAJOR") > 2, "C").when(F.count_if(s == "MINOR") > 5, "C").when(F.count_if(s.isin("MAJOR", "MINOR")) > 0, "B").otherwise("A")
    return t.issues().groupBy("doc_id").agg(grade.alias("grade"))


@query("agg_34_project_type", "SELECT source, CASE WHEN bool_or(contains(text, 'licensed')) THEN 'LICENSED' WHEN bool_or(contains(text, ' | ')) THEN 'TABULAR' ELSE 'PLAIN' END AS kind FROM documents GROUP BY 1")
def _(t: Tables) -> DataFrame:
    x = F.col("text")
    return t["documents"].groupBy("source").agg(F.when(F.bool_or(x.contains("licensed")), "LICENSED").when(F.bool_or(x.contains(" | ")), "TABULAR").otherwise("PLAIN").alias("kind"))


@query("agg_37_mean_latency", "SELECT round(avg(value), 6) AS latency, count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events")
def _(t: Tables) -> DataFrame:
    return t["events"].agg(F.round(F.avg("value"), 6).alias("latency"), n().alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query("fn_02_reciprocal_ranks", "SELECT o_orderkey, round(1 / (60 + row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey)) + 1 / (60 + row_number() OVER (ORDER BY o_orderkey)), 10) AS score FROM orders")
def _(t: Tables) -> DataFrame:
    by_key = S.ranked(t["orders"].select("o_orderkey", "o_totalprice"), "b", "o_orderkey")
    both = S.ranked(by_key, "a", F.desc("o_totalprice"), "o_orderkey")
    return both.select("o_orderkey", F.round(T.reciprocal_rank(F.col("a"), F.col("b")), 10).alias("score"))


_BYTES = "list_transform(range(0, 32, 2), lambda i: CAST(('0x' || substr(md5(text), i + 1, 2))::INTEGER AS DOUBLE))"


@query("fn_09_hash_embedding", f"WITH b AS (SELECT item_id, list_transform({_BYTES}, lambda b: (CASE WHEN b > 127 THEN b - 256 ELSE b END) / 128 - 1) AS v FROM benchmark), s AS (SELECT item_id, v, sqrt(48 * list_sum(list_transform(v, lambda x: x * x))) AS norm FROM b) SELECT item_id, 768 AS size, round(v[1] / norm, 5) AS first, round(v[8] / norm, 5) AS eighth, round(v[16] / norm, 5) AS last FROM s")
def _(t: Tables) -> DataFrame:
    """The vector of every item: its length and some of its numbers, which come round every sixteen."""
    v = t["benchmark"].select("item_id", N.hash_embedding(F.col("text")).alias("v"))
    at = lambda i: F.round(F.get("v", F.lit(i)).cast("double"), 5)
    return v.select("item_id", F.size("v").alias("size"), at(0).alias("first"), at(23).alias("eighth"), at(767).alias("last"))


@query("fn_18_deep_layer", using(ASSETS) + "SELECT doc_id, CASE WHEN address LIKE '%src0.%' THEN 'API' WHEN address LIKE '%src1.%' THEN 'DOMAIN' WHEN address LIKE '%.de.%' THEN 'INFRA' ELSE 'OTHER' END AS layer FROM assets")
def _(t: Tables) -> DataFrame:
    a = F.col("address")
    return t.assets().select("doc_id", N.first_of(("API", a.contains("src0.")), ("DOMAIN", a.contains("src1.")), ("INFRA", a.contains(".de.")), other="OTHER").alias("layer"))


@query("fn_21_camel_words", "SELECT c_custkey, lower(array_to_string(regexp_extract_all(replace(c_name, '#', ''), '[A-Z][a-z]+|[0-9]+'), ' ')) AS words FROM customer")
def _(t: Tables) -> DataFrame:
    return t["customer"].select("c_custkey", F.array_join(N.camel_words(F.replace("c_name", F.lit("#"), F.lit(""))), " ").alias("words"))


@query("fn_22_tags", "SELECT p_partkey, concat_ws(',', CASE WHEN p_size < 10 THEN 'small' END, CASE WHEN p_type LIKE '%STEEL%' THEN 'steel' END, CASE WHEN p_retailprice > 1500 THEN 'dear' END) AS tags FROM part")
def _(t: Tables) -> DataFrame:
    return t["part"].select("p_partkey", F.array_join(N.tags(("small", F.col("p_size") < 10), ("steel", F.col("p_type").contains("STEEL")), ("dear", F.col("p_retailprice") > 1500)), ",").alias("tags"))


@query("fn_23_verbs", "SELECT event_id, CASE event_type WHEN 'click' THEN 'QUERY' WHEN 'purchase' THEN 'COMMAND' WHEN 'signup' THEN 'COMMAND' ELSE 'EVENT' END AS verb FROM events")
def _(t: Tables) -> DataFrame:
    e = F.col("event_type")
    return t["events"].select("event_id", N.first_of(("QUERY", e == "click"), ("COMMAND", e.isin("purchase", "signup")), other="EVENT").alias("verb"))


@query("fn_28_depth", using(ASSETS) + "SELECT doc_id, least(inheritance_depth, 1) AS depth FROM assets")
def _(t: Tables) -> DataFrame:
    return t.assets().select("doc_id", F.least("inheritance_depth", F.lit(1)).alias("depth"))


_KEY = "concat_ws('|', rule_key, coalesce(class_name, ''), coalesce(method, ''), left(message, 50))"


@query("fn_29_issue_keys", using(ISSUES) + f"SELECT DISTINCT {_KEY} AS key FROM issues")
def _(t: Tables) -> DataFrame:
    return t.issues().select(T.issue_key(F.col("rule_key"), F.col("class_name"), F.col("method"), F.col("message")).alias("key")).distinct()


@query("fn_30_location_keys", using(REVIEWED) + "SELECT DISTINCT concat_ws(':', file, CAST(line AS VARCHAR), method) AS location FROM reviewed")
def _(t: Tables) -> DataFrame:
    return t.reviewed().select(T.location_key(F.col("file"), F.col("line"), F.col("method")).alias("location")).distinct()


@query("fn_31_downgrade", using(ISSUES) + "SELECT severity, CASE severity WHEN 'CRITICAL' THEN 'MAJOR' WHEN 'MAJOR' THEN 'MINOR' ELSE 'INFO' END AS lower, count(*) AS n FROM issues GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return t.issues().groupBy("severity", T.downgraded(F.col("severity")).alias("lower")).agg(n().alias("n"))


@query("fn_37_address_class", "SELECT page_id, CASE WHEN url LIKE 'https://www.%' THEN 'INTERNAL' WHEN url LIKE '%example.net%' THEN 'JDK' ELSE 'THIRD_PARTY' END AS kind FROM pages")
def _(t: Tables) -> DataFrame:
    u = F.col("url")
    return t["pages"].select("page_id", N.first_of(("INTERNAL", u.startswith("https://www.")), ("JDK", u.contains("example.net")), other="THIRD_PARTY").alias("kind"))


@query("fn_38_node_size", using(EDGES) + ", d AS (SELECT node, count(*) AS k FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1) SELECT node, round(8 + least(k, 50) / 50 * 22, 6) AS size FROM d")
def _(t: Tables) -> DataFrame:
    return G.degrees(t.edges()).select("node", F.round(8 + F.least("degree", F.lit(50)) / 50 * 22, 6).alias("size"))


@query("fn_39_routes", "SELECT page_id, '/' || regexp_extract(url, '^https?://[^/]+/([^#?]*)', 1) AS route FROM pages")
def _(t: Tables) -> DataFrame:
    return t["pages"].select("page_id", F.concat(F.lit("/"), F.regexp_extract("url", "^https?://[^/]+/([^#?]*)", 1)).alias("route"))


@query("fn_40_content_type", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'text/html' WHEN 1 THEN 'application/json' WHEN 2 THEN 'text/css' ELSE 'application/octet-stream' END AS type FROM part")
def _(t: Tables) -> DataFrame:
    suffix = F.element_at(F.array(*map(F.lit, ("a.html", "b.json", "c.css", "d"))), (F.col("p_size") % 4 + 1).cast("int"))
    return t["part"].select("p_partkey", N.content_type(suffix).alias("type"))


@query("fn_44_summary", "SELECT c_custkey, concat_ws(', ', CASE WHEN c_acctbal < 0 THEN 'in debt' END, CASE WHEN c_nationkey < 5 THEN 'near' END, 'of ' || c_mktsegment) AS summary FROM customer")
def _(t: Tables) -> DataFrame:
    parts = F.array_compact(F.array(F.when(F.col("c_acctbal") < 0, "in debt"), F.when(F.col("c_nationkey") < 5, "near"), F.concat(F.lit("of "), "c_mktsegment")))
    return t["customer"].select("c_custkey", F.array_join(parts, ", ").alias("summary"))


@query("gr_06_paths_to_exit", recursive(CHAIN, "w AS (SELECT 2::BIGINT AS node, [2::BIGINT] AS path UNION ALL SELECT c.dst, list_append(w.path, c.dst) FROM w JOIN chain c ON w.node = c.src WHERE len(w.path) < 6 AND w.node % 10 <> 9 AND NOT list_contains(w.path, c.dst))") + "SELECT array_to_string(path, '>') AS path FROM w WHERE node % 10 = 9")
def _(t: Tables) -> DataFrame:
    return G.paths_to(t.spark, t.chain(), 2, "node % 10 = 9", 6)


@query("gr_09_longest_path")
def _(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(G.longest_path(t.chain(), 7),)], "length int")


@query("gr_15_asset_graph", using(EDGES, "nodes AS (SELECT 's' || s_suppkey AS id, CASE WHEN s_acctbal < 0 THEN 'D' ELSE 'A' END AS grade FROM supplier)") + "SELECT grade, count(*) AS links, CAST(sum(value) AS BIGINT) AS weight FROM edges JOIN nodes ON src = id GROUP BY 1")
def _(t: Tables) -> DataFrame:
    nodes = t["supplier"].select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.when(F.col("s_acctbal") < 0, "D").otherwise("A").alias("grade"))
    return t.edges().join(nodes, "src").groupBy("grade").agg(n().alias("links"), F.sum("value").alias("weight"))


@query("gr_16_adjacency", using(CHAIN) + "SELECT src AS node, count(*) AS out, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS targets FROM chain GROUP BY 1")
def _(t: Tables) -> DataFrame:
    targets = F.array_join(F.transform(F.array_sort(F.collect_list("dst")), lambda x: x.cast("string")), ",")
    return t.chain().groupBy(F.col("src").alias("node")).agg(n().alias("out"), targets.alias("targets"))


@query("gr_17_flagged_calls", using(CHAIN) + "SELECT src, dst, (src % 3 = 0 AND dst % 3 = 2) AS violation FROM chain")
def _(t: Tables) -> DataFrame:
    return t.chain().select("src", "dst", ((F.col("src") % 3 == 0) & (F.col("dst") % 3 == 2)).alias("violation"))


@query("gr_21_def_use", "SELECT event_id AS use_at, max(d) AS def_at FROM (SELECT event_id, user_id, max(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS d, event_type FROM events) WHERE event_type = 'click' AND d IS NOT NULL GROUP BY 1")
def _(t: Tables) -> DataFrame:
    before = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("event_type") == "signup", F.col("event_id"))).over(before)
    return t["events"].withColumn("def_at", last).filter("event_type = 'click' and def_at is not null").select(F.col("event_id").alias("use_at"), "def_at")


@query("join_05_table_entity", "SELECT 'part_' || s_suppkey AS table_name, 'Part' || p_partkey AS entity FROM supplier JOIN part ON contains(lower('Part' || p_partkey), 'part' || s_suppkey)")
def _(t: Tables) -> DataFrame:
    """Tables to the entities whose simple name is the table's in CamelCase, or holds it without its underscores; every match."""
    tables = t["supplier"].select(F.concat(F.lit("part_"), "s_suppkey").alias("table_name"))
    return L.table_entities(tables, t["part"].select(F.concat(F.lit("Part"), "p_partkey").alias("entity")))


@query("join_10_two_stage_lookup", "SELECT l.page_id, coalesce(a.page_id, b.page_id) AS target FROM (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, url FROM pages) l LEFT JOIN (SELECT url, min(page_id) AS page_id FROM pages WHERE page_id % 2 = 0 GROUP BY 1) a ON l.url = a.url LEFT JOIN (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, min(page_id) AS page_id FROM pages GROUP BY 1) b ON l.host = b.host")
def _(t: Tables) -> DataFrame:
    p = t["pages"].select("page_id", "url", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))
    exact = p.filter("page_id % 2 = 0").groupBy("url").agg(F.min("page_id").alias("a"))
    near = p.groupBy("host").agg(F.min("page_id").alias("b"))
    return p.join(exact, "url", "left").join(near, "host", "left").select("page_id", F.coalesce("a", "b").alias("target"))


@query("join_12_injections", using(EDGES) + "SELECT e.src, e.dst FROM edges e JOIN supplier ON src = 's' || s_suppkey JOIN part ON dst = 'p' || p_partkey WHERE s_nationkey = 3 AND p_size > 40")
def _(t: Tables) -> DataFrame:
    s = t["supplier"].filter("s_nationkey = 3").select(F.concat(F.lit("s"), "s_suppkey").alias("src"))
    p = t["part"].filter("p_size > 40").select(F.concat(F.lit("p"), "p_partkey").alias("dst"))
    return t.edges().join(s, "src", "left_semi").join(p, "dst", "left_semi").select("src", "dst")


@query("join_21_first_slice", "SELECT o_orderkey, l_linenumber, l_partkey FROM (SELECT o_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey) AS rn FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 25) WHERE rn = 1")
def _(t: Tables) -> DataFrame:
    item = t["lineitem"].filter("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    first = item.groupBy("o_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey")).alias("f"))
    return first.join(t["orders"].select("o_orderkey"), "o_orderkey", "left_semi").select("o_orderkey", "f.*")


@query("join_27_internal_edges", using(CHAIN) + "SELECT src, dst FROM (SELECT src, dst FROM chain UNION SELECT c_custkey, c_nationkey FROM customer) WHERE dst IN (SELECT s_suppkey FROM supplier)")
def _(t: Tables) -> DataFrame:
    both = t.chain().union(t["customer"].select("c_custkey", F.col("c_nationkey").cast("long"))).distinct()
    return both.join(t["supplier"].select(F.col("s_suppkey").alias("dst")), "dst", "left_semi").select("src", "dst")


@query("snk_01_module_json", using(ASSETS) + "SELECT module, count(*) AS files, '{\"module\":\"' || module || '\",\"files\":' || count(*) || '}' AS json FROM assets GROUP BY 1")
def _(t: Tables) -> DataFrame:
    counted = t.assets().groupBy("module").agg(n().alias("files"))
    return counted.select("module", "files", F.to_json(F.struct("module", "files")).alias("json"))


@query("snk_03_report_cards", using(ISSUES) + "SELECT severity, '<b>' || severity || '</b>: ' || count(*) AS card FROM issues GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.issues().groupBy("severity").agg(n().alias("n")).select("severity", F.format_string("<b>%s</b>: %d", "severity", "n").alias("card"))


@query("snk_04_check_json", using(ISSUES) + "SELECT CASE WHEN count(*) FILTER (WHERE severity = 'CRITICAL') > 0 THEN 'failure' ELSE 'success' END AS conclusion, '{\"total\":' || count(*) || '}' AS output FROM issues")
def _(t: Tables) -> DataFrame:
    total = t.issues().agg(F.count_if(F.col("severity") == "CRITICAL").alias("critical"), n().alias("total"))
    return total.select(F.when(F.col("critical") > 0, "failure").otherwise("success").alias("conclusion"), F.to_json(F.struct("total")).alias("output"))


@query("set_05_ungrouped", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def _(t: Tables) -> DataFrame:
    return t["customer"].select("c_custkey").distinct().join(t["orders"].filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("srt_03_text_rank", "SELECT doc_id, CAST((length(text) - length(replace(lower(text), 'tion', ''))) / 4 AS BIGINT) AS score FROM documents ORDER BY score DESC, doc_id LIMIT 25")
def _(t: Tables) -> DataFrame:
    return t["documents"].select("doc_id", T.term_frequency(F.col("text"), F.lit("tion")).cast("long").alias("score")).orderBy(F.desc("score"), "doc_id").limit(25)


@query("srt_09_top_nodes", using(EDGES) + ", d AS (SELECT src AS node, sum(value) AS w FROM edges GROUP BY 1 ORDER BY w DESC, node LIMIT 15) SELECT src, dst, value FROM edges WHERE src IN (SELECT node FROM d)")
def _(t: Tables) -> DataFrame:
    e = t.edges()
    top = e.groupBy("src").agg(F.sum("value").alias("w")).orderBy(F.desc("w"), "src").limit(15)
    return e.join(top, "src", "left_semi").select("src", "dst", "value")


@query("srt_12_display_limits", using(ASSETS) + "SELECT address FROM assets WHERE kind = 'CLASS' ORDER BY address LIMIT 50")
def _(t: Tables) -> DataFrame:
    return t.assets().filter("kind = 'CLASS'").select("address").orderBy("address").limit(50)


@query("str_06_incremental", "SELECT doc_id, sha256(text) AS hash FROM documents WHERE doc_id % 9 = 0")
def _(t: Tables) -> DataFrame:
    now = t["documents"].select("doc_id", F.sha2("text", 256).alias("hash"))
    return now.join(now.filter("doc_id % 9 != 0"), ["doc_id", "hash"], "left_anti")


@query("rag_03_derived_query", using(ISSUES) + "SELECT doc_id, rule_key, trim(regexp_replace(lower(message || ' ' || coalesce(method, class_name)), '[^a-z0-9]+', ' ', 'g')) AS q FROM issues")
def _(t: Tables) -> DataFrame:
    said = F.concat_ws(" ", "message", F.coalesce("method", "class_name"))
    return t.issues().select("doc_id", "rule_key", F.trim(F.regexp_replace(F.lower(said), "[^a-z0-9]+", " ")).alias("q"))


@query("rag_10_fingerprint_skip", "SELECT count(*) AS files, count(DISTINCT sha256(text)) AS reviewed, count(*) - count(DISTINCT sha256(text)) AS skipped FROM documents")
def _(t: Tables) -> DataFrame:
    counted = t["documents"].groupBy(F.sha2("text", 256).alias("h")).agg(n().alias("k"))
    return counted.agg(F.sum("k").alias("files"), n().alias("reviewed"), (F.sum("k") - n()).alias("skipped"))


@query("rul_12_complexity_issues", using(ASSETS) + "SELECT doc_id, CASE WHEN cyclomatic_complexity > 50 THEN 'too complex' ELSE 'complex' END AS issue FROM assets WHERE cyclomatic_complexity > 10")
def _(t: Tables) -> DataFrame:
    return t.assets().filter("cyclomatic_complexity > 10").select("doc_id", F.when(F.col("cyclomatic_complexity") > 50, "too complex").otherwise("complex").alias("issue"))
