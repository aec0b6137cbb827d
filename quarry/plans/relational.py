"""Filters, projections, joins, aggregations, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import issues as I
from quarry.operators import rules as R
from quarry.plans.oracle import ASSETS, EDGES, ISSUES, REVIEWED, using
from quarry.plans.registry import query
from quarry.sources.tables import Tables

n = lambda: F.count(F.lit(1))


@query("flt_01_asset_filter", using(ASSETS) + "SELECT address, kind, method_count FROM assets WHERE (contains(lower(address), 'src1') OR contains(lower(body), 'thand')) AND kind IN ('CLASS', 'ENUM') AND method_count BETWEEN 1 AND 8")
def _(t: Tables) -> DataFrame:
    a = t.assets()
    keyword = F.lower("address").contains("src1") | F.lower("body").contains("thand")
    return a.filter(keyword & F.col("kind").isin("CLASS", "ENUM") & F.col("method_count").between(1, 8)).select("address", "kind", "method_count")


@query("flt_02_line_filter", "SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: contains(lower(x), 'the ') AND length(x) > 200)) AS BIGINT) AS hits FROM documents")
def _(t: Tables) -> DataFrame:
    held = F.filter(F.split("text", "\n"), lambda x: F.lower(x).contains("the ") & (F.length(x) > 200))
    return t["documents"].select("doc_id", F.size(held).cast("long").alias("hits"))


@query("flt_03_search_lines", "SELECT doc_id, array_to_string(list_filter(string_split(text, ' '), lambda x: contains(x, 'thha')), ' ') AS found FROM documents WHERE len(list_filter(string_split(text, ' '), lambda x: contains(x, 'thha'))) > 0 OR contains(source, '7')")
def _(t: Tables) -> DataFrame:
    found = F.filter(F.split("text", " "), lambda x: x.contains("thha"))
    return t["documents"].filter((F.size(found) > 0) | F.col("source").contains("7")).select("doc_id", F.array_join(found, " ").alias("found"))


@query("flt_04_filter_stats", using(ASSETS) + "SELECT count(*) AS original, count(*) FILTER (WHERE kind = 'CLASS') AS filtered, round(100.0 - 100.0 * count(*) FILTER (WHERE kind = 'CLASS') / count(*), 4) AS reduction FROM assets")
def _(t: Tables) -> DataFrame:
    kept = F.count_if(F.col("kind") == "CLASS")
    return t.assets().agg(n().alias("original"), kept.alias("filtered"), F.round(100.0 - 100.0 * kept / n(), 4).alias("reduction"))


@query("flt_05_confidence_bucket", using(REVIEWED) + "SELECT doc_id, severity, confidence FROM reviewed WHERE confidence IS NULL OR (confidence >= 0.7 AND confidence < 0.9)")
def _(t: Tables) -> DataFrame:
    c = F.col("confidence")
    return t.reviewed().filter(c.isNull() | ((c >= 0.7) & (c < 0.9))).select("doc_id", "severity", "confidence")


@query("flt_06_high_confidence", using(REVIEWED) + "SELECT doc_id, confidence FROM reviewed WHERE confidence >= 0.9")
def _(t: Tables) -> DataFrame:
    return t.reviewed().filter("confidence >= 0.9").select("doc_id", "confidence")


@query("flt_07_severity_default", "SELECT event_id, CASE event_type WHEN 'error' THEN 'CRITICAL' WHEN 'purchase' THEN NULL ELSE 'MAJOR' END AS severity FROM events WHERE coalesce(CASE event_type WHEN 'error' THEN 'CRITICAL' WHEN 'purchase' THEN NULL ELSE 'MAJOR' END, 'MINOR') = 'MINOR'")
def _(t: Tables) -> DataFrame:
    severity = F.when(F.col("event_type") == "error", "CRITICAL").when(F.col("event_type") == "purchase", None).otherwise("MAJOR")
    return t["events"].select("event_id", severity.alias("severity")).filter(F.coalesce("severity", F.lit("MINOR")) == "MINOR")


@query("flt_08_visible_links", using(EDGES) + "SELECT src, dst, value FROM edges WHERE src IN (SELECT 's' || s_suppkey FROM supplier WHERE s_acctbal > 5000) AND dst IN (SELECT 'p' || p_partkey FROM part WHERE p_size < 10)")
def _(t: Tables) -> DataFrame:
    one = t["supplier"].filter("s_acctbal > 5000").select(F.concat(F.lit("s"), "s_suppkey").alias("src"))
    two = t["part"].filter("p_size < 10").select(F.concat(F.lit("p"), "p_partkey").alias("dst"))
    return t.edges().join(one, "src", "left_semi").join(two, "dst", "left_semi").select("src", "dst", "value")


@query("flt_09_relation_filter", using(EDGES) + "SELECT src, dst, value FROM edges WHERE value >= 2")
def _(t: Tables) -> DataFrame:
    return t.edges().filter("value >= 2")


@query("flt_10_rule_config", using(ISSUES) + ", config AS (SELECT * FROM (VALUES ('DOC-TABLE', false, NULL), ('DOC-SHORT', true, 'INFO')) AS c(rule_key, enabled, severity)) SELECT i.rule_key, coalesce(c.severity, i.severity) AS severity, count(*) AS n FROM issues i LEFT JOIN config c ON i.rule_key = c.rule_key WHERE coalesce(c.enabled, true) GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    config = t.spark.createDataFrame([("DOC-TABLE", False, None), ("DOC-SHORT", True, "INFO")], "rule_key string, enabled boolean, own string")
    joined = t.issues().join(F.broadcast(config), "rule_key", "left").filter(F.coalesce("enabled", F.lit(True)))  # the catalogue has a fixed number of rules
    return joined.groupBy("rule_key", F.coalesce("own", "severity").alias("severity")).agg(n().alias("n"))


@query("flt_12_include_exclude", using(ISSUES) + "SELECT rule_key, count(*) AS n FROM issues WHERE rule_key NOT IN ('DOC-LONG') AND rule_key IN ('DOC-LONG', 'DOC-SHOUT', 'DOC-TABLE') GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.issues().filter(~F.col("rule_key").isin("DOC-LONG") & F.col("rule_key").isin("DOC-LONG", "DOC-SHOUT", "DOC-TABLE")).groupBy("rule_key").agg(n().alias("n"))


@query("flt_14_complex_top", using(ASSETS) + "SELECT address, cyclomatic_complexity FROM assets WHERE cyclomatic_complexity > 10 ORDER BY cyclomatic_complexity DESC, address LIMIT 5")
def _(t: Tables) -> DataFrame:
    return t.assets().filter("cyclomatic_complexity > 10").orderBy(F.desc("cyclomatic_complexity"), "address").limit(5).select("address", "cyclomatic_complexity")


@query("prj_01_normalise_paths", using(ISSUES) + "SELECT DISTINCT substr(file, instr(file, '/src/main/java/') + 1) AS path, 1.0::DOUBLE AS confidence FROM issues")
def _(t: Tables) -> DataFrame:
    return t.issues().select(T.relative_path(F.col("file")).alias("path"), F.lit(1.0).alias("confidence")).distinct()


@query("prj_02_auto_filtered", using(REVIEWED) + "SELECT doc_id, coalesce(confidence < 0.5, false) AS auto_filtered FROM reviewed")
def _(t: Tables) -> DataFrame:
    return t.reviewed().select("doc_id", F.coalesce(F.col("confidence") < 0.5, F.lit(False)).alias("auto_filtered"))


@query("prj_05_confidence_level", using(REVIEWED) + "SELECT CASE WHEN confidence >= 0.9 THEN 'HIGH' WHEN confidence >= 0.7 THEN 'MEDIUM' WHEN confidence >= 0.5 THEN 'LOW' ELSE 'FILTERED' END AS level, count(*) AS n FROM reviewed GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.reviewed().groupBy(T.confidence_level(F.col("confidence")).alias("level")).agg(n().alias("n"))


@query("prj_06_links", "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS link FROM pages")
def _(t: Tables) -> DataFrame:
    return t["pages"].select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("link"))


@query("prj_07_edge_union", "SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'EXTENDS' AS type FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'DEPENDS_ON' FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'IMPLEMENTS' FROM supplier")
def _(t: Tables) -> DataFrame:
    def edge(table: str, a: str, x: str, b: str, y: str, kind: str) -> DataFrame:
        return t[table].select(F.concat(F.lit(a), F.col(x).cast("string")).alias("src"), F.concat(F.lit(b), F.col(y).cast("string")).alias("dst"), F.lit(kind).alias("type"))

    return edge("nation", "n", "n_nationkey", "r", "n_regionkey", "EXTENDS").unionByName(edge("customer", "c", "c_custkey", "n", "c_nationkey", "DEPENDS_ON")).unionByName(edge("supplier", "s", "s_suppkey", "n", "s_nationkey", "IMPLEMENTS"))


@query("prj_10_segmentation", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'state' WHEN p_type LIKE '%BRASS%' THEN 'component' ELSE 'external' END AS segment FROM part")
def _(t: Tables) -> DataFrame:
    return t["part"].select("p_partkey", F.when(F.col("p_size") < 10, "state").when(F.col("p_type").contains("BRASS"), "component").otherwise("external").alias("segment"))


_MERGED = (
    using(ISSUES, REVIEWED)
    + """, s AS (SELECT * FROM (SELECT concat_ws(':', substr(file, instr(file, '/src/main/java/') + 1), CAST(line AS VARCHAR), method) AS location, *, row_number() OVER (PARTITION BY concat_ws(':', substr(file, instr(file, '/src/main/java/') + 1), CAST(line AS VARCHAR), method) ORDER BY rule_key DESC) AS rn FROM issues) WHERE rn = 1),
r AS (SELECT * FROM (SELECT concat_ws(':', file, CAST(line AS VARCHAR), method) AS location, *, row_number() OVER (PARTITION BY concat_ws(':', file, CAST(line AS VARCHAR), method) ORDER BY doc_id DESC) AS rn FROM reviewed) WHERE rn = 1),
j AS (SELECT coalesce(s.location, r.location) AS location, CASE WHEN s.location IS NULL THEN 'ai' WHEN r.location IS NULL THEN 'static' ELSE 'merged' END AS origin, coalesce(s.severity, r.severity) AS severity, coalesce(s.category, 'OTHER') AS category, s.rule_key, CASE WHEN r.location IS NULL THEN 1.0 ELSE r.confidence END AS confidence, r.suggestion FROM s FULL JOIN r ON s.location = r.location),
merged AS (SELECT *, CASE WHEN origin = 'static' THEN false ELSE coalesce(confidence < 0.5, false) END AS auto_filtered FROM j WHERE origin <> 'ai' OR confidence >= 0.5) """
)


def merged(t: Tables) -> DataFrame:
    static = t.issues().withColumn("file", T.relative_path(F.col("file")))
    return I.merge(I.last_of_location(static, "rule_key"), I.last_of_location(t.reviewed(), "doc_id"))


@query("join_01_merge_issues", _MERGED + "SELECT location, origin, severity, category, rule_key, confidence, suggestion, auto_filtered FROM merged")
def _(t: Tables) -> DataFrame:
    return merged(t)


@query("join_03_latest_reports", "SELECT c_custkey, c_name, o_orderkey, o_orderstatus FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' WHERE c_mktsegment = 'BUILDING'")
def _(t: Tables) -> DataFrame:
    o = t["orders"].filter("o_orderstatus = 'F'")
    return t["customer"].filter("c_mktsegment = 'BUILDING'").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", "o_orderkey", "o_orderstatus")


@query("join_04_suffix_match", using(ASSETS) + ", ns AS (SELECT 'Doc' || (doc_id * 3) AS name, doc_id AS k FROM documents) SELECT k, min(address) AS address FROM ns JOIN assets ON address = name OR address LIKE '%.' || name GROUP BY k")
def _(t: Tables) -> DataFrame:
    names = t["documents"].select(F.concat(F.lit("Doc"), (F.col("doc_id") * 3).cast("string")).alias("suffix"), F.col("doc_id").alias("k"))
    parts = F.split("address", "[.]")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    wide = t.assets().select("address", F.explode(suffixes).alias("suffix"))  # the theta join as an equi-join
    return names.join(wide, "suffix").groupBy("k").agg(F.min("address").alias("address"))


@query("join_07_layer_violation", using(EDGES) + ", a AS (SELECT 's' || s_suppkey AS id, CASE WHEN s_nationkey % 3 = 0 THEN 'UI' WHEN s_nationkey % 3 = 1 THEN 'SERVICE' ELSE 'DATA' END AS layer FROM supplier), b AS (SELECT 'p' || p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'UI' WHEN p_size % 3 = 1 THEN 'SERVICE' ELSE 'DATA' END AS layer FROM part) SELECT a.layer AS from_layer, b.layer AS to_layer, count(*) AS n FROM edges JOIN a ON src = a.id JOIN b ON dst = b.id WHERE a.layer <> b.layer AND a.layer || b.layer NOT IN ('UISERVICE', 'SERVICEDATA') GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    def layer(c: str):
        return F.when(F.col(c) % 3 == 0, "UI").when(F.col(c) % 3 == 1, "SERVICE").otherwise("DATA")

    one = t["supplier"].select(F.concat(F.lit("s"), "s_suppkey").alias("src"), layer("s_nationkey").alias("from_layer"))
    two = t["part"].select(F.concat(F.lit("p"), "p_partkey").alias("dst"), layer("p_size").alias("to_layer"))
    allowed = t.spark.createDataFrame([("UI", "SERVICE"), ("SERVICE", "DATA")], "from_layer string, to_layer string")
    return t.edges().join(one, "src").join(two, "dst").filter("from_layer != to_layer").join(F.broadcast(allowed), ["from_layer", "to_layer"], "left_anti").groupBy("from_layer", "to_layer").agg(n().alias("n"))


@query("join_11_missing", "SELECT DISTINCT 'Part' || l_partkey AS name FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)")
def _(t: Tables) -> DataFrame:
    known = t["part"].filter("p_size > 5").select(F.col("p_partkey").alias("l_partkey"))
    return t["lineitem"].select("l_partkey").distinct().join(known, "l_partkey", "left_anti").select(F.concat(F.lit("Part"), "l_partkey").alias("name"))


_KEY = "concat_ws('|', rule_key, coalesce(class_name, ''), coalesce(method, ''), left(message, 50))"


@query("join_13_baseline", using(ISSUES) + f"SELECT rule_key, count(*) AS n FROM issues WHERE {_KEY} NOT IN (SELECT {_KEY} FROM issues WHERE doc_id % 3 = 0) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    key = T.issue_key(F.col("rule_key"), F.col("class_name"), F.col("method"), F.col("message"))
    baseline = t.issues().filter("doc_id % 3 = 0").select(key.alias("key"))
    return I.not_suppressed(t.issues(), baseline).groupBy("rule_key").agg(n().alias("n"))


@query("join_14_delta", using(ISSUES) + f", cur AS (SELECT DISTINCT {_KEY} AS key, rule_key FROM issues WHERE doc_id % 4 <> 0), old AS (SELECT DISTINCT {_KEY} AS key, rule_key FROM issues WHERE doc_id % 5 <> 0) SELECT 'new' AS change, rule_key, count(*) AS n FROM cur WHERE key NOT IN (SELECT key FROM old) GROUP BY 2 UNION ALL SELECT 'fixed', rule_key, count(*) FROM old WHERE key NOT IN (SELECT key FROM cur) GROUP BY 2")
def _(t: Tables) -> DataFrame:
    changed = I.delta(t.issues(), F.col("doc_id") % 4 != 0, F.col("doc_id") % 5 != 0)
    return changed.groupBy("change", "rule_key").agg(n().alias("n"))


@query("join_15_changed_files", "SELECT d.doc_id, CASE WHEN c.hash IS NULL THEN 'added' ELSE 'changed' END AS change FROM (SELECT doc_id, sha256(text) AS hash FROM documents) d LEFT JOIN (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS hash FROM documents WHERE doc_id % 10 <> 0) c ON d.doc_id = c.doc_id WHERE c.hash IS NULL OR c.hash <> d.hash")
def _(t: Tables) -> DataFrame:
    d = t["documents"]
    now = d.select("doc_id", F.sha2("text", 256).alias("hash"))
    cached = d.filter("doc_id % 10 != 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("cached"))
    return now.join(cached, "doc_id", "left").filter(F.col("cached").isNull() | (F.col("cached") != F.col("hash"))).select("doc_id", F.when(F.col("cached").isNull(), "added").otherwise("changed").alias("change"))


@query("join_16_cache_merge", "SELECT doc_id, source, 'cached' AS origin FROM documents WHERE doc_id % 4 <> 0 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) UNION ALL SELECT doc_id, source, 'new' FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(t: Tables) -> DataFrame:
    changed = t["labels"].filter("toxic = 1").select("doc_id")
    d = t["documents"].select("doc_id", "source")
    old = d.filter("doc_id % 4 != 0").join(changed, "doc_id", "left_anti").withColumn("origin", F.lit("cached"))
    return old.unionByName(d.join(changed, "doc_id", "left_semi").withColumn("origin", F.lit("new")))


@query("join_17_quality_on_nodes", using(ASSETS, ISSUES) + "SELECT address, coalesce(c, 0) AS critical, coalesce(m, 0) AS major, CASE WHEN c > 0 THEN 'D' WHEN m > 0 THEN 'C' WHEN k > 0 THEN 'B' ELSE 'A' END AS grade FROM assets LEFT JOIN (SELECT doc_id, count(*) FILTER (WHERE severity = 'CRITICAL') AS c, count(*) FILTER (WHERE severity = 'MAJOR') AS m, count(*) FILTER (WHERE severity = 'MINOR') AS k FROM issues GROUP BY 1) q USING (doc_id)")
def _(t: Tables) -> DataFrame:
    s = F.col("severity")
    q = t.issues().groupBy("doc_id").agg(F.count_if(s == "CRITICAL").alias("c"), F.count_if(s == "MAJOR").alias("m"), F.count_if(s == "MINOR").alias("k"))
    grade = F.when(F.col("c") > 0, "D").when(F.col("m") > 0, "C").when(F.col("k") > 0, "B").otherwise("A")
    return t.assets().select("address", "doc_id").join(q, "doc_id", "left").select("address", F.coalesce("c", F.lit(0)).alias("critical"), F.coalesce("m", F.lit(0)).alias("major"), grade.alias("grade"))


@query("join_20_range_join", "SELECT o_orderkey, min(l_linenumber) AS line FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND o_totalprice / 100 BETWEEN l_quantity * 10 - 50 AND l_quantity * 10 + 50 GROUP BY 1")
def _(t: Tables) -> DataFrame:
    o, item = t["orders"], t["lineitem"]
    near = (F.col("o_totalprice") / 100).between(F.col("l_quantity") * 10 - 50, F.col("l_quantity") * 10 + 50)
    return o.join(item, (F.col("o_orderkey") == F.col("l_orderkey")) & near).groupBy("o_orderkey").agg(F.min("l_linenumber").alias("line"))


@query("join_22_package_links", "SELECT s_nationkey AS src, p_size AS dst, count(DISTINCT l_suppkey) AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    joined = t["lineitem"].select("l_suppkey", "l_partkey").join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey")).join(t["part"], F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy(F.col("s_nationkey").alias("src"), F.col("p_size").alias("dst")).agg(F.countDistinct("l_suppkey").alias("value"))


@query("join_24_orphans", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) ORDER BY c_custkey LIMIT 10")
def _(t: Tables) -> DataFrame:
    return t["customer"].select("c_custkey").join(t["orders"].select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").orderBy("c_custkey").limit(10)


@query("join_26_fingerprint_lookup", "SELECT fp, count(*) - 1 AS hits FROM (SELECT left(sha256(text), 16) AS fp FROM documents) GROUP BY fp HAVING count(*) > 1")
def _(t: Tables) -> DataFrame:
    return t["documents"].groupBy(F.left(F.sha2("text", 256), F.lit(16)).alias("fp")).agg((n() - 1).alias("hits")).filter("hits > 0")


@query("agg_01_report_summary", _MERGED + "SELECT count(*) AS total, count(*) FILTER (WHERE origin = 'static') AS static, count(*) FILTER (WHERE origin = 'ai') AS ai, count(*) FILTER (WHERE origin = 'merged') AS merged, count(*) FILTER (WHERE auto_filtered) AS hidden, count(*) FILTER (WHERE NOT auto_filtered AND severity = 'CRITICAL') AS critical, floor(avg(coalesce(confidence, 0)) FILTER (WHERE origin <> 'static') * 100 + 0.5) / 100 AS avg_confidence FROM merged")
def _(t: Tables) -> DataFrame:
    o, shown = F.col("origin"), ~F.col("auto_filtered")
    review = F.avg(F.when(o != "static", F.coalesce("confidence", F.lit(0.0))))
    return merged(t).agg(n().alias("total"), F.count_if(o == "static").alias("static"), F.count_if(o == "ai").alias("ai"), F.count_if(o == "merged").alias("merged"), F.count_if("auto_filtered").alias("hidden"), F.count_if(shown & (F.col("severity") == "CRITICAL")).alias("critical"), T.round_half_up(review, 2).alias("avg_confidence"))


@query("agg_02_rule_summary", using(ISSUES) + ", s AS (SELECT * FROM (VALUES ('CRITICAL'), ('MAJOR'), ('MINOR'), ('INFO')) AS x(severity)) SELECT s.severity, count(i.rule_key) AS n FROM s LEFT JOIN issues i ON s.severity = i.severity GROUP BY 1")
def _(t: Tables) -> DataFrame:
    every = t.spark.createDataFrame([(s,) for s in I.MINUTES], "severity string")
    counted = t.issues().groupBy("severity").agg(n().alias("n"))
    return every.join(counted, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


@query("agg_03_pipeline_summary", using(ISSUES) + "SELECT count(*) AS total, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical, count(*) FILTER (WHERE severity = 'MAJOR') AS major, count(*) FILTER (WHERE severity = 'MINOR') AS minor, count(*) FILTER (WHERE category = 'BUG') AS bugs, count(*) FILTER (WHERE category = 'SECURITY') AS security FROM issues")
def _(t: Tables) -> DataFrame:
    s, c = F.col("severity"), F.col("category")
    return t.issues().agg(n().alias("total"), F.count_if(s == "CRITICAL").alias("critical"), F.count_if(s == "MAJOR").alias("major"), F.count_if(s == "MINOR").alias("minor"), F.count_if(c == "BUG").alias("bugs"), F.count_if(c == "SECURITY").alias("security"))


@query("agg_04_project_metrics", using(ASSETS) + "SELECT count(*) AS classes, CAST(sum(method_count) AS BIGINT) AS methods, round(sum(method_count) / count(*), 6) AS avg_method_length, round(sum(comment_lines) / greatest(sum(lines_of_code), 1), 6) AS comment_ratio, round(avg(cyclomatic_complexity), 6) AS avg_complexity, max(cyclomatic_complexity) AS max_complexity, max(inheritance_depth) AS max_depth, count(*) FILTER (WHERE kind = 'INTERFACE') AS interfaces FROM assets")
def _(t: Tables) -> DataFrame:
    return t.assets().agg(n().alias("classes"), F.sum("method_count").alias("methods"), F.round(F.sum("method_count") / n(), 6).alias("avg_method_length"), F.round(F.sum("comment_lines") / F.greatest(F.sum("lines_of_code"), F.lit(1)), 6).alias("comment_ratio"), F.round(F.avg("cyclomatic_complexity"), 6).alias("avg_complexity"), F.max("cyclomatic_complexity").alias("max_complexity"), F.max("inheritance_depth").alias("max_depth"), F.count_if(F.col("kind") == "INTERFACE").alias("interfaces"))


@query("agg_05_fan_in_out", using(EDGES) + "SELECT node, CAST(sum(o) AS BIGINT) AS fan_out, CAST(sum(i) AS BIGINT) AS fan_in FROM (SELECT src AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    e = t.edges()
    both = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(e.select("dst", F.lit(0), F.lit(1)))
    return both.groupBy("node").agg(F.sum("o").alias("fan_out"), F.sum("i").alias("fan_in"))


@query("agg_06_cohesion", "SELECT source, round(count(DISTINCT w) / 5.0, 6) AS cohesion FROM (SELECT source, w FROM documents, (VALUES ('tion'), ('ouea'), ('idiot'), ('Ciónes'), ('licensed')) AS f(w) WHERE contains(text, w)) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    fields = ["tion", "ouea", "idiot", "Ciónes", "licensed"]
    used = [F.max(F.col("text").contains(f).cast("int")) for f in fields]
    return t["documents"].groupBy("source").agg(F.round(sum(used) / 5.0, 6).alias("cohesion")).filter("cohesion > 0")


@query("agg_07_module_matrix", "SELECT s_nationkey AS src, CAST(count(*) FILTER (WHERE l_returnflag = 'A') AS BIGINT) AS a, CAST(count(*) FILTER (WHERE l_returnflag = 'N') AS BIGINT) AS n, CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS BIGINT) AS r FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1")
def _(t: Tables) -> DataFrame:
    j = t["lineitem"].select("l_suppkey", "l_returnflag").join(t["supplier"].select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    m = j.groupBy(F.col("s_nationkey").alias("src")).pivot("l_returnflag", ["A", "N", "R"]).agg(n())
    return m.select("src", *(F.coalesce(x, F.lit(0)).alias(x.lower()) for x in ("A", "N", "R")))


@query("agg_11_debt", using(ISSUES) + ", m AS (SELECT category, CASE severity WHEN 'CRITICAL' THEN 30 WHEN 'MAJOR' THEN 15 WHEN 'MINOR' THEN 5 WHEN 'INFO' THEN 1 ELSE 5 END AS minutes FROM issues) SELECT category, CAST(sum(minutes) AS BIGINT) AS minutes, floor(sum(minutes) / 60 * 50 * 10 + 0.5) / 10 AS cost FROM m GROUP BY 1")
def _(t: Tables) -> DataFrame:
    m = t.issues().select("category", I.minutes(F.col("severity")).alias("minutes"))
    return m.groupBy("category").agg(F.sum("minutes").alias("minutes"), T.round_half_up(F.sum("minutes") / 60 * I.COST_PER_HOUR, 1).alias("cost"))


_GATE = using(ASSETS, ISSUES) + ", q AS (SELECT module, sum(lines_of_code) * 0.06 AS cost FROM assets GROUP BY 1), i AS (SELECT a.module, count(*) FILTER (WHERE severity = 'CRITICAL') AS c, count(*) FILTER (WHERE severity = 'MAJOR') AS m, count(*) FILTER (WHERE severity = 'MINOR') AS k, sum(CASE severity WHEN 'CRITICAL' THEN 30 WHEN 'MAJOR' THEN 15 WHEN 'MINOR' THEN 5 WHEN 'INFO' THEN 1 ELSE 5 END) AS minutes FROM issues JOIN assets a USING (doc_id) GROUP BY 1), g AS (SELECT module, c, m, k, floor(minutes / 60 * 50 / cost * 100 * 10 + 0.5) / 10 AS ratio FROM i JOIN q USING (module)) "


def _modules(t: Tables) -> DataFrame:
    a = t.assets().select("doc_id", "module", "lines_of_code")
    cost = a.groupBy("module").agg((F.sum("lines_of_code") * I.COST_PER_LINE).alias("cost"))
    s = F.col("severity")
    i = t.issues().join(a.select("doc_id", "module"), "doc_id").groupBy("module").agg(F.count_if(s == "CRITICAL").alias("c"), F.count_if(s == "MAJOR").alias("m"), F.count_if(s == "MINOR").alias("k"), F.sum(I.minutes(s)).alias("minutes"))
    return i.join(cost, "module").select("module", "c", "m", "k", T.round_half_up(F.col("minutes") / 60 * I.COST_PER_HOUR / F.col("cost") * 100, 1).alias("ratio"))


@query("agg_11_debt_rating", _GATE + "SELECT module, ratio, CASE WHEN ratio <= 5 THEN 'A' WHEN ratio <= 10 THEN 'B' WHEN ratio <= 20 THEN 'C' WHEN ratio <= 50 THEN 'D' ELSE 'E' END AS rating FROM g")
def _(t: Tables) -> DataFrame:
    return _modules(t).select("module", "ratio", I.rating(F.col("ratio")).alias("rating"))


@query("agg_14_quality_gate", _GATE + "SELECT module, concat_ws(', ', CASE WHEN c > 0 THEN 'critical issues' END, CASE WHEN m > 0 THEN 'major issues' END, CASE WHEN c + m + k > 10 THEN 'too many issues' END, CASE WHEN ratio > 5 THEN 'debt ratio' END) AS reasons FROM g")
def _(t: Tables) -> DataFrame:
    return _modules(t).select("module", I.gate(F.col("c"), F.col("m"), F.col("k"), F.col("ratio")).alias("reasons"))


@query("agg_17_validation", _MERGED + ", v AS (SELECT CASE WHEN origin = 'merged' AND confidence >= 0.8 THEN 'ACCEPT' WHEN origin = 'ai' AND (confidence IS NULL OR confidence < 0.5) THEN 'FLAG' WHEN origin = 'ai' AND confidence < 0.7 THEN 'DOWNGRADE' WHEN severity = 'CRITICAL' AND confidence < 0.6 THEN 'RETRY' ELSE 'ACCEPT' END AS decision FROM merged) SELECT decision, count(*) AS n FROM v GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return merged(t).groupBy(I.decision(F.col("origin"), F.col("severity"), F.col("confidence")).alias("decision")).agg(n().alias("n"))


@query("agg_18_trend", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events WHERE value > 5 GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return t["events"].filter("value > 5").groupBy(F.to_date("ts").alias("day"), "event_type").agg(n().alias("n"))


@query("agg_19_cache_stats", "SELECT count(*) AS entries, count(*) FILTER (WHERE value > 10) AS hit, round(sum(value), 2) AS total, round(avg(value), 6) AS mean, max(value) AS most FROM events")
def _(t: Tables) -> DataFrame:
    return t["events"].agg(n().alias("entries"), F.count_if(F.col("value") > 10).alias("hit"), F.round(F.sum("value"), 2).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("most"))


@query("agg_20_percentiles", "SELECT event_type, min(value) AS low, max(value) AS high, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    rank = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value)").alias(name) for p, name in ((0.5, "p50"), (0.9, "p90"), (0.95, "p95"), (0.99, "p99"))]
    return t["events"].groupBy("event_type").agg(F.min("value").alias("low"), F.max("value").alias("high"), *rank)


@query("agg_21_histogram", "SELECT b.bucket, count(e.value) AS n FROM (VALUES ('<=1'), ('<=2'), ('<=5'), ('>5')) AS b(bucket) LEFT JOIN (SELECT value, CASE WHEN value <= 1 THEN '<=1' WHEN value <= 2 THEN '<=2' WHEN value <= 5 THEN '<=5' ELSE '>5' END AS bucket FROM events WHERE value > 0) e ON b.bucket = e.bucket GROUP BY 1")
def _(t: Tables) -> DataFrame:
    v = F.col("value")
    counted = t["events"].filter(v > 0).groupBy(F.when(v <= 1, "<=1").when(v <= 2, "<=2").when(v <= 5, "<=5").otherwise(">5").alias("bucket")).agg(n().alias("n"))
    every = t.spark.createDataFrame([("<=1",), ("<=2",), ("<=5",), (">5",)], "bucket string")
    return every.join(counted, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


@query("agg_22_type_breakdown", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t["events"].groupBy("event_type").agg(n().alias("n"))


@query("agg_23_grouped_rows", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t["nation"].groupBy("n_regionkey").agg(F.expr("listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name)").alias("names"))


@query("agg_24_package_stats", using(ASSETS) + "SELECT package, count(*) AS n, round(avg(method_count), 6) AS mean, max(method_count) AS most, min(method_count) AS least FROM assets GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.assets().groupBy("package").agg(n().alias("n"), F.round(F.avg("method_count"), 6).alias("mean"), F.max("method_count").alias("most"), F.min("method_count").alias("least"))


@query("agg_25_hierarchy", "SELECT r_name, n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def _(t: Tables) -> DataFrame:
    j = t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    return j.rollup("r_name", "n_name").agg(n().alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("agg_26_package_tree", using(ASSETS) + "SELECT array_to_string(list_slice(string_split(package, '.'), 1, i), '.') AS prefix, count(*) AS n, CAST(sum(method_count) AS BIGINT) AS methods FROM assets, range(1, 4) AS d(i) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    parts = F.split("package", "[.]")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
    return t.assets().select("method_count", F.explode(prefixes).alias("prefix")).groupBy("prefix").agg(n().alias("n"), F.sum("method_count").alias("methods"))


@query("agg_27_kinds", using(ASSETS) + "SELECT kind, count(*) AS n FROM assets GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.assets().groupBy("kind").agg(n().alias("n"))


@query("agg_29_weighted_degree", using(EDGES) + "SELECT node, CAST(sum(value) AS BIGINT) AS degree FROM (SELECT src AS node, value FROM edges UNION ALL SELECT dst, value FROM edges) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    e = t.edges()
    return e.select(F.col("src").alias("node"), "value").union(e.select("dst", "value")).groupBy("node").agg(F.sum("value").alias("degree"))


@query("agg_30_link_weights", using(EDGES) + "SELECT * FROM edges")
def _(t: Tables) -> DataFrame:
    return t.edges()


@query("agg_31_affixes", "SELECT word, count(*) AS n FROM (SELECT regexp_extract(unnest(string_split(p_name, ' ')), '^[a-zA-Z]+', 0) AS word FROM part) WHERE word <> '' GROUP BY 1 ORDER BY n DESC, word LIMIT 50")
def _(t: Tables) -> DataFrame:
    words = t["part"].select(F.explode(F.split("p_name", " ")).alias("w")).select(F.regexp_extract("w", "^[a-zA-Z]+", 0).alias("word"))
    return words.filter("word != ''").groupBy("word").agg(n().alias("n")).orderBy(F.desc("n"), "word").limit(50)


@query("agg_32_dominant", "SELECT source, lang FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS rn FROM documents GROUP BY 1, 2) WHERE rn = 1")
def _(t: Tables) -> DataFrame:
    counted = t["documents"].groupBy("source", "lang").agg(n().alias("n"))
    return counted.groupBy("source").agg(F.min_by("lang", F.struct(-F.col("n"), F.col("lang"))).alias("lang"))


@query("agg_33_architecture", "SELECT source, CASE WHEN count(DISTINCT lang) = 4 THEN 'DDD' WHEN bool_or(lang = 'fr') AND bool_or(lang = 'de') THEN 'MVC' WHEN count(DISTINCT lang) >= 2 THEN 'LAYERED' ELSE 'GENERIC' END AS architecture FROM documents GROUP BY 1")
def _(t: Tables) -> DataFrame:
    seen = t["documents"].groupBy("source").agg(F.collect_set("lang").alias("l"))  # a set of languages is small
    kind = F.when(F.size("l") == 4, "DDD").when(F.array_contains("l", "fr") & F.array_contains("l", "de"), "MVC").when(F.size("l") >= 2, "LAYERED").otherwise("GENERIC")
    return seen.select("source", kind.alias("architecture"))


@query("agg_35_rule_hits", using(ISSUES) + "SELECT rule_key, count(*) AS hits, count(DISTINCT file || ':' || line) AS places FROM issues GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.issues().groupBy("rule_key").agg(n().alias("hits"), F.countDistinct(F.concat_ws(":", "file", F.col("line").cast("string"))).alias("places"))


@query("agg_36_asset_totals", using(ASSETS) + "SELECT module, CAST(sum(method_count) AS BIGINT) AS methods, CAST(sum(lines_of_code) AS BIGINT) AS lines FROM assets GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.assets().groupBy("module").agg(F.sum("method_count").alias("methods"), F.sum("lines_of_code").alias("lines"))


@query("agg_38_health", "SELECT user_id, CASE WHEN bool_or(event_type = 'error') THEN 'DOWN' ELSE 'UP' END AS health FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t["events"].groupBy("user_id").agg(F.when(F.bool_or(F.col("event_type") == "error"), "DOWN").otherwise("UP").alias("health"))


@query("agg_39_coupling", using(EDGES) + "SELECT floor(100.0 * (SELECT count(*) FROM edges) / (x.n * (x.n - 1)) * 1000 + 0.5) / 1000 AS coupling FROM (SELECT count(*) AS n FROM (SELECT src FROM edges UNION SELECT dst FROM edges)) x")
def _(t: Tables) -> DataFrame:
    e = t.edges()
    degree = e.select(F.col("src").alias("v"), F.lit(1).alias("e")).union(e.select("dst", F.lit(0))).groupBy("v").agg(F.sum("e").alias("e"))
    return degree.agg(T.round_half_up(100.0 * F.sum("e") / (n() * (n() - 1)), 3).alias("coupling"))


@query("win_01_rank", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders")
def _(t: Tables) -> DataFrame:
    return t["orders"].select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long").alias("rank"))


@query("win_02_first_wins", using(ISSUES) + "SELECT doc_id, rule_key FROM (SELECT *, row_number() OVER (PARTITION BY file, line, method ORDER BY rule_key) AS rn FROM issues) WHERE rn = 1")
def _(t: Tables) -> DataFrame:
    return R.first_of_key(t.issues(), ["file", "line", "method"], ["rule_key"]).select("doc_id", "rule_key")


@query("win_03_last_wins", "SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1")
def _(t: Tables) -> DataFrame:
    last = t["events"].groupBy("user_id").agg(F.max_by(F.struct("event_type", "value"), "event_id").alias("r"))
    return last.select("user_id", "r.*")


@query("win_04_limit_per_entry", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn <= 10")
def _(t: Tables) -> DataFrame:
    turn = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return t["orders"].withColumn("rn", turn).filter("rn <= 10").select("o_custkey", "o_orderkey")


@query("win_06_last_definition", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS defined_at FROM events")
def _(t: Tables) -> DataFrame:
    before = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    return t["events"].select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(before).alias("defined_at"))


@query("win_07_context_frame", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 10 PRECEDING AND 1 FOLLOWING), 6) AS around FROM events")
def _(t: Tables) -> DataFrame:
    around = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-10, 1)
    return t["events"].select("event_id", F.round(F.avg("value").over(around), 6).alias("around"))


@query("win_08_edge_cap", using(EDGES) + ", r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS a, row_number() OVER (PARTITION BY dst ORDER BY src) AS b FROM edges WHERE value >= 1) SELECT src, dst FROM r WHERE a <= 20 AND b <= 5")
def _(t: Tables) -> DataFrame:
    one, two = F.row_number().over(Window.partitionBy("src").orderBy("dst")), F.row_number().over(Window.partitionBy("dst").orderBy("src"))
    return t.edges().filter("value >= 1").withColumns({"a": one, "b": two}).filter("a <= 20 and b <= 5").select("src", "dst")


@query("srt_05_top_issues", using(ISSUES) + "SELECT rule_key, doc_id FROM issues ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'MAJOR' THEN 1 WHEN 'MINOR' THEN 2 ELSE 3 END, doc_id, rule_key LIMIT 50")
def _(t: Tables) -> DataFrame:
    return t.issues().orderBy(T.severity_rank(F.col("severity")), "doc_id", "rule_key").limit(50).select("rule_key", "doc_id")


@query("srt_06_by_confidence", using(REVIEWED) + "SELECT doc_id, confidence FROM reviewed ORDER BY coalesce(confidence, 0) DESC, doc_id")
def _(t: Tables) -> DataFrame:
    return t.reviewed().orderBy(F.desc(F.coalesce("confidence", F.lit(0.0))), "doc_id").select("doc_id", "confidence")


@query("srt_07_top_rules", using(ISSUES) + "SELECT rule_key, count(*) AS n FROM issues GROUP BY 1 ORDER BY n DESC, rule_key LIMIT 10")
def _(t: Tables) -> DataFrame:
    return t.issues().groupBy("rule_key").agg(n().alias("n")).orderBy(F.desc("n"), "rule_key").limit(10)


@query("srt_08_hubs", using(EDGES) + "SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1 ORDER BY degree DESC, node LIMIT 10")
def _(t: Tables) -> DataFrame:
    e = t.edges()
    return e.select(F.col("src").alias("node")).union(e.select("dst")).groupBy("node").agg(n().alias("degree")).orderBy(F.desc("degree"), "node").limit(10)


@query("srt_10_history", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey = 7 ORDER BY o_orderdate DESC, o_orderkey LIMIT 5")
def _(t: Tables) -> DataFrame:
    return t["orders"].filter("o_custkey = 7").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(5).select("o_orderkey", "o_orderdate")


@query("srt_11_layers", "SELECT lang, count(*) AS n FROM documents GROUP BY 1 ORDER BY n, lang")
def _(t: Tables) -> DataFrame:
    return t["documents"].groupBy("lang").agg(n().alias("n")).orderBy("n", "lang")


@query("set_01_union", "SELECT c_name AS name, 'customer' AS kind, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, 'supplier', NULL FROM supplier")
def _(t: Tables) -> DataFrame:
    one = t["customer"].select(F.col("c_name").alias("name"), F.lit("customer").alias("kind"), F.col("c_mktsegment").alias("segment"))
    return one.unionByName(t["supplier"].select(F.col("s_name").alias("name"), F.lit("supplier").alias("kind")), allowMissingColumns=True)


@query("set_02_key_difference", "SELECT 'left' AS side, c_nationkey AS k FROM (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) UNION ALL SELECT 'right', s_nationkey FROM (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000 EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)")
def _(t: Tables) -> DataFrame:
    one = t["customer"].filter("c_acctbal > 9900").select(F.col("c_nationkey").alias("k"))
    two = t["supplier"].filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
    return one.subtract(two).select(F.lit("left").alias("side"), "k").union(two.subtract(one).select(F.lit("right"), "k"))


@query("set_03_deleted", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def _(t: Tables) -> DataFrame:
    return t["documents"].select("doc_id").subtract(t["labels"].select("doc_id"))


@query("set_04_involved", using(EDGES) + "SELECT src AS node FROM edges UNION SELECT dst FROM edges")
def _(t: Tables) -> DataFrame:
    e = t.edges()
    return e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()


@query("set_06_inside_links", using(EDGES) + "SELECT e.src, e.dst FROM edges e WHERE e.src IN (SELECT src FROM edges WHERE value > 1) AND e.dst IN (SELECT dst FROM edges WHERE value > 1)")
def _(t: Tables) -> DataFrame:
    e = t.edges()
    strong = e.filter("value > 1")
    return e.join(strong.select("src").distinct(), "src", "left_semi").join(strong.select("dst").distinct(), "dst", "left_semi").select("src", "dst")


@query("src_20_json_defaults", """SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), CAST(json_extract_string(props, '$.key') AS BIGINT), -1) AS k FROM events""")
def _(t: Tables) -> DataFrame:
    return t["events"].select("event_id", F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.get_json_object("props", "$.key").cast("long"), F.lit(-1).cast("long")).alias("k"))


@query("snk_02_sarif_rules", using(ISSUES) + "SELECT rule_key, arg_min(message, doc_id) AS text, CASE arg_min(severity, doc_id) WHEN 'CRITICAL' THEN 'error' WHEN 'MAJOR' THEN 'warning' WHEN 'MINOR' THEN 'note' ELSE 'none' END AS level, count(*) AS results FROM issues GROUP BY 1")
def _(t: Tables) -> DataFrame:
    s = F.min_by("severity", "doc_id")  # the first issue of a rule says its text and level
    level = F.when(s == "CRITICAL", "error").when(s == "MAJOR", "warning").when(s == "MINOR", "note").otherwise("none")
    return t.issues().groupBy("rule_key").agg(F.min_by("message", "doc_id").alias("text"), level.alias("level"), n().alias("results"))


@query("snk_05_dot", "SELECT n_regionkey, string_agg('\"r' || n_regionkey || '\" -> \"' || n_name || '\";', ' ' ORDER BY n_name) AS dot FROM nation GROUP BY 1")
def _(t: Tables) -> DataFrame:
    line = F.format_string('"r%d" -> "%s";', "n_regionkey", "n_name")
    return t["nation"].select("n_regionkey", "n_name", line.alias("line")).groupBy("n_regionkey").agg(F.expr("listagg(line, ' ') WITHIN GROUP (ORDER BY n_name)").alias("dot"))


@query("snk_07_upsert", "SELECT k, v, batch FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY batch DESC) AS rn FROM (SELECT doc_id AS k, n_chars AS v, 1 AS batch FROM documents UNION ALL SELECT doc_id, toxic * 1000, 2 FROM labels)) WHERE rn = 1")
def _(t: Tables) -> DataFrame:
    old = t["documents"].select(F.col("doc_id").alias("k"), F.col("n_chars").alias("v"), F.lit(1).alias("batch"))
    new = t["labels"].select(F.col("doc_id").alias("k"), (F.col("toxic") * 1000).cast("long").alias("v"), F.lit(2).alias("batch"))
    return old.unionByName(new).groupBy("k").agg(F.max_by(F.struct("v", "batch"), "batch").alias("r")).select("k", "r.*")


@query("snk_08_delete", "SELECT o_orderkey FROM orders WHERE NOT (o_orderdate < TIMESTAMP '1995-01-01' OR o_custkey % 10 = 3)")
def _(t: Tables) -> DataFrame:
    return t["orders"].filter(~((F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp")) | (F.col("o_custkey") % 10 == 3))).select("o_orderkey")


@query("snk_10_prometheus", "SELECT 'events_total{type=\"' || event_type || '\"} ' || count(*) AS line FROM events GROUP BY event_type")
def _(t: Tables) -> DataFrame:
    return t["events"].groupBy("event_type").agg(n().alias("n")).select(F.format_string('events_total{type="%s"} %d', "event_type", "n").alias("line"))


@query("snk_13_prompt", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS prompt FROM conversations GROUP BY 1")
def _(t: Tables) -> DataFrame:
    said = t["conversations"].select("conv_id", "turn", F.concat_ws(": ", "role", "text").alias("said"))
    turns = said.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "said"))).alias("t"))
    return turns.select("conv_id", F.array_join(F.transform("t", lambda x: x["said"]), "\n").alias("prompt"))
