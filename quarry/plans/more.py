"""Front-end queries, further relations, projections, retrieval and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import frontend as E
from quarry.operators import issues as I
from quarry.operators import review as V
from quarry.plans.oracle import FILES, ISSUES, REVIEWED, using
from quarry.plans.registry import query
from quarry.plans.relational import _MERGED, merged
from quarry.sources import code_tables as C
from quarry.sources.tables import Tables

n = lambda: F.count(F.lit(1))

WEB = "web AS (SELECT s_suppkey AS k, s_nationkey AS n, CASE WHEN s_suppkey % 5 = 0 THEN '/repo/web/src/comp' || s_suppkey || '/index.ts' ELSE '/repo/web/src/comp' || s_suppkey || '.tsx' END AS path FROM supplier)"


@query("rul_10_xss_flows", using(WEB) + "SELECT path, 7 AS sink_line, 'innerHTML assignment' AS sink, 'CRITICAL' AS severity, 5 AS source_line, 'URL parameter' AS source, 'q' AS variable FROM web WHERE k % 3 <> 0")
def _(t: Tables) -> DataFrame:
    return E.xss_flows(C.web_files(t["supplier"]))


@query("rul_11_frontend_issues", using(WEB) + "SELECT path, unnest(['FE-ARCH-011', 'FE-BUNDLE-004']) AS rule_key, unnest(['INFO', 'MINOR']) AS severity FROM web")
def _(t: Tables) -> DataFrame:
    return E.issues(C.web_files(t["supplier"])).select("path", "rule_key", "severity")


@query("rul_11_file_metrics", using(WEB) + "SELECT path, 13 AS lines, 6 AS complexity, 2 AS functions, 1 AS anys FROM web")
def _(t: Tables) -> DataFrame:
    return E.metrics(C.web_files(t["supplier"]))


@query("fn_26_frontend_complexity", using(WEB) + "SELECT path, 6 AS complexity FROM web")
def _(t: Tables) -> DataFrame:
    return C.web_files(t["supplier"]).select("path", E.complexity(F.col("content")).alias("complexity"))


@query("src_22_frontend_files", using(WEB) + "SELECT DISTINCT path FROM web WHERE regexp_matches(path, '[.](ts|tsx|js|jsx|vue|svelte|html|css)$') AND NOT contains(path, 'node_modules')")
def _(t: Tables) -> DataFrame:
    return C.web_files(t["supplier"]).filter(F.col("path").rlike("[.](ts|tsx|js|jsx|vue|svelte|html|css)$") & ~F.col("path").contains("node_modules")).select("path").dropDuplicates(["path"])


@query("join_25_import_paths", using(WEB) + "SELECT a.path, 'comp' || (a.k + 1) AS name, min(b.path) AS target FROM web a JOIN web b ON b.path LIKE '%comp' || (a.k + 1) || '.tsx' OR b.path LIKE '%comp' || (a.k + 1) || '/index.ts' GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    files = C.web_files(t["supplier"])
    return E.resolved(E.imports(files), files).select("path", "name", "target")


@query(
    "join_06_relations",
    using(FILES)
    + "SELECT k, 'CONFIG_TO_CLASS' AS type, unnest(['Database (JDBC/JPA)', 'Redis']) AS target, 0.8::DOUBLE AS confidence FROM files WHERE readable UNION ALL SELECT k, 'POM_TO_USAGE', unnest(['shop' || (k + 1), 'managed']), 0.5 FROM files WHERE readable UNION ALL SELECT k, 'DOCKER_TO_JAR', 'target/shop' || k || '.jar', 0.85 FROM files WHERE readable",
)
def _(t: Tables) -> DataFrame:
    """Settings to middleware, dependencies to code, images to what they start, each with its confidence."""
    k = F.regexp_extract("path", "/s([0-9]+)/", 1).cast("long").alias("k")
    one = t.project("properties").select(k, F.lit("CONFIG_TO_CLASS").alias("type"), F.explode("middleware").alias("target"), F.lit(0.8).alias("confidence"))
    two = t.project("pom").select(k, F.lit("POM_TO_USAGE").alias("type"), F.explode("dependencies").alias("d")).filter("d.artifact_id != ''").select("k", "type", F.col("d.artifact_id").alias("target"), F.lit(0.5).alias("confidence"))
    three = t.project("dockerfile").filter("jar_path != ''").select(k, F.lit("DOCKER_TO_JAR").alias("type"), F.col("jar_path").alias("target"), F.lit(0.85).alias("confidence"))
    return one.unionByName(two).unionByName(three)


@query("flt_13_partial_index", using(REVIEWED) + "SELECT doc_id, confidence FROM reviewed WHERE confidence IS NOT NULL")
def _(t: Tables) -> DataFrame:
    return t.reviewed().filter("confidence is not null").select("doc_id", "confidence")


@query("prj_03_issue_rows", using(ISSUES) + "SELECT rule_key, lower(severity) AS severity, lower(category) AS category, file || ':' || line AS place, coalesce(method, '') AS method, doc_id FROM issues")
def _(t: Tables) -> DataFrame:
    return t.issues().select("rule_key", F.lower("severity").alias("severity"), F.lower("category").alias("category"), F.concat_ws(":", "file", "line").alias("place"), F.coalesce("method", F.lit("")).alias("method"), "doc_id")


@query("prj_04_analysis_rows", _MERGED + "SELECT location, coalesce(rule_key, 'AI_REVIEW') AS rule, severity, category FROM merged WHERE NOT auto_filtered")
def _(t: Tables) -> DataFrame:
    """What a report shows of merged issues: hidden ones left out, names of the exchange format."""
    return merged(t).filter("not auto_filtered").select("location", F.coalesce("rule_key", F.lit("AI_REVIEW")).alias("rule"), "severity", "category")


@query("prj_11_safe_paths", "SELECT p_partkey, replace(replace(p_name, chr(10), '_'), chr(13), '_') AS name, NOT contains('/repo/' || p_partkey || CASE WHEN p_size > 40 THEN '/../x.java' ELSE '/x.java' END, '..') AS valid FROM part")
def _(t: Tables) -> DataFrame:
    path = F.concat(F.lit("/repo/"), F.col("p_partkey").cast("string"), F.when(F.col("p_size") > 40, "/../x.java").otherwise("/x.java"))
    return t["part"].select("p_partkey", V.one_line(F.col("p_name")).alias("name"), V.safe_path(path, "/repo/").alias("valid"))


@query(
    "fn_05_text_rank",
    "WITH d AS (SELECT doc_id, len(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g')), ' '), lambda w: w = 'the')) AS a, len(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g')), ' '), lambda w: w = 'of')) AS b FROM documents) SELECT doc_id, round((0.6079271 * (1 + ln(a)) / 1 + 0.6079271 * (1 + ln(b)) / 1) / 10, 6) AS score FROM d WHERE a > 0 AND b > 0",
)
def _(t: Tables) -> DataFrame:
    return V.text_rank(t["documents"], "the of").select("doc_id", F.round("score", 6).alias("score"))


@query("fn_07_retrieval_query", "SELECT item_id, regexp_replace(trim(regexp_replace(text, '[^a-zA-Z0-9_\\s]', ' ', 'g')), '\\s+', ' ', 'g') AS q, 'Item' || item_id || ' find' AS summary FROM benchmark")
def _(t: Tables) -> DataFrame:
    name = F.concat(F.lit("org.shop.Item"), F.col("item_id").cast("string"))
    return t["benchmark"].select("item_id", V.retrieval_query(F.col("text")).alias("q"), V.summary_query(name, F.lit("find")).alias("summary"))


@query(
    "fn_34_salvaged_answers",
    "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'R' || p_size WHEN 1 THEN 'AI_REVIEW' WHEN 2 THEN 'R' || p_size END AS rule_key, CASE p_partkey % 4 WHEN 0 THEN 'MINOR' WHEN 1 THEN 'MAJOR' WHEN 2 THEN 'MINOR' END AS severity FROM part WHERE p_partkey % 4 < 3",
)
def _(t: Tables) -> DataFrame:
    """Issues in the answers of a model: an object that lists them, one of them, both in prose; what is no JSON gives none."""
    key = F.col("p_partkey") % 4
    answer = F.when(key == 0, C.filled('Here: ```{"issues": [{"ruleKey": "R$s$", "line": 3}]}``` done', s=F.col("p_size"))).when(key == 1, F.lit('{"severity": "MAJOR", "message": "x"}')).when(key == 2, C.filled('{"issues": [{"ruleKey": "R$s$"}]}', s=F.col("p_size"))).otherwise(F.lit("no answer"))
    return V.answered(t["part"].select("p_partkey", answer.alias("answer")), "answer").select("p_partkey", "rule_key", "severity")


@query("fn_45_vector_literal", "SELECT vec_id, '[' || array_to_string(list_transform(embedding[1:2], lambda x: printf('%.3f', x)), ',') || ']' AS literal FROM embeddings")
def _(t: Tables) -> DataFrame:
    first = F.slice("embedding", 1, 2)
    return t["embeddings"].select("vec_id", V.vector_literal(F.transform(first, lambda x: F.format_string("%.3f", x.cast("double")))).alias("literal"))


@query("fn_32_decisions", _MERGED + "SELECT location, CASE WHEN origin = 'merged' AND confidence >= 0.8 THEN 'ACCEPT' WHEN origin = 'ai' AND (confidence IS NULL OR confidence < 0.5) THEN 'FLAG' WHEN origin = 'ai' AND confidence < 0.7 THEN 'DOWNGRADE' WHEN severity = 'CRITICAL' AND confidence < 0.6 THEN 'RETRY' ELSE 'ACCEPT' END AS decision FROM merged")
def _(t: Tables) -> DataFrame:
    return merged(t).select("location", I.decision(F.col("origin"), F.col("severity"), F.col("confidence")).alias("decision"))


@query("src_25_dictionary", "SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: CASE w WHEN 'steel' THEN 'metal' WHEN 'copper' THEN 'metal' ELSE w END), ' ') AS words FROM part")
def _(t: Tables) -> DataFrame:
    """Words by a dictionary that is loaded as JSON and lower-cased."""
    words = V.dictionary('{"STEEL": "metal", "Copper": "metal"}')
    return t["part"].select("p_partkey", F.array_join(V.translated(F.split(F.lower("p_type"), " "), words), " ").alias("words"))


@query("src_23_project_index", "SELECT unnest(['a', 'b', 'c', 'd']) AS name, unnest([1, 1, 2, 3]) AS shape")
def _(t: Tables) -> DataFrame:
    """A list, an object that holds it as projects, an object by name."""
    rows = t.spark.createDataFrame([(1, '[{"name": "a"}, {"name": "b"}]'), (2, '{"projects": [{"name": "c"}]}'), (3, '{"d": {"path": "x"}}')], "shape int, content string")
    return V.project_index(rows).select("name", "shape")


@query("rag_08_degradation", "SELECT event_id, CASE event_type WHEN 'error' THEN 'RETRY' WHEN 'click' THEN 'REDUCE_CONTEXT' WHEN 'purchase' THEN 'STATIC_ONLY' ELSE 'EMPTY' END AS step, CASE event_type WHEN 'error' THEN 4 END AS wait FROM events")
def _(t: Tables) -> DataFrame:
    """What follows a failure: a retry after 1, 2 and 4 seconds, a smaller context, static results only, nothing."""
    tried = F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "click", 3).when(F.col("event_type") == "purchase", 4).otherwise(5)
    return t["events"].select("event_id", V.degraded(tried).alias("step"), V.wait_seconds(tried).alias("wait"))


@query("rag_01_index", "SELECT item_id, 768 AS size, length(text) + length('Item') + length(CAST(item_id AS VARCHAR)) + 1 AS searchable FROM benchmark")
def _(t: Tables) -> DataFrame:
    """The index rows of all items: searchable text and vector, of two with one key the last."""
    slices = t["benchmark"].select(F.concat(F.lit("Item"), F.col("item_id").cast("string")).alias("class_name"), F.col("text").alias("code"), F.col("item_id"))
    return V.indexed(slices, ["item_id"], "item_id").select("item_id", F.size("embedding").alias("size"), F.length("searchable").alias("searchable"))


@query("rag_02_review")
def _(t: Tables) -> DataFrame:
    """For every benchmark item the slice that text and vector rank first, a prompt, and the issues of a reviewer that needs no model."""
    return V.reviewed(t["documents"].select("doc_id", "text"), t["benchmark"].limit(1).select("item_id", "text"), 10)


@query("snk_11_markdown_report", using(ISSUES) + "SELECT severity, '## ' || severity || chr(10) || chr(10) || '| rule | issues |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || rule_key || ' | ' || n || ' |', chr(10) ORDER BY rule_key) AS report FROM (SELECT severity, rule_key, count(*) AS n FROM issues GROUP BY 1, 2) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return V.markdown_report(t.issues())


@query("snk_06_insert", "SELECT count(*) AS rows, count(DISTINCT o_orderkey) AS keys FROM orders WHERE o_orderstatus = 'F'")
def _(t: Tables) -> DataFrame:
    """Rows appended to a table in one commit, each with a key that is given when they are written."""
    path = V.appended(t["orders"].filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey"), "inserted")
    return t.spark.read.parquet(path).agg(n().alias("rows"), F.countDistinct("id").alias("keys"))


@query("str_06_versioned_cache", "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'changed' WHEN doc_id % 7 = 0 THEN 'version' ELSE 'new' END AS reason FROM documents WHERE doc_id % 9 = 0 OR doc_id % 7 = 0 OR doc_id % 5 = 0")
def _(t: Tables) -> DataFrame:
    """Files to read again: of another hash than the cache has, read by another version, or not in the cache."""
    now = t["documents"].select("doc_id", F.sha2("text", 256).alias("hash"))
    id_ = F.col("doc_id")
    old = now.filter((id_ % 5 != 0) | (id_ % 7 == 0) | (id_ % 9 == 0)).select("doc_id", F.when(id_ % 9 == 0, "old").otherwise(F.col("hash")).alias("hash"), F.when(id_ % 7 == 0, "1.0").otherwise("2.0").alias("version"))
    return V.stale(now, old, "doc_id", "2.0")


@query("str_09_reloaded_rules", "SELECT event_id, value > CASE WHEN event_id >= 50 THEN 40 ELSE 10 END AS fires FROM events")
def _(t: Tables) -> DataFrame:
    """Each event against the thresholds that were in force when it came: the last load before it."""
    loads = t.spark.createDataFrame([(0, 10.0), (50, 40.0)], "since long, threshold double")
    return V.in_force(t["events"].select("event_id", "value"), loads, "event_id").select("event_id", (F.col("value") > F.col("threshold")).alias("fires"))
