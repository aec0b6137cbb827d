"""Scalar functions over text, rule evaluation and duplicate detection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import duplicates as D
from quarry.plans.oracle import ASSETS, ISSUES, using
from quarry.plans.registry import query
from quarry.sources.tables import Tables

n = lambda: F.count(F.lit(1))


@query("src_04_parser_dispatch", "SELECT page_id, CASE WHEN url LIKE '%.pdf' THEN 'binary' WHEN url LIKE '%#%' THEN 'anchor' WHEN url LIKE 'https%' THEN 'secure' ELSE 'plain' END AS format FROM pages")
def _(t: Tables) -> DataFrame:
    u = F.col("url")
    return t["pages"].select("page_id", F.when(u.endswith(".pdf"), "binary").when(u.contains("#"), "anchor").when(u.startswith("https"), "secure").otherwise("plain").alias("format"))


@query("src_09_text_outline", "SELECT doc_id, CAST(len(string_split(rtrim(text, chr(10)), chr(10))) AS BIGINT) AS lines, CAST(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) AS BIGINT) AS words, left(text, 500) AS preview FROM documents")
def _(t: Tables) -> DataFrame:
    return t["documents"].select("doc_id", T.line_count(F.col("text")).cast("long").alias("lines"), F.regexp_count("text", F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long").alias("words"), F.left("text", F.lit(500)).alias("preview"))


@query("src_09_page_headings", "SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS heading, CAST(len(regexp_extract_all(html, '<p>')) AS BIGINT) AS paragraphs FROM pages")
def _(t: Tables) -> DataFrame:
    return t["pages"].select("page_id", F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("heading"), F.regexp_count("html", F.lit("<p>")).cast("long").alias("paragraphs"))


@query("src_21_point_read", "SELECT * FROM customer WHERE c_custkey = 42")
def _(t: Tables) -> DataFrame:
    return t["customer"].filter("c_custkey = 42")


@query("fn_01_cosine", "SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: CAST(p[1] * p[2] AS DOUBLE))) / (sqrt(list_sum(list_transform(a.embedding, lambda x: CAST(x * x AS DOUBLE)))) * sqrt(list_sum(list_transform(b.embedding, lambda x: CAST(x * x AS DOUBLE))))), 4) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 3) b")
def _(t: Tables) -> DataFrame:
    e = t["embeddings"].select("vec_id", "embedding")
    wanted = e.filter("vec_id = 3").select(F.col("embedding").alias("q"))
    return e.join(F.broadcast(wanted.limit(1))).select("vec_id", F.round(T.cosine(F.col("embedding"), F.col("q")), 4).alias("score"))  # one query vector


@query("fn_03_term_frequency", "SELECT doc_id, CAST((length(text) - length(replace(lower(text), 'the', ''))) / 3 AS BIGINT) AS tf FROM documents WHERE lang = 'en'")
def _(t: Tables) -> DataFrame:
    return t["documents"].filter("lang = 'en'").select("doc_id", T.term_frequency(F.col("text"), F.lit("the")).cast("long").alias("tf"))


@query("fn_04_query_terms", "SELECT item_id, regexp_replace(trim(regexp_replace(lower(text), '[^a-z0-9_\\s]', ' ', 'g')), '\\s+', ' & ', 'g') AS q FROM benchmark")
def _(t: Tables) -> DataFrame:
    return t["benchmark"].select("item_id", T.query_terms(F.col("text")).alias("q"))


@query("fn_06_search_text", using(ASSETS) + "SELECT doc_id, concat_ws(' ', address, kind, body) AS searchable FROM assets")
def _(t: Tables) -> DataFrame:
    return t.assets().select("doc_id", F.concat_ws(" ", "address", "kind", "body").alias("searchable"))


@query("fn_08_token_estimate", "SELECT doc_id, CAST(floor(length(regexp_replace(text, '[^一-鿿]', '', 'g')) / 2) + floor((length(text) - length(regexp_replace(text, '[^一-鿿]', '', 'g'))) / 4) AS BIGINT) AS tokens FROM documents")
def _(t: Tables) -> DataFrame:
    return t["documents"].select("doc_id", T.estimated_tokens(F.col("text")).alias("tokens"))


@query("fn_10_hashes", "SELECT doc_id, sha256(text) AS full_hash, left(sha256(text), 16) AS short_hash, md5(text) AS md5 FROM documents")
def _(t: Tables) -> DataFrame:
    return t["documents"].select("doc_id", F.sha2("text", 256).alias("full_hash"), F.left(F.sha2("text", 256), F.lit(16)).alias("short_hash"), F.md5("text").alias("md5"))


@query("fn_11_canonical_text", "SELECT page_id, left(sha256(trim(regexp_replace(regexp_replace(regexp_replace(html, '/\\*(.|\\n)*?\\*/', '', 'g'), '//[^\\n]*', '', 'g'), '\\s+', ' ', 'g'))), 16) AS fp FROM pages")
def _(t: Tables) -> DataFrame:
    return t["pages"].select("page_id", T.fingerprint(F.col("html")).alias("fp"))


@query("fn_14_project_fingerprint", "SELECT source, sha256(string_agg(sha256(text), ',' ORDER BY doc_id)) AS fp FROM documents GROUP BY 1")
def _(t: Tables) -> DataFrame:
    h = t["documents"].select("source", "doc_id", F.sha2("text", 256).alias("h"))
    parts = h.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", "h"))).alias("p"))
    return parts.select("source", F.sha2(F.array_join(F.transform("p", lambda x: x["h"]), ","), 256).alias("fp"))


@query("fn_15_hamming", "SELECT doc_id, CAST(len(list_filter(range(1, 17), lambda i: substr(md5(text), i, 1) <> substr(md5(source), i, 1))) AS INTEGER) AS distance FROM documents")
def _(t: Tables) -> DataFrame:
    d = t["documents"].select("doc_id", F.left(F.md5("text"), F.lit(16)).alias("a"), F.left(F.md5("source"), F.lit(16)).alias("b"))
    return d.select("doc_id", T.hamming(F.col("a"), F.col("b")).alias("distance"))


_TOKENS = "list_filter(string_split(lower(regexp_replace(text, '[^A-Za-z0-9_]', ' ', 'g')), ' '), lambda w: length(w) > 1 AND w NOT IN ('the', 'and', 'for', 'with', 'that', 'this', 'from', 'are', 'was', 'not', 'you'))"


@query("fn_16_shingle_tokens", f"SELECT doc_id, array_to_string({_TOKENS}, ' ') AS tokens FROM documents")
def _(t: Tables) -> DataFrame:
    return t["documents"].select("doc_id", F.array_join(T.shingle_tokens(F.col("text")), " ").alias("tokens"))


@query("fn_17_layer", using(ASSETS) + "SELECT doc_id, CASE WHEN contains(package, 'src1') THEN 'CONTROLLER' WHEN contains(package, '.fr') THEN 'REPOSITORY' WHEN address LIKE '%7' THEN 'UTIL' ELSE 'SERVICE' END AS layer FROM assets")
def _(t: Tables) -> DataFrame:
    p = F.col("package")
    return t.assets().select("doc_id", F.when(p.contains("src1"), "CONTROLLER").when(p.contains(".fr"), "REPOSITORY").when(F.col("address").endswith("7"), "UTIL").otherwise("SERVICE").alias("layer"))


@query("fn_19_names", using(ASSETS) + "SELECT DISTINCT package, 'Doc' || doc_id AS simple, source FROM (SELECT package, doc_id, module AS source FROM assets)")
def _(t: Tables) -> DataFrame:
    return t.assets().select(T.package_name(F.col("address")).alias("package"), T.simple_name(F.col("address")).alias("simple"), F.col("module").alias("source")).distinct()


@query("fn_20_camel", "SELECT DISTINCT p_type, array_to_string(list_transform(string_split(lower(replace(p_type, ' ', '_')), '_'), lambda w: upper(left(w, 1)) || substr(w, 2)), '') AS camel FROM part")
def _(t: Tables) -> DataFrame:
    return t["part"].select("p_type").distinct().select("p_type", T.camel(F.replace("p_type", F.lit(" "), F.lit("_"))).alias("camel"))


@query("fn_24_complexity", "SELECT doc_id, CAST(1 + len(regexp_extract_all(text, 'the ')) + len(regexp_extract_all(text, 'of ')) + len(regexp_extract_all(text, '[|]')) AS BIGINT) AS complexity FROM documents")
def _(t: Tables) -> DataFrame:
    parts = [F.regexp_count("text", F.lit(p)) for p in ("the ", "of ", "[|]")]
    return t["documents"].select("doc_id", (1 + sum(parts)).cast("long").alias("complexity"))


@query("fn_27_code_lines", "SELECT doc_id, CAST(len(list_filter(string_split(rtrim(text, chr(10)), chr(10)), lambda x: trim(x) <> '' AND NOT starts_with(trim(x), '//') AND NOT starts_with(trim(x), '*') AND NOT starts_with(trim(x), '/*'))) AS BIGINT) AS loc FROM documents")
def _(t: Tables) -> DataFrame:
    return t["documents"].select("doc_id", T.code_lines(F.col("text")).cast("long").alias("loc"))


@query("fn_33_trend", "SELECT source, CASE WHEN a = b THEN 'STABLE' WHEN a > b THEN 'DEGRADING' ELSE 'IMPROVING' END AS trend FROM (SELECT source, count(*) FILTER (WHERE doc_id % 2 = 0) AS a, count(*) FILTER (WHERE doc_id % 2 = 1) AS b FROM documents GROUP BY 1)")
def _(t: Tables) -> DataFrame:
    return t["documents"].groupBy("source").agg(T.trend(F.count_if(F.col("doc_id") % 2 == 0), F.count_if(F.col("doc_id") % 2 == 1)).alias("trend"))


@query("fn_35_html_escape", "SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped FROM pages")
def _(t: Tables) -> DataFrame:
    return t["pages"].select("page_id", T.html_escaped(F.col("html")).alias("escaped"))


@query("fn_36_language", "SELECT page_id, regexp_extract(html, 'lang=\"([a-z]+)\"', 1) AS lang, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages")
def _(t: Tables) -> DataFrame:
    return t["pages"].select("page_id", F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))


@query("fn_41_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS stamp, CAST(o_orderdate AS DATE) AS day FROM orders")
def _(t: Tables) -> DataFrame:
    return t["orders"].select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("stamp"), F.to_date("o_orderdate").alias("day"))


@query("fn_42_rounding", "SELECT l_orderkey, l_linenumber, floor(l_extendedprice * l_discount * 10 + 0.5) / 10 AS rounded FROM lineitem")
def _(t: Tables) -> DataFrame:
    return t["lineitem"].select("l_orderkey", "l_linenumber", T.round_half_up(F.col("l_extendedprice") * F.col("l_discount"), 1).alias("rounded"))


_SHINGLES = f"toks AS (SELECT doc_id, {_TOKENS} AS w FROM documents), sh AS (SELECT doc_id, i - 1 AS pos, array_to_string(list_slice(w, i, i + 9), ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 8, 1))) AS i FROM toks))"


@query("win_05_shingles", using(_SHINGLES) + "SELECT doc_id, count(*) AS n, count(DISTINCT shingle) AS different FROM sh GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return D.shingle_rows(t["documents"], 10).groupBy("doc_id").agg(n().alias("n"), F.countDistinct("key").alias("different"))


@query("rul_07_duplicates", using(_SHINGLES) + ", c AS (SELECT shingle, count(*) AS n, min({'d': doc_id, 'p': pos}) AS place FROM sh GROUP BY 1 HAVING count(*) >= 2) SELECT place.d AS doc_id, min(place.p) AS pos, arg_min(n, place.p) AS occurrences FROM c GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return D.reported_duplicates(t["documents"], 10)


@query("rul_02_pack", using(ISSUES) + "SELECT rule_key, severity, category, doc_id FROM issues")
def _(t: Tables) -> DataFrame:
    return t.issues().select("rule_key", "severity", "category", "doc_id")


@query("rul_08_taint_lines", "WITH l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents), s AS (SELECT doc_id, min(pos) AS src FROM l WHERE contains(line, 'tion') GROUP BY 1), k AS (SELECT doc_id, pos FROM l WHERE contains(line, '!!')), z AS (SELECT doc_id, pos FROM l WHERE contains(line, 'licensed')) SELECT k.doc_id, min(k.pos) AS sink FROM k JOIN s ON k.doc_id = s.doc_id AND s.src < k.pos WHERE NOT EXISTS (SELECT 1 FROM z WHERE z.doc_id = k.doc_id AND z.pos > s.src AND z.pos < k.pos) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return D.tainted_sinks(t["documents"], "tion", "!!", "licensed")
