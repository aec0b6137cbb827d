"""Queries over the code base that is written out of the star schema: sources, parsers, flows and rules of code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import names as N
from quarry.operators import control_flow as CF
from quarry.operators import java_source as J
from quarry.operators import layers as L
from quarry.operators import method_rules as M
from quarry.operators import rules as R
from quarry.operators.graph import kept
from quarry.plans.oracle import FILES, JAVA, recursive, using
from quarry.plans.registry import query
from quarry.sources import code_tables as C
from quarry.sources import files as S
from quarry.sources.tables import Tables

n = lambda: F.count(F.lit(1))

_PATHS = """paths AS (SELECT p_partkey AS k, '/repo/m' || p_partkey % 3 || '/' || CASE WHEN p_partkey % 17 = 0 THEN 'src/test/java' WHEN p_partkey % 19 = 0 THEN 'target/classes' WHEN p_partkey % 23 = 0 THEN 'node_modules/x'
  WHEN p_partkey % 29 = 0 THEN 'latest/src' ELSE 'src/main/java' END || '/File' || p_partkey || '.' || CASE p_partkey % 6 WHEN 0 THEN 'java' WHEN 1 THEN 'xml' WHEN 2 THEN 'png' WHEN 3 THEN 'md' WHEN 4 THEN 'txt' ELSE 'class' END AS path, p_size::BIGINT * 300000 AS bytes FROM part)"""


@query("src_01_java_sources", using(_PATHS) + "SELECT path FROM paths WHERE path LIKE '%.java' AND (contains(path, 'java/') OR contains(path, 'src')) AND NOT contains(path, 'test') AND NOT contains(path, 'target')")
def _(t: Tables) -> DataFrame:
    return S.java_sources(C.paths(t["part"])).select("path")


@query(
    "src_02_asset_scan",
    using(_PATHS)
    + "SELECT path, regexp_extract(path, '/(m[0-9]+)/', 1) AS module, CASE WHEN path LIKE '%.md' THEN 'markdown' WHEN path LIKE '%.java' THEN 'java' END AS format, CASE WHEN bytes > 10485760 THEN 'file too large' END AS error FROM paths WHERE path NOT LIKE '%/target/%' AND path NOT LIKE '%/node_modules/%' AND NOT path LIKE '%.png' AND NOT path LIKE '%.class'",
)
def _(t: Tables) -> DataFrame:
    kept = C.paths(t["part"]).filter(S.wanted(F.col("path")))
    return kept.select("path", F.regexp_extract("path", "/(m[0-9]+)/", 1).alias("module"), S.file_format(F.col("path")).alias("format"), S.size_error(F.col("bytes")).alias("error"))


@query("src_03_modules", using(FILES) + "SELECT '/repo/s' || k AS folder, unnest(['core', 'web' || k]) AS module FROM files WHERE readable UNION ALL SELECT '/repo/s' || k, '.' FROM files WHERE NOT readable")
def _(t: Tables) -> DataFrame:
    """A project's modules, or the project itself where it names none."""
    parsed = t.project("pom").select(F.regexp_replace("path", "/pom.xml$", "").alias("folder"), "modules")
    return parsed.select("folder", F.explode(F.when(F.size("modules") > 0, F.col("modules")).otherwise(F.array(F.lit(".")))).alias("module"))


@query(
    "src_05_pom",
    using(FILES)
    + "SELECT k, CASE WHEN readable THEN 'shop' || k ELSE '' END AS artifact, CASE WHEN readable THEN '2.' || k % 7 ELSE '' END AS version, CASE WHEN readable THEN 'parent' || n ELSE '' END AS parent, CASE WHEN readable THEN '3.' || n || '.1' END AS lib, CASE WHEN readable THEN 'org.shop:shop' || (k + 1) || ':${lib.version}:compile,org.base:managed::test' ELSE '' END AS dependencies, CASE WHEN readable THEN 'managed:9.' || k ELSE '' END AS managed FROM files",
)
def _(t: Tables) -> DataFrame:
    one = lambda d: F.concat_ws(":", d["group_id"], d["artifact_id"], d["version"], d["scope"])
    fixed = lambda d: F.concat_ws(":", d["artifact_id"], d["version"])
    return t.project("pom").select(_key("path"), F.col("artifact_id").alias("artifact"), "version", F.col("parent.artifact_id").alias("parent"), F.element_at("properties", "lib.version").alias("lib"), F.array_join(F.transform("dependencies", one), ",").alias("dependencies"), F.array_join(F.transform("managed", fixed), ",").alias("managed"))


def _key(path: str):
    return F.regexp_extract(path, "/s([0-9]+)/", 1).cast("long").alias("k")


@query(
    "src_19_dependency_closure",
    using(FILES)
    + ", d AS (SELECT k, 'org.shop' AS g, 'shop' || (k + 1) AS a, '3.' || n || '.1' AS v, 'compile' AS scope FROM files WHERE readable UNION ALL SELECT k, 'org.base', 'managed', '9.' || k, 'test' FROM files WHERE readable) SELECT k, g || ':' || a || ':' || v || ':' || scope AS dependency, '/m2/' || replace(g, '.', '/') || '/' || a || '/' || v || '/' || a || '-' || v || '.jar' AS jar FROM d",
)
def _(t: Tables) -> DataFrame:
    return L.dependency_jars(t.project("pom"), "/m2").select(_key("path"), "dependency", "jar")


@query("src_06_properties", using(FILES) + "SELECT k, CASE WHEN readable THEN CAST(port AS VARCHAR) ELSE '' END AS port, CASE WHEN readable THEN 'jdbc:db://host' || n || '/shop' ELSE '' END AS url, CASE WHEN readable THEN 'cache' || n ELSE '' END AS cache, CASE WHEN readable THEN 'WARN' ELSE '' END AS level, CASE WHEN readable THEN 'Database (JDBC/JPA),Redis' ELSE '' END AS middleware FROM files")
def _(t: Tables) -> DataFrame:
    return t.project("properties").select(_key("path"), F.col("server_port").alias("port"), F.col("datasource_url").alias("url"), F.col("redis_host").alias("cache"), F.col("log_level").alias("level"), F.array_join("middleware", ",").alias("middleware"))


@query("src_06_yaml", using(FILES) + "SELECT k, CASE WHEN readable THEN CAST(port AS VARCHAR) ELSE '' END AS port, CASE WHEN readable THEN name ELSE '' END AS application, CASE WHEN readable THEN 'broker' || n || ':9092' END AS servers, CASE WHEN readable THEN 'DEBUG' ELSE '' END AS level, CASE WHEN readable THEN 'Message Queue,Kafka' ELSE '' END AS middleware FROM files")
def _(t: Tables) -> DataFrame:
    return t.project("yaml").select(_key("path"), F.col("server_port").alias("port"), F.col("application_name").alias("application"), F.element_at("items", "spring.kafka.servers").alias("servers"), F.col("log_level").alias("level"), F.array_join("middleware", ",").alias("middleware"))


@query("src_07_sql_script", using(FILES) + "SELECT k, CASE WHEN readable THEN 'shop.supplier_' || k || '(id,name,price)' ELSE '' END AS tables, CASE WHEN readable THEN 'by_name ON supplier_' || k ELSE '' END AS indexes, CASE WHEN readable THEN 1 ELSE 0 END AS inserts, CASE WHEN readable THEN 1 ELSE 0 END AS alters FROM files")
def _(t: Tables) -> DataFrame:
    one = lambda x: F.concat(x["schema"], F.lit("."), x["table_name"], F.lit("("), F.array_join(x["columns"], ","), F.lit(")"))
    return t.project("sql").select(_key("path"), F.array_join(F.transform("tables", one), ";").alias("tables"), F.array_join("indexes", ";").alias("indexes"), F.col("insert_count").alias("inserts"), F.col("alter_count").alias("alters"))


@query("src_08_mapper", using(FILES) + "SELECT k, CASE WHEN readable THEN 'org.shop.mapper.Supplier' || k || 'Mapper' ELSE '' END AS namespace, CASE WHEN readable THEN 'SELECT find long row SELECT * FROM supplier_' || k || ' WHERE id = #{id};DELETE drop   DELETE FROM nation_' || n ELSE '' END AS statements, CASE WHEN readable THEN 'row:2:1' ELSE '' END AS maps, CASE WHEN readable THEN 1 ELSE 0 END AS fragments, CASE WHEN readable THEN 'supplier_' || k || ',nation_' || n ELSE '' END AS tables FROM files")
def _(t: Tables) -> DataFrame:
    one = lambda x: F.concat_ws(" ", x["type"], x["id"], x["parameter_type"], x["result_type"], x["sql_preview"])
    row = lambda x: F.concat_ws(":", x["id"], x["results"], x["ids"])
    return t.project("mapper").select(_key("path"), "namespace", F.array_join(F.transform("statements", one), ";").alias("statements"), F.array_join(F.transform("result_maps", row), ";").alias("maps"), "fragments", F.array_join("tables", ",").alias("tables"))


@query("src_09_markdown", using(FILES) + "SELECT k, CASE WHEN readable THEN 'H1: Supplier ' || k || ';H2: Use' ELSE '' END AS headings, CASE WHEN readable THEN 1 ELSE 0 END AS code_blocks, CASE WHEN readable THEN 'the list -> list' || k || '.md' ELSE '' END AS links, CASE WHEN readable THEN 'Supplies the shop from nation ' || n || ' since long ago.' ELSE '' END AS description FROM files")
def _(t: Tables) -> DataFrame:
    return t.project("markdown").select(_key("path"), F.array_join("headings", ";").alias("headings"), F.col("code_blocks").cast("int").alias("code_blocks"), F.array_join("links", ";").alias("links"), "description")


@query("src_10_dockerfile", using(FILES) + "SELECT k, CASE WHEN readable THEN 'maven:3 AS build' ELSE '' END AS image, CASE WHEN readable THEN port || ',9' || n ELSE '' END AS ports, CASE WHEN readable THEN 'shop' || k END AS name, CASE WHEN readable THEN 'build,stage-2' ELSE '' END AS stages, CASE WHEN readable THEN 'target/shop' || k || '.jar' ELSE '' END AS jar FROM files")
def _(t: Tables) -> DataFrame:
    return t.project("dockerfile").select(_key("path"), F.col("base_image").alias("image"), F.array_join("ports", ",").alias("ports"), F.element_at("env", "NAME").alias("name"), F.array_join("stages", ",").alias("stages"), F.col("jar_path").alias("jar"))


@query("src_11_compose", using(FILES) + "SELECT k, CASE WHEN readable THEN 'db' || k || '=mysql:8,cache=redis:' || n || ',app=shop/app' || k ELSE '' END AS services, CASE WHEN readable THEN 'Database,Redis' ELSE '' END AS middleware, readable AS volumes, false AS networks FROM files")
def _(t: Tables) -> DataFrame:
    return t.project("compose").select(_key("path"), F.array_join(F.transform("services", lambda s: F.concat_ws("=", s["name"], s["image"])), ",").alias("services"), F.array_join("middleware", ",").alias("middleware"), "volumes", "networks")


@query("src_12_shell", using(FILES) + "SELECT k, CASE WHEN readable THEN '#!/bin/bash' ELSE '' END AS shebang, CASE WHEN readable THEN CAST(port AS VARCHAR) END AS port, CASE WHEN readable THEN '--server.port=' || port || ' --spring.profiles.active=dev,n' || n ELSE '' END AS params, CASE WHEN readable THEN 'startup' ELSE 'utility' END AS purpose, CASE WHEN readable THEN 'dev,n' || n ELSE '' END AS profiles FROM files")
def _(t: Tables) -> DataFrame:
    return t.project("shell").select(_key("path"), "shebang", F.element_at("env", "PORT").alias("port"), F.array_join("params", " ").alias("params"), "purpose", F.array_join("profiles", ",").alias("profiles"))


@query("src_13_logging", using(FILES) + "SELECT k, CASE WHEN readable THEN 'INFO' ELSE '' END AS root, CASE WHEN readable THEN 'org.shop.n' || n || '=DEBUG,org.base=inherit' ELSE '' END AS loggers, CASE WHEN readable THEN 'OUT' || k || '=console,FILE=file' ELSE '' END AS appenders FROM files")
def _(t: Tables) -> DataFrame:
    pair = lambda a, b: lambda s: F.concat_ws("=", s[a], s[b])
    return t.project("logging").select(_key("path"), F.col("root_level").alias("root"), F.array_join(F.transform("loggers", pair("name", "level")), ",").alias("loggers"), F.array_join(F.transform("appenders", pair("name", "type")), ",").alias("appenders"))


@query("src_14_unreadable", using(FILES) + "SELECT k, 'content is missing' AS error FROM files WHERE NOT readable")
def _(t: Tables) -> DataFrame:
    """A file that cannot be read gives an asset with an error; it stops nothing."""
    return t.project("pom").filter("line_count is null").select(_key("path"), F.lit("content is missing").alias("error"))


@query("src_16_comments", using(FILES) + "SELECT k, CASE WHEN readable THEN 'javadoc' ELSE 'none' END AS style, CASE WHEN readable THEN 'Supplies nation ' || n || '.' ELSE '' END AS summary, CASE WHEN readable THEN 'id=the key of the row' ELSE '' END AS params, CASE WHEN readable THEN 'IOException=if it fails' ELSE '' END AS throws, CASE WHEN readable THEN 'the supplier' ELSE '' END AS returns, CASE WHEN readable THEN 'TODO: rename ' || k ELSE '' END AS notes FROM files")
def _(t: Tables) -> DataFrame:
    named = lambda x: F.concat_ws("=", x["name"], x["text"])
    return t.project("comment").select(_key("path"), "style", "summary", F.array_join(F.transform("params", named), ";").alias("params"), F.array_join(F.transform("throws", named), ";").alias("throws"), "returns", F.array_join("notes", ";").alias("notes"))


@query(
    "src_15_classes",
    using(JAVA)
    + "SELECT address, kind, CASE kind WHEN 'CLASS' THEN mark END AS annotation, CASE kind WHEN 'CLASS' THEN 'Base' || k % 3 WHEN 'INTERFACE' THEN 'Sold' ELSE '' END AS extends, CASE kind WHEN 'CLASS' THEN 'Sold,Priced' WHEN 'ENUM' THEN 'Priced' ELSE '' END AS implements, CASE kind WHEN 'CLASS' THEN 'Keeps ' || p_name || '.' WHEN 'INTERFACE' THEN 'What part ' || k || ' gives.' ELSE '' END AS description, CASE kind WHEN 'CLASS' THEN 'SIZE int,next Part' || (k + 1) || ',names List<String>' WHEN 'ENUM' THEN 'size int' ELSE '' END AS fields, CASE kind WHEN 'CLASS' THEN 2 ELSE 0 END AS imports, CASE kind WHEN 'CLASS' THEN CASE WHEN k % 3 = 0 THEN 5 ELSE 4 END ELSE 1 END AS methods, CASE kind WHEN 'CLASS' THEN CASE WHEN k % 3 = 0 THEN 36 ELSE 33 END WHEN 'ENUM' THEN 7 ELSE 3 END AS lines_of_code FROM java",
)
def _(t: Tables) -> DataFrame:
    names = F.array_join(F.transform("fields", lambda f: F.concat_ws(" ", f["name"], f["type"])), ",")
    return t.java().select("address", "kind", F.get("annotations", F.lit(0))["name"].alias("annotation"), F.array_join("extends", ",").alias("extends"), F.array_join("implements", ",").alias("implements"), "description", names.alias("fields"), F.size("imports").alias("imports"), F.size("methods").alias("methods"), "lines_of_code")


_METHODS = """m AS (SELECT k, address, next_address, p_size, unnest([{'name': '<init>', 'params': 'Part' || (k + 1) || ',int', 'returns': '', 'first': 16, 'last': 18, 'lines': 3, 'complexity': 1},
  {'name': 'find', 'params': 'String,int', 'returns': 'String', 'first': 21, 'last': 30, 'lines': 9, 'complexity': 3}, {'name': 'sweep', 'params': 'String', 'returns': 'void', 'first': 32, 'last': 38, 'lines': 6, 'complexity': 1},
  {'name': 'load', 'params': 'String', 'returns': 'void', 'first': 40, 'last': 45, 'lines': 6, 'complexity': 2}]) AS m FROM class
  UNION ALL SELECT k, address, next_address, p_size, {'name': 'main', 'params': 'String[]', 'returns': 'void', 'first': 47, 'last': 49, 'lines': 3, 'complexity': 1} FROM class WHERE k % 3 = 0
  UNION ALL SELECT k, address, next_address, p_size, {'name': 'find', 'params': 'String,int', 'returns': 'String', 'first': 5, 'last': 5, 'lines': 0, 'complexity': 1} FROM java WHERE kind = 'INTERFACE'
  UNION ALL SELECT k, address, next_address, p_size, {'name': 'size', 'params': '', 'returns': 'int', 'first': 8, 'last': 10, 'lines': 3, 'complexity': 1} FROM java WHERE kind = 'ENUM')"""


@query("src_15_methods", using(JAVA, _METHODS) + "SELECT address || '#' || m.name || '(' || m.params || ')' AS method, m.returns AS returns, m.first AS first, m.last AS last, m.lines AS lines FROM m")
def _(t: Tables) -> DataFrame:
    m = J.methods(t.java())
    return m.select(J.method_address(m).alias("method"), F.col("return_type").alias("returns"), F.col("line_start").alias("first"), F.col("line_end").alias("last"), F.col("line_count").alias("lines"))


@query("fn_25_method_complexity", using(JAVA, _METHODS) + "SELECT address || '#' || m.name AS method, m.complexity AS complexity FROM m")
def _(t: Tables) -> DataFrame:
    return J.methods(t.java()).select(F.concat_ws("#", "class_address", "name").alias("method"), "complexity")


@query("prj_08_call_edges", using(JAVA) + "SELECT address || '#find(String,int)' AS source, next_address || '#find' AS target, 'CALLS' AS type FROM class UNION ALL SELECT address || '#sweep(String)', next_address || '#sweep', 'CALLS' FROM class")
def _(t: Tables) -> DataFrame:
    return J.call_edges(t.java())


@query(
    "prj_09_key_statements",
    using(JAVA)
    + ", s AS (SELECT k, address, unnest([{'m': 'find(String,int)', 'type': 'CONDITION', 'text': 'count > SIZE', 'line': 23}, {'m': 'find(String,int)', 'type': 'THROW', 'text': 'new IllegalStateException(\"too many\")', 'line': 24}, {'m': 'find(String,int)', 'type': 'RETURN', 'text': 'next.find(name, count)', 'line': 29}, {'m': 'find(String,int)', 'type': 'EXTERNAL_CALL', 'text': 'System.out.println', 'line': 27}, {'m': 'find(String,int)', 'type': 'EXTERNAL_CALL', 'text': 'next.find', 'line': 29}, {'m': 'sweep(String)', 'type': 'SYNCHRONIZED', 'text': 'this', 'line': 34}, {'m': 'sweep(String)', 'type': 'EXTERNAL_CALL', 'text': 'names.remove', 'line': 35}, {'m': 'sweep(String)', 'type': 'EXTERNAL_CALL', 'text': 'next.sweep', 'line': 37}, {'m': 'load(String)', 'type': 'EXTERNAL_CALL', 'text': 'names.isEmpty', 'line': 42}, {'m': 'load(String)', 'type': 'EXTERNAL_CALL', 'text': 'next.load', 'line': 43}]) AS s FROM class UNION ALL SELECT k, address, {'m': 'main(String[])', 'type': 'EXTERNAL_CALL', 'text': 'System.out.println', 'line': 48} FROM class WHERE k % 3 = 0 UNION ALL SELECT k, address, {'m': 'size()', 'type': 'RETURN', 'text': 'size', 'line': 9} FROM java WHERE kind = 'ENUM') SELECT address || '#' || s.m AS method, s.type AS type, s.text AS text, s.line AS line FROM s",
)
def _(t: Tables) -> DataFrame:
    return J.key_statements(t.java()).drop("seq")


@query(
    "gr_23_entry_points",
    using(JAVA)
    + "SELECT address AS class, 'find' AS method, 'REST_CONTROLLER' AS type, '/parts/' || k AS detail, 'GET' AS http, 21 AS line FROM class UNION ALL SELECT address, 'sweep', 'SCHEDULED_TASK', '0 0 ' || k % 24 || ' * * *', '', 32 FROM class UNION ALL SELECT address, 'main', 'MAIN_METHOD', '', '', 47 FROM class WHERE k % 3 = 0",
)
def _(t: Tables) -> DataFrame:
    return J.entry_points(t.java()).withColumnRenamed("class_address", "class")


@query("gr_24_beans", using(JAVA) + "SELECT address, CASE mark WHEN 'RestController' THEN 'CONTROLLER' ELSE upper(mark) END AS type FROM class WHERE mark <> 'Utility'")
def _(t: Tables) -> DataFrame:
    return J.beans(t.java())


@query("gr_24_injections", using(JAVA) + "SELECT address AS source, 'Part' || (k + 1) AS target, unnest(['FIELD', 'CONSTRUCTOR']) AS how, unnest(['next', 'spare']) AS name FROM class")
def _(t: Tables) -> DataFrame:
    return J.injections(t.java())


_STRUCTURES = "CASE m.name WHEN 'find' THEN 'IF;THROW;FOREACH;VAR(String);CALL(println);RETURN;CALL(find)' WHEN 'sweep' THEN 'SYNC;CALL(remove);CALL(sweep)' WHEN 'load' THEN 'VAR(String);WHILE;CALL(isEmpty);CALL(load)' WHEN 'main' THEN 'CALL(println)' WHEN 'size' THEN 'RETURN' ELSE '' END"


@query("fn_12_body_hashes", using(JAVA, _METHODS) + f"SELECT address || '#' || m.name AS method, left(sha256({_STRUCTURES}), 8) AS hash FROM m WHERE m.lines > 0")
def _(t: Tables) -> DataFrame:
    return J.methods(t.java()).filter("body is not null").select(F.concat_ws("#", "class_address", "name").alias("method"), J.body_hash(F.col("structure")).alias("hash"))


@query("fn_13_signatures", using(JAVA) + "SELECT address, left(sha256('package:org.shop.' || layer || '.m' || k % 5 || chr(10) || 'imports:' || chr(10) || 'type:INTERFACE:Part' || k || ':public:extends=Sold' || chr(10) || 'fields:' || chr(10) || 'methods:find(String name,int count)->String::abstract'), 8) AS hash FROM java WHERE kind = 'INTERFACE'")
def _(t: Tables) -> DataFrame:
    return J.signature(t.java().filter("kind = 'INTERFACE'")).select("address", "hash")


@query("join_08_layer_violations", using(JAVA) + ", l AS (SELECT address, next_address, CASE layer WHEN 'controller' THEN 'CONTROLLER' WHEN 'service' THEN 'SERVICE' WHEN 'repository' THEN 'REPOSITORY' ELSE 'UTIL' END AS a, CASE (k + 1) % 4 WHEN 0 THEN 'CONTROLLER' WHEN 1 THEN 'SERVICE' WHEN 2 THEN 'REPOSITORY' ELSE 'UTIL' END AS b FROM class) SELECT address AS source, a AS source_layer, next_address AS target, b AS target_layer FROM l WHERE a || b NOT IN ('CONTROLLERSERVICE', 'SERVICEREPOSITORY', 'REPOSITORYUTIL')")
def _(t: Tables) -> DataFrame:
    imports = t.java().select(F.col("address").alias("source"), F.explode("imports").alias("target"))
    return L.violations(imports)


@query("join_09_import_resolve", using(JAVA) + "SELECT c.address AS source, n.address AS target FROM class c JOIN java n ON n.address = c.next_address")
def _(t: Tables) -> DataFrame:
    """An import by the end of a known class's name, the first in order."""
    found = kept(t.java().select("address", "imports"), "imports")
    wanted = found.select(F.col("address").alias("source"), F.explode("imports").alias("name"))
    return L.by_suffix(wanted, found.select("address"), "name").select("source", F.col("address").alias("target"))


@query("join_19_navigation", using(JAVA) + "SELECT c.address AS source, 'Part' || (c.k + 1) AS type, n.address AS target FROM class c LEFT JOIN java n ON n.address = c.next_address")
def _(t: Tables) -> DataFrame:
    """Types of fields to the classes that declare them: the full name, else the simple one, else without its arguments, else by its end."""
    found = kept(t.java().select("address", "name", "fields"), "fields")
    wanted = found.select(F.col("address").alias("source"), F.explode("fields").alias("f")).filter("f.name = 'next'").select("source", F.col("f.type").alias("type"))
    return L.navigated(wanted, found.select("address", "name")).select("source", "type", F.col("address").alias("target"))


@query("join_18_issue_source", using(JAVA) + "SELECT k, address || '#find' AS source FROM class WHERE k % 4 = 0 UNION ALL SELECT k, address FROM java WHERE k % 4 <> 0 UNION ALL SELECT k, address FROM java WHERE k % 4 = 0 AND kind = 'ENUM' UNION ALL SELECT k, address || '#find' FROM java WHERE k % 4 = 0 AND kind = 'INTERFACE'")
def _(t: Tables) -> DataFrame:
    """Issues name their class in full or simply; of those that name a method the method is found as well."""
    key = F.col("p_partkey")
    issues = t["part"].select(key.alias("k"), F.when(key % 2 == 0, C.full_name(key)).otherwise(F.concat(F.lit("Part"), key.cast("string"))).alias("class_name"), F.when(key % 4 == 0, "find").alias("method"))
    return L.located(issues, t.java())


def _flat_methods(t: Tables) -> DataFrame:
    return J.methods(t.java()).filter("body is not null").select(F.col("class_address").alias("file"), "name", "body")


@query("gr_22_flow_metrics", using(JAVA, _METHODS) + "SELECT address AS file, m.name AS name, CASE m.name WHEN 'find' THEN 7 WHEN 'sweep' THEN 5 WHEN 'load' THEN 5 ELSE 3 END AS nodes, CASE m.name WHEN 'find' THEN 8 WHEN 'sweep' THEN 4 WHEN 'load' THEN 5 ELSE 2 END AS edges, CASE m.name WHEN 'find' THEN 1 WHEN 'sweep' THEN 1 WHEN 'load' THEN 1 ELSE 0 END AS nesting FROM m WHERE m.lines > 0")
def _(t: Tables) -> DataFrame:
    return CF.flow_metrics(_flat_methods(t)).select("file", "name", "nodes", "edges", "nesting")


@query("gr_20_value_flows", using(JAVA) + "SELECT address AS file, 'load' AS name, 'sql' AS variable, 2 AS def_line, 4 AS use_line FROM class")
def _(t: Tables) -> DataFrame:
    return CF.value_flows(_flat_methods(t)).filter("variable = 'sql'")


@query("rul_09_tainted_paths", using(JAVA) + "SELECT address AS file, 'load' AS name, 2 AS source_line, 4 AS sink_line FROM class")
def _(t: Tables) -> DataFrame:
    return CF.tainted(_flat_methods(t), r"\bid\b", r"\.load\(", r"escape\(")


@query("rul_04_method_issues")
def _(t: Tables) -> DataFrame:
    """The whole catalogue of method rules over all methods, a row for each issue."""
    return M.method_issues(L.rule_subjects(t.java()))


@query("rul_04_console_issues", using(JAVA) + "SELECT 'RSPEC-106' AS rule_key, count(*) + count(*) FILTER (WHERE k % 3 = 0) AS n FROM class")
def _(t: Tables) -> DataFrame:
    """Of the issues of all method rules those on console output, whose number the sources say."""
    return M.method_issues(L.rule_subjects(t.java())).filter("rule_key = 'RSPEC-106'").groupBy("rule_key").agg(n().alias("n"))


@query("rul_06_catalogue", f"SELECT {len(M.METHOD_RULES)} AS rules, {sum(r.category == 'SECURITY' for r in M.METHOD_RULES)} AS security")
def _(t: Tables) -> DataFrame:
    """The registry as a table: keys, ratings and titles of all rules."""
    rows = t.spark.createDataFrame([(r.key, r.severity, r.category, r.message) for r in M.METHOD_RULES], "rule_key string, severity string, category string, message string")
    return rows.agg(F.countDistinct("rule_key").cast("int").alias("rules"), F.count_if(F.col("category") == "SECURITY").cast("int").alias("security"))


@query("flt_11_applicable", using(JAVA) + "SELECT address, mark <> 'Utility' AS spring, mark = 'Repository' AS database, mark = 'RestController' AS web FROM class")
def _(t: Tables) -> DataFrame:
    names = F.transform("annotations", lambda a: a["name"])
    return t.java().filter("kind = 'CLASS'").select("address", R.applicable(names, "SPRING").alias("spring"), R.applicable(names, "DATABASE").alias("database"), R.applicable(names, "WEB").alias("web"))


@query("fn_18_twelve_layers", using(JAVA) + "SELECT address, CASE layer WHEN 'controller' THEN 'CONTROLLER' WHEN 'service' THEN 'SERVICE' WHEN 'repository' THEN 'REPOSITORY' ELSE 'UTIL' END AS layer FROM java")
def _(t: Tables) -> DataFrame:
    return t.java().select("address", L.package_layer(F.col("package")).alias("layer"))


_VERBS = "CASE m.name WHEN 'find' THEN 'Query' WHEN 'main' THEN '' WHEN 'size' THEN '' WHEN '<init>' THEN 'Lifecycle' ELSE '' END"


@query("fn_23_method_tags", using(JAVA, _METHODS) + f"SELECT address || '#' || m.name AS method, {_VERBS} AS tags FROM m")
def _(t: Tables) -> DataFrame:
    return J.methods(t.java()).select(F.concat_ws("#", "class_address", "name").alias("method"), F.array_join(N.method_tags(F.col("name")), ",").alias("tags"))


@query(
    "gr_19_parameter_flow",
    recursive(
        JAVA,
        "own AS (SELECT address || '#' || m AS method, p, m FROM (SELECT address, unnest(['find', 'find', 'sweep']) AS m, unnest(['name', 'count', 'name']) AS p FROM class))",
        "step AS (SELECT c.address || '#' || o.m AS method, o.p, c.next_address || '#' || o.m AS target, n.kind = 'CLASS' OR n.kind = 'INTERFACE' AND o.m = 'find' AS known FROM class c JOIN own o ON o.method = c.address || '#' || o.m LEFT JOIN java n ON n.address = c.next_address)",
        "w AS (SELECT method AS start, p AS parameter, method || '>' || target AS walked, method AS path, target, 1 AS depth, coalesce(known, false) AS known FROM step UNION ALL SELECT w.start, w.parameter, w.walked || '>' || s.target, w.walked, s.target, w.depth + 1, coalesce(s.known, false) FROM w JOIN step s ON s.method = w.target AND s.p = w.parameter WHERE w.known AND w.depth < 6)",
    )
    + "SELECT start, parameter, path, target, depth, known FROM w UNION ALL SELECT address || '#sweep', 'name', address || '#sweep', 'java.util.List#remove', 1, false FROM class UNION ALL SELECT start, parameter, walked, 'java.util.List#remove', depth + 1, false FROM w WHERE known AND depth < 6 AND target LIKE '%#sweep'",
)
def _(t: Tables) -> DataFrame:
    """Where parameters go, through up to six calls."""
    return L.parameter_flow(t.java(), 6)
