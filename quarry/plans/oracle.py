"""The engine's relations in SQL, for the statements that queries are held against."""

_FILE = "'/repo/' || source || '/src/main/java/' || lang || '/Doc' || doc_id || '.java'"

ASSETS = """assets AS (SELECT 'org.' || source || '.' || lang || '.Doc' || doc_id AS address, doc_id,
  CASE lang WHEN 'fr' THEN 'INTERFACE' WHEN 'de' THEN 'ENUM' ELSE 'CLASS' END AS kind, source AS module, 'org.' || source || '.' || lang AS package,
  """ + _FILE + """ AS source_file, text AS body,
  len(string_split(rtrim(text, chr(10)), chr(10))) AS lines_of_code,
  len(list_filter(string_split(rtrim(text, chr(10)), chr(10)), lambda x: contains(x, '|'))) AS comment_lines,
  CAST(len(regexp_extract_all(text, '[.!?]')) AS DOUBLE) AS cyclomatic_complexity, CAST(doc_id % 2 AS INTEGER) AS inheritance_depth, CAST(n_chars // 500 AS INTEGER) AS method_count
  FROM documents)"""

_RULES = (
    ("DOC-LONG", "MAJOR", "CODE_SMELL", "Text is long", "n_chars > 5000"),
    ("DOC-SHOUT", "CRITICAL", "BUG", "Text shouts", "regexp_matches(text, '[A-Z]{6,}!!')"),
    ("DOC-SECRET", "CRITICAL", "SECURITY", "Text holds a secret", "regexp_matches(text, '(token|password|secret|api_key) = \"')"),
    ("DOC-EMAIL", "MAJOR", "SECURITY", "Text holds a mail address", "regexp_matches(text, '[a-z0-9.]+@[a-z0-9]+[.][a-z]+')"),
    ("DOC-LICENSE", "INFO", "DESIGN", "Text holds a licence line", "regexp_matches(text, '[Ll]icensed under')"),
    ("DOC-TABLE", "MINOR", "CODE_SMELL", "Text is a table", "regexp_matches(text, ' [|] [^|]+ [|] ')"),
    ("DOC-SHORT", "MINOR", "CODE_SMELL", "Text is short", "n_chars < 200"),
    ("DOC-NUMBER", "MINOR", "PERFORMANCE", "Text holds a long number", "regexp_matches(text, '[0-9]{12,}')"),
)

_METHOD = "CASE WHEN doc_id % 5 <> 0 THEN 'm' || (doc_id % 7) END"

ISSUES = (
    "fired AS (" + " UNION ALL ".join(f"SELECT '{k}' AS rule_key, '{s}' AS severity, '{c}' AS category, '{m}' AS message, doc_id, lang, source FROM documents WHERE {w}" for k, s, c, m, w in _RULES) + "), "
    f"issues AS (SELECT rule_key, severity, category, {_FILE} AS file, 'Doc' || doc_id AS class_name, {_METHOD} AS method, doc_id % 200 + 1 AS line, message || ' in ' || source AS message, doc_id FROM fired)"
)

REVIEWED = f"""reviewed AS (SELECT 'src/main/java/' || lang || '/Doc' || doc_id || '.java' AS file, doc_id % 200 + 1 AS line, {_METHOD} AS method,
  CASE WHEN toxic = 1 THEN 'CRITICAL' ELSE 'MAJOR' END AS severity, CASE WHEN doc_id % 11 <> 0 THEN (doc_id % 10) / 10 END AS confidence, 'review ' || doc_id AS suggestion, doc_id
  FROM labels JOIN documents USING (doc_id) WHERE toxic = 1 OR quality = 0)"""

EDGES = "edges AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, count(*) AS value FROM lineitem GROUP BY 1, 2)"

CHAIN = """chain AS (SELECT DISTINCT c_custkey AS src, unnest([(c_custkey * 7 + 3) % m, (c_custkey * 13 + 5) % m]) AS dst
  FROM customer, (SELECT greatest(500, count(*)) AS m FROM customer))"""


_LAYER = "CASE {0} % 4 WHEN 0 THEN 'controller' WHEN 1 THEN 'service' WHEN 2 THEN 'repository' ELSE 'util' END"
_NAME = "'org.shop.' || " + _LAYER + " || '.m' || {0} % 5 || '.Part' || ({0})"

#: The types of the code base by their parts.
JAVA = (
    "java AS (SELECT p_partkey AS k, CASE p_partkey % 10 WHEN 0 THEN 'INTERFACE' WHEN 1 THEN 'ENUM' ELSE 'CLASS' END AS kind, "
    + _LAYER.format("p_partkey") + " AS layer, " + _NAME.format("p_partkey") + " AS address, " + _NAME.format("(p_partkey + 1)") + " AS next_address, "
    "CASE p_partkey % 4 WHEN 0 THEN 'RestController' WHEN 1 THEN 'Service' WHEN 2 THEN 'Repository' ELSE 'Utility' END AS mark, p_name, p_brand, p_size FROM part), "
    "class AS (SELECT * FROM java WHERE kind = 'CLASS')"
)

#: The suppliers whose project files can be read.
FILES = "files AS (SELECT s_suppkey AS k, s_nationkey AS n, s_name AS name, 8000 + s_suppkey % 1000 AS port, s_suppkey % 50 <> 0 AS readable FROM supplier)"


def using(*relations: str) -> str:
    return "WITH " + ", ".join(relations) + " "


def recursive(*relations: str) -> str:
    return "WITH RECURSIVE " + ", ".join(relations) + " "
