"""Parsers of project files, as column expressions over their text; one row in, one row out.

Each takes a DataFrame with path and content and returns path, line_count and its own
columns. A null content gives nulls and empty lists, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import line_count

TEXT = lambda: F.coalesce(F.col("content"), F.lit(""))


def every(pattern: str, group: int = 1, text: Column | None = None) -> Column:
    return F.regexp_extract_all(TEXT() if text is None else text, F.lit(pattern), F.lit(group))


def first(pattern: str, group: int = 1, text: Column | None = None) -> Column:
    return F.trim(F.regexp_extract(TEXT() if text is None else text, pattern, group))


def records(pattern: str, fields: dict[str, str], text: Column | None = None) -> Column:
    """For each place that the pattern finds a struct of what each field's own pattern finds in it."""
    return F.transform(every(pattern, 0, text), lambda x: F.struct(*(F.trim(F.regexp_extract(x, p, 1)).alias(n) for n, p in fields.items())))


def _with(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select("path", F.when(F.col("content").isNotNull(), line_count(F.col("content"))).alias("line_count"), *(c.alias(n) for n, c in columns.items()))


_COORDINATES = {"group_id": "<groupId>([^<]+)</groupId>", "artifact_id": "<artifactId>([^<]+)</artifactId>", "version": "<version>([^<]+)</version>"}


def pom(df: DataFrame) -> DataFrame:
    """Coordinates of the project itself, its parent, properties, dependencies (scope compile by default), managed ones, plugins, modules, profiles."""
    text = TEXT()
    own = F.regexp_replace(text, r"(?s)<(parent|dependencies|dependencyManagement|build|profiles|properties)>.*?</\1>", "")
    parent = F.regexp_extract(text, r"(?s)<parent>(.*?)</parent>", 1)
    managed = F.regexp_extract(text, r"(?s)<dependencyManagement>(.*?)</dependencyManagement>", 1)
    direct = F.regexp_replace(text, r"(?s)<(dependencyManagement|build|profiles)>.*?</\1>", "")
    block = r"(?s)<dependency>.*?</dependency>"

    def dependencies(source: Column) -> Column:
        found = F.transform(
            every(block, 0, source),
            lambda x: F.struct(*(F.trim(F.regexp_extract(x, p, 1)).alias(n) for n, p in _COORDINATES.items()), F.coalesce(F.nullif(F.trim(F.regexp_extract(x, "<scope>([^<]+)</scope>", 1)), F.lit("")), F.lit("compile")).alias("scope")),
        )
        return found

    entries = every(r"<([\w.-]+)>([^<]+)</\1>", 0, F.regexp_extract(text, r"(?s)<properties>(.*?)</properties>", 1))
    pairs = F.transform(entries, lambda x: F.struct(F.regexp_extract(x, r"<([\w.-]+)>", 1).alias("key"), F.trim(F.regexp_extract(x, ">([^<]+)<", 1)).alias("value")))
    return _with(
        df,
        group_id=first(_COORDINATES["group_id"], text=own),
        artifact_id=first(_COORDINATES["artifact_id"], text=own),
        version=first(_COORDINATES["version"], text=own),
        parent=F.struct(*(first(p, text=parent).alias(n) for n, p in _COORDINATES.items())),
        properties=_last_of_key(pairs),
        dependencies=dependencies(direct),
        managed=dependencies(managed),
        plugins=records(r"(?s)<plugin>.*?</plugin>", _COORDINATES),
        modules=F.transform(every("<module>([^<]+)</module>"), lambda x: F.trim(x)),
        profiles=F.transform(every(r"(?s)<profile>\s*<id>([^<]+)</id>"), lambda x: F.trim(x)),
    )


def _last_of_key(pairs: Column) -> Column:
    """A map of key, value structs; of equal keys the last counts."""
    return F.aggregate(pairs, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x["key"]), F.create_map(x["key"], x["value"])))


# Middleware by what the keys of a configuration hold.
MIDDLEWARE = (
    ("Database (JDBC/JPA)", ("spring.datasource", "spring.jpa")),
    ("Redis", ("spring.redis",)),
    ("Message Queue", ("spring.rabbitmq", "spring.kafka")),
    ("Service Registry", ("spring.cloud.nacos", "spring.cloud.consul", "spring.cloud.eureka")),
    ("Config Center", ("spring.cloud.config", "spring.cloud.nacos.config")),
    ("Kafka", ("spring.kafka",)),
    ("RabbitMQ", ("spring.rabbitmq",)),
    ("Elasticsearch", ("spring.elasticsearch",)),
    ("MongoDB", ("spring.mongodb", "spring.data.mongodb")),
)


def _settings(df: DataFrame, items: Column) -> DataFrame:
    table = df.withColumn("_items", items)
    keys = F.array_join(F.map_keys("_items"), " ")

    def found(tokens: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for t in tokens:
            out |= keys.contains(t)
        return out

    def value(*names: str) -> Column:
        return F.coalesce(*(F.element_at("_items", n) for n in names), F.lit(""))

    return _with(
        table,
        items=F.col("_items"),
        server_port=value("server.port"),
        datasource_url=value("spring.datasource.url"),
        redis_host=value("spring.redis.host", "spring.redis.cluster.nodes"),
        active_profiles=value("spring.profiles.active"),
        application_name=value("spring.application.name"),
        log_level=value("logging.level.root"),
        middleware=F.array_compact(F.array(*(F.when(found(tokens), name) for name, tokens in MIDDLEWARE))),
    )


def properties(df: DataFrame) -> DataFrame:
    """key=value lines; comments begin with # or !."""
    own = F.filter(F.transform(F.split(TEXT(), "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("!") & (F.instr(x, "=") > 1))
    pairs = F.transform(own, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("key"), F.trim(F.substr(x, F.instr(x, "=") + 1)).alias("value")))
    return _settings(df, _last_of_key(pairs))


def yaml(df: DataFrame) -> DataFrame:
    """Nested maps as dotted keys, from the indentation: a line's parents are the last lines before it that stand further left."""
    own = F.filter(F.split(F.replace(TEXT(), F.lit("\r"), F.lit("")), "\n"), lambda x: F.trim(x).rlike(r"^[^#!\s-][^:]*:(\s|$)"))
    rows = F.transform(
        own,
        lambda x: F.struct(
            (F.length(x) - F.length(F.ltrim(x))).alias("indent"),
            F.trim(F.substring_index(x, ":", 1)).alias("key"),
            F.regexp_replace(F.trim(F.regexp_replace(F.substr(x, F.instr(x, ":") + 1), r"\s+#.*$", "")), r"""^["']|["']$""", "").alias("value"),
        ),
    )
    empty = F.struct(F.array().cast("array<struct<indent:int,key:string>>").alias("stack"), F.array().cast("array<struct<key:string,value:string>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        above = F.filter(s["stack"], lambda p: p["indent"] < x["indent"])
        stack = F.concat(above, F.array(F.struct(x["indent"], x["key"])))
        entry = F.struct(F.array_join(F.transform(stack, lambda p: p["key"]), ".").alias("key"), x["value"].alias("value"))
        return F.struct(stack.alias("stack"), F.when(x["value"] != "", F.concat(s["out"], F.array(entry))).otherwise(s["out"]).alias("out"))

    return _settings(df, _last_of_key(F.aggregate(rows, empty, step)["out"]))


def sql_script(df: DataFrame) -> DataFrame:
    """Tables with their columns, indexes, referenced tables in order, and counts of statements."""
    create = r"(?i)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(?:`?\w+`?\.)?`?\w+`?\s*\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)"
    head = r"(?i)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(?:`?(\w+)`?\.)?`?(\w+)`?\s*\("

    def columns(body: Column) -> Column:
        parts = F.transform(F.split(body, ","), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
        parts = F.filter(parts, lambda p: ~p.rlike("^(PRIMARY|KEY|INDEX|UNIQUE|CONSTRAINT|FOREIGN)"))
        return F.filter(F.transform(parts, lambda p: F.regexp_extract(p, r"`?(\w+)`?\s+\w+", 1)), lambda c: c != "")

    tables = F.transform(every(create, 0), lambda t: F.struct(F.regexp_extract(t, head, 1).alias("schema"), F.regexp_extract(t, head, 2).alias("table_name"), columns(F.regexp_replace(t, head, "")).alias("columns")))
    index = r"(?i)CREATE\s+(?:UNIQUE\s+)?INDEX\s+(?:IF\s+NOT\s+EXISTS\s+)?`?(\w+)`?\s+ON\s+`?(\w+)`?"
    return _with(
        df,
        tables=tables,
        indexes=F.transform(every(index, 0), lambda x: F.concat_ws(" ON ", F.regexp_extract(x, index, 1), F.regexp_extract(x, index, 2))),
        table_references=F.array_distinct(every(r"(?i)(?:FROM|JOIN|INTO|UPDATE|TABLE)\s+`?(\w+)`?")),
        insert_count=F.regexp_count(TEXT(), F.lit(r"(?i)INSERT\s+INTO")),
        alter_count=F.regexp_count(TEXT(), F.lit(r"(?i)ALTER\s+TABLE")),
    )


def _flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _preview(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def mapper(df: DataFrame) -> DataFrame:
    """Namespace, statements by kind, result maps, referenced tables and fragments."""

    def statements(tag: str) -> Column:
        block = rf"(?s)<{tag}\s+([^>]+)>(.*?)</{tag}>"

        def one(x: Column) -> Column:
            attributes, body = F.regexp_extract(x, block, 1), F.trim(F.regexp_extract(x, block, 2))
            of = {"id": r'id\s*=\s*"([^"]+)"', "parameter_type": r'parameterType\s*=\s*"([^"]+)"', "result_type": r'(?:resultType|resultMap)\s*=\s*"([^"]+)"'}
            return F.struct(*(F.regexp_extract(attributes, p, 1).alias(n) for n, p in of.items()), F.lit(tag.upper()).alias("type"), _preview(body, 200).alias("sql_preview"), F.length(body).alias("sql_length"))

        return F.transform(every(block, 0), one)

    maps = r"(?s)<resultMap\s+([^>]+)>(.*?)</resultMap>"
    return _with(
        df,
        namespace=first(r'namespace\s*=\s*"([^"]+)"'),
        statements=F.concat(*map(statements, ("select", "insert", "update", "delete"))),
        result_maps=F.transform(
            every(maps, 0),
            lambda x: F.struct(
                F.regexp_extract(F.regexp_extract(x, maps, 1), r'id\s*=\s*"([^"]+)"', 1).alias("id"),
                F.regexp_extract(F.regexp_extract(x, maps, 1), r'type\s*=\s*"([^"]+)"', 1).alias("type"),
                F.regexp_count(F.regexp_extract(x, maps, 2), F.lit("<result")).alias("results"),
                F.regexp_count(F.regexp_extract(x, maps, 2), F.lit("<id")).alias("ids"),
            ),
        ),
        tables=F.array_distinct(every(r"(?i)(?:FROM|INTO|UPDATE|JOIN)\s+`?([a-zA-Z_]\w*)`?")),
        fragments=F.regexp_count(TEXT(), F.lit(r"<sql[\s>]")),
    )


def markdown(df: DataFrame) -> DataFrame:
    """Headings, code blocks, links, second-level sections, the first paragraph of prose, and counts."""
    head = r"(?m)^(#{1,6})\s+(.+)$"
    section = r"(?ms)^##\s+([^\n]+)\n?(.*?)(?=^##\s|\z)"
    link = r"\[([^\]]+)\]\(([^)]+)\)"
    prose = F.filter(F.transform(F.split(TEXT(), "\n\n"), lambda x: F.trim(x)), lambda p: ~p.startswith("#") & ~p.startswith("```") & ~p.startswith("[") & (F.length(p) > 20))
    return _with(
        df,
        headings=F.transform(every(head, 0), lambda x: F.concat(F.lit("H"), F.length(F.regexp_extract(x, head, 1)).cast("string"), F.lit(": "), F.trim(F.regexp_extract(x, head, 2)))),
        code_blocks=F.floor(F.regexp_count(TEXT(), F.lit("```")) / 2),
        links=F.transform(every(link, 0), lambda x: F.concat_ws(" -> ", F.regexp_extract(x, link, 1), F.regexp_extract(x, link, 2))),
        sections=F.transform(every(section, 0), lambda x: F.struct(F.trim(F.regexp_extract(x, section, 1)).alias("title"), _preview(F.trim(F.regexp_extract(x, section, 2)), 300).alias("text"))),
        description=F.coalesce(_preview(F.get(prose, F.lit(0)), 200), F.lit("")),
        words=F.size(F.split(TEXT(), r"\s+")),
    )


def dockerfile(df: DataFrame) -> DataFrame:
    """Base image, ports, variables, copies, entry point, jar and build stages."""

    def instruction(name: str) -> Column:
        return F.regexp_replace(first(rf"(?im)^{name}\s+(.+)$"), '^"|"$', "")

    stage = r"(?im)^FROM\s+\S+(?:\s+AS\s+(\w+))?"
    stages = F.transform(every(stage, 0), lambda x, i: F.coalesce(F.nullif(F.regexp_extract(x, stage, 1), F.lit("")), F.concat(F.lit("stage-"), (i + 1).cast("string"))))
    pairs = F.transform(every(r"(?im)^ENV\s+\w+=.+$", 0), lambda x: F.struct(F.regexp_extract(x, r"(?i)^ENV\s+(\w+)=", 1).alias("key"), F.trim(F.regexp_extract(x, r"=(.+)$", 1)).alias("value")))
    return _with(
        df,
        base_image=instruction("FROM"),
        workdir=instruction("WORKDIR"),
        ports=F.flatten(F.transform(every(r"(?im)^EXPOSE\s+(.+)$"), lambda p: F.split(F.trim(p), r"\s+"))),
        env=_last_of_key(pairs),
        copies=F.transform(every(r"(?im)^(?:COPY|ADD)\s+(.+)$"), lambda x: F.trim(x)),
        entrypoint=instruction("ENTRYPOINT"),
        cmd=instruction("CMD"),
        jar_path=first(r"(?i)(\S+\.jar)"),
        stages=stages,
        multi_stage=F.size(stages) > 1,
    )


# Middleware by what a service's image holds; the first counts.
IMAGES = (("Database", "mysql|postgres|mariadb"), ("Redis", "redis"), ("RabbitMQ", "rabbitmq"), ("Kafka", "kafka"), ("Elasticsearch", "elasticsearch"), ("MongoDB", "mongo"), ("Service Registry", "nacos|consul|eureka"))


def compose(df: DataFrame) -> DataFrame:
    """Services (name, image) below the services key, their middleware, and whether networks and volumes are defined."""
    block = F.regexp_extract(TEXT(), r"(?ms)^services:[^\n]*\n(.*?)(?=^[^\s#]|\z)", 1)
    service = r"(?ms)^  ([\w.-]+):[ \t]*\n(.*?)(?=^  [\w.-]+:[ \t]*$|\z)"
    services = F.transform(every(service, 0, block), lambda x: F.struct(F.regexp_extract(x, service, 1).alias("name"), F.trim(F.regexp_extract(x, r"(?m)^\s{4,}image:\s*(.+)$", 1)).alias("image")))

    def kind(image: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, pattern in IMAGES:
            out = F.coalesce(out, F.when(image.rlike(pattern), name))
        return out

    return _with(df, services=services, middleware=F.array_compact(F.transform(services, lambda s: kind(s["image"]))), networks=TEXT().rlike(r"(?m)^networks:\s*$"), volumes=TEXT().rlike(r"(?m)^volumes:\s*$"))


# What a script is for, by the first words that it holds.
PURPOSES = (("startup", "start|run|launch"), ("deployment", "deploy|publish|release"), ("build", "build|compile|package"), ("initialization", "init|setup|install"), ("shutdown", "stop|shutdown|kill"))


def shell(df: DataFrame) -> DataFrame:
    """Shebang, variables, java and maven commands, --key=value parameters, purpose and profiles."""
    variable = r"(?m)^\s*(?:export\s+)?([A-Z_][A-Z0-9_]*)=(.+)$"
    pairs = F.transform(every(variable, 0), lambda x: F.struct(F.regexp_extract(x, variable, 1).alias("key"), F.trim(F.regexp_extract(x, variable, 2)).alias("value")))
    command = r"(?m)(?:^|\s)(java\s+-jar|java\s+-cp|mvn\s+\w+)(.+?)(?:\s&&|\s\||\s;|$)"
    purpose = F.lit(None).cast("string")
    for name, pattern in PURPOSES:
        purpose = F.coalesce(purpose, F.when(F.lower(TEXT()).rlike(pattern), name))
    profiles = F.flatten(F.transform(F.concat(every(r"--spring\.profiles\.active=(\S+)"), every(r"SPRING_PROFILES_ACTIVE=(\S+)")), lambda p: F.split(p, ",")))
    return _with(
        df,
        shebang=first(r"\A(#![^\n]*)"),
        env=_last_of_key(pairs),
        commands=F.transform(every(command, 0), lambda x: F.concat(F.regexp_extract(x, command, 1), F.regexp_extract(x, command, 2))),
        params=every(r"(--[a-zA-Z0-9.-]+=\S+)"),
        purpose=F.coalesce(purpose, F.lit("utility")),
        profiles=F.array_distinct(profiles),
    )


def logging(df: DataFrame) -> DataFrame:
    """Root level, loggers (level inherit by default) and appenders with their kind."""
    logger, appender = r'<logger\s+name="([^"]+)"(?:\s+level="([^"]+)")?', r'<appender\s+name="([^"]+)"\s+class="([^"]+)"'

    def kind(c: Column) -> Column:
        return F.when(c.contains("ConsoleAppender"), "console").when(c.contains("FileAppender"), "file").otherwise("other")

    return _with(
        df,
        root_level=first(r'(?i)<root[^>]+level\s*=\s*"([^"]+)"'),
        loggers=F.transform(every(logger, 0), lambda x: F.struct(F.regexp_extract(x, logger, 1).alias("name"), F.coalesce(F.nullif(F.regexp_extract(x, logger, 2), F.lit("")), F.lit("inherit")).alias("level"))),
        appenders=F.transform(every(appender, 0), lambda x: F.struct(F.regexp_extract(x, appender, 1).alias("name"), kind(F.regexp_extract(x, appender, 2)).alias("type"))),
    )


# Words that mark a note in a comment.
NOTES = ("TODO", "FIXME", "NOTE", "HACK", "XXX", "WORKAROUND")


def comments(df: DataFrame) -> DataFrame:
    """content is one comment: its style, cleaned text, summary (the first sentence, else the first line, else 200 characters), tags and notes."""
    text = TEXT()
    style = F.when(F.col("content").isNull(), "none").when(F.trim(text).startswith("/**"), "javadoc").when(F.trim(text).startswith("/*"), "block").otherwise("line")
    bare = F.regexp_replace(F.regexp_replace(text, r"/\*+", ""), r"\*+/", "")
    clean = F.trim(F.array_join(F.transform(F.split(bare, "\n"), lambda x: F.regexp_replace(F.trim(x), r"^(\*+|//)\s?", "")), "\n"))
    clean = F.regexp_replace(clean, r"^\s+|\s+$", "")
    dot, line = F.instr(clean, ". "), F.instr(clean, "\n")
    summary = F.when(dot > 1, F.left(clean, dot)).when(line > 1, F.trim(F.left(clean, line - 1))).otherwise(_preview(clean, 200))
    tag = r"(?s)@(?:param)\s+(\w+)\s+([^@]+)"
    thrown = r"(?s)@(?:throws|exception)\s+(\S+)\s+([^@]+)"

    def named(pattern: str) -> Column:
        return F.transform(every(pattern, 0, clean), lambda x: F.struct(F.regexp_extract(x, pattern, 1).alias("name"), _flat(F.regexp_extract(x, pattern, 2)).alias("text")))

    def noted(word: str) -> Column:
        return F.transform(every(rf"(?i)\b{word}\b[:\s]*([^\n]+)", 1, clean), lambda x: F.concat(F.lit(f"{word}: "), F.trim(x)))

    notes = F.concat(*map(noted, NOTES))
    return _with(df, style=style, cleaned=clean, summary=summary, params=named(tag), throws=named(thrown), returns=_flat(F.regexp_extract(clean, r"(?s)@return\s+([^@]+)", 1)), notes=notes)


PARSERS = {"pom": pom, "properties": properties, "yaml": yaml, "compose": compose, "dockerfile": dockerfile, "logging": logging, "sql": sql_script, "mapper": mapper, "markdown": markdown, "shell": shell, "comment": comments}


def parsed(files: DataFrame, kind: str) -> DataFrame:
    """The files of one format, parsed."""
    return PARSERS[kind](files.filter(F.col("format") == kind))
