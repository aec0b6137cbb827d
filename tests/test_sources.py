from quarry.sources import files, parsers


def one(spark, parser, content):
    return parser(spark.createDataFrame([("f", content)], "path string, content string")).first()


def test_scan_keeps_the_files_it_should(spark, tmp_path):
    for name in ("core/src/main/java/A.java", "core/pom.xml", "core/target/B.java", "core/Dockerfile", "x.png", "docs/README.md", "run.sh", "docker-compose.yml", "application-dev.yml", "db/schema.sql"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("text")
    (tmp_path / "large.txt").write_text("x" * (files.MOST_BYTES + 1))
    rows = {r["path"].split("/")[-1]: r for r in files.scan(spark, str(tmp_path)).collect()}
    assert {n: r["format"] for n, r in rows.items()} == {"A.java": "java", "pom.xml": "pom", "Dockerfile": "dockerfile", "README.md": "markdown", "run.sh": "shell", "docker-compose.yml": "compose", "application-dev.yml": "yaml", "schema.sql": "sql", "large.txt": None}
    assert rows["A.java"]["module"] == "core" and rows["large.txt"]["error"] and rows["large.txt"]["content"] is None
    assert files.java_sources(files.scan(spark, str(tmp_path))).count() <= 1


def test_pom(spark):
    r = one(
        spark,
        parsers.pom,
        """<project><parent><groupId>p.g</groupId><artifactId>pa</artifactId><version>9</version></parent>
<artifactId>own</artifactId><version>1.0</version><properties><java.version>17</java.version><x>1</x></properties>
<modules><module>a</module><module>b</module></modules>
<dependencyManagement><dependencies><dependency><groupId>m</groupId><artifactId>n</artifactId><version>3</version></dependency></dependencies></dependencyManagement>
<dependencies><dependency><groupId>g1</groupId><artifactId>a1</artifactId></dependency>
<dependency><groupId>g2</groupId><artifactId>a2</artifactId><version>2</version><scope>test</scope></dependency></dependencies>
<build><plugins><plugin><groupId>pg</groupId><artifactId>pl</artifactId></plugin></plugins></build><profiles><profile><id>dev</id></profile></profiles></project>""",
    )
    assert (r["group_id"], r["artifact_id"], r["version"], r["parent"]["group_id"]) == ("", "own", "1.0", "p.g")
    assert r["properties"] == {"java.version": "17", "x": "1"}
    assert [tuple(d) for d in r["dependencies"]] == [("g1", "a1", "", "compile"), ("g2", "a2", "2", "test")]
    assert [tuple(d) for d in r["managed"]] == [("m", "n", "3", "compile")]
    assert (r["modules"], r["profiles"], r["plugins"][0]["artifact_id"]) == (["a", "b"], ["dev"], "pl")


def test_properties_and_yaml_give_the_same_items(spark):
    flat = one(spark, parsers.properties, "# no\nserver.port = 8080\nspring.redis.host=h\nspring.kafka.x=a=b\nserver.port=9090\n\n")
    nested = one(spark, parsers.yaml, "server:\n  port: 9090 # here\nspring:\n  redis:\n    host: 'h'\n  kafka:\n    x: a=b\n")
    assert flat["items"] == nested["items"] == {"server.port": "9090", "spring.redis.host": "h", "spring.kafka.x": "a=b"}
    assert flat["middleware"] == ["Redis", "Message Queue", "Kafka"]
    assert (flat["server_port"], flat["redis_host"], flat["datasource_url"], flat["line_count"]) == ("9090", "h", "", 5)


def test_sql_script(spark):
    r = one(spark, parsers.sql_script, "CREATE TABLE IF NOT EXISTS `s`.`users` (id BIGINT PRIMARY KEY, name VARCHAR(20) DEFAULT ('x'), UNIQUE (name));\ncreate unique index ix on users (name);\nINSERT INTO users VALUES (1);\nSELECT * FROM users JOIN orders;")
    assert [(t["schema"], t["table_name"], t["columns"]) for t in r["tables"]] == [("s", "users", ["id", "name"])]
    assert (r["indexes"], r["insert_count"], r["alter_count"]) == (["ix ON users"], 1, 0)
    assert "orders" in r["table_references"]


def test_mapper(spark):
    r = one(spark, parsers.mapper, '<mapper namespace="a.UserMapper"><resultMap id="m" type="U"><id/><result/><result/></resultMap><sql id="c">x</sql><select id="find" parameterType="long" resultMap="m">SELECT x FROM users</select><insert id="add">INSERT INTO users</insert></mapper>')
    assert r["namespace"] == "a.UserMapper" and r["fragments"] == 1 and r["tables"] == ["users"]
    assert [(s["id"], s["type"], s["result_type"]) for s in r["statements"]] == [("find", "SELECT", "m"), ("add", "INSERT", "")]
    assert tuple(r["result_maps"][0]) == ("m", "U", 2, 1)


def test_markdown(spark):
    r = one(spark, parsers.markdown, "# Title\n\nThis is a long description of it.\n\n## Use\n```\nx\n```\nsee [here](u)\n## End\nbye\n")
    assert r["headings"] == ["H1: Title", "H2: Use", "H2: End"]
    assert (r["code_blocks"], r["links"], r["description"]) == (1, ["here -> u"], "This is a long description of it.")
    assert [s["title"] for s in r["sections"]] == ["Use", "End"]


def test_dockerfile(spark):
    r = one(spark, parsers.dockerfile, "FROM maven:3 AS build\nCOPY . .\nFROM jre:17\nEXPOSE 80 443\nENV A=1\nWORKDIR /app\nADD target/app.jar app.jar\nENTRYPOINT java -jar app.jar\n")
    assert (r["base_image"], r["ports"], r["env"], r["stages"], r["multi_stage"], r["jar_path"]) == ("maven:3 AS build", ["80", "443"], {"A": "1"}, ["build", "stage-2"], True, "target/app.jar")


def test_compose(spark):
    r = one(spark, parsers.compose, "version: '3'\nservices:\n  db:\n    image: postgres:15\n    ports: x\n  cache:\n    image: redis\nvolumes:\n  data:\n")
    assert [tuple(s) for s in r["services"]] == [("db", "postgres:15"), ("cache", "redis")]
    assert (r["middleware"], r["networks"], r["volumes"]) == (["Database", "Redis"], False, True)


def test_shell(spark):
    r = one(spark, parsers.shell, "#!/bin/bash\nexport APP_HOME=/a\njava -jar app.jar --spring.profiles.active=dev,test --x=1\n")
    assert (r["shebang"], r["env"], r["purpose"], r["profiles"]) == ("#!/bin/bash", {"APP_HOME": "/a"}, "utility", ["dev", "test"])
    assert r["params"] == ["--spring.profiles.active=dev,test", "--x=1"] and r["commands"][0].startswith("java -jar app.jar")


def test_logging(spark):
    r = one(spark, parsers.logging, '<configuration><appender name="C" class="ch.ConsoleAppender"/><appender name="F" class="x.RollingFileAppender"/><logger name="a.b"/><logger name="c" level="WARN"/><root level="INFO"/></configuration>')
    assert r["root_level"] == "INFO"
    assert [tuple(x) for x in r["loggers"]] == [("a.b", "inherit"), ("c", "WARN")]
    assert [tuple(x) for x in r["appenders"]] == [("C", "console"), ("F", "file")]


def test_comments(spark):
    r = one(spark, parsers.comments, "/**\n * Adds two. And more.\n * TODO: check it\n * @param a the first\n * @return the sum\n * @throws E when bad\n */")
    assert (r["style"], r["summary"], r["notes"], r["returns"]) == ("javadoc", "Adds two.", ["TODO: check it"], "the sum")
    assert [tuple(x) for x in r["params"]] == [("a", "the first")] and [tuple(x) for x in r["throws"]] == [("E", "when bad")]


def test_no_content(spark):
    for parser in (*parsers.PARSERS.values(), parsers.comments):
        assert one(spark, parser, None)["path"] == "f"
        assert one(spark, parser, "")["path"] == "f"
