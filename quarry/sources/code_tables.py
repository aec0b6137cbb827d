"""A code base written out of the star schema: Java sources, project files and paths, one row each.

The parsers and the operators on code have no source tree to read on a cluster without
one; these relations give them one of any size. Every text follows from the columns of
its row, so what a parser finds in it can be said in SQL over the same table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAYERS = ("controller", "service", "repository", "util")
MARKS = ("RestController", "Service", "Repository", "Utility")


def filled(template: str, **values: Column) -> Column:
    """The template with every $name$ replaced by its column."""
    parts = re.split(r"\$(\w+)\$", template)
    return F.concat(*(values[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts)))


def layer(key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LAYERS)), (key % 4 + 1).cast("int"))


def package(key: Column) -> Column:
    return F.concat(F.lit("org.shop."), layer(key), F.lit(".m"), (key % 5).cast("string"))


def full_name(key: Column) -> Column:
    return F.concat(package(key), F.lit(".Part"), key.cast("string"))


_CLASS = """package $package$;

import java.util.List;
import $next_name$;

/**
 * Keeps $name$. Made by $maker$.
 */
@$mark$("part$key$")
public class Part$key$ extends Base$base$ implements Sold, Priced {
    private static final int SIZE = $size$;
    @Autowired
    private Part$next$ next;
    private List<String> names;

    public Part$key$(@Qualifier("spare") Part$next$ spare, int size) {
        this.next = spare;
    }

    /** Finds by name. Counts too. */
    @GetMapping("/parts/$key$")
    public String find(String name, int count) {
        if (count > SIZE) {
            throw new IllegalStateException("too many");
        }
        for (String each : names) {
            System.out.println(each);
        }
        return next.find(name, count);
    }

    @Scheduled(cron = "0 0 $hour$ * * *")
    protected void sweep(String name) {
        synchronized (this) {
            names.remove(name);
        }
        next.sweep(name);
    }

    void load(String id) {
        String sql = "select * from part where id = " + id;
        while (names.isEmpty()) {
            next.load(sql);
        }
    }
$main$}
"""
_MAIN = """
    public static void main(String[] args) {
        System.out.println("part");
    }
"""
_INTERFACE = """package $package$;

/** What part $key$ gives. */
public interface Part$key$ extends Sold {
    String find(String name, int count);
}
"""
_ENUM = """package $package$;

public enum Part$key$ implements Priced {
    SMALL, LARGE("$size$") { void grow() { } };

    private int size;

    public int size() {
        return size;
    }
}
"""


def java_files(part: DataFrame) -> DataFrame:
    """key, path, content: of every tenth part an interface, of the next an enum, of all others a class."""
    key = F.col("p_partkey")
    values = {
        "package": package(key),
        "next_name": full_name(key + 1),
        "name": F.col("p_name"),
        "maker": F.col("p_brand"),
        "mark": F.element_at(F.array(*map(F.lit, MARKS)), (key % 4 + 1).cast("int")),
        "key": key,
        "next": key + 1,
        "base": key % 3,
        "size": F.col("p_size"),
        "hour": key % 24,
        "main": F.when(key % 3 == 0, _MAIN).otherwise(""),
    }
    text = F.when(key % 10 == 0, filled(_INTERFACE, **values)).when(key % 10 == 1, filled(_ENUM, **values)).otherwise(filled(_CLASS, **values))
    path = F.concat(F.lit("/repo/shop/src/main/java/"), F.replace(package(key), F.lit("."), F.lit("/")), F.lit("/Part"), key.cast("string"), F.lit(".java"))
    return part.select(key.alias("key"), path.alias("path"), text.alias("content"))


def paths(part: DataFrame) -> DataFrame:
    """key, path, bytes of files of all kinds, some in folders that a scan leaves out, some too large."""
    key = F.col("p_partkey")
    folder = F.when(key % 17 == 0, "src/test/java").when(key % 19 == 0, "target/classes").when(key % 23 == 0, "node_modules/x").when(key % 29 == 0, "latest/src").otherwise("src/main/java")
    suffix = F.element_at(F.array(*map(F.lit, ("java", "xml", "png", "md", "txt", "class"))), (key % 6 + 1).cast("int"))
    path = F.concat(F.lit("/repo/m"), (key % 3).cast("string"), F.lit("/"), folder, F.lit("/File"), key.cast("string"), F.lit("."), suffix)
    return part.select(key.alias("key"), path.alias("path"), (F.col("p_size").cast("long") * 300_000).alias("bytes"))


_POM = """<project>
  <parent>
    <groupId>org.base</groupId>
    <artifactId>parent$nation$</artifactId>
    <version>1.$nation$</version>
  </parent>
  <artifactId>shop$key$</artifactId>
  <version>$version$</version>
  <properties>
    <lib.version>3.$nation$.1</lib.version>
    <java.version>17</java.version>
  </properties>
  <modules>
    <module>core</module>
    <module>web$key$</module>
  </modules>
  <dependencyManagement><dependencies>
    <dependency><groupId>org.base</groupId><artifactId>managed</artifactId><version>9.$key$</version></dependency>
  </dependencies></dependencyManagement>
  <dependencies>
    <dependency>
      <groupId>org.shop</groupId>
      <artifactId>shop$next$</artifactId>
      <version>${lib.version}</version>
    </dependency>
    <dependency><groupId>org.base</groupId><artifactId>managed</artifactId><scope>test</scope></dependency>
  </dependencies>
</project>
"""
_PROPERTIES = """# settings of $name$
server.port=$port$
spring.datasource.url=jdbc:db://host$nation$/shop
spring.redis.host = cache$nation$
! off
logging.level.root=INFO
logging.level.root=WARN
"""
_YAML = """server:
  port: $port$
spring:
  application:
    name: "$name$"  # its name
  kafka:
    servers: broker$nation$:9092
logging:
  level:
    root: DEBUG
"""
_SCRIPT = """CREATE TABLE IF NOT EXISTS shop.supplier_$key$ (
  id BIGINT,
  name VARCHAR(25),
  price DECIMAL(12, 2),
  PRIMARY KEY (id)
);
CREATE UNIQUE INDEX by_name ON supplier_$key$ (name);
INSERT INTO supplier_$key$ SELECT * FROM nation_$nation$ JOIN region ON 1 = 1;
ALTER TABLE region ADD x INT;
"""
_MAPPER = """<mapper namespace="org.shop.mapper.Supplier$key$Mapper">
  <resultMap id="row" type="org.shop.Supplier$key$"><id column="id"/><result column="name"/><result column="price"/></resultMap>
  <sql id="all">id, name</sql>
  <select id="find" parameterType="long" resultMap="row">SELECT * FROM supplier_$key$ WHERE id = #{id}</select>
  <delete id="drop">DELETE FROM nation_$nation$</delete>
</mapper>
"""
_DOCKER = """FROM maven:3 AS build
WORKDIR /src
FROM openjdk:17
ENV PORT=$port$
ENV NAME=shop$key$
EXPOSE $port$ 9$nation$
COPY target/shop$key$.jar /app/shop.jar
ENTRYPOINT ["java", "-jar", "/app/shop.jar"]
"""
_COMPOSE = """version: "3"
services:
  db$key$:
    image: mysql:8
  cache:
    image: redis:$nation$
  app:
    image: shop/app$key$
volumes:
  data:
"""
_SHELL = """#!/bin/bash
# starts the shop
export JAVA_HOME=/opt/java$nation$
PORT=$port$
java -jar shop$key$.jar --server.port=$port$ --spring.profiles.active=dev,n$nation$
"""
_LOGBACK = """<configuration>
  <appender name="OUT$key$" class="ch.qos.logback.core.ConsoleAppender"/>
  <appender name="FILE" class="ch.qos.logback.core.rolling.RollingFileAppender"/>
  <logger name="org.shop.n$nation$" level="DEBUG"/>
  <logger name="org.base"/>
  <root level="INFO"><appender-ref ref="FILE"/></root>
</configuration>
"""
_MARKDOWN = """# Supplier $key$

Supplies the shop from nation $nation$ since long ago.

## Use

See [the list](list$key$.md).

```
run
```
"""
_COMMENT = """/**
 * Supplies nation $nation$. Kept for $name$.
 * TODO: rename $key$
 * @param id   the key of
 *             the row
 * @return the supplier
 * @throws IOException if it fails
 */"""
TEMPLATES = {"pom": ("pom.xml", _POM), "properties": ("application.properties", _PROPERTIES), "yaml": ("application.yml", _YAML), "sql": ("schema.sql", _SCRIPT), "mapper": ("SupplierMapper.xml", _MAPPER), "dockerfile": ("Dockerfile", _DOCKER), "compose": ("docker-compose.yml", _COMPOSE), "shell": ("start.sh", _SHELL), "logging": ("logback.xml", _LOGBACK), "markdown": ("README.md", _MARKDOWN), "comment": ("Comment.txt", _COMMENT)}


def project_files(supplier: DataFrame, kind: str) -> DataFrame:
    """path, format, content: a file of this kind for every supplier; of every fiftieth nothing can be read."""
    key = F.col("s_suppkey")
    name, template = TEMPLATES[kind]
    values = {"key": key, "next": key + 1, "nation": F.col("s_nationkey"), "name": F.col("s_name"), "port": 8000 + key % 1000, "version": F.concat(F.lit("2."), (key % 7).cast("string"))}
    content = F.when(key % 50 != 0, filled(template.replace("${lib.version}", "$lib$"), lib=F.lit("${lib.version}"), **values))
    return supplier.select(F.concat(F.lit("/repo/s"), key.cast("string"), F.lit(f"/{name}")).alias("path"), F.lit(kind).alias("format"), content.alias("content"))


_COMPONENT = """import { Comp$next$ } from './comp$next$';
import * as all from 'lib/util$nation$';

export function Comp$key$(props: any) {
  const q = window.location.search;
  if (q && props.name) {
    el.innerHTML = q$clean$;
  } else if (q) {
    return all.map?.(x => x);
  }
  return <b style="color: #aabbcc">{q}</b>;
}
"""


def web_files(supplier: DataFrame) -> DataFrame:
    """path, content: a component for every supplier, every fifth in a folder of its own; every third cleans its input."""
    key = F.col("s_suppkey")
    values = {"key": key, "next": key + 1, "nation": F.col("s_nationkey"), "clean": F.when(key % 3 == 0, ".map(escapeHtml)").otherwise("")}
    path = F.when(key % 5 == 0, filled("/repo/web/src/comp$key$/index.ts", key=key)).otherwise(filled("/repo/web/src/comp$key$.tsx", key=key))
    return supplier.select(path.alias("path"), filled(_COMPONENT, **values).alias("content"))
