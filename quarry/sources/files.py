"""Scan of a source tree: one row per file, with its format and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What a scan leaves out, what it reads, and the largest file in bytes.
LEFT_OUT_FOLDERS = ("target", ".git", ".idea", ".vscode", "node_modules", "dist", "build", ".gradle", ".mvn", "out", "bin")
LEFT_OUT_SUFFIXES = (".class", ".jar", ".war", ".zip", ".tar.gz", ".so", ".dll", ".png", ".jpg", ".gif", ".ico", ".svg")
READ_SUFFIXES = (".java", ".xml", ".yml", ".yaml", ".properties", ".sql", ".md", ".sh", ".gradle", ".json", ".conf", ".cfg", ".ini", ".txt")
MOST_BYTES = 10 * 1024 * 1024


def file_format(path: Column) -> Column:
    """The parser for a file: the first that takes it, in a fixed order."""
    name = F.lower(F.substring_index(path, "/", -1))
    return (
        F.when(name == "pom.xml", "pom")
        .when(name.rlike(r"^application.*\.properties$"), "properties")
        .when(name.rlike(r"^(application.*\.(yml|yaml)|bootstrap.*\.(yml|yaml))$"), "yaml")
        .when(name.rlike(r"^docker-compose.*\.(yml|yaml)$"), "compose")
        .when(name.rlike(r"^dockerfile"), "dockerfile")
        .when(name.isin("logback.xml", "logback-spring.xml", "log4j2.xml", "log4j2-spring.xml"), "logging")
        .when(name.endswith(".sql"), "sql")
        .when(name.endswith("mapper.xml"), "mapper")
        .when(name.endswith(".md"), "markdown")
        .when(name.endswith(".sh"), "shell")
        .when(name.endswith(".java"), "java")
    )


def scan(spark: SparkSession, root: str) -> DataFrame:
    """path, module, format, bytes, content, error. Files above MOST_BYTES have an error and no content; files of other kinds are left out.

    Dockerfiles are read though they have no suffix."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path, error = F.col("path"), size_error(F.col("length"))
    return files.filter(wanted(path)).select(
        path,
        module_of(path).alias("module"),
        file_format(path).alias("format"),
        F.col("length").alias("bytes"),
        F.when(error.isNull(), F.decode("content", "UTF-8")).alias("content"),
        error.alias("error"),
    )


def wanted(path: Column) -> Column:
    """Whether a scan reads a file: by its suffix, and no folder or suffix that is left out."""
    name = F.lower(F.substring_index(path, "/", -1))
    kept = name.startswith("dockerfile")
    for suffix in READ_SUFFIXES:
        kept |= name.endswith(suffix)
    dropped = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, LEFT_OUT_FOLDERS)))
    for suffix in LEFT_OUT_SUFFIXES:
        dropped |= name.endswith(suffix)
    return kept & ~dropped


def size_error(size: Column) -> Column:
    return F.when(size > MOST_BYTES, "file too large")


def module_of(path: Column) -> Column:
    """The folder above src, or the file's own folder."""
    found = F.regexp_extract(path, r"([^/]+)/src/", 1)
    return F.when(found != "", found).otherwise(F.element_at(F.split(path, "/"), -2))


def java_sources(files: DataFrame) -> DataFrame:
    """Java files of the main tree: below java/ or src, and no test or target in the path."""
    p = F.col("path")
    return files.filter(p.endswith(".java") & (p.contains("java/") | p.contains("src")) & ~p.contains("test") & ~p.contains("target"))
