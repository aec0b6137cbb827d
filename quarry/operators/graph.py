"""Graph operators on edge lists src, dst: degrees, components, reachability, paths, cycles, contraction."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no spark.checkpoint.dir and runs in one process, as in local tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or LOCAL_CHECKPOINTS


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared checkpoint folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def kept(df: DataFrame, tag: str) -> DataFrame:
    """Written to the shared folder as Parquet and read from there. For many wide rows, as a checkpoint holds them at full width; until the session ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex[:10]}"
    atexit.register(_forget, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _forget(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may already have gone
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def degrees(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("src").alias("node")).unionAll(edges.select("dst"))
    return both.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def components(edges: DataFrame) -> DataFrame:
    """node, component: the least node reached without regard to direction. Labels jump along their own labels, so rounds grow with the logarithm of the diameter."""
    both = cut(edges.select("src", "dst").union(edges.select("dst", "src")).distinct().toDF("node", "next"))
    labels = cut(both.groupBy("node").agg(F.least("node", F.min("next")).alias("label")))
    while True:
        seen = both.join(labels.toDF("next", "near"), "next").groupBy("node").agg(F.min("near").alias("near"))
        step = labels.join(seen, "node").select("node", "label", F.least("label", "near").alias("to"))
        new = cut(step.join(labels.toDF("to", "beyond"), "to", "left").select("node", "label", F.least("to", F.coalesce("beyond", "to")).alias("new")))
        if new.filter("label != new").isEmpty():
            return new.select("node", F.col("label").alias("component"))
        labels = new.select("node", F.col("new").alias("label"))


def reached(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """node, depth of every node reached from the starts, breadth first, until a level reaches none that is new."""
    known = cut(starts.select("node", F.lit(0).alias("depth")).distinct())
    front = known
    for depth in count(1):
        near = front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        front = cut(near.join(known, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            return known
        known = cut(known.union(front))


def chains(spark: SparkSession, edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """start, path: paths of at most `depth` edges, ended by a leaf, the depth or a node seen before (which the path then repeats)."""
    live, ended = starts.select(F.col("node").alias("start"), "node", F.array("node").alias("path")), []
    for _ in range(depth):
        step = cut(live.join(edges.select("src", "dst"), F.col("node") == F.col("src"), "left").select("start", "path", "dst", F.array_contains("path", F.col("dst")).alias("over")))
        on = step.select("start", F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"), "over")
        ended += [step.filter("dst is null").select("start", "path"), on.filter("over").select("start", "path")]
        live = on.filter("not over").drop("over")
    out = live.select("start", "path")
    for rows in ended:
        out = out.union(rows)
    return out.select("start", F.array_join("path", ">").alias("path"))


def paths_to(spark: SparkSession, edges: DataFrame, start: int, end: str, most: int) -> DataFrame:
    """path: simple paths of at most `most` nodes from the start to a node for which `end` holds; a path goes no further than such a node."""
    view = f"edges_{id(edges)}"
    edges.createOrReplaceTempView(view)
    on = "true" if end == "true" else f"NOT (w.{end})"
    return spark.sql(f"""
      WITH RECURSIVE walk(node, path) AS (
        SELECT CAST({start} AS BIGINT), array(CAST({start} AS BIGINT))
        UNION ALL
        SELECT e.dst, array_append(w.path, e.dst) FROM walk w JOIN {view} e ON w.node = e.src
        WHERE size(w.path) < {most} AND {on} AND NOT array_contains(w.path, e.dst))
      SELECT array_join(path, '>') AS path FROM walk WHERE {end}""")


def longest_path(edges: DataFrame, most: int) -> int:
    """Nodes of the longest simple path from any node: exact where no cycle is, by peeling; else paths of at most `most` nodes are walked, as their number grows exponentially."""
    e = cut(edges.select("src", "dst").filter("src != dst").distinct())
    left, links = e, e.count()
    for rounds in count(1):
        if links == 0:
            return rounds
        inner = cut(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"))
        if (rest := inner.count()) == links:
            break
        left, links = inner, rest
    walk = e.select(F.col("src").alias("node"), F.array("src").alias("path")).distinct()
    for size in range(1, most):
        walk = cut(walk.join(e, F.col("node") == F.col("src")).filter(~F.array_contains("path", F.col("dst"))).select(F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path")))
        if walk.isEmpty():
            return size
    return most


def cyclic(edges: DataFrame) -> DataFrame:
    """node, component of every node on a cycle of any length: the least node of its strongly connected component.

    Links that no cycle can hold are peeled off; each node takes the least node that reaches it as its colour, and what
    reaches that node within the colour is its component. The rest goes round again, without links between colours."""
    all_edges = cut(edges.select("src", "dst").distinct())
    found = all_edges.filter("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))
    left = cut(all_edges.filter("src != dst"))
    while True:
        links = left.count()
        while True:
            left = cut(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            if (rest := left.count()) == links:
                break
            links = rest
        if links == 0:
            return found.groupBy("node").agg(F.min("component").alias("component"))
        colours = cut(left.select(F.col("src").alias("node"), F.col("src").alias("colour")).distinct())  # after peeling each node is a source
        while True:
            seen = left.join(colours.toDF("src", "near"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("near").alias("near"))
            step = cut(colours.join(seen, "node").select("node", "colour", F.least("colour", "near").alias("new")))
            colours = step.select("node", F.col("new").alias("colour"))
            if step.filter("new != colour").isEmpty():
                break
        inside = cut(left.join(colours.toDF("src", "colour"), "src").join(colours.toDF("dst", "other"), "dst").filter("colour = other").select("src", "dst", "colour"))
        back = inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        roots = colours.filter("node = colour").select("node")
        members = cut(reached(back, roots).join(colours, "node").select("node", F.col("colour").alias("component")))
        large = members.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        found = cut(found.union(members.join(large, "component", "left_semi").select("node", "component")))
        gone = members.select(F.col("node").alias("src"))
        left = cut(inside.join(gone, "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti").select("src", "dst"))


def short_cycles(edges: DataFrame) -> DataFrame:
    """Cycles of two and three different nodes, each once, from its least node."""
    e = edges.select("src", "dst").filter("src != dst").distinct()
    a, b, c = (e.alias(x) for x in "abc")
    two = a.join(b, (F.col("a.dst") == F.col("b.src")) & (F.col("b.dst") == F.col("a.src"))).filter("a.src < a.dst").select(F.concat_ws(">", "a.src", "a.dst").alias("cycle"))
    path = a.join(b, F.col("a.dst") == F.col("b.src")).filter("a.src < a.dst and a.src < b.dst and b.dst != a.dst")
    three = path.join(c, (F.col("b.dst") == F.col("c.src")) & (F.col("c.dst") == F.col("a.src"))).select(F.concat_ws(">", "a.src", "a.dst", "b.dst").alias("cycle"))
    return two.union(three)


def contracted(edges: DataFrame, cluster: Column, name: str) -> DataFrame:
    """Edges with all nodes for which cluster(node) holds made one; inner links dropped, values summed."""

    def to(column: str) -> Column:
        return F.when(cluster(F.col(column)), name).otherwise(F.col(column))

    return edges.select(to("src").alias("src"), to("dst").alias("dst"), "value").filter("src != dst").groupBy("src", "dst").agg(F.sum("value").alias("value"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The links between kept nodes."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")
