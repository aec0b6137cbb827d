"""Mixing sources to target weights by entropy balancing.

Every source has a target number of words. Among all non-negative document rates
of at most MOST that meet it, those are taken that stay closest to one in
relative entropy; they are exponentially tilted by a document's size,

    rate = min(MOST, exp(tilt * size / mean size of the source)),

where the tilt solves the convex dual of the problem. It is found by Newton steps,
each one aggregation over all (source, size) counts, kept inside a bracket that
halves where a step would leave it. Rates become whole copies by systematic
rounding along the sizes of a source: every class of equal size gets the copies
that the running total of its rates crosses, drawn by hash within the class. What
then is left to a source's target is mended by one document whose size comes
closest, where that helps. Reruns agree.

Null texts have no words. A null source is a source of its own, the last one.
Documents without words take nothing. Rows that agree in id, source and size are
interchangeable. Extra columns are passed through by `mix_documents`.

An empty table has no sources and gives no rows. Texts of any length are counted whole.
Columns of the documents may have any name: the mix stands beside a struct of them.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import BROADCAST_ROWS, materialise, small

MOST = 3
#: Relative error at which a source counts as solved, and the most steps.
CLOSE, STEPS = 1e-7, 60
#: Documents of equal source and size that are drawn from together.
CLASS = 1000


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    """Ascends as the sources do, null last."""
    return F.coalesce(F.concat(F.lit("a"), source.cast("string")), F.lit("b"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """sizes: key, source_size, mean. Adds target: shares by weight of all words, at most MOST times a source's own, the excess reshared by weight.

    Sources are capped in the order of their caps per weight for as long as the level of the others lies above."""
    ranked = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(Window.orderBy("key")) - 1, F.lit(len(weights))) + 1).cast("int")))
    everything, cap = Window.partitionBy(), F.col("source_size") * MOST
    filling = Window.orderBy(F.col("source_size") / F.col("w"), "key").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(filling), F.lit(0))
    open_weight = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(filling), F.lit(0))
    levels = ranked.withColumn("level", left / open_weight)
    at = F.struct((F.col("source_size") / F.col("w")).alias("cap"), "key", "level")
    first = levels.withColumn("level", F.min(F.when(F.col("level") * F.col("w") <= cap, at)).over(everything)["level"])
    return first.select("key", "source_size", "mean", F.least(cap.cast("double"), F.col("level") * F.col("w")).alias("target"))


def tilts(counts: DataFrame, sources: DataFrame) -> DataFrame:
    """counts: key, size, n. Adds tilt to the sources; null where all documents are taken MOST times or nothing is wanted."""
    solvable = (F.col("target") > 0) & (F.col("target") < F.col("source_size") * MOST * (1 - 1e-12))
    state = materialise(sources.withColumns({"tilt": F.when(solvable, F.lit(0.0)), "low": F.lit(None).cast("double"), "high": F.lit(None).cast("double"), "off": F.lit(None).cast("double")}), "tilts")
    for _ in range(STEPS):
        at = counts.join(state.filter("tilt is not null"), "key")
        z, rate = F.col("size") / F.col("mean"), F.least(F.lit(float(MOST)), F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(2.0))))
        words = F.col("n") * F.col("size") * rate
        moved = at.groupBy("key").agg(F.sum(words).alias("got"), F.sum(F.when(rate < MOST, words * z)).alias("slope"))
        new = state.drop("off").join(moved, "key", "left")
        off = (F.col("got") - F.col("target")) / F.col("target")
        low, high = F.when(F.col("got") <= F.col("target"), F.col("tilt")).otherwise(F.col("low")), F.when(F.col("got") > F.col("target"), F.col("tilt")).otherwise(F.col("high"))
        new = new.withColumns({"off": F.abs(off), "low": low, "high": high})
        newton = F.col("tilt") - (F.col("got") - F.col("target")) / F.col("slope")
        inside = (F.col("slope") > 0) & (F.coalesce(F.col("low"), F.lit(float("-inf"))) < newton) & (newton < F.coalesce(F.col("high"), F.lit(float("inf")))) & (F.abs(newton - F.col("tilt")) <= 4 + 2 * F.abs("tilt"))
        halved = F.when(F.col("low").isNull(), F.col("high") * 2 - 1).when(F.col("high").isNull(), F.col("low") * 2 + 1).otherwise((F.col("low") + F.col("high")) / 2)
        step = F.when(F.col("off") <= CLOSE, F.col("tilt")).when(inside, newton).otherwise(F.when(F.col("low").isNull() & (F.col("high") >= 0), F.col("high") - 1).when(F.col("high").isNull() & (F.col("low") <= 0), F.col("low") + 1).otherwise(halved))
        state = materialise(new.select("key", "source_size", "mean", "target", F.when(F.col("tilt").isNotNull(), step).alias("tilt"), "low", "high", "off"), "tilts")
        if (state.agg(F.max("off")).first()[0] or 0.0) <= CLOSE:
            break
    return state.drop("low", "high", "off")


def _crossed(classes: DataFrame) -> DataFrame:
    """classes: key, size, part, n, rate. Adds base, the whole part of the rate, and extra: the whole numbers that the running total of
    the rest crosses along the classes of a source. Totals run inside stretches of like size first, then over the stretches, so a
    source is never in one task; sums are taken in order, so reruns agree."""
    stretch = [F.floor(F.log2(F.col("size") + 1) * 64).alias("range"), F.floor(F.col("part") / 1024).alias("block")]
    rest = F.col("n") * (F.col("rate") - F.floor("rate"))
    inside = Window.partitionBy("key", "range", "block").orderBy("size", "part")
    dealt = materialise(classes.select("*", *stretch).withColumn("run", F.sum(rest).over(inside)), "runs")
    ahead = Window.partitionBy("key").orderBy("range", "block").rowsBetween(Window.unboundedPreceding, -1)
    whole = dealt.groupBy("key", "range", "block").agg(F.max("run").alias("whole"))
    before = materialise(whole.select("key", "range", "block", F.coalesce(F.sum("whole").over(ahead), F.lit(0.0)).alias("before")), "before")
    last = F.coalesce(F.lag("run").over(inside), F.lit(0.0))
    upto = dealt.withColumn("last", last).join(small(before), ["key", "range", "block"])
    extra = F.floor(F.col("before") + F.col("run") + 0.5) - F.floor(F.col("before") + F.col("last") + 0.5)
    # a stretch begins where the one before it ended
    return upto.withColumns({"base": F.floor("rate"), "extra": extra}).drop("range", "block", "run", "last", "before")


def plan_copies(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, key (its source's), size, source_size, target, copies."""
    own = materialise(docs.select(F.col(id_col).cast("long").alias("doc_id"), _key(F.col(source_col)).alias("key"), words_in(F.col(text_col)).alias("size")), "sizes")
    counts = materialise(own.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")), "counts")
    total = counts.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), (F.sum(F.col("n") * F.col("size")) / F.greatest(F.sum(F.when(F.col("size") > 0, F.col("n"))), F.lit(1))).alias("mean"))
    solved = tilts(counts.filter("size > 0"), targets(total, weights))
    rate = F.when(F.col("target") <= 0, 0.0).when(F.col("tilt").isNull(), float(MOST)).otherwise(F.least(F.lit(float(MOST)), F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(2.0)))))
    drawn = F.xxhash64(F.lit("draw"), "doc_id")
    # only sizes of more than CLASS documents have parts: at most one for CLASS documents
    wide = counts.filter(F.col("n") > CLASS).select("key", "size", F.ceil(F.col("n") / CLASS).alias("parts"))
    placed = own.join(small(wide), ["key", "size"], "left").withColumn("part", F.pmod(drawn, F.coalesce("parts", F.lit(1)))).drop("parts")
    placed = materialise(placed, "placed")
    classes = placed.groupBy("key", "size", "part").agg(F.count(F.lit(1)).alias("n")).join(small(solved), "key").withColumn("rate", rate)
    classes = _crossed(materialise(classes, "classes"))
    turn = F.row_number().over(Window.partitionBy("key", "size", "part").orderBy(drawn, "doc_id"))
    copies = F.when(F.col("size") > 0, F.col("base") + (F.col("turn") <= F.col("extra")).cast("long")).otherwise(F.lit(0))
    rounded = placed.withColumn("turn", turn).join(classes.select("key", "size", "part", "source_size", "target", "base", "extra"), ["key", "size", "part"]).select("doc_id", "key", "size", "part", "turn", "source_size", "target", copies.cast("long").alias("copies"))
    rounded = materialise(rounded, "rounded")
    short = rounded.groupBy("key").agg((F.round(F.max("target")) - F.sum(F.col("copies") * F.col("size"))).alias("short"))
    open_to = ((F.col("short") > 0) & (F.col("copies") < MOST)) | ((F.col("short") < 0) & (F.col("copies") > 0))
    miss = F.abs(F.col("size") - F.abs("short"))
    mend = rounded.join(small(short), "key").filter(open_to & (F.col("size") > 0) & (miss < F.abs("short"))).groupBy("key").agg(F.min_by(F.struct("size", "part", "turn", F.signum("short").cast("long").alias("change")), F.struct(miss, "size", "part", "turn")).alias("m"))
    mend = mend.select("key", "m.size", "m.part", "m.turn", "m.change")
    return rounded.join(mend, ["key", "size", "part", "turn"], "left").select("doc_id", "key", "size", "source_size", "target", (F.col("copies") + F.coalesce("change", F.lit(0))).alias("copies"))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The documents themselves, each as many times as it is taken. Copies are dealt by id, source and size, any of the rows that agree in these."""
    planned = plan_copies(docs, weights)
    own = ["mix_id", "mix_key", "mix_size"]  # the document itself is a struct beside these, so no name can clash
    plan = materialise(planned.select(F.col("doc_id").alias(own[0]), F.col("key").alias(own[1]), F.col("size").alias(own[2]), F.col("copies").alias("mix_copies")), "copies")
    rows = docs.select(F.struct(*docs.columns).alias("mix_row"), F.col("doc_id").cast("long").alias(own[0]), _key(F.col("source")).alias(own[1]), words_in(F.col("text")).alias(own[2]))
    if not plan.groupBy(*own).count().filter("count > 1").isEmpty():  # rows that agree in all three take turns
        like = Window.partitionBy(*own)
        plan = plan.withColumn("mix_turn", F.row_number().over(like.orderBy("mix_copies")))
        rows = rows.withColumn("mix_turn", F.row_number().over(like.orderBy("mix_row.text")))
        own = [*own, "mix_turn"]
    plan = plan.filter("mix_copies > 0")
    few = plan.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    taken = rows.join(F.broadcast(plan) if few else plan, reduce(and_, (plan[c].eqNullSafe(rows[c]) for c in own)))
    return taken.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int")))).select("mix_row.*")
