"""Size-aware Jaccard join of documents over word n-grams, exact, with the components of its links.

A document's set holds its distinct shingles of SHINGLE lower-cased words; a
shorter text is one shingle as a whole, and one without words has an empty set
and no links. Documents of equal sets form one class from the start, so copies
cost nothing. Two sets link when 100 * |A and B| >= PERCENT * |A or B|.

1. Every shingle's frequency is counted over all documents, as hashes packed by
   bucket. Shingles found once can link nothing: a set of which fewer than
   PERCENT % occur elsewhere is out.
2. Light sets, up to a size x, meet by subsets: two sets of sizes p <= q link
   exactly if they share a subset of r(p, q) = ceil(PERCENT (p + q) / (100 + PERCENT))
   shingles. Each set emits its subsets of that size, once for every size its partner
   may have; equal subsets are links, settled by one aggregation.
3. Heavy sets scan inverted lists. Shingles are ordered from rare to frequent;
   two sets that link share one among the first n - ceil(PERCENT n / 100) + 1.
   In a few rounds each set is compared with a few sets that share most pairs of
   minimal hashes with it, and with the one among those whose shingles are the most
   frequent, which the others were likely copied from; what links grows into components. Then every pair of list mates in different
   components that passes the length and the positional filter is verified, so
   a list full of one group's copies costs no pairs, and no link between
   components is lost.
4. x is the size at which the counted costs of both ways add up to the least.

Shingles and sets are told apart by 64-bit hashes. Null texts count as empty.
Documents that share an id are classed by their texts; component_id is the
least id reached (a null id counts as larger than all others).

Defined results: an empty table gives no rows. Texts of any length are read whole; one
alone may be a batch. Other columns are not read and may have any name; `keep_one` passes
them through, and keeps one of the rows that agree in id and text.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .scratch import arrow_bytes, lean, lean_group, materialise, only, reclaim, small, spare, without
from .substring_dedup import PROBES, SLICE, TEXTS, _batch, _grouped, _keyed, _parts, _PACKED, _row, batch_number, bucket_count

SHINGLE, PERCENT = 5, 80
#: Sizes above this are never light: a set has too many subsets whatever the counts say.
MOST_LIGHT = 16
#: Rounds in which a set is compared with a few likely mates only, before all pairs of components that are left; pairs of minimal hashes by which mates are found.
ROUNDS, BANDS = 2, 16
#: Of texts whose shingles are made at once; bounds what that takes besides its result.
PIECE = 1 << 20


def required(p: int, q: int) -> int:
    """The least overlap of linked sets of p and q shingles."""
    return -(-PERCENT * (p + q) // (100 + PERCENT))


def shingles(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles, ordered by text and hash: the texts' indices and the hashes. Taken from PIECE bytes of whole texts at a time."""
    texts, hashes, i = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], 0
    while i < len(off) - 1:
        j = max(i + 1, int(np.searchsorted(off, off[i] + PIECE, side="right")) - 1)
        text, h = _shingles(buf[off[i] : off[j]], off[i : j + 1] - off[i])
        texts.append(text + i)
        hashes.append(h)
        i = j
    return np.concatenate(texts), np.concatenate(hashes)


def _shingles(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s, e, f = W.spans(buf, off)
    words, count = W.span_hash(buf, s, e, W.FOLDED), np.diff(f)
    at, text = W.run_starts(f, SHINGLE)
    texts, hashes = [text], [W.runs(words, SHINGLE)[at] if len(at) else np.empty(0, np.uint64)]
    for n in range(1, SHINGLE):
        short = np.flatnonzero(count == n)
        if len(short):
            texts.append(short)
            hashes.append(W.runs(words, n)[f[short]])
    text, h = np.concatenate(texts), np.concatenate(hashes)
    order = np.argsort(h)
    order = order[np.argsort(text[order].astype(np.uint16), kind="stable")]
    text, h = text[order], h[order]
    new = np.append(True, (text[1:] != text[:-1]) | (h[1:] != h[:-1]))[: len(h)]
    return text[new], h[new]


def _slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for i, buf, off in W.slices(column, SLICE):
        for a in range(0, len(off) - 1, 60_000):  # indices of texts have 16 bits
            b = min(a + 60_000, len(off) - 1)
            yield i + a, buf[off[a] : off[b]], off[a : b + 1] - off[a]


def _scan(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Columns doc_id, h1, h2, text. Emits all sets' shingles by bucket, and the documents' rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order_here = 0
        for batch in batches:
            keys = [batch.column(i) for i in (0, 1, 2)]
            for i, buf, off in _slices(batch.column(3)):
                n_texts = len(off) - 1
                text, h = shingles(buf, off)
                size = np.bincount(text, minlength=n_texts)
                begin = np.concatenate(([0], np.cumsum(size)))
                with np.errstate(over="ignore"):
                    sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(W.mix(h + np.uint64(k)))))[begin] for k in (1, 2)]
                    first, second = (W.mix(x[1:] - x[:-1] + size.astype(np.uint64)).view(np.int64) for x in sums)
                h1, h2 = (k.slice(i, n_texts).to_numpy() for k in keys[1:])
                number = batch_number(int(W.mix(np.concatenate((h1, h2)).view(np.uint64) + np.arange(2 * n_texts, dtype=np.uint64)).sum()), order_here)
                order_here += 1
                names = pa.RecordBatch.from_arrays([keys[0].slice(i, n_texts), pa.array(h1), pa.array(h2), pa.array(first), pa.array(second), pa.array(size, pa.int64())], ["doc_id", "h1", "h2", "s1", "s2", "n"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, names.schema) as out:
                    out.write_batch(names)
                bucket = (h % np.uint64(buckets)).astype(np.int64)
                order, cut = _grouped(bucket, buckets)
                part = (h >> np.uint64(32)).astype(np.uint32)[order]
                rows = [_row(-1 - number % buckets, TEXTS, number, sink.getvalue().to_pybytes(), text[order].astype(np.uint16).tobytes())]
                rows += [_row(b, PROBES, number, part[x:y].tobytes()) for b, (x, y) in enumerate(zip(cut, cut[1:], strict=False)) if y > x]
                for k in range(0, len(rows), 64):
                    yield _batch(rows[k : k + 64])
                rows.clear()

    return run


def _count(key: tuple, table: pa.Table) -> pa.Table:
    """One bucket: for every shingle sent the number of sets that have it, up to 255."""
    import pyarrow.compute  # noqa: F401

    if (bucket := key[0].as_py()) < 0:
        return pa.Table.from_batches([_batch([_row(-1, TEXTS, *x) for x in _parts(table, TEXTS)])])
    sent = _parts(table, PROBES)
    parts = [np.frombuffer(p, np.uint32) for _, p, _ in sent]
    _, where, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    df = np.minimum(times, 255).astype(np.uint8)[where]
    cut = np.cumsum([0, *map(len, parts)])
    return pa.Table.from_batches([_batch([_row(bucket, PROBES, n, df[a:b].tobytes()) for (n, _, _), a, b in zip(sent, cut, cut[1:], strict=False)])])


def _gather(key: tuple, table: pa.Table) -> pa.Table:
    """One batch: per document its set and, if enough of it occurs elsewhere, all frequencies in order of bucket and hash."""
    import pyarrow.compute  # noqa: F401

    alike = _parts(table, TEXTS)
    text = np.frombuffer(alike[0][2], np.uint16)
    back = table.filter(pa.compute.equal(table["kind"], PROBES))
    replies = dict(zip(back["bucket"].to_pylist(), back["payload"].to_pylist(), strict=True))
    df = np.frombuffer(b"".join(replies[b] for b in sorted(replies)), np.uint8)
    order = np.argsort(text, kind="stable")
    df = df[order]
    out = []
    for _, names, _ in alike:
        names = pa.ipc.open_stream(names).read_all()
        n = names["n"].to_numpy()
        begin = np.concatenate(([0], np.cumsum(n)))
        often = np.concatenate(([0], np.cumsum(df > 1)))[begin]
        enough = (np.diff(often) * 100 >= n * PERCENT) & (n > 0)
        out.append(names.append_column("df", pa.array([df[begin[k] : begin[k + 1]].tobytes() if enough[k] else None for k in range(len(n))], pa.binary())))
    return pa.concat_tables(out)


def _bands(own: np.ndarray) -> list[int]:
    """Pairs of minimal hashes of a set; sets alike have many in common."""
    with np.errstate(over="ignore"):
        least = [W.mix(own ^ np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64))).min() for k in range(1, 2 * BANDS + 1)]
        pairs = np.array(least, np.uint64).reshape(-1, 2)
        return W.mix(W.mix(pairs[:, 0] + np.arange(BANDS, dtype=np.uint64)) + pairs[:, 1]).view(np.int64).tolist()


def _sets(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Columns sid, df, text. Emits each set's shared shingles from rare to frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sid, dfs = batch.column(0), batch.column(1).to_pylist()
            for i, buf, off in _slices(batch.column(2)):
                text, h = shingles(buf, off)
                cut = np.searchsorted(text, np.arange(len(off)))
                sets, sizes, rare, marks, hubs = [], [], [], [], []
                for k in range(len(off) - 1):
                    own = h[cut[k] : cut[k + 1]]
                    own = own[np.argsort((own % np.uint64(buckets)).astype(np.int64), kind="stable")]
                    df = np.frombuffer(dfs[i + k], np.uint8)
                    order = np.lexsort((own, df))
                    order = order[df[order] > 1]
                    sets.append(own[order].view(np.int64))
                    marks.append(_bands(own))
                    hubs.append(float(df.mean()))
                    sizes.append(len(own))
                    rare.append(int(df[order[: len(own) - -(-PERCENT * len(own) // 100) + 1 - (len(own) - len(order))]].astype(np.int64).sum()))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *sets])))
                yield pa.RecordBatch.from_arrays([sid.slice(i, len(sets)), pa.array(sizes, pa.int64()), lists, pa.array(rare, pa.int64()), pa.array(marks, pa.list_(pa.int64())), pa.array(hubs, pa.float64())], ["sid", "n", "items", "scanned", "bands", "hub"])

    return run


def _subsets(boundary: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Columns sid, n, items of light sets. Emits for each size of a partner all subsets that linked sets share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sid, n, items in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                items, out = np.sort(np.array(items, np.int64).view(np.uint64)), []
                for m in range(-(-PERCENT * n // 100), min(100 * n // PERCENT, boundary) + 1):
                    r = required(n, m)
                    if r > min(len(items), m):
                        continue
                    own = np.array(list(itertools.combinations(items, r)), np.uint64)
                    with np.errstate(over="ignore"):
                        tag = W.mix(np.array([min(n, m) * 1000 + max(n, m)], np.uint64))
                        key = W.mix(W.mix(own + tag).sum(axis=1) + tag)
                    out += [(k, n <= m, n >= m) for k in key.view(np.int64).tolist()]
                if out:
                    keys, low, high = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([sid] * len(keys), pa.int64()), pa.array(low), pa.array(high)], ["subset", "sid", "low", "high"])

    return run


def light_links(sets: DataFrame, boundary: int) -> DataFrame:
    """Links a, b that connect all linked sets of up to `boundary` shingles."""
    emitted = materialise(sets.filter(F.col("n") <= boundary).select("sid", "n", "items").mapInArrow(lean(_subsets(boundary)), "subset long, sid long, low boolean, high boolean"), "subsets")
    hubs = emitted.groupBy("subset").agg(F.min(F.when(F.col("low"), F.col("sid"))).alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1 and hub is not null")
    return emitted.join(hubs.select("subset", "hub"), "subset").filter("sid != hub").select(F.col("sid").alias("a"), F.col("hub").alias("b")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs a, b that link."""
    left = sets.select(F.col("sid").alias("a"), F.col("n").alias("n_a"), F.col("items").alias("items_a"))
    right = sets.select(F.col("sid").alias("b"), F.col("n").alias("n_b"), F.col("items").alias("items_b"))
    both = F.size(F.array_intersect("items_a", "items_b"))
    return pairs.join(left, "a").join(right, "b").filter(both * 100 >= PERCENT * (F.col("n_a") + F.col("n_b") - both)).select("a", "b")


def heavy_links(sets: DataFrame, boundary: int) -> DataFrame:
    """Links a, b that connect all linked sets of which one at least has more than `boundary` shingles."""
    part = sets.filter(F.col("n") * 100 > PERCENT * boundary)
    prefix = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1 - (F.col("n") - F.size("items"))
    lists = part.select("sid", "n", (F.col("n") - F.size("items")).alias("alone"), F.posexplode(F.slice("items", 1, prefix.cast("int"))).alias("pos", "item"))
    lists = materialise(lists.select("item", "sid", "n", (F.col("alone") + F.col("pos")).alias("pos")), "lists")
    many = lists.groupBy("item").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    lists = materialise(lists.join(many.select("item"), "item", "left_semi"), "lists")
    alike = materialise(part.select("sid", "n", "hub", F.explode("bands").alias("item")), "bands")
    links = None
    for _ in range(ROUNDS):
        placed = _placed(alike, links)
        found = materialise(_verified(_mates(placed), part), "links")
        links = found if links is None else materialise(links.unionByName(found).distinct(), "links")
    # lists of one component are done; of the others, what is not of the largest component meets everything else
    placed = _placed(lists, links)
    here = placed.filter("parts > 1")
    one, two = here.filter("label != main").alias("x"), here.alias("y")
    need = F.ceil((F.col("x.n") + F.col("y.n")) * PERCENT / (100 + PERCENT))
    in_reach = (F.col("x.n") * 100 >= F.col("y.n") * PERCENT) & (F.col("y.n") * 100 >= F.col("x.n") * PERCENT)
    possible = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")) >= need
    pairs = one.join(two, F.col("x.item") == F.col("y.item")).filter((F.col("x.label") != F.col("y.label")) & in_reach & possible)
    pairs = pairs.select(F.greatest("x.sid", "y.sid").alias("a"), F.least("x.sid", "y.sid").alias("b")).distinct()
    return links.unionByName(materialise(_verified(pairs, part), "links"))


def _placed(lists: DataFrame, links: DataFrame | None) -> DataFrame:
    """The lists with every entry's component, the list's largest component and how many it has."""
    if links is None:
        placed = lists.withColumn("label", F.col("sid"))
    else:
        placed = lists.join(components(links).withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    placed = materialise(placed, "placed")
    share = placed.groupBy("item", "label").agg(F.count(F.lit(1)).alias("k"))
    main = share.groupBy("item").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.count(F.lit(1)).alias("parts"))
    return placed.join(main, "item")


def _mates(placed: DataFrame) -> DataFrame:
    """For each set the mates of other components that it meets most often: those next to it by size, and the one whose shingles are the
    most frequent. That one is likely what the others were copied from. A number of pairs in proportion to the lists."""
    along, whole = Window.partitionBy("item").orderBy("n", "sid"), Window.partitionBy("item")
    tries = [F.when(f("label").over(along) != F.col("label"), f("sid").over(along)) for f in (F.lag, F.lead)]
    hub = F.max(F.struct("hub", "sid", "label")).over(whole)
    tries.append(F.when(hub["label"] != F.col("label"), hub["sid"]))
    near = Window.partitionBy("item").orderBy("hub", "sid")
    tries.append(F.when(F.lead("label").over(near) != F.col("label"), F.lead("sid").over(near)))
    met = placed.filter("parts > 1").select("sid", *(t.alias(f"try{k}") for k, t in enumerate(tries)))
    each = F.explode(F.array(*(F.struct(F.col(f"try{k}").alias("b"), F.lit(k).alias("how")) for k in range(len(tries)))))
    met = met.select("sid", each.alias("m")).filter("m.b is not null").select("sid", "m.b", "m.how")
    often = met.groupBy("sid", "b", "how").count()
    best = often.groupBy("sid", "how").agg(F.max_by("b", F.struct("count", "b")).alias("b"))
    return best.filter("b is not null").select(F.greatest("sid", "b").alias("a"), F.least("sid", "b").alias("b")).filter("a != b").distinct()


def boundary_by_cost(sets: DataFrame) -> int:
    """The largest light size: its sets' subsets against the list entries that they would scan, from counts by size."""
    counted = sets.filter(F.col("n") <= MOST_LIGHT).groupBy("n").agg(F.count(F.lit(1)).alias("k"), F.avg(F.size("items")).alias("m"), F.sum("scanned").alias("scanned")).collect()
    by = {r["n"]: r for r in counted}  # at most MOST_LIGHT rows
    best, least, light, scanned = 0, sum(r["scanned"] for r in counted), 0.0, sum(r["scanned"] for r in counted)
    for n in range(1, MOST_LIGHT + 1):
        if n in by:
            light += by[n]["k"] * sum(math.comb(math.ceil(by[n]["m"]), required(n, m)) for m in range(-(-PERCENT * n // 100), 100 * n // PERCENT + 1) if required(n, m) <= by[n]["m"])
            scanned -= by[n]["scanned"]
        if light + scanned <= least:
            best, least = n, light + scanned
    return best


def group_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, h1, h2 (of its text), n_shingles, component_id, component (names the group; null without words)."""
    spark = docs.sparkSession
    arrow_bytes(spark)
    keyed = _keyed(docs, id_col, text_col)
    buckets = bucket_count(keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    counted = keyed.mapInArrow(lean(_scan(buckets)), _PACKED).groupBy("bucket").applyInArrow(lean_group(_count), _PACKED).select("bucket", "kind", "batch", "payload", "more")
    state = materialise(counted.groupBy("batch").applyInArrow(lean_group(_gather), "doc_id long, h1 long, h2 long, s1 long, s2 long, n long, df binary"), "state")
    reclaim(spark)
    classes = state.filter("n > 0").groupBy("s1", "s2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "h1", "h2")).alias("rep"), F.first("df", ignorenulls=True).alias("df"))
    classes = materialise(classes.select(F.col("s1").alias("sid"), "s2", "rep.doc_id", "rep.h1", "rep.h2", "df"), "classes")
    likely = classes.filter("df is not null")
    texts = only(keyed, likely, ["h1", "h2", "doc_id"]).alias("d").join(likely.alias("c"), (F.col("d.h1") == F.col("c.h1")) & (F.col("d.h2") == F.col("c.h2")) & F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")))
    sets = materialise(texts.select("sid", "df", "text").mapInArrow(lean(_sets(buckets)), "sid long, n long, items array<long>, scanned long, bands array<long>, hub double").dropDuplicates(["sid"]), "sets")
    boundary = boundary_by_cost(sets)
    links = light_links(sets, boundary).unionByName(heavy_links(sets, boundary))
    groups = components(links)
    least = groups.withColumnRenamed("node", "sid").join(classes.select("sid", "doc_id"), "sid").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = groups.join(least, "label").select(F.col("node").alias("s1"), "label", "component_id")
    own = classes.select(F.col("sid").alias("s1"), "s2", F.col("doc_id").alias("class_id")).join(named, "s1", "left").select("s1", "s2", F.coalesce("label", "s1").alias("component"), F.when(F.col("label").isNull(), F.col("class_id")).otherwise(F.col("component_id")).alias("component_id"))
    named = materialise(own, "named")
    out = state.select("doc_id", "h1", "h2", "s1", "s2", "n").join(named, ["s1", "s2"], "left")
    return out.select("doc_id", "h1", "h2", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(F.col("n") > 0, F.col("component")).alias("component"))


def join_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id."""
    return group_documents(docs, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of which none of their group has a smaller id, all columns kept; those without words all stay."""
    groups = materialise(group_documents(docs, id_col, text_col), "groups")
    at = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "h1", "h2")
    # a component may hold a third of all rows: its first row is broadcast where components are few; beyond that both sides are plain shuffles, which AQE splits
    first = materialise(groups.filter("component is not null").groupBy("component").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k"), "first")
    others = groups.join(small(first), "component").filter(~at.eqNullSafe(F.col("first")))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    by = {"doc_id": F.col(id_col).cast("long"), "h1": F.xxhash64(text), "h2": F.xxhash64(F.lit(1), text)}
    left = without(docs, others.select("doc_id", "h1", "h2"), by)
    again = materialise(groups.filter("component is not null").groupBy("doc_id", "h1", "h2").count().filter("count > 1").drop("count"), "again")
    if again.isEmpty():
        return left
    names = {c: spare(f"once_{c}", docs.columns) for c in by}
    keyed = left.withColumns({names[c]: v for c, v in by.items()})
    once = only(keyed, again.select(*(F.col(c).alias(names[c]) for c in by)), list(names.values())).dropDuplicates(list(names.values()))
    return without(left, again, by).unionByName(once.select(*docs.columns))
