"""Removal of word passages that occur more than once, by fixed-block anchors.

With windows of WINDOW words and blocks of (WINDOW + 1) // 2 words, every window
contains a whole block that begins at a multiple of the block size. So:

1. The non-overlapping blocks of all texts are the reference index.
2. Every rolling run of block size, at every word, probes the index. A probe
   hits if the index has its words from another place.
3. Around each hit all windows that contain it are looked at, and those whose
   words start anywhere else are kept; overlapping ones join to the maximal
   repeat, whose words are removed.

Nothing is compared in pairs: a passage with many copies costs one entry for
each batch of texts. Runs travel as hashes packed by bucket, a batch's
positions as gaps; runs that repeat within a batch are settled there. Windows
are told apart by 64-bit hashes.

Equal texts are one text with a multiplicity, whatever their ids. Null texts
count as empty. Texts of fewer than WINDOW words are left alone.

Defined results: an empty table gives no rows. Texts of any length are read whole; one
alone may be a batch. Other columns are not read and may have any name.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .scratch import arrow_bytes, materialise, reclaim

SLICE = 1 << 23
_PACKED = "bucket long, kind int, batch long, payload binary, more binary"
_NAMES = ["bucket", "kind", "batch", "payload", "more"]
#: Kinds of packed rows.
BLOCKS, PROBES, TEXTS, LOCAL, HITS = range(5)


def bucket_count(total_bytes: int) -> int:
    """About two million runs to a bucket; from a thousand buckets on, both numbers grow with the square root."""
    n = total_bytes / 6 / 2e6
    return max(1, round(n if n <= 1024 else math.sqrt(1024 * n)))


def batch_number(content: int, order: int) -> int:
    """Names a batch by its content, its task's partition and its order there, so that equal batches are groups of their own."""
    task = TaskContext.get()
    own = np.array([content, ((task.partitionId() if task else 0) << 32) + order], np.uint64)
    with np.errstate(over="ignore"):
        return int(W.mix(W.mix(own[:1]) + own[1:])[0] >> np.uint64(1))


def _row(bucket: int, kind: int, batch: int, payload: bytes, more: bytes = b"") -> tuple:
    return bucket, kind, batch, payload, more


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], _NAMES)


def _grouped(bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by bucket, and where each bucket begins in it."""
    order = np.argsort(bucket.astype(np.uint16 if n <= 1 << 16 else np.uint32), kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n + 1))


def _place(at: np.ndarray) -> bytes:
    return np.diff(at, prepend=0).astype(np.uint32).tobytes()


def _unplace(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, np.uint32).astype(np.int64))


def _packed_gaps(at: np.ndarray) -> bytes:
    """Ascending positions as 16-bit gaps; 65535 stands for itself and goes on."""
    gap = np.diff(at, prepend=0)
    over = gap // 65535
    out = np.full(len(gap) + int(over.sum()), 65535, np.uint16)
    out[np.arange(len(gap)) + np.cumsum(over)] = (gap % 65535).astype(np.uint16)
    return out.tobytes()


def _unpacked_gaps(raw: bytes) -> np.ndarray:
    gap = np.frombuffer(raw, np.uint16)
    return np.cumsum(gap.astype(np.int64))[gap != 65535]


def joined(buf: np.ndarray, off: np.ndarray, s: np.ndarray, e: np.ndarray, f: np.ndarray, kept: np.ndarray | None = None) -> list[bytes]:
    """Each text's words, or its kept ones, joined by one space."""
    if kept is not None:
        f = np.concatenate(([0], np.cumsum(kept)))[f]
        s, e = s[kept], e[kept]
    size = e - s + 1
    to = np.concatenate(([0], np.cumsum(size)))
    out = np.full(to[-1] + 1, 0x20, np.uint8)
    source = np.arange(to[-1]) + np.repeat(s - to[:-1], size)
    source[to[1:] - 1] = 0
    out[:-1] = buf[source] if len(buf) else 0x20
    out[to[1:] - 1] = 0x20
    data = out.tobytes()
    return [data[to[a] : max(to[b] - 1, to[a])] for a, b in zip(f, f[1:], strict=False)]


def _scan(window: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Columns doc_id, h1, h2, text. Emits reference blocks, probes, the texts' rows and the hits within a batch."""
    size = (window + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order_here = 0
        for batch in batches:
            ids, keys = batch.column(0), np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2)], axis=1)
            for i, buf, off in W.slices(batch.column(3), SLICE):
                n_texts = len(off) - 1
                own = keys[i : i + n_texts]
                s, e, f = W.spans(buf, off)
                number = batch_number(int(W.mix(own.astype(np.uint64).reshape(-1) * np.uint64(0x9E3779B97F4A7C15) + np.arange(2 * n_texts, dtype=np.uint64)).sum()), order_here)
                order_here += 1
                sha = b"".join(hashlib.sha256(t).digest() for t in joined(buf, off, s, e, f))
                names = pa.RecordBatch.from_arrays([ids.slice(i, n_texts), pa.array(own[:, 0]), pa.array(own[:, 1]), pa.array(f[:-1]), pa.array(np.diff(f)), pa.array([sha[k : k + 32] for k in range(0, len(sha), 32)], pa.binary())], ["doc_id", "h1", "h2", "first", "n_words", "sha"])
                home = -1 - number % buckets
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, names.schema) as out:
                    out.write_batch(names)
                at, text = W.run_starts(f, size)
                long = np.diff(f)[text] >= window
                at, text = at[long], text[long]
                if not len(at):
                    yield _batch([_row(home, TEXTS, number, sink.getvalue().to_pybytes())])
                    continue
                h = W.runs(W.span_hash(buf, s, e), size)[at]
                aligned = (at - f[text]) % size == 0
                rows = []
                blocks, times = np.unique(h[aligned], return_counts=True)
                bucket = (blocks % np.uint64(buckets)).astype(np.int64)
                order, cut = _grouped(bucket, buckets)
                blocks, times = blocks[order], (times[order] > 1).astype(np.uint8)
                rows += [_row(b, BLOCKS, number, blocks[x:y].tobytes(), times[x:y].tobytes()) for b, (x, y) in enumerate(zip(cut, cut[1:], strict=False)) if y > x]
                order = np.argsort(h, kind="stable")
                same = h[order][1:] == h[order][:-1]
                repeated = np.zeros(len(h), bool)
                repeated[order[1:][same]] = True
                repeated[order[:-1][same]] = True
                rows.append(_row(home, TEXTS, number, sink.getvalue().to_pybytes(), _place(at[repeated])))
                h, at, aligned = h[~repeated], at[~repeated], aligned[~repeated]
                bucket = (h % np.uint64(buckets)).astype(np.int64)
                order, cut = _grouped(bucket, buckets)
                short = ((h >> np.uint64(32)) << np.uint64(1)).astype(np.uint32)[order] | aligned[order].astype(np.uint32)
                at = at[order]
                rows += [_row(b, PROBES, number, short[x:y].tobytes(), _packed_gaps(at[x:y])) for b, (x, y) in enumerate(zip(cut, cut[1:], strict=False)) if y > x]
                for k in range(0, len(rows), 64):
                    yield _batch(rows[k : k + 64])

    return run


def _parts(table: pa.Table, kind: int) -> list[tuple[int, bytes, bytes]]:
    some = table.filter(pa.compute.equal(table["kind"], kind))
    return list(zip(some["batch"].to_pylist(), some["payload"].to_pylist(), some["more"].to_pylist(), strict=True))


def _pass_on(table: pa.Table) -> pa.Table:
    rows = [_row(0, TEXTS, *x) for x in _parts(table, TEXTS)]
    return pa.Table.from_batches([_batch(rows)])


def _probe(key: tuple, table: pa.Table) -> pa.Table:
    """One bucket: the probes that the index has from another place."""
    import pyarrow.compute  # noqa: F401

    if key[0].as_py() < 0:
        return _pass_on(table)
    found = _parts(table, BLOCKS)
    blocks = (np.concatenate([np.frombuffer(p, np.uint64) for _, p, _ in found] or [np.empty(0, np.uint64)]) >> np.uint64(32) << np.uint64(1)).astype(np.uint32)
    many = np.concatenate([np.frombuffer(m, np.uint8) for _, _, m in found] or [np.empty(0, np.uint8)])
    known, first, times = np.unique(blocks, return_inverse=True, return_counts=True)
    several = (times > 1) | (np.bincount(first, many, len(known)) > 0)
    rows = []
    for number, payload, gaps in _parts(table, PROBES):
        short = np.frombuffer(payload, np.uint32)
        at = np.minimum(np.searchsorted(known, short & np.uint32(0xFFFFFFFE)), max(len(known) - 1, 0))
        hit = (known[at] == (short & np.uint32(0xFFFFFFFE))) & (several[at] | (short & np.uint32(1) == 0)) if len(known) else np.zeros(len(short), bool)
        if hit.any():
            rows.append(_row(0, HITS, number, b"", _place(_unpacked_gaps(gaps)[hit])))
    return pa.Table.from_batches([_batch(rows)])


def _gather(table: pa.Table) -> tuple[list[pa.Table], np.ndarray]:
    """Of one batch: its texts, and all positions that came back for it."""
    texts = _parts(table, TEXTS)
    at = [_unplace(m) for _, _, m in texts[:1] + _parts(table, HITS) if m]
    return [pa.ipc.open_stream(t).read_all() for _, t, _ in texts], np.unique(np.concatenate(at or [np.empty(0, np.int64)]))


def _covered(starts: np.ndarray, low: int, length: int) -> bytes:
    """Intervals [begin, end) that cover `length` words from each start less low, merged."""
    begin = starts - low
    new = np.append(True, begin[1:] > begin[:-1] + length)
    cut = np.flatnonzero(new)
    end = begin[np.append(cut[1:] - 1, len(begin) - 1)] + length
    return np.stack([begin[cut], end], axis=1).astype(np.int32).tobytes()


def _candidates(window: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """Per text of a batch: the windows to look at, as intervals of their starts."""
    size = (window + 1) // 2

    def run(key: tuple, table: pa.Table) -> pa.Table:
        import pyarrow.compute  # noqa: F401

        alike, at = _gather(table)
        first, n = alike[0]["first"].to_numpy(), alike[0]["n_words"].to_numpy()
        cut, out = np.searchsorted(at, np.append(first, first[-1] + n[-1] if len(first) else 0)), []
        for k in range(len(first)):
            here = at[cut[k] : cut[k + 1]] - first[k]
            if len(here) and n[k] >= window:
                low = np.frombuffer(_covered(here - (window - size), 0, window - size + 1), np.int32).reshape(-1, 2)
                low = np.clip(low, 0, n[k] - window + 1).astype(np.int32)
                out.append(low[low[:, 0] < low[:, 1]].tobytes() or None)
            else:
                out.append(None)
        return pa.concat_tables(pa.table({"doc_id": texts["doc_id"], "h1": texts["h1"], "h2": texts["h2"], "n_words": texts["n_words"], "sha": texts["sha"], "look": pa.array(out, pa.binary())}) for texts in alike)

    return run


def _spread(intervals: list[bytes], first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places inside each text's intervals, as indices of words and of texts."""
    lows = [np.frombuffer(x, np.int32).reshape(-1, 2).astype(np.int64) for x in intervals]
    text = np.repeat(np.arange(len(lows)), [len(x) for x in lows])
    low = np.concatenate([np.empty((0, 2), np.int64), *lows])
    size = low[:, 1] - low[:, 0]
    base = np.concatenate(([0], np.cumsum(size)))
    begin = low[:, 0] + first[:-1][text]
    return np.arange(base[-1]) + np.repeat(begin - base[:-1], size), np.repeat(text, size)


def _windows(window: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Columns h1, h2, copies, look, text. Emits the windows to look at, those settled within the batch, and the texts' rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order_here = 0
        for batch in batches:
            keys, copies, look = np.stack([batch.column(i).to_numpy() for i in (0, 1)], axis=1), batch.column(2).to_numpy(), batch.column(3).to_pylist()
            for i, buf, off in W.slices(batch.column(4), SLICE):
                n_texts = len(off) - 1
                own = keys[i : i + n_texts]
                s, e, f = W.spans(buf, off)
                number = batch_number(int(W.mix(own.astype(np.uint64).reshape(-1) * np.uint64(0x9E3779B97F4A7C15) + np.arange(2 * n_texts, dtype=np.uint64)).sum()), order_here)
                order_here += 1
                names = pa.RecordBatch.from_arrays([pa.array(own[:, 0]), pa.array(own[:, 1]), pa.array(f[:-1]), pa.array(np.diff(f))], ["h1", "h2", "first", "n_words"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, names.schema) as out:
                    out.write_batch(names)
                at, text = _spread([np.array([0, n - window + 1], np.int32).tobytes() if x is None else x for x, n in zip(look[i : i + n_texts], np.diff(f), strict=True)], f)
                h = W.runs(W.span_hash(buf, s, e), window)[at] if len(at) else np.empty(0, np.uint64)
                order = np.argsort(h, kind="stable")
                new = np.append(True, h[order][1:] != h[order][:-1])[: len(h)]
                group = np.cumsum(new) - 1
                many = np.bincount(group, (copies[i : i + n_texts][text] > 1)[order] + 1 if len(h) else None) > 1
                rows = [_row(-1 - number % buckets, TEXTS, number, sink.getvalue().to_pybytes(), _place(np.sort(at[order[many[group]]])) if len(h) else b"")]
                lone = order[new]
                h, at = h[lone], at[lone]
                back = np.argsort(at)
                h, at, many = h[back], at[back], many[back]
                bucket = (h % np.uint64(buckets)).astype(np.int64)
                order, cut = _grouped(bucket, buckets)
                h, at, many = h[order], at[order], many[order]
                for b, (x, y) in enumerate(zip(cut, cut[1:], strict=False)):
                    if y > x:
                        settled = many[x:y]
                        rows.append(_row(b, PROBES, number, h[x:y][~settled].tobytes(), _packed_gaps(at[x:y][~settled])))
                        if settled.any():
                            rows.append(_row(b, BLOCKS, number, h[x:y][settled].tobytes()))
                for k in range(0, len(rows), 64):
                    yield _batch(rows[k : k + 64])

    return run


def _verify(key: tuple, table: pa.Table) -> pa.Table:
    """One bucket of windows: those that another batch has too."""
    import pyarrow.compute  # noqa: F401

    if key[0].as_py() < 0:
        return _pass_on(table)
    probes = _parts(table, PROBES)
    settled = [np.frombuffer(p, np.uint64) for _, p, _ in _parts(table, BLOCKS)]
    every = [np.frombuffer(p, np.uint64) for _, p, _ in probes]
    known, times = np.unique(np.concatenate([np.empty(0, np.uint64), *every, *settled, *settled]), return_counts=True)
    known = known[times > 1]
    rows = []
    for (number, _, gaps), h in zip(probes, every, strict=True):
        hit = known[np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))] == h if len(known) else np.zeros(len(h), bool)
        if hit.any():
            rows.append(_row(0, HITS, number, b"", _place(_unpacked_gaps(gaps)[hit])))
    return pa.Table.from_batches([_batch(rows)])


def _repeats(window: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """Per text with repeats: the maximal repeated stretches of words."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        import pyarrow.compute  # noqa: F401

        (texts, *_), at = _gather(table)
        first, n = texts["first"].to_numpy(), texts["n_words"].to_numpy()
        cut = np.searchsorted(at, np.append(first, first[-1] + n[-1]))
        some = np.flatnonzero(np.diff(cut))
        gone = [_covered(at[cut[k] : cut[k + 1]], first[k], window) for k in some]
        return pa.table({"h1": texts["h1"].take(some), "h2": texts["h2"].take(some), "gone": pa.array(gone, pa.binary())})

    return run


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns h1, h2, gone, text. Emits what is left of each text."""
    for batch in batches:
        gone = batch.column(2).to_pylist()
        for i, buf, off in W.slices(batch.column(3), SLICE):
            n = len(off) - 1
            s, e, f = W.spans(buf, off)
            kept = np.ones(len(s), bool)
            kept[_spread(gone[i : i + n], f)[0]] = False
            removed = [int(x) for x in np.add.reduceat(np.append(~kept, False).astype(np.int64), f[:-1])] if len(s) else [0] * n
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), batch.column(1).slice(i, n), pa.array(removed, pa.int64()), pa.array([t.decode() for t in joined(buf, off, s, e, f, kept)], pa.string())], ["h1", "h2", "n_removed", "kept"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), text.alias("text"))


def find_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two written tables: per document doc_id, h1, h2, n_words, sha (of all its words); per distinct text with repeats
    h1, h2, rep (a document that has it) and gone, the stretches of words to remove as pairs of 32-bit integers."""
    spark = docs.sparkSession
    arrow_bytes(spark)
    keyed = _keyed(docs, id_col, text_col)
    total = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = bucket_count(total)
    hits = materialise(keyed.mapInArrow(_scan(window, buckets), _PACKED).groupBy("bucket").applyInArrow(_probe, _PACKED).select("kind", "batch", "payload", "more"), "hits")
    reclaim(spark)
    state = materialise(hits.groupBy("batch").applyInArrow(_candidates(window), "doc_id long, h1 long, h2 long, n_words long, sha binary, look binary"), "state")
    texts = state.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("n_words").alias("n"), F.first("look", ignorenulls=True).alias("look"))
    look = F.when(F.col("copies") == 1, F.col("look"))  # all of a text that has copies
    texts = materialise(texts.filter((F.col("n") >= window) & (F.col("look").isNotNull() | (F.col("copies") > 1))).select("h1", "h2", "rep", "copies", look.alias("look")), "look")
    at = keyed.alias("d").join(texts.alias("t"), (F.col("d.h1") == F.col("t.h1")) & (F.col("d.h2") == F.col("t.h2")) & F.col("d.doc_id").eqNullSafe(F.col("t.rep")))
    packed = at.select("t.h1", "t.h2", "copies", "look", "text").mapInArrow(_windows(window, buckets), _PACKED)
    verified = materialise(packed.groupBy("bucket").applyInArrow(_verify, _PACKED).select("kind", "batch", "payload", "more"), "verified")
    reclaim(spark)
    gone = verified.groupBy("batch").applyInArrow(_repeats(window), "h1 long, h2 long, gone binary").dropDuplicates(["h1", "h2"])
    return state.drop("look"), materialise(gone.join(texts.select("h1", "h2", "rep"), ["h1", "h2"]), "gone")


def strip_repeats(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per distinct text with repeats: h1, h2, n_removed, kept (what is left, words joined by one space)."""
    keyed = _keyed(docs, id_col, text_col)
    at = keyed.alias("d").join(gone.alias("g"), (F.col("d.h1") == F.col("g.h1")) & (F.col("d.h2") == F.col("g.h2")) & F.col("d.doc_id").eqNullSafe(F.col("g.rep")))
    return at.select("g.h1", "g.h2", "gone", "text").mapInArrow(_strip, "h1 long, h2 long, n_removed long, kept string").dropDuplicates(["h1", "h2"])


def dedup_substrings(docs: DataFrame, window: int = 35) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space)."""
    state, gone = find_repeats(docs, window)
    left = strip_repeats(docs, gone).select("h1", "h2", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    left = materialise(left, "left")
    reclaim(docs.sparkSession)
    return state.join(left, ["h1", "h2"], "left").select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha256", F.lower(F.hex("sha"))).alias("kept_sha256"))
