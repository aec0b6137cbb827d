"""Benchmark decontamination by spaced seeds.

Words are compared without case (of Latin-1 letters) and ASCII punctuation. Each mask of MASKS looks
at five words and skips those between them, so a passage with words replaced
still has places where some mask sees only equal words. The masks' hashes of
all benchmark items are joined with those of every place of every document; at
each hit the document and the item are laid over one another on that diagonal,
and the stretch is found that gains most, a point for each equal word against
MISS for each other one. It counts if it has MATCHED equal words, or all words of
a shorter item, and SHARE of its words are equal. Where it does not count, the
stretch that does with the most to spare is found instead, if there is any.

The benchmark is taken in blocks of at most BLOCK_BYTES or a single item, each held
in memory against all documents; documents are never shuffled. Items of fewer
words than a mask sees match where all their words stand in their order. Null
and empty texts match nothing, and items without an id are left out.

Defined results: repeated rows each have their own result, of the same text the same one.
An empty table of documents, or an empty benchmark, finds nothing. Texts of any length are
compared whole, in pieces of hits. Other columns are not read and may have any name;
`drop_leaking` passes them through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .scratch import arrow_bytes, lean, without
from .substring_dedup import _keyed

MASKS = ((0, 1, 2, 3, 4), (0, 1, 3, 5, 6), (0, 2, 3, 7, 8), (0, 1, 4, 6, 9))
MISS, MATCHED, SHARE = 1.0, 10, 0.65
BLOCK_BYTES = 1 << 24
#: Bytes of whole texts that are compared at a time; a worker holds some twenty-five times as much.
SLICE = 1 << 20
_BITS = 20
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def plain_words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words without case and punctuation, and each text's first."""
    kept = ~_PUNCTUATION[buf]
    if len(buf) > 1:
        capital = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)  # U+00C0 to U+00DE, but for the times sign
        buf = buf.copy()
        buf[1:] += capital.astype(np.uint8) << 5
    off = np.concatenate(([0], np.cumsum(kept)))[off]
    buf = buf[kept]
    s, e, first = W.spans(buf, off)
    return W.span_hash(buf, s, e, W.FOLDED), first


def seeds(words: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The mask's hash at every place that has all its words."""
    n = max(len(words) - mask[-1], 0)
    with np.errstate(over="ignore"):
        out = words[:n].copy()
        for k in mask[1:]:
            out *= np.uint64(0x9E3779B97F4A7C15)
            out += words[k : k + n]
    return out


class Items:
    """The seeds of a block of benchmark items, ready to be looked up."""

    def __init__(self, names: list[int], texts: list[str]):
        column = pa.array(texts, pa.large_string())
        buf, off = W.buffers(column)
        self.words, self.first = plain_words(buf, off)
        self.names = np.array(names, np.int64)
        self.tables = []
        owner = np.repeat(np.arange(len(names)), np.diff(self.first))
        size = np.diff(self.first)
        self.masks = MASKS + tuple(tuple(range(k)) for k in range(1, len(MASKS[0])) if (size == k).any())  # short items as a whole
        for mask in self.masks:
            h = seeds(self.words, mask)
            at = np.flatnonzero(owner[: len(h)] == owner[mask[-1] :][: len(h)])
            if len(mask) < len(MASKS[0]):
                at = at[size[owner[at]] == len(mask)]
            at = at[np.argsort(h[at], kind="stable")]
            near = np.zeros(1 << _BITS, bool)
            near[W.mix(h[at]) & np.uint64((1 << _BITS) - 1)] = True
            self.tables.append((h[at], at, near))
        self.owner = owner

    def diagonals(self, words: np.ndarray, text: np.ndarray, most: int = 1 << 18) -> Iterator[np.ndarray]:
        """Rows of text, item, place in the words where the item would begin; distinct in each piece. A piece comes from
        a stretch of places with about `most` hits, or from one place, which has no more than there are words in the items."""
        hits = []
        count = np.zeros(len(words) + 1, np.int64)
        for mask, (known, _, near) in zip(self.masks, self.tables, strict=True):
            h = seeds(words, mask)
            some = np.flatnonzero(near[W.mix(h) & np.uint64((1 << _BITS) - 1)])
            some = some[text[some] == text[some + mask[-1]]]
            low, high = np.searchsorted(known, h[some]), np.searchsorted(known, h[some], side="right")
            some, low, size = some[high > low], low[high > low], (high - low)[high > low]
            hits.append((some, low, size))
            count[some] += size
        upto = np.cumsum(count)
        cuts = np.unique(np.concatenate(([0], np.searchsorted(upto, np.arange(most, int(upto[-1]) + most, most)) + 1)))
        for a, b in zip(cuts, np.append(cuts[1:], len(words)), strict=True):
            found = []
            for (some, low, size), (_, at, _) in zip(hits, self.tables, strict=True):
                i, j = np.searchsorted(some, (a, b))
                before = np.concatenate(([0], np.cumsum(size[i:j])))
                place = at[np.arange(before[-1]) + np.repeat(low[i:j] - before[:-1], size[i:j])]
                here = np.repeat(some[i:j], size[i:j])
                item = self.owner[place]
                found.append(np.stack([text[here], item, here - (place - self.first[item])], axis=1))
            if sum(map(len, found)):
                yield np.unique(np.concatenate(found), axis=0)


def best_stretch(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of comparisons (1 equal, 0 other, -1 outside) the begin and end of the stretch that gains most, and its equal words."""
    rows, n = equal.shape
    gain = np.where(equal == 1, 1.0, np.where(equal == 0, -MISS, -1e9))
    best, run, since = np.zeros(rows), np.zeros(rows), np.zeros(rows, np.int64)
    begin, end = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    for k in range(n):
        fresh = run <= 0
        since = np.where(fresh, k, since)
        run = np.where(fresh, 0, run) + gain[:, k]
        better = run > best
        best, begin, end = np.where(better, run, best), np.where(better, since, begin), np.where(better, k + 1, end)
    total = np.concatenate((np.zeros((rows, 1), np.int64), np.cumsum(equal == 1, axis=1)), axis=1)
    at = np.arange(rows)
    return begin, end, total[at, end] - total[at, begin]


def counting_stretch(equal: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As best_stretch, of the stretches with `least` equal words of which SHARE are equal the one with the most to spare; no equal words where there is none."""
    rows, n = equal.shape
    at, zero = np.arange(rows), np.zeros((rows, 1), np.int64)
    total = np.concatenate((zero, np.cumsum(equal == 1, axis=1)), axis=1)
    share = round(1000 * SHARE)  # whole numbers, so that no sum is rounded
    gain = np.concatenate((zero, np.cumsum(np.where(equal == 1, 1000 - share, np.where(equal == 0, -share, -(10**10))), axis=1)), axis=1)
    best, begin, end = np.full(rows, -1), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    lowest, since, next_ = np.full(rows, 1 << 61), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    for k in range(1, n + 1):
        while (open_ := (next_ < k) & (total[at, next_] <= total[:, k] - least)).any():  # begins that leave enough equal words
            lower = open_ & (gain[at, next_] < lowest)
            lowest, since = np.where(lower, gain[at, next_], lowest), np.where(lower, next_, since)
            next_ += open_
        better = gain[:, k] - lowest > best
        best, begin, end = np.where(better, gain[:, k] - lowest, best), np.where(better, since, begin), np.where(better, k, end)
    return begin, end, total[at, end] - total[at, begin]


def _matches(items: Items, words: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """Text, item, first and last word (excluded) in the text, equal words, words of the item: the best stretch of each pair."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    size = np.diff(items.first)
    for at in items.diagonals(words, text):
        _compare(items, words, first, at[np.argsort(size[at[:, 1]], kind="stable")], best)  # rows of like length are compared together
    return [(t, int(items.names[m]), -b, e, same, int(size[m])) for (t, m), (same, b, e) in sorted(best.items())]


def _compare(items: Items, words: np.ndarray, first: np.ndarray, at: np.ndarray, best: dict[tuple[int, int], tuple[int, int, int]]) -> None:
    """Lay texts and items over one another on the diagonals; best gets the best stretch of each pair."""
    size, i = np.diff(items.first), 0
    while i < len(at):
        j = i + 1
        longest = size[at[i, 1]]
        while j < len(at) and j - i < 4096 and size[at[j, 1]] <= 2 * longest + 16 and (j - i) * size[at[j, 1]] < 1 << 21:
            j += 1
        t, m, place = at[i:j].T
        n = size[m]
        k = np.arange(n.max())
        here, there = place[:, None] + k, items.first[m][:, None] + k
        inside = (k < n[:, None]) & (here >= first[t][:, None]) & (here < first[t + 1][:, None])
        equal = np.where(inside, (words[np.where(inside, here, 0)] == items.words[np.where(inside, there, 0)]).astype(np.int8), -1)
        begin, end, same = best_stretch(equal)
        least = np.minimum(MATCHED, n)
        good = (same >= least) & (same >= SHARE * (end - begin))
        if len(rest := np.flatnonzero(~good & ((equal == 1).sum(axis=1) >= least))):
            begin[rest], end[rest], same[rest] = counting_stretch(equal[rest], least[rest])
            good[rest] = same[rest] > 0
        for r in np.flatnonzero(good):
            row = (int(same[r]), -int(place[r] + begin[r] - first[t[r]]), int(place[r] + end[r] - first[t[r]]))
            key = (int(t[r]), int(m[r]))
            best[key] = max(best.get(key, row), row)
        i = j


def _probe(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            for i, buf, off in W.slices(batch.column(3), SLICE):
                words, first = plain_words(buf, off)
                if rows := _matches(items, words, first):
                    at, *rest = (list(c) for c in zip(*rows, strict=True))
                    own = [batch.column(c).take(pa.array([i + t for t in at])) for c in range(3)]
                    yield pa.RecordBatch.from_arrays(own + [pa.array(c, pa.int64()) for c in rest], ["doc_id", "h1", "h2", "item_id", "first_word", "end_word", "n_equal", "item_words"])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document and benchmark item that it holds: doc_id, h1, h2 (of the text), item_id, first_word, end_word, n_equal, item_words.

    first_word and end_word count the document's words without punctuation-only ones; the longest match of a pair is given."""
    spark = docs.sparkSession
    arrow_bytes(spark)
    items = benchmark.filter("text is not null and item_id is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    sized = items.withColumn("size", F.octet_length("text"))
    blocks = max(1, -(-(sized.agg(F.sum("size")).first()[0] or 0) // BLOCK_BYTES))
    keyed, out = _keyed(docs, id_col, text_col), None
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()  # a block is bounded
        shared = spark.sparkContext.broadcast(Items([r[0] for r in rows], [r[1] for r in rows]))
        found = keyed.mapInArrow(lean(_probe(shared)), "doc_id long, h1 long, h2 long, item_id long, first_word long, end_word long, n_equal long, item_words long")
        out = found if out is None else out.unionByName(found)
    if blocks > 1:
        order = Window.partitionBy("doc_id", "h1", "h2", "item_id").orderBy(F.desc("n_equal"), "first_word")
        out = out.withColumn("rank", F.rank().over(order)).filter("rank = 1").drop("rank")
    return out


def drop_leaking(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold no benchmark item, all columns kept."""
    leaks = find_leaks(docs, benchmark, id_col, text_col).select("h1", "h2")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return without(docs, leaks, {"h1": F.xxhash64(text), "h2": F.xxhash64(F.lit(1), text)})
