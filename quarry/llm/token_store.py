"""Token-ID output as Simple-8b: word-aligned binary files of token ids.

A file is a sequence of records; a record holds whole documents in ascending
order of their ids and ends with the eight bytes MARK, so that all words stay
aligned. All numbers are little-endian 64-bit words unless said otherwise:

    MAGIC, documents, ids, blocks, coded words, escapes, documents without an id
    the documents' ids, then their numbers of token ids
    for each block and once more at the end: first coded word (uint32), first escape (uint32)
    the coded words, the escaped values

A block holds BLOCK token ids (the last of a record may hold fewer). A coded
word has a selector in its upper four bits. Selectors below ESCAPE say how many
ids of which width the lower sixty bits hold, first id lowest; ESCAPE refers to
the block's escaped values, which need more than sixty bits. Places past the
end of a block are zeros and are dropped in reading. Blocks decode
independently and in vectors.

Files are written by Spark's own writer to any file system it knows, under its
commit protocol, so a lost executor leaves no half-written file behind.
Null texts count as empty; a null document id sorts first and reads back as
null; equal document ids are ordered by the hash of their text, then the text.

Defined results: an empty table gives an empty store and no rows. A null text is an
empty one, the end id alone. Null ids come first. Rows that agree in id and text are
stored as often as they occur. Texts of any length are encoded whole, a record then
holds that one. Other columns are not read and may have any name.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .scratch import arrow_bytes, arrow_rows, discard, held, lean, materialise, new_path

BLOCK = 128
MARK = "|S8BEND|"
MAGIC = int.from_bytes(b"S8B-IDS1", "little")
#: Fixed by the coding: widths in bits of the selectors, and how many ids each packs into sixty bits.
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
COUNTS = tuple(60 // w for w in WIDTHS)
ESCAPE = len(WIDTHS)
_COUNT = np.array([*COUNTS, 1, 0], np.int64)
_LIMITS = np.array([1 << w for w in WIDTHS], np.uint64)
_CLASS = np.searchsorted(_LIMITS, np.arange(1 << 16, dtype=np.uint64), side="right").astype(np.int8)


def _widest(classes: np.ndarray) -> np.ndarray:
    """For each place of a block the selector that packs most ids from there on."""
    reach, best = {1: classes}, np.full(classes.shape, ESCAPE, np.int8)
    size = classes.shape[1]

    def ahead(a: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros_like(a)
        if n < size:
            out[:, : size - n] = a[:, n:]
        return out

    for n in (2, 4, 8, 16, 32):
        reach[n] = np.maximum(reach[n // 2], ahead(reach[n // 2], n // 2))
    for k in range(len(WIDTHS) - 1, -1, -1):
        n = COUNTS[k]
        p = 1 << (n.bit_length() - 1)
        most = reach[p] if n == p else np.maximum(reach[p], ahead(reach[p], n - p))
        best[most <= k] = k
    return best


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The coded words, the offsets of the blocks (uint32, blocks + 1 by 2) and the escaped values."""
    ids = ids.astype(np.uint64, copy=False)
    n = -(-len(ids) // BLOCK)
    wide = np.zeros((n, BLOCK + COUNTS[0]), np.uint64)
    flat = np.zeros(n * BLOCK, np.uint64)
    flat[: len(ids)] = ids
    wide[:, :BLOCK] = flat.reshape(n, BLOCK)
    classes = (_CLASS[flat] if not len(ids) or int(ids.max()) < 1 << 16 else np.searchsorted(_LIMITS, flat, side="right").astype(np.int8)).reshape(n, BLOCK)
    chosen = _widest(classes)
    begins, at, live = np.zeros((n, BLOCK), bool), np.zeros(n, np.int64), np.arange(n)
    while len(live):
        here = at[live]
        begins[live, here] = True
        at[live] = here + _COUNT[chosen[live, here]]
        live = live[at[live] < BLOCK]
    block, place = np.nonzero(begins)
    selector = chosen[block, place]
    out = selector.astype(np.uint64) << np.uint64(60)
    source, values = block * wide.shape[1] + place, wide.reshape(-1)
    for k, (width, count) in enumerate(zip(WIDTHS, COUNTS, strict=True)):
        of = np.flatnonzero(selector == k)
        if len(of):
            word, start = out[of], source[of]
            for i in range(count):
                word |= values[start + i] << np.uint64(width * i)
            out[of] = word
    escaped = np.flatnonzero(selector == ESCAPE)
    ranks = np.arange(len(escaped)) - np.searchsorted(block[escaped], block[escaped])
    out[escaped] |= ranks.astype(np.uint64)
    offsets = np.stack([np.searchsorted(block, np.arange(n + 1)), np.searchsorted(block[escaped], np.arange(n + 1))], axis=1).astype(np.uint32)
    return out, offsets, values[source[escaped]]


def unpack(coded: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, n_ids: int) -> np.ndarray:
    """The ids of whole blocks, all at once."""
    n = len(offsets) - 1
    selector = (coded >> np.uint64(60)).astype(np.int64)
    block = np.repeat(np.arange(n), np.diff(offsets[:, 0].astype(np.int64)))
    before = np.concatenate(([0], np.cumsum(_COUNT[selector])))
    place = before[:-1] - before[offsets[:, 0].astype(np.int64)][block]
    out = np.zeros((n, BLOCK + COUNTS[0]), np.uint64)
    to, values = block * out.shape[1] + place, out.reshape(-1)
    for k, (width, count) in enumerate(zip(WIDTHS, COUNTS, strict=True)):
        of = np.flatnonzero(selector == k)
        if len(of):
            word, start = coded[of], to[of]
            for i in range(count):
                values[start + i] = (word >> np.uint64(width * i)) & np.uint64((1 << width) - 1)
    escaped = np.flatnonzero(selector == ESCAPE)
    values[to[escaped]] = escapes[offsets[block[escaped], 1].astype(np.int64) + (coded[escaped] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out[:, :BLOCK].reshape(-1)[:n_ids]


def to_record(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """One record; documents without an id come first."""
    coded, offsets, escapes = pack(ids)
    unnamed = sum(d is None for d in doc_ids)
    head = np.array([MAGIC, len(doc_ids), len(ids), len(offsets) - 1, len(coded), len(escapes), unnamed], np.uint64)
    named = np.array([d or 0 for d in doc_ids], np.int64)
    return b"".join(a.tobytes() for a in (head, named, counts.astype(np.int64), offsets, coded, escapes))


def from_file(content: bytes) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """Of each record the documents' ids, their numbers of token ids and the token ids."""
    data, at = np.frombuffer(content, np.uint64), 0
    while at < len(data):
        magic, docs, n_ids, blocks, coded, escapes, unnamed = (int(x) for x in data[at : at + 7])
        if magic != MAGIC:
            raise ValueError("no record begins here")
        cuts = np.cumsum([at + 7, docs, docs, blocks + 1, coded, escapes])
        part = [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        names = [None] * unnamed + part[0].view(np.int64)[unnamed:].tolist()
        yield names, part[1].view(np.int64), unpack(part[3], part[2].view(np.uint32).reshape(-1, 2), part[4], n_ids)
        at = int(cuts[-1])
        if data[at : at + 1].tobytes() != MARK.encode():
            raise ValueError("a record does not end with its mark")
        at += 1


class PieceEncoder:
    """Token ids of texts by a byte-level BPE tokenizer, each distinct piece of text encoded once.

    A text is cut before every space that follows a character which cannot be
    white space. The tokenizer's pattern takes a space only as the first
    character of a token or inside a run of white space, so every such place is
    a boundary of its own pattern and what follows does not depend on what came
    before: the ids of a text are the ids of its pieces, in order. For the same
    reason pieces that begin with a space can be encoded behind one another.
    Tokenizers of another kind, and those with added tokens that contain a
    space, are called on whole texts.
    """

    def __init__(self, path: str, most_cached: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most_cached
        added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        flags = any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", []))
        self.by_piece = plain and spec.get("normalizer") is None and not flags and not any(re.search(r"\s", t) for t in added)
        if self.by_piece:
            vocab = self.tokenizer.get_vocab(with_added_tokens=True)
            self.bytes_of = np.zeros(max(vocab.values()) + 1, np.int64)
            for token, i in vocab.items():
                self.bytes_of[i] = len(token.encode()) if token in added else len(token)
        self._reset()

    def _reset(self) -> None:
        self.known, self.slot = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.bounds, self.ids = np.zeros(1, np.int64), np.empty(0, np.uint32)

    def _run(self, texts: list[str]) -> list[np.ndarray]:
        some = (texts[i : i + 8] for i in range(0, len(texts), 8))  # an encoding holds far more than its ids
        return [np.array(e.ids, np.uint32) for part in some for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the number of each text."""
        if not self.by_piece:
            parts = self._run([buf[a:b].tobytes().decode() for a, b in zip(offsets, offsets[1:], strict=False)])
            return np.concatenate([np.empty(0, np.uint32), *parts]), np.array([len(p) for p in parts], np.int64)
        starts = self._cuts(buf, offsets)
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        ends = np.append(starts[1:], len(buf))
        names, first, piece = np.unique(W.span_hash(buf, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > self.most:
            self._reset()
        at = np.searchsorted(self.known, names)
        new = np.flatnonzero((at == len(self.known)) | (self.known[np.minimum(at, len(self.known) - 1)] != names)) if len(self.known) else np.arange(len(names))
        if len(new):
            self._learn(buf, starts[first[new]], ends[first[new]], names[new])
            at = np.searchsorted(self.known, names)
        slots = self.slot[at]
        low, size = self.bounds[slots], self.bounds[slots + 1] - self.bounds[slots]
        size, low = size[piece], low[piece]
        before = np.concatenate(([0], np.cumsum(size)))
        ids = self.ids[np.arange(before[-1]) + np.repeat(low - before[:-1], size)]
        return ids, np.diff(before[np.searchsorted(starts, offsets)])

    def _cuts(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        cut = np.zeros(len(buf), bool)
        if len(buf) > 2:
            ends_word = (buf > 0x20) & (buf < 0x7F)  # and the last byte of U+00C0 to U+07FF, none of which is white space
            ends_word[1:] |= (buf[1:] >= 0x80) & (buf[:-1] >= 0xC3) & (buf[:-1] <= 0xDF)
            cut[1:] = (buf[1:] == 0x20) & ends_word[:-1]
        cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        return np.flatnonzero(cut)

    def _learn(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, names: np.ndarray) -> None:
        last = buf[ends - 1]
        joins = (buf[starts] == 0x20) & (last > 0x20) & (last < 0x7F) & (ends - starts > 1)
        alone = np.flatnonzero(~joins)
        parts = self._run([buf[starts[i] : ends[i]].tobytes().decode() for i in alone])
        order, lengths = [alone], [np.array([len(p) for p in parts], np.int64)]
        joined = np.flatnonzero(joins)
        groups = np.array_split(joined, max(1, int((ends - starts)[joined].sum()) >> 15)) if len(joined) else []
        texts = [W.take(buf, starts[g], ends[g]).tobytes() for g in groups]
        for g, text, ids in zip(groups, texts, self._run([t.decode() for t in texts]), strict=True):
            reached = np.cumsum(self.bytes_of[ids])
            if not len(g):
                continue
            wanted = np.cumsum(ends[g] - starts[g])
            at = np.searchsorted(reached, wanted)
            if reached[-1] != len(text) or (reached[at] != wanted).any():
                raise ValueError("a token crosses a cut")  # excluded by the pattern; never hidden if it should happen
            parts.append(ids)
            order.append(g)
            lengths.append(np.diff(np.concatenate(([0], at + 1))))
        order, lengths = np.concatenate(order), np.concatenate(lengths)
        slot = np.empty(len(names), np.int64)
        slot[order] = len(self.bounds) - 1 + np.arange(len(names))
        to = np.searchsorted(self.known, names)
        self.known, self.slot = np.insert(self.known, to, names), np.insert(self.slot, to, slot)
        self.bounds = np.concatenate((self.bounds, self.bounds[-1] + np.cumsum(lengths)))
        self.ids = np.concatenate((self.ids, *parts))


_encoders: dict[str, PieceEncoder] = held("encoders")


def encoder_for(path: str) -> PieceEncoder:
    """One encoder for each tokenizer and Python worker: its cache outlives a task."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def _packer(path: str, end_id: int, record_ids: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, names, counts, parts, size = encoder_for(path), [], [], [], 0

        def record() -> pa.RecordBatch:
            out = to_record(names, np.concatenate(counts), np.concatenate(parts))
            return pa.RecordBatch.from_arrays([pa.array([out], pa.binary())], ["value"])

        for batch in batches:
            docs = batch.column(0).to_pylist()
            for i, buf, off in W.slices(batch.column(1), 1 << 20):
                ids, n = encoder.encode(buf, off)
                to = np.cumsum(n + 1)
                out = np.full(to[-1], end_id, np.uint32)
                keep = np.ones(to[-1], bool)
                keep[to - 1] = False
                out[keep] = ids
                names += docs[i : i + len(n)]
                counts.append(n + 1)
                parts.append(out)
                size += len(out)
                if size >= record_ids:
                    yield record()
                    names, counts, parts, size = [], [], [], 0
        if names:
            yield record()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", record_ids: int = 1 << 18, records_per_file: int = 32) -> None:
    """Encode every text, append end_id to each and write the ids to `path` in ascending order of id_col.

    Partitions are ranges of ids and, of one id or of null ids, of their texts' hashes; file
    names sort as the ranges do. A task holds one record at a time: about record_ids ids, or
    one document if it alone has more.
    """
    arrow_bytes(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ranged = rows.withColumn("hash", F.xxhash64("text")).repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text")
    packed = ranged.select("doc_id", "text").mapInArrow(lean(_packer(tokenizer, end_id, record_ids), "encoders"), "value binary").select(F.col("value").cast("string"))
    packed.write.option("lineSep", MARK).option("maxRecordsPerFile", records_per_file).text(path)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, content in zip(batch.column(0), batch.column(1), strict=True):
            part, piece = re.search(r"part-(\d+)-.*?(?:-c(\d+))?\.txt$", name.as_py()).groups()
            at = 0
            for names, counts, ids in from_file(content.as_buffer()):
                raw, ends = memoryview(ids.astype("<u4")), np.cumsum(counts)
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(ends - counts, ends, strict=True)]
                n = len(names)
                yield pa.RecordBatch.from_pydict({"part": pa.array([int(part)] * n, pa.int64()), "piece": pa.array([int(piece or 0)] * n, pa.int64()), "doc_id": pa.array(names, pa.int64()), "at": pa.array(at + ends - counts, pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})
                at += len(ids)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a token store: doc_id, start (ids before it), n_tokens, ids_crc32."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    with arrow_rows(spark, 1):  # a row is a file
        rows = materialise(files.mapInArrow(lean(_decode), "part long, piece long, doc_id long, at long, n_tokens long, ids_crc32 long"), "token_rows")
    sizes = rows.groupBy("part", "piece").agg(F.sum("n_tokens").alias("n"))
    order = Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sizes.select("part", "piece", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    return rows.join(ahead, ["part", "piece"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def store_and_read(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write a token store in the shared folder, read it back, and drop the files once they are read."""
    spark = docs.sparkSession
    path = new_path(spark, "token_store")
    write_tokens(docs, path, tokenizer, end_id)
    out = read_tokens(spark, path)
    discard(spark, path)
    return out
