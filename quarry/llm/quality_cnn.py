"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are cut into chunks of CHUNK bytes that overlap by the width of
a filter, so the filters pass over the whole document, at every STRIDE-th place.
Every filter is linear in learned embeddings of WIDTH consecutive bytes; rectified, its
largest answer in a chunk is kept (max-pooling). The mean and the largest of the
chunks' answers, and nothing else, give one logit and its probability.

Filters, embeddings and weights are fitted by Adam on the driver, on whole texts
of at most MOST_DOCS labelled documents and MOST_BYTES bytes, taken in the order
of the documents' checksums; a text that the bytes left cannot hold is passed
over and takes none of them. The bound holds for training alone, scoring covers
all documents. Only rows whose crc32(id as text) mod FOLDS is not HELD_OUT are
learned from. Reruns give the same model. Without labels of both kinds the score
is the share of label 1 among those there are, or 0.5 without any.

Null and empty texts are scored as a chunk of zeros.

Defined results: a null text scores as an empty one. Rows that agree in id, label and text
are learned from once and scored each. An empty table gives no rows; without a label of
either kind all scores are the share of good labels, 0.5 without labels. A labelled text
longer than the bytes that are left is not learned from and takes none of them; it is
scored whole, in pieces. Other columns are not read and may have any name; `keep_good`
passes them through.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .scratch import arrow_bytes, lean, spare

FOLDS, HELD_OUT = 3, 1
CHUNK, WIDTH, STRIDE, FILTERS, EMBEDDED = 128, 6, 2, 24, 8
MOST_DOCS, MOST_BYTES = 4000, 16_000_000
#: Bytes passed through in training, spread over as many epochs as that takes.
SEEN_BYTES, LEAST_EPOCHS, MOST_EPOCHS = 120_000_000, 4, 30


def chunks(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All chunks as rows (with the overlap behind them), each text's first chunk, and the share of each chunk that is text."""
    size = np.diff(off)
    count = np.maximum(-(-size // CHUNK), 1)
    first = np.concatenate(([0], np.cumsum(count)))
    text = np.repeat(np.arange(len(size)), count)
    begin = off[:-1][text] + (np.arange(first[-1]) - first[text]) * CHUNK
    left = off[1:][text] - begin
    row = np.arange(CHUNK + WIDTH - 1)
    at = begin[:, None] + row
    inside = row < left[:, None]
    out = np.where(inside, buf[np.where(inside, at, 0)], 0).astype(np.uint8) if len(buf) else np.zeros((len(begin), len(row)), np.uint8)
    return out, first, np.clip(left, 1, CHUNK) / CHUNK


@dataclass
class Model:
    embedding: np.ndarray  # 256, EMBEDDED
    kernel: np.ndarray  # WIDTH, EMBEDDED, FILTERS
    bias: np.ndarray  # FILTERS
    head: np.ndarray  # 2 * FILTERS + 1

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, self.kernel, self.bias, self.head]

    def tables(self) -> np.ndarray:
        """Each filter's answer to each byte at each of its places."""
        out = np.einsum("be,wef->wbf", self.embedding, self.kernel).astype(np.float32)
        out[0] += self.bias.astype(np.float32)
        return out


def pooled(rows: np.ndarray, tables: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """The largest rectified answer of every filter in every chunk, and where it was."""
    out, where = np.empty((len(rows), FILTERS), np.float32), np.empty((len(rows), FILTERS), np.int64) if places else None
    for i in range(0, len(rows), 64):  # stays in the processor's cache
        part = rows[i : i + 64]
        answer = tables[0][part[:, 0:CHUNK:STRIDE]]
        for w in range(1, WIDTH):
            answer += tables[w][part[:, w : w + CHUNK : STRIDE]]
        out[i : i + 64] = answer.max(axis=1)
        if places:
            where[i : i + 64] = answer.argmax(axis=1) * STRIDE
    np.maximum(out, 0, out=out)
    return out, where


def features(peaks: np.ndarray, first: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text the chunks' weighted mean and their largest; and each chunk's weight."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    weight = share / np.add.reduceat(share, first[:-1])[text]
    mean = np.add.reduceat(peaks * weight[:, None], first[:-1], axis=0)
    return np.concatenate((mean, np.maximum.reduceat(peaks, first[:-1], axis=0), np.ones((len(first) - 1, 1))), axis=1), weight


def probability(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 1) -> Model | float:
    """A model, or the share of label 1 if there are not both labels."""
    if not len(labels) or labels.min() == labels.max():
        return float(labels.mean()) if len(labels) else 0.5
    draw = np.random.default_rng(seed)
    model = Model(draw.normal(0, 0.5, (256, EMBEDDED)), draw.normal(0, 0.35, (WIDTH, EMBEDDED, FILTERS)), np.zeros(FILTERS), np.zeros(2 * FILTERS + 1))
    model.head[-1] = np.log(labels.mean() / (1 - labels.mean()))
    held = [chunks(np.frombuffer(t, np.uint8), np.array([0, len(t)])) for t in texts]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in model.parameters()]
    total = sum(len(h[0]) for h in held) * CHUNK
    epochs = int(np.clip(SEEN_BYTES // max(total, 1), LEAST_EPOCHS, MOST_EPOCHS))
    step, steps = 0, epochs * -(-len(texts) // 16)
    for _ in range(epochs):
        order = draw.permutation(len(texts))
        for i in range(0, len(order), 16):
            some = order[i : i + 16]
            rows = np.concatenate([held[k][0] for k in some])
            share = np.concatenate([held[k][2] for k in some])
            first = np.concatenate(([0], np.cumsum([len(held[k][0]) for k in some])))
            gradients = _gradients(model, rows, first, share, labels[some])
            step += 1
            rate = 0.02 * min(1, step / 20) * (1 - step / (steps + 1))
            for p, g, m in zip(model.parameters(), gradients, moments, strict=True):
                g = g + 1e-4 * p
                m[0] += 0.1 * (g - m[0])
                m[1] += 0.01 * (g * g - m[1])
                p -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
    return model


def _gradients(model: Model, rows: np.ndarray, first: np.ndarray, share: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    peaks, where = pooled(rows, model.tables(), places=True)
    seen, weight = features(peaks, first, share)
    error = (probability(seen @ model.head) - labels) / len(labels)
    text = np.repeat(np.arange(len(labels)), np.diff(first))
    largest = peaks == seen[:, FILTERS : 2 * FILTERS].astype(np.float32)[text]
    largest = largest / np.add.reduceat(largest, first[:-1], axis=0)[text]
    back = error[text][:, None] * (model.head[:FILTERS] * weight[:, None] + model.head[FILTERS:-1] * largest) * (peaks > 0)
    chunk = np.arange(len(rows))[:, None]
    kernel, embedding = np.zeros_like(model.kernel), np.zeros_like(model.embedding)
    for w in range(WIDTH):
        byte = rows[chunk, where + w].astype(np.int64)
        table = np.bincount((byte * FILTERS + np.arange(FILTERS)).ravel(), back.ravel(), 256 * FILTERS).reshape(256, FILTERS)
        kernel[w] = model.embedding.T @ table
        embedding += table @ model.kernel[w].T
    return [embedding, kernel, back.sum(axis=0), seen.T @ error]


def score(model: Model | float, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    if isinstance(model, float):
        return np.full(len(off) - 1, model)
    tables, out, i, n = model.tables(), [], 0, len(off) - 1
    while i < n:  # some texts at a time; a long one in pieces
        j = max(i + 1, int(np.searchsorted(off, off[i] + (1 << 20), side="right")) - 1)
        if off[j] - off[i] <= 1 << 22:
            rows, first, share = chunks(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            out.append(features(pooled(rows, tables)[0], first, share)[0])
        else:
            out.append(_long(buf[off[i] : off[j]], tables))
        i = j
    seen = np.concatenate(out) if out else np.empty((0, 2 * FILTERS + 1))
    return probability(seen @ model.head)


def _long(text: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """The features of one very long text, its chunks in pieces."""
    piece, total, largest, weight = CHUNK << 11, np.zeros(FILTERS), np.zeros(FILTERS, np.float32), 0.0
    for a in range(0, len(text), piece):
        part = text[a : a + piece + WIDTH - 1]
        rows, _, share = chunks(part, np.array([0, len(part)]))
        n = -(-min(piece, len(text) - a) // CHUNK)
        peaks = pooled(rows[:n], tables)[0]
        share = share[:n]
        total += (peaks * share[:, None]).sum(axis=0)
        largest = np.maximum(largest, peaks.max(axis=0))
        weight += share.sum()
    return np.concatenate((total / weight, largest, [1.0]))[None]


def held_out(doc_ids: list[int | None]) -> list[bool]:
    return [d is not None and zlib.crc32(str(d).encode()) % FOLDS == HELD_OUT for d in doc_ids]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model | float:
    """Fit on the labelled documents that may be learned from."""
    crc = F.crc32(F.col("doc_id").cast("string"))
    marked = labels.filter("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).withColumn("crc", crc)
    some = marked.filter(F.col("crc") % FOLDS != HELD_OUT).distinct().orderBy("crc", "doc_id", "quality").limit(MOST_DOCS)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = rows.join(F.broadcast(some), "doc_id").withColumns({"size": F.octet_length("text"), "hash": F.xxhash64("text")})  # MOST_DOCS rows
    # rows that agree in id, label and text count once, and are brought together before any of them is moved
    order = ["crc", "doc_id", "quality", "hash", "size"]
    listed = found.groupBy(*order).agg(F.lit(1)).orderBy(*order).limit(2 * MOST_DOCS).select(*order).collect()
    taken, left = [], MOST_BYTES
    for row in listed:
        if row["size"] <= left:
            taken, left = [*taken, (row["doc_id"], row["quality"], row["hash"], row["size"])], left - row["size"]
    # by way of Arrow: rows in a list would take Python workers of another kind on the executors
    columns = list(zip(*taken, strict=True)) or [[]] * 4
    kinds = {"doc_id": pa.int64(), "quality": pa.int32(), "hash": pa.int64(), "size": pa.int32()}
    wanted = docs.sparkSession.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds)))
    learned = found.join(F.broadcast(wanted), ["doc_id", "quality", "hash", "size"]).groupBy(*order).agg(F.min("text").alias("text"))
    learned = learned.orderBy(*order).select("quality", "text").collect()  # bounded by MOST_BYTES
    return fit([r["text"].encode() for r in learned], np.array([r["quality"] for r in learned], np.float64))


def _scorer(model: Model | float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.concatenate([np.empty(0), *(score(model, buf, off) for _, buf, off in W.slices(batch.column(batch.num_columns - 1)))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], [*batch.schema.names[:-1], "score"])

    return run


def score_documents(docs: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    arrow_bytes(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(lean(_scorer(model)), "doc_id long, score double")
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))
    return out.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model | float, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The documents that score `least` or more, all columns kept."""
    arrow_bytes(docs.sparkSession)
    rows = docs.withColumn(spare("text", docs.columns), F.col(text_col).cast("string"))
    out = rows.mapInArrow(lean(_keeper(model, least)), docs.schema)
    return out


def _keeper(model: Model | float, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.concatenate([np.empty(0), *(score(model, buf, off) for _, buf, off in W.slices(batch.column(batch.num_columns - 1)))])
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1]).filter(pa.array(scores >= least))

    return run
