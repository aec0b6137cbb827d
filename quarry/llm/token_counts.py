"""Token counts, with huge texts encoded in overlapping chunks that resynchronise.

A text of at most whole_bytes is encoded as it is. A longer one is cut into
chunks that overlap; the chunks are dealt out and encoded separately, with
offsets. Two neighbours are spliced at the first place inside their overlap
that both see as the end of one unit of the tokenizer's pattern and the begin
of the next. The pattern is matched from left to right and looks ahead, never
back, so from a common boundary on both see the same units; the left chunk is
right up to there because it was spliced itself and the end of its own text is
too far away to matter. Where a pair has no such place (a run without any
boundary may be longer than the overlap) all texts concerned go into a further
round with chunks and overlaps WIDEN times as long, at last as one chunk.

Null and empty texts have no bytes and no tokens. Rows that agree in id and
text give equal counts, each in a row of its own.

Defined results: an empty table gives no rows. Copies of a huge text are encoded once.
Other columns are not read and may have any name.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .scratch import arrow_bytes, materialise, small
from .token_store import PieceEncoder, encoder_for

WIDEN = 8
#: Characters at the end of a chunk that decide nothing, besides the longest added token: the pattern looks one ahead.
GUARD = 16


def _whole(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            encoder = encoder_for(path)
        for batch in batches:
            if path.endswith(".model"):
                count = [len(x) for x in model.encode([t or "" for t in batch.column(2).to_pylist()], num_threads=1)]
            else:
                count = np.concatenate([encoder.encode(buf, off)[1] for _, buf, off in W.slices(batch.column(2), 1 << 21)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(count, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def _chunks(chunk: int, overlap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                step = chunk - overlap
                n = max(1, -(-(len(text) - overlap) // step))
                for k in range(n):
                    part = text[k * step : k * step + chunk]
                    yield pa.RecordBatch.from_pydict({"key": [key], "k": pa.array([k], pa.int64()), "n": pa.array([n], pa.int64()), "at": pa.array([k * step], pa.int64()), "part": [part]})

    return run


def boundaries(encoding, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the pattern's units in an encoded text, and the number of tokens up to each."""
    unit, ends = encoding.word_ids, encoding.offsets
    found = [(ends[i][1], i + 1) for i in range(len(unit) - 1) if unit[i] != unit[i + 1] and ends[i][0] < ends[i][1] and not text[ends[i][1] - 1].isspace()]
    at = np.array(found, np.int64).reshape(-1, 2)
    return at[:, 0], at[:, 1]


def _encode_chunks(path: str, overlap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        guard = GUARD + max((len(t.content) for t in tokenizer.get_added_tokens_decoder().values()), default=0)
        for batch in batches:
            for key, k, n, at, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                encoding = tokenizer.encode(part, add_special_tokens=False)
                place, before = boundaries(encoding, part)
                left = place < overlap if k else np.zeros(len(place), bool)
                right = (place > len(part) - overlap) & (place <= len(part) - guard) if k + 1 < n else np.zeros(len(place), bool)
                lists = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (place[left] + at, before[left], place[right] + at, before[right])]
                yield pa.RecordBatch.from_arrays([pa.array([key]), *(pa.array([v], pa.int64()) for v in (k, n, len(encoding.ids))), *lists], ["key", "k", "n", "tokens", "left_at", "left_before", "right_at", "right_before"])

    return run


def splice(chunks: DataFrame) -> DataFrame:
    """Per key the tokens of the spliced chunks; null where some pair has no common boundary."""
    ahead = chunks.select("key", (F.col("k") - 1).alias("k"), F.col("left_at").alias("next_at"), F.col("left_before").alias("next_before"))
    pairs = chunks.join(ahead, ["key", "k"], "left").withColumn("cut", F.array_min(F.array_intersect("right_at", "next_at")))
    before = lambda at, n: F.expr(f"{n}[cast(array_position({at}, cut) as int) - 1]")
    own = F.when(F.col("k") == F.col("n") - 1, F.col("tokens")).when(F.col("cut").isNotNull(), before("right_at", "right_before") - before("next_at", "next_before"))
    return pairs.groupBy("key").agg(F.when(F.count(own) == F.max("n"), F.sum(own)).alias("n_tokens"))


def count_huge(texts: DataFrame, tokenizer: str, chunk: int, overlap: int) -> DataFrame:
    """texts: key, text, row; the key is unique to the text, of which one row stands for all. Returns key, n_tokens."""
    first = materialise(texts.groupBy("key").agg(F.min("row").alias("row")), "first")
    left, done = texts.join(small(first), ["key", "row"], "left_semi"), None
    while True:
        dealt = left.select("key", "text").mapInArrow(_chunks(chunk, overlap), "key string, k long, n long, at long, part string").repartition(F.col("key"), F.col("k"))
        schema = "key string, k long, n long, tokens long, left_at array<long>, left_before array<long>, right_at array<long>, right_before array<long>"
        chunks = materialise(dealt.mapInArrow(_encode_chunks(tokenizer, overlap), schema).dropDuplicates(["key", "k"]), "chunks")
        counted = materialise(splice(chunks), "spliced")
        good = counted.filter("n_tokens is not null")
        done = good if done is None else done.unionByName(good)
        missed = counted.filter("n_tokens is null").select("key")
        if missed.isEmpty():
            return done
        left = left.join(small(missed), "key", "left_semi")
        chunk, overlap = chunk * WIDEN, overlap * WIDEN


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, whole_bytes: int = 1 << 16, chunk: int = 1 << 15, overlap: int = 1 << 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit)."""
    if chunk < 4 * overlap or overlap < 8 * GUARD:
        raise ValueError("a chunk needs four overlaps and an overlap eight guards")
    arrow_bytes(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(F.coalesce(text_col, F.lit(""))).cast("long").alias("n_bytes"), F.col(text_col).cast("string").alias("text"))
    cuttable = not tokenizer.endswith(".model") and PieceEncoder(tokenizer).by_piece
    short = rows.filter(F.col("n_bytes") <= whole_bytes) if cuttable else rows
    out = short.mapInArrow(_whole(tokenizer), "doc_id long, n_bytes long, n_tokens long")
    if cuttable:
        huge = rows.withColumn("row", F.monotonically_increasing_id()).filter(F.col("n_bytes") > whole_bytes).withColumn("key", F.sha2("text", 256))
        counted = count_huge(huge.select("key", "text", "row"), tokenizer, chunk, overlap)
        out = out.unionByName(huge.select("doc_id", "n_bytes", "key").join(small(counted), "key").drop("key"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
