import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm import token_counts as C
from quarry.llm import token_store as S
from quarry.llm import words as W

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "a  b", "hi <|endoftext|> there<|endoftext|>", "x   y", "  lead", "trail  ", "é è ñ ß", "日本 語 テスト", "don't  I'll\n\n x", "a <|endof text|>", "naïve \u0085 z", "  q w", "x" * 3000, " " * 500]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return S.PieceEncoder(PATH)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 60000) | st.integers(0, 3), max_size=700))
def test_coding_round_trip(ids):
    a = np.array(ids, np.uint64)
    assert S.unpack(*S.pack(a), len(a)).tolist() == ids


def test_records_round_trip():
    counts, ids = np.array([2, 0, 3]), np.array([1, 2, 1 << 63, 5, 60000], np.uint64)
    data = (S.to_record([None, 4, 9], counts, ids) + S.MARK.encode()) * 2
    for names, n, back in S.from_file(data):
        assert (names, n.tolist(), back.tolist()) == ([None, 4, 9], counts.tolist(), ids.tolist())


def encoded(encoder, texts):
    parts = [encoder.encode(buf, off) for _, buf, off in W.slices(pa.array(texts, pa.string()), 1 << 12)]
    return [int(x) for ids, _ in parts for x in ids], [int(x) for _, n in parts for x in n]


def test_pieces_give_the_librarys_ids(library, encoder):
    draw = random.Random(5)
    words = ["the", "naïve", "  ", "\n\n", "<|endoftext|>", "don't", "日本語", "x" * 50, "123", "!!", " ", "　"]
    texts = ODD + ["".join(draw.choice([" ", "", "  "]) + draw.choice(words) for _ in range(draw.randint(1, 200))) for _ in range(200)]
    whole = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert encoded(encoder, texts) == ([x for ids in whole for x in ids], [len(ids) for ids in whole])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t'1!  s<|", max_size=30), min_size=1, max_size=5))
def test_pieces_on_arbitrary_texts(texts):
    library, encoder = Tokenizer.from_file(PATH), S.encoder_for(PATH)
    whole = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert encoded(encoder, texts)[0] == [x for ids in whole for x in ids]


def test_store_reads_back_what_the_library_gives(spark, library):
    texts = {i * 3: t for i, t in enumerate(ODD)}
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()][::-1], "doc_id long, text string, start string").repartition(3)
    rows, start = sorted(S.store_and_read(docs, PATH).collect()), 0
    assert [r["doc_id"] for r in rows] == sorted(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_store_of_repeated_and_unnamed_documents(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (None, None)], "doc_id long, text string")
    rows = sorted(S.store_and_read(docs, PATH).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, None, 1, 1]
    assert S.store_and_read(docs.limit(0), PATH).collect() == []


def test_counts_of_spliced_chunks(spark, library):
    draw = random.Random(3)
    words = ["the", "naïve", "  ", "\n\n", "<|endoftext|>", "don't", "日本語", "x" * 50, "123", "!!", " "]
    texts = [t or "" for t in ODD] + [" ".join(draw.choice(words) for _ in range(draw.randint(1, 3000))) for _ in range(25)]
    texts += ["a" * 30000 + " b", "".join(draw.choice("ab") for _ in range(9000)) + " " + "x y " * 2000, " " * 5000 + "q"]  # no boundary inside an overlap
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9, texts[9]), (None, texts[-1]), (-1, None)], "doc_id long, text string")
    rows = C.count_tokens(docs, PATH, whole_bytes=600, chunk=700, overlap=128).collect()
    assert len(rows) == len(texts) + 3
    for r in rows:
        text = texts[r["doc_id"]] if r["doc_id"] is not None and r["doc_id"] >= 0 else "" if r["doc_id"] == -1 else texts[-1]
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 1024)


def test_counts_of_a_sentencepiece_model(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = spark.createDataFrame([(1, "Hello there, world"), (2, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in C.count_tokens(docs, path).collect()} == {1: len(model.encode("Hello there, world")), 2: 0}
