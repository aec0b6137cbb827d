import random

import pytest

from quarry.llm import decontam as C


@pytest.fixture(scope="module")
def items(spark, folder):
    return spark.read.parquet(f"{folder}/benchmark.parquet")


def planted(spark, folder, items, change):
    texts = [r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").limit(45).collect()]
    rows = [(r["item_id"], texts[k % 45] + " " + change(r["text"]) + "\n" + texts[(k + 1) % 45]) for k, r in enumerate(items.collect())]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize(("rate", "least"), [(0, 1.0), (0.1, 1.0), (0.2, 0.9)])
def test_passages_with_words_replaced(spark, folder, items, rate, least):
    draw = random.Random(1)
    rows, docs = planted(spark, folder, items, lambda t: " ".join(w if draw.random() >= rate else f"zz{draw.randrange(999)}" for w in t.split()).upper())
    found = {(r["doc_id"], r["item_id"]) for r in C.find_leaks(docs, items).collect()}
    assert sum((i, i) in found for i, _ in rows) >= least * len(rows)


def test_positions(spark, items):
    text = items.filter("item_id = 3").first()["text"]
    docs = spark.createDataFrame([(1, "one two three " + text + " four")], "doc_id long, text string")
    (row,) = C.find_leaks(docs, items).collect()
    n = len(text.split())
    assert (row["item_id"], row["first_word"], row["end_word"], row["n_equal"], row["item_words"]) == (3, 3, 3 + n, n, n)


def test_clean_documents_stay(spark, items):
    draw = random.Random(8)
    words = sorted({w for r in items.collect() for w in r["text"].split()})
    docs = spark.createDataFrame([(i, " ".join(draw.choice(words) for _ in range(400))) for i in range(200)], "doc_id long, text string")
    assert C.find_leaks(docs, items).collect() == []
    assert C.drop_leaking(docs, items).count() == 200


def test_nulls_repeats_and_clashing_names(spark, items):
    text = items.first()["text"]
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, text, 1), (3, text + " " + text, 1), (3, text + " " + text, 1)], "doc_id long, text string, h1 int")
    bench = spark.createDataFrame([(0, text), (1, None), (None, "x"), (2, ""), (3, "a b"), (4, text)], "item_id long, text string")
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in C.find_leaks(docs, bench).collect()) == [(0, 0), (0, 4), (3, 0), (3, 0), (3, 4), (3, 4)]
    left = C.drop_leaking(docs, bench)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [1, 2]
    assert C.find_leaks(docs, bench.limit(0)).collect() == []
    assert C.find_leaks(docs.limit(0), bench).collect() == []


def test_benchmark_in_several_blocks(spark, folder, items, monkeypatch):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    whole = sorted(C.find_leaks(docs, items).collect())
    monkeypatch.setattr(C, "BLOCK_BYTES", 2000)
    assert sorted(C.find_leaks(docs, items).collect()) == whole and whole


def test_stretches_inside_one_that_fails(spark):
    words = [f"w{k}" for k in range(48)]
    copy = [w if k < 10 or 19 <= k < 29 or k >= 38 else f"z{k}" for k, w in enumerate(words)]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    (row,) = C.find_leaks(spark.createDataFrame([(1, " ".join(copy))], "doc_id long, text string"), bench).collect()
    assert row["n_equal"] >= 10 and row["n_equal"] >= C.SHARE * (row["end_word"] - row["first_word"])


def test_a_counting_stretch_is_found_wherever_there_is_one():
    draw = C.np.random.default_rng(4)
    for _ in range(60):
        equal = (draw.random((8, 40)) < draw.uniform(0.2, 0.8)).astype(C.np.int8)
        equal[0, :5] = -1
        least = draw.integers(1, 14, 8)
        begin, end, same = C.counting_stretch(equal, least)
        for r, row in enumerate(equal):
            there = any(-1 not in row[i:j] and (row[i:j] == 1).sum() >= max(least[r], C.SHARE * (j - i) - 1e-9) for i in range(40) for j in range(i + 1, 41))
            assert (same[r] > 0) == there
            if there:
                assert same[r] == (row[begin[r] : end[r]] == 1).sum() >= max(least[r], C.SHARE * (end[r] - begin[r]) - 1e-9)


def test_items_of_few_words_match_as_a_whole(spark):
    bench = spark.createDataFrame([(k, " ".join(f"q{i}" for i in range(k))) for k in range(1, 6)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a q0, Q1 q2 b"), (2, "q1 q0 q2"), (3, "q1 q2 q3"), (4, "x q0 q1 q2 q3 q4")], "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"], r["n_equal"]) for r in C.find_leaks(docs, bench).collect()}
    assert found == {(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 1, 1)} | {(4, k, k) for k in range(1, 6)}


def test_against_all_alignments(spark):
    """Every document over every item at every place: a pair counts if some mask sees only equal words on the diagonal and a stretch of it meets the thresholds."""
    draw = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    items = [[draw.choice(words) for _ in range(draw.choice([3, 5, 8, 12, 20, 40, 40]))] for _ in range(16)]
    docs = []
    for _ in range(80):
        text = [draw.choice(words) for _ in range(draw.randint(0, 60))]
        for _ in range(draw.randint(0, 2)):
            item, rate = draw.choice(items), draw.choice([0, 0.1, 0.25, 0.4])
            a = draw.randrange(len(item) // 3 + 1)
            part = [w if draw.random() >= rate else draw.choice(words) for w in item[a : a + draw.randint(len(item) // 2, len(item))]]
            text[len(text) // 2 : len(text) // 2] = part
        docs.append(text)

    def counts(equal, n):
        for a in range(len(equal)):
            same = 0
            for b in range(a, len(equal)):
                same += equal[b]
                if same >= min(C.MATCHED, n) and same >= C.SHARE * (b + 1 - a):
                    return True
        return False

    def held(text, item):
        n = len(item)
        masks = C.MASKS if n >= 5 else (tuple(range(n)),)
        for place in range(-n + 1, len(text)):
            low, high = max(0, -place), min(n, len(text) - place)
            equal = [text[place + k] == item[k] for k in range(low, high)]
            seen = any(all(equal[i + m] for m in mask) for mask in masks for i in range(len(equal) - mask[-1]))
            if seen and counts(equal, n):
                return True
        return False

    expected = {(d, i) for d, text in enumerate(docs) for i, item in enumerate(items) if held(text, item)}
    left = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(docs)], "doc_id long, text string")
    right = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in C.find_leaks(left, right).collect()}
    assert (got - expected, expected - got) == (set(), set()) and len(expected) > 10


def test_hits_in_pieces_are_those_at_once():
    import numpy as np

    draw = random.Random(3)
    texts = [" ".join(draw.choice("abcdefgh") for _ in range(200)) for _ in range(3)]
    items = C.Items([1, 2], [" ".join(draw.choice("abcdefgh") for _ in range(50)) for _ in range(2)])
    words, first = C.plain_words(*C.W.buffers(C.pa.array(texts)))
    text = np.repeat(np.arange(3), np.diff(first))
    whole, pieces = (np.unique(np.concatenate(list(items.diagonals(words, text, most))), axis=0) for most in (1 << 30, 5))
    assert whole.tolist() == pieces.tolist() and len(whole)
