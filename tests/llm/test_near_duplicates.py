import random
import re

import pytest

from quarry.llm import jaccard_join as J


def by_hand(rows):
    def shingles(text):
        words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return frozenset([tuple(words[i : i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [tuple(words)] if words else [])

    docs = [(doc, shingles(text)) for doc, text in rows]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(docs):
        for j in range(i):
            b = docs[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return {doc: (len(a), least[root(i)]) for i, (doc, a) in enumerate(docs)}


def joined(docs):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.join_documents(docs).collect()}


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(7)
    vocabulary, texts = ["aa", "Bb", "cc", "dd", "ee", "é", "x1"], [None, "", "  ", "a", "A a", "a a"]
    for _ in range(250):
        if draw.random() < 0.6:
            words = (draw.choice(texts) or "").split()
            for _ in range(draw.randint(0, 2)):
                if words:
                    words[draw.randrange(len(words))] = draw.choice(vocabulary)
            words += [draw.choice(vocabulary)] * (draw.random() < 0.3)
        else:
            words = [draw.choice(vocabulary) + str(draw.randint(0, 3)) for _ in range(draw.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 14, 18, 25, 60, 200]))]
        texts.append(draw.choice([" ", "\n\t"]).join(words))
    return list(enumerate(texts))


@pytest.mark.parametrize("boundary", [None, 0, 9])
def test_against_all_pairs(spark, rows, boundary, monkeypatch):
    monkeypatch.setattr(J, "SLICE", 2000)
    if boundary is not None:
        monkeypatch.setattr(J, "boundary_by_cost", lambda sets: boundary)
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, n string")
    assert joined(docs) == by_hand(rows)


def test_documents_of_the_test_data(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert joined(docs) == by_hand([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_a_large_group_of_near_copies(spark):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(w if draw.random() > 0.012 else f"n{draw.randrange(10**6)}" for w in words)) for i in range(120)]
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == by_hand(rows)


def test_one_of_each_group_stays(spark):
    text, other = "a b c d e f g", "k l m n o p"
    docs = spark.createDataFrame([(1, text, 3), (2, text, 3), (2, text, 3), (3, None, None), (3, None, None), (None, "z z", 1), (None, text, 1), (4, other, 1), (4, other, 1)], "doc_id long, text string, component int")
    left = J.keep_one(docs)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in left.collect()) == [(0, "z z"), (1, text), (3, ""), (3, ""), (4, other)]
    assert J.join_documents(docs.limit(0)).collect() == []


def test_required_overlap_is_the_contracts():
    for p in range(1, 30):
        for q in range(1, 30):
            r = J.required(p, q)
            assert 100 * r >= 80 * (p + q - r) and 100 * (r - 1) < 80 * (p + q - r + 1)
