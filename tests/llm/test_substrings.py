import hashlib
import random
import re
from collections import Counter

import pytest

from quarry.llm import substring_dedup as D


def by_hand(texts, window):
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for t in texts]
    times = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        kept = [True] * len(w)
        for i in range(len(w) - window + 1):
            if times[tuple(w[i : i + window])] > 1:
                kept[i : i + window] = [False] * window
        left = [x for x, k in zip(w, kept, strict=True) if k]
        out.append((len(w), len(w) - len(left), hashlib.sha256(" ".join(left).encode()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(5)
    base = ["".join(draw.choice("abcdé") for _ in range(3)) for _ in range(120)]
    out = [None, "", "a b c"]
    for _ in range(150):
        words = [draw.choice(base) for _ in range(draw.randint(0, 90))]
        if draw.random() < 0.6:
            at = draw.randint(0, 40)
            words[at:at] = base[draw.randint(0, 5) : draw.randint(30, 60)]
        out.append("  ".join(words) + draw.choice(["", "\n"]))
    return out + [out[20], out[20], out[33], " ".join(base * 2)]


@pytest.mark.parametrize(("window", "size"), [(35, 4000), (35, 1 << 23), (8, 4000), (1, 4000)])
def test_against_all_windows(spark, texts, window, size, monkeypatch):
    monkeypatch.setattr(D, "SLICE", size)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, h1 int")
    rows = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in D.dedup_substrings(docs, window).collect()}
    assert [rows[i] for i in range(len(texts))] == by_hand(texts, window)


def test_documents_of_the_test_data(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in D.dedup_substrings(docs).collect()}
    assert rows == dict(zip(texts, by_hand(list(texts.values()), 35), strict=True))


def test_repeated_unnamed_and_no_documents(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text), (1, text), (None, "x"), (None, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in D.dedup_substrings(docs).collect()) == [(0, 0, 0), (0, 1, 0), (1, 40, 40), (1, 40, 40)]
    assert D.dedup_substrings(docs.limit(0)).collect() == []


def test_positions_pack_across_large_gaps():
    at = D.np.array([0, 3, 65534, 65535 * 3, 65535 * 3 + 1, 500000])
    assert D._unpacked_gaps(D._packed_gaps(at)).tolist() == at.tolist()
