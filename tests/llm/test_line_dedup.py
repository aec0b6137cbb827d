import random
import re
from collections import Counter, defaultdict

import pytest

from quarry.llm import line_dedup as L


def by_hand(rows):
    out, before, holders, seen = {}, [], defaultdict(list), set()
    for doc, text in sorted(rows):
        parts, gone = [] if text is None else text.split("\n"), []
        for i, line in enumerate(parts):
            words = frozenset(re.findall("[^\x20\x09-\x0d]+", line))
            if not words:
                continue
            if words not in seen:
                shared = Counter(j for w in words for j in holders[w])
                alike = any(100 * n >= 80 * (len(words) + len(before[j]) - n) for j, n in shared.items())
                seen.add(words)
                before.append(words)
                for w in words:
                    holders[w].append(len(before) - 1)
            else:
                alike = True
            if alike:
                gone.append(i)
        out[doc] = (len(parts), len(gone), gone)
    return out


def decided(docs):
    return {r["doc_id"]: (r["n_lines"], r["n_removed"], r["removed"]) for r in L.dedup_lines(docs).collect()}


def test_against_all_pairs(spark):
    draw = random.Random(2)
    vocabulary = [f"w{i}" for i in range(40)]
    pool = [[draw.choice(vocabulary) for _ in range(draw.randint(1, 25))] for _ in range(60)]
    texts = [None, "", "\n\n", " a ", "a"]
    for _ in range(200):
        lines = []
        for _ in range(draw.randint(0, 5)):
            line = list(draw.choice(pool))
            for _ in range(draw.randint(0, 3)):
                line[draw.randrange(len(line))] = draw.choice(vocabulary)
            lines.append(draw.choice([" ", "\t", "  "]).join(line) + draw.choice(["", "\r"]))
        texts.append("\n".join(lines))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, line string")
    removed = L.dedup_lines(docs)
    assert decided(docs) == by_hand(rows)
    left = L.without_lines(docs, removed)
    assert left.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in left.collect()} == {i: t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in by_hand(rows)[i][2]) for i, t in rows}


def test_documents_of_the_test_data(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert decided(docs) == by_hand([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_many_variants_of_one_line(spark):
    draw = random.Random(9)
    line = [f"word{i}" for i in range(40)]
    rows = [(i, " ".join(w if draw.random() > 0.06 else f"new{draw.randrange(10**6)}" for w in line)) for i in range(150)]
    assert decided(spark.createDataFrame(rows, "doc_id long, text string")) == by_hand(rows)


def test_repeated_unnamed_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (None, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_lines"], r["n_removed"]) for r in L.dedup_lines(docs).collect()) == [(0, 0, 0), (0, 1, 0), (1, 1, 1), (1, 1, 1)]
    assert L.dedup_lines(docs.limit(0)).collect() == []


def test_lines_of_a_slice():
    buf, off = L.W.buffers(L.pa.array(["a\n\nb", "", "c\n", "\n"]))
    begin, text = L._line_offsets(buf, off)
    assert text.tolist() == [0, 0, 0, 1, 2, 2, 3, 3]
    assert [bytes(buf[a:b]).strip() for a, b in zip(begin, begin[1:], strict=False)] == [b"a", b"", b"b", b"", b"c", b"", b"", b""]


def test_variants_that_are_like_the_first_alone(spark):
    """Half of the variants are unlike one another, so only the hub settles them; the rest is like nothing."""
    draw = random.Random(4)
    line = [f"word{i}" for i in range(60)]
    rows = [(0, " ".join(line))]
    for i in range(1, 160):
        edits = set(draw.sample(range(60), 6 if i % 2 else 12))
        rows.append((i, " ".join(f"new{draw.randrange(10**6)}" if k in edits else w for k, w in enumerate(line))))
    draw.shuffle(rows)
    assert decided(spark.createDataFrame(rows, "doc_id long, text string")) == by_hand(rows)


def test_very_long_texts_and_lines(spark):
    draw = random.Random(5)
    long_line = " ".join(f"w{draw.randrange(20000)}" for _ in range(30000))
    many = "\n".join(" ".join(f"v{draw.randrange(3000)}" for _ in range(12)) for _ in range(3000))
    rows = [(1, long_line), (2, long_line + " other"), (3, many), (4, many + "\nlast line of all these here"), (5, "last line of all these here")]
    assert decided(spark.createDataFrame(rows, "doc_id long, text string")) == by_hand(rows)


def test_clashing_names(spark):
    rows = [(1, "a b c d e\nx", 5, "p", "q", 7, "r"), (2, "a b c d e\ny", 6, "p", "q", 8, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, line long, _gone string, _gone_id string, rank long, _key_doc_id string")
    left = L.without_lines(docs, L.dedup_lines(docs))
    assert left.columns == docs.columns
    assert [tuple(r) for r in left.orderBy("doc_id").collect()] == [rows[0], (2, "y", *rows[1][2:])]


def test_no_python_on_the_executors(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("DataFrame functions only are asked for")

    rows = [(1, "a\tb\x0bc\x0cd\re"), (2, "e d c b a x"), (3, "\x0b\x0c\r\t \n\x0cé à\n à é"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for kind, name in ((type(docs), "mapInArrow"), (type(docs), "mapInPandas"), (type(docs.groupBy("doc_id")), "applyInArrow"), (type(docs.groupBy("doc_id")), "applyInPandas")):
        monkeypatch.setattr(kind, name, refused)
    assert decided(docs) == by_hand(rows) == {1: (1, 0, []), 2: (1, 1, [0]), 3: (3, 1, [2]), 4: (0, 0, [])}


def test_long_words_first_without_a_count(spark, monkeypatch):
    """Words that are as frequent are listed by their length, and no word is counted while lists are short."""
    monkeypatch.setattr(L, "word_places", lambda *_: pytest.fail("words were counted"))
    rows = [(1, "a be sea tree rivers mountain elephants"), (2, "be a mountain sea tree rivers elephants x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    first = L.with_keys(L.raw_lines(docs), None).orderBy("doc_id").collect()[0]["keys"]
    alone = {w: L.with_keys(L.raw_lines(spark.createDataFrame([(1, w)], "doc_id long, text string")), None).first()["keys"][0] for w in rows[0][1].split()}
    assert first == [alone[w] for w in sorted(alone, key=len, reverse=True)]
    assert decided(docs) == by_hand(rows)


def test_words_are_counted_where_lists_are_long(spark, monkeypatch):
    """With the common long words behind the others the result is the same."""
    draw, counted = random.Random(11), []
    places = L.word_places
    monkeypatch.setattr(L, "word_places", lambda *a: counted.append(1) or places(*a))
    monkeypatch.setattr(L, "PAIRS_A_SET", 20)
    common = [f"averylongandcommonword{i}" for i in range(4)]
    rows = []
    for i in range(150):
        line = [*common, *(f"w{draw.randrange(300)}" for _ in range(14))]
        rows.append((i, " ".join(line) if i % 3 or not i else " ".join([*rows[i - 1][1].split()[:-1], f"x{i}"])))
    assert decided(spark.createDataFrame(rows, "doc_id long, text string")) == by_hand(rows)
    assert counted == [1]


def test_bits_never_prove_more_than_differs(spark):
    """Small and large sets, on either side of the size at which the second map begins."""
    draw = random.Random(12)
    rows = [(i, " ".join(draw.sample([f"w{k}" for k in range(260)], draw.choice([4, 20, 60, 96, 97, 110, 130, 200])))) for i in range(120)]
    found = {r["doc_id"]: r for r in L.lines(spark.createDataFrame(rows, "doc_id long, text string"), None).collect()}
    words = {i: set(t.split()) for i, t in rows}
    ones = lambda x: (x & (1 << 64) - 1).bit_count()
    for i, a in found.items():
        assert a["n"] == len(words[i]) and (a["bits1"] == 0) == (a["n"] <= L._LARGE)
        for j, b in found.items():
            differ, every, half = len(words[i] ^ words[j]), a["bits0"] ^ b["bits0"], a["bits1"] ^ b["bits1"]
            assert ones(every) <= differ
            assert min(a["n"], b["n"]) <= L._LARGE or ones(half) + ones(every ^ half) <= differ
