import random
import re

import numpy as np
import pyarrow as pa

from quarry.llm import words as W


def test_words_and_hashes_of_random_texts():
    draw = random.Random(1)
    texts = ["".join(draw.choice("ab \n\té") for _ in range(draw.randint(0, 60))) for _ in range(300)] + ["", " ", "a" * 700000 + " b b", None]
    buf, off = W.buffers(pa.array(texts))
    starts, ends, first = W.spans(buf, off)
    expected = [re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode()) for t in texts]
    assert [[bytes(buf[starts[i] : ends[i]]) for i in range(first[d], first[d + 1])] for d in range(len(texts))] == expected
    flat, hashes = [w for d in expected for w in d], W.span_hash(buf, starts, ends)
    for n in (1, 2, 3, 5, 18, 35):
        seen = {}
        for i, h in enumerate(W.runs(hashes, n).tolist()):
            assert seen.setdefault(tuple(flat[i : i + n]), h) == h
        assert len(set(seen.values())) == len(seen)
        at, text = W.run_starts(first, n)
        assert len(at) == sum(max(0, len(d) - n + 1) for d in expected)
        assert all(first[t] <= a and a + n <= first[t + 1] for a, t in zip(at, text, strict=True))


def test_case_is_folded_for_ascii_letters_only():
    buf, off = W.buffers(pa.array(["Ab aB É é"]))
    h = W.span_hash(buf, *W.spans(buf, off)[:2], W.FOLDED)
    assert h[0] == h[1] and h[2] != h[3]


def test_slices_cover_all_texts():
    column = pa.array(["x" * n for n in (5, 0, 300, 1, 1, 0)])
    parts = list(W.slices(column, 10))
    assert [i for i, _, _ in parts] == sorted({i for i, _, _ in parts})
    assert sum(len(off) - 1 for _, _, off in parts) == 6
    assert sum(len(buf) for _, buf, _ in parts) == 307


def test_empty_column():
    assert list(W.slices(pa.array([], pa.string()))) == []
    assert len(W.runs(np.empty(0, np.uint64), 5)) == 0
