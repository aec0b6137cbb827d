import numpy as np

from quarry.llm import multi_index as M


def nearest(rows, every=20, k=20):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        score, other = (x * x[i]).sum(axis=1), ids != ids[i]
        best = np.lexsort((ids[other], -score[other]))[:k]
        out[int(ids[i])] = list(zip(ids[other][best].tolist(), score[other][best].tolist(), strict=True))
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_all_candidates_of_a_small_table(spark, folder):
    df = spark.read.parquet(f"{folder}/embeddings.parquet")
    assert found(M.search(df)) == nearest([(r["vec_id"], r["embedding"]) for r in df.collect()])


def test_recall_and_exact_scores_of_a_larger_one(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(6000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[2000:2500] = x[0]  # one vector many times
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, expected = found(M.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))), nearest(rows)
    assert set(got) == set(expected)
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in expected[q]}) for q in got)
    assert hits >= 0.9 * sum(map(len, expected.values()))
    assert got[0] == expected[0]  # ties go to the smaller id
    assert all((x[q].astype(np.float64) * x[v]).sum() == s for q in list(got)[:20] for v, s in got[q])


def test_heap_order_is_by_sum():
    draw = np.random.default_rng(2)
    books, query = (draw.normal(size=(7, 3)), draw.normal(size=(5, 3))), draw.normal(size=6)
    sums = (books[0] @ query[:3])[:, None] + (books[1] @ query[3:])[None]
    assert M.visited(query, books, np.ones(35, np.int64), 35) == np.argsort(-sums.ravel(), kind="stable").tolist()


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 2.0, 0.5]), (1, [1.0, None, 0.0]), (2, None), (3, [0.0, 0.0, 0.0]), (20, [1.0, 2.0, 0.5]), (40, [float("nan"), 1.0, 1.0]), (41, [1.0, 2.0, 0.5]), (42, [1.0]), (None, [1.0, 1.0, 1.0]), (60, [2.0, 0.0, 1.0]), (60, [2.0, 0.0, 1.0]), (80, [float("inf"), 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {q: [v for v, _ in r] for q, r in found(M.search(df)).items()} == {0: [20, 41, 60, 60], 20: [0, 41, 60, 60], 60: [0, 20, 41]}
    assert M.search(df.limit(0)).collect() == []


def test_groups_split_large_cells():
    counts = np.array([10, M.GROUP * 3, 0, M.GROUP, 5])
    first, parts = M._groups(counts)
    assert parts[1] >= 3 and parts[[0, 3, 4]].tolist() == [1, 1, 1]
    own = set(range(first[1], first[1] + parts[1]))
    assert not own & {first[0], first[3], first[4]}
