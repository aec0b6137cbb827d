from collections import Counter

from quarry.llm import mixing as M


def wanted(sizes):
    """Targets by the contract, round by round."""
    keys = sorted(sizes)
    weight = {k: 1 + i % 3 for i, k in enumerate(keys)}
    total, capped = sum(sizes.values()), set()
    while True:
        left, open_weight = total - sum(3 * sizes[k] for k in capped), sum(weight[k] for k in keys if k not in capped)
        out = {k: 3 * sizes[k] if k in capped else left * weight[k] / open_weight if open_weight else 0 for k in keys}
        over = {k for k in keys if k not in capped and out[k] > 3 * sizes[k]}
        if not over:
            return out
        capped |= over


def checked(docs):
    rows = M.plan_copies(docs).collect()
    assert len(rows) == docs.count()
    sizes, taken, target, largest = Counter(), Counter(), {}, Counter()
    for r in rows:
        assert 0 <= r["copies"] <= 3
        sizes[r["key"]] += r["size"]
        taken[r["key"]] += r["copies"] * r["size"]
        largest[r["key"]] = max(largest[r["key"]], r["size"])
        target[r["key"]] = (r["source_size"], r["target"])
    expected = wanted(sizes)
    for k in sizes:
        assert target[k][0] == sizes[k]
        assert abs(target[k][1] - expected[k]) <= 1e-6 * max(1, expected[k])
        assert abs(taken[k] - expected[k]) <= largest[k] / 2 + 1 + 1e-6 * expected[k]
    return rows


def test_targets_are_met(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert sorted(checked(docs)) == sorted(checked(docs))  # reruns agree


ODD = [(1, "a b c", "x", 1), (1, "a b c", "x", 2), (2, None, "x", 1), (3, "q " * 500, None, 1), (4, "", "zz", 1), (None, "hello there", "y", 1)] + [(i, "w " * (i % 17), "big", 1) for i in range(10, 200)]
SCHEMA = "doc_id long, text string, source string, copies int"


def test_nulls_ties_and_clashing_names(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    rows = checked(docs)
    mixed = M.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r["copies"] for r in rows)


def test_nothing_to_mix(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    assert M.plan_copies(docs.limit(0)).collect() == []
    assert M.mix_documents(docs.limit(0)).collect() == []
    assert all(r["copies"] == 0 for r in checked(docs.filter("text = ''")))


def test_only_functions_of_the_engine(spark, folder):
    plan = M.plan_copies(spark.read.parquet(f"{folder}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rates_solve_the_dual_exactly(spark):
    """Each source's tilt by bisection: the copies are its rates rounded up or down, but for one mended document."""
    import math
    import random

    draw = random.Random(6)
    rows = [(i, draw.choice("abcd"), " ".join(["w"] * draw.randint(1, 60))) for i in range(500)]
    got = M.plan_copies(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    by = {}
    for r in got:
        by.setdefault(r["key"], []).append(r)
    for own in by.values():
        target, total = own[0]["target"], sum(r["size"] for r in own)
        mean = total / len(own)
        rate = lambda t, s: min(3.0, math.exp(min(t * s / mean, 2.0)))  # noqa: E731, B023
        low, high = -60.0, 60.0
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if sum(r["size"] * rate(middle, r["size"]) for r in own) < target else (low, middle)
        off = [r for r in own if abs(r["copies"] - rate(low, r["size"])) >= 1 + 1e-4]
        assert len(off) <= 1
        assert abs(sum(r["copies"] * r["size"] for r in own) - target) <= 60
