import zlib

import numpy as np
import pytest

from quarry.llm import quality_cnn as Q


@pytest.fixture(scope="module")
def data(spark):
    folder = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


@pytest.fixture(scope="module")
def model(data):
    return Q.train(*data)


def test_held_out_accuracy(data, model):
    quality = {r["doc_id"]: r["quality"] for r in data[1].collect()}
    rows = [r for r in Q.score_documents(data[0], model).collect() if r["held_out"] and r["doc_id"] in quality]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows)
    assert np.mean([r["predicted"] == quality[r["doc_id"]] for r in rows]) >= 0.95


def test_training_never_sees_held_out_rows_and_reruns_agree(data, model):
    docs, labels = data
    other = labels.withColumn("quality", Q.F.when(Q.F.crc32(Q.F.col("doc_id").cast("string")) % 3 == 1, 1 - Q.F.col("quality")).otherwise(Q.F.col("quality")))
    again = Q.train(docs, other)
    assert all((a == b).all() for a, b in zip(model.parameters(), again.parameters(), strict=True))


def test_gradients_against_differences():
    draw = np.random.default_rng(3)
    texts = [draw.integers(1, 255, n, dtype=np.uint8).tobytes() for n in (40, 300, 0)]
    held = [Q.chunks(np.frombuffer(t, np.uint8), np.array([0, len(t)])) for t in texts]
    rows, share = np.concatenate([h[0] for h in held]), np.concatenate([h[2] for h in held])
    first, labels = np.concatenate(([0], np.cumsum([len(h[0]) for h in held]))), np.array([1.0, 0.0, 1.0])
    model = Q.Model(draw.normal(size=(256, Q.EMBEDDED)), draw.normal(size=(Q.WIDTH, Q.EMBEDDED, Q.FILTERS)), draw.normal(size=Q.FILTERS), draw.normal(size=2 * Q.FILTERS + 1) / 50)

    def loss():
        p = Q.probability(Q.features(Q.pooled(rows, model.tables())[0], first, share)[0] @ model.head)
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    for parameter, gradient in zip(model.parameters(), Q._gradients(model, rows, first, share, labels), strict=True):
        flat, slope = parameter.reshape(-1), gradient.reshape(-1)
        for i in np.argsort(-np.abs(slope))[:3]:
            flat[i] += 1e-3
            up = loss()
            flat[i] -= 2e-3
            down = loss()
            flat[i] += 1e-3
            assert abs((up - down) / 2e-3 - slope[i]) <= 0.05 * abs(slope[i]) + 1e-4


def test_a_long_text_scores_as_in_one_piece(model):
    text = np.random.default_rng(1).integers(32, 120, (1 << 22) + 777, dtype=np.uint8)
    rows, first, share = Q.chunks(text, np.array([0, len(text)]))
    whole = Q.probability(Q.features(Q.pooled(rows, model.tables())[0], first, share)[0] @ model.head)
    assert abs(Q.score(model, text, np.array([0, len(text)]))[0] - whole[0]) < 1e-6


def test_nulls_repeats_and_clashing_names(spark, model):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", None), (None, "abc " * 30, "z"), (3, "x" * 300000, "l"), (3, "x" * 300000, "l")], "doc_id long, text string, score string")
    rows = Q.score_documents(docs, model).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert Q.keep_good(docs, model).columns == docs.columns
    labels = spark.createDataFrame([(2, 1), (None, 1), (1, None)], "doc_id long, quality int")
    assert isinstance(Q.train(docs, labels), float)
    assert Q.train(docs.limit(0), labels.limit(0)) == 0.5
    assert Q.score_documents(docs.limit(0), 0.5).collect() == []


def test_a_giant_text_does_not_empty_the_sample(spark, monkeypatch):
    ids = sorted((i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1), key=lambda i: zlib.crc32(str(i).encode()))
    docs = spark.createDataFrame([(i, "g" * 5000 if i == ids[0] else f"text {i}") for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(Q, "MOST_BYTES", 4000)
    monkeypatch.setattr(Q, "fit", lambda texts, marks: seen.append((texts, list(marks))) or 0.5)
    Q.train(docs, labels)
    assert seen == [([f"text {i}".encode() for i in ids[1:]], [float(k % 2) for k in range(1, len(ids))])]
