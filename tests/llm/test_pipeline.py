import pytest

import corpus_pipeline as P


def test_stages_follow_one_another(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for k, (name, stage) in enumerate(P.STAGES):
        docs = P.materialise(stage(spark, docs, folder), name)
        if k < 4:
            assert docs.columns == columns
        if k < 3:
            assert 0 < docs.count() <= n
            n = docs.count()
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    rows = docs.orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows)
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:], strict=False))


@pytest.mark.parametrize("stage", [s for _, s in P.STAGES])
def test_a_stage_without_documents(spark, stage):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert stage(spark, docs, "/root/testdata/sf0.001").collect() == []


def test_near_copies_and_leaks_go(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    once = P.near_duplicates(spark, docs, folder)
    assert P.near_duplicates(spark, once, folder).count() == once.count()
    clean = P.decontamination(spark, docs, folder)
    assert P.decontamination(spark, clean, folder).count() == clean.count() < docs.count()
