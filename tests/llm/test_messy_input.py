"""Nulls, repeated rows, a very long text and columns with the names that operators use for their own: every stage, and the operators without one."""

import pytest

import corpus_pipeline as P
from quarry.llm import multi_index, token_counts
from quarry.llm.scratch import spare

FOLDER = "/root/testdata/sf0.001"
#: Names that intermediate columns have or had.
CLASHING = "_key_doc_id _once_h1 _gone _gone_id _mix_id mix_row mix_size _text rank line part key hash row h1 h2 component source_size"


@pytest.fixture(scope="module")
def messy(spark):
    long_text = " ".join(f"word{i % 5000} of {i % 17}" for i in range(60000))
    texts = [(1, "a good text of some words here"), (1, "a good text of some words here"), (2, None), (2, ""), (None, "no id at all but words"), (None, None), (3, "   "), (4, long_text), (5, long_text), (6, "one")]
    extra = CLASHING.split()
    rows = [(i, t, "en" if k % 2 else None, "s1" if k % 3 else None, len(t or ""), *(f"x{k}" for _ in extra)) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra))


def test_the_whole_pipeline(spark, messy):
    docs = messy
    for k, (name, stage) in enumerate(P.STAGES):
        before = docs
        docs = P.materialise(stage(spark, docs, FOLDER), name)
        if k < 4:
            assert docs.columns == messy.columns
        if k < 3:
            assert docs.exceptAll(before).count() == 0
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_one_of_equal_rows_stays(spark, messy):
    kept = [(r["doc_id"], r["text"]) for r in P.near_duplicates(spark, messy, FOLDER).select("doc_id", "text").collect()]
    assert len(kept) == 8 and sum(i == 1 for i, _ in kept) == 1 and sum(i in (4, 5) for i, _ in kept) == 1


def test_copies_of_a_huge_text_count_alike(spark, messy):
    import public_tokenizers

    got = token_counts.count_tokens(messy, public_tokenizers.path("byte_bpe_50k.json"), whole_bytes=1 << 14).collect()
    assert len(got) == 10 and len({r["n_tokens"] for r in got if r["doc_id"] in (4, 5)}) == 1


def test_vectors_beside_clashing_columns(spark):
    rows = [(i, [float(i % 7), 1.0, float(i)], i, i, i) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cell long, block long, `group` long")
    plain = sorted(map(tuple, multi_index.search(df.select("vec_id", "embedding")).collect()))
    assert sorted(map(tuple, multi_index.search(df).collect())) == plain and len(plain) == 60


def test_spare_names_differ_in_any_case():
    assert spare("a", ["_A", "b"]) == "__a" and spare("a", []) == "_a"
