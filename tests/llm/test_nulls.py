"""Nulls in every column, clashing extra columns and empty tables, through every operator and stage."""

import public_tokenizers
import pytest

import corpus_pipeline
from lodestack.llm import bpe, language_id, line_dedup, media_chunks, mixing, ngram_join, ordinal_quality, quality_rules, unigram_count

LINE = "a line that many documents hold, word for word"
BODY = " ".join(f"the w{i} of and" for i in range(30))
ROWS = [
    (1, BODY + "\n" + LINE, "en", "a", None),
    (2, None, None, None, None),
    (None, BODY + "\n" + LINE, "en", "b", 3),
    (None, None, None, None, None),
    (4, "", "en", None, 0),
    (5, BODY + " x\n" + LINE, None, "a", 1),
    (9007199254740993, BODY + " yes\n" + LINE, "en", "a", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_operators(spark, docs):
    wide = docs.selectExpr("*", "doc_id AS h", "text AS kept", "1 AS grp", "2 AS label")
    sp, tok = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    grades = spark.createDataFrame([(1, 2), (None, 1), (5, None), (5, 0)], "doc_id long, grade int")
    results = [
        quality_rules.measure(wide),
        mixing.report(spark, wide),
        ngram_join.join(spark, wide, 3, 90, 100),
        ordinal_quality.score(wide, ordinal_quality.fit(wide, grades)),
        bpe.encode(wide, tok, public_tokenizers.PATTERN),
        language_id.predict(wide, language_id.fit(wide)),
        media_chunks.store_and_measure(spark, wide),
        unigram_count.count(wide, sp),
        line_dedup.dedup(spark, wide),
    ]
    for r in results:
        ids = sorted((x.doc_id for x in r.collect()), key=str)
        assert ids == sorted((x[0] for x in ROWS), key=str)


def test_line_dedup_counts_rows_without_an_id(spark, docs):
    got = {(r.doc_id, r.n_dropped) for r in line_dedup.dedup(spark, docs).collect()}
    assert got == {(1, 1), (2, 0), (None, 0), (4, 0), (5, 1), (9007199254740993, 0)}


@pytest.mark.parametrize("k", range(5))
def test_stages(spark, docs, k):
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs.withColumn("extra", docs.doc_id), "unused")
    if k < 4:
        assert out.columns == corpus_pipeline.COLUMNS
    ids = [r.doc_id for r in out.collect()]
    if k in (1, 4):
        assert sorted(ids, key=str) == sorted((x[0] for x in ROWS), key=str)
    if k == 0:
        assert sorted(ids, key=str) == [1, 5, 9007199254740993, None]
    if k == 2:
        assert sorted(ids, key=str) == [1, 2, 4, None, None]
    empty = stage(spark, docs.limit(0), "unused")
    assert empty.collect() == [] and empty.columns == out.columns


def test_rows_that_share_an_id_keep_their_unique_texts(spark):
    word = lambda name, n=30: " ".join(f"{name}{i}" for i in range(n))
    near = word("a") + " more"  # 26 of 27 shingles
    rows = []
    for i in range(8):  # each copy is of the document of its own ten
        rows += [(10 * i + 1, f"{i} {word('a' + str(i))}"), (10 * i + 5, f"{i} {word('a' + str(i))}"), (10 * i + 5, word(f"own{i}x"))]
    rows += [(101, word("a")), (105, near), (105, word("b")), (105, word("b")), (103, None), (103, word("c")), (109, word("c") + " more")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, "unused").collect()), key=str)
    gone = {(10 * i + 5, f"{i} {word('a' + str(i))}") for i in range(8)} | {(105, near), (109, word("c") + " more")}
    assert got == sorted(set(rows) - gone, key=str)
