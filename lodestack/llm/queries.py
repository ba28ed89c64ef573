"""The queries of this subpackage over whole tables, with production parameters, and their SQL where it can be stated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html_extract, language_id, line_dedup, media_chunks, mixing, ngram_join, oracles, ordinal_quality, quality_rules, unigram_count
from .runtime import read


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(read(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(spark, read(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measure(read(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(spark, read(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    model = ordinal_quality.fit(docs, read(spark, sf_dir, "labels").select("doc_id", grade.alias("grade")))
    return ordinal_quality.score(docs, model)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = language_id.fit(docs.filter(~held_out))
    out = language_id.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


def op8_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_chunks.store_and_measure(spark, read(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return unigram_count.count(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(spark, read(spark, sf_dir, "documents"), with_text=False, keep_cols=["doc_id"])
    return out.select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_quality_rules": oracles.QUALITY_RULES,
        "op4_ngram_join": oracles.NGRAM_JOIN,
        "op10_line_dedup": oracles.LINE_DEDUP,
    }
