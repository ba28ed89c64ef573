"""From raw documents to token ids: quality rules, line dedup, near-duplicate removal, source mix, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of ``documents``. ``run``
writes each stage to shared storage and reads it again, so a lost executor costs at most one stage, and deletes the work
tables of a stage and its input once its result is written.

For every stage: null texts count as empty, and empty and very long ones are handled whole; rows without an id stay unless a
rule rejects them; equal rows are one document where ids count (line dedup, n-gram join) and rows of their own elsewhere; ties
go to the smallest id (n-gram join), the largest (line dedup) or a hash (mix); an empty table gives an empty one; extra columns
of the input are dropped.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.llm import bpe, line_dedup, mixing, ngram_join, quality_rules
from lodestack.llm.runtime import Workspace, read, scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.apply(docs.select(*COLUMNS))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more documents hold stay in the largest doc_id only; n_chars follows the text."""
    out = line_dedup.dedup(spark, docs, keep_cols=["doc_id", "lang", "source"])
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group linked by five-word shingles at similarity 0.8 or more.

    A document is an id with a text, known by a 64-bit hash of both: rows that share an id stay each in their own group, and
    only rows of one group compete. Of rows alike in id and text one stays; rows without an id stay all.
    """
    docs = docs.select(*COLUMNS).withColumn("_key", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")))
    keyed = docs.filter(F.col("doc_id").isNotNull())
    groups = ngram_join.join(spark, docs, k=5, num=80, den=100, id_col="_key")
    groups = groups.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_key"), F.col("component_id").alias("_group"))
    members = keyed.select("doc_id", "_key").distinct().join(groups.distinct(), "_key")
    first = members.groupBy("_group").agg(F.min(F.struct("doc_id", "_key")).alias("m")).select("m.doc_id", "m._key")
    same = Window.partitionBy("doc_id", "_key").orderBy(F.xxhash64("text", "source", "lang"))
    kept = keyed.join(first, ["doc_id", "_key"], "left_semi")
    kept = kept.withColumn("_n", F.row_number().over(same)).filter("_n = 1").select(*COLUMNS)
    return kept.unionByName(docs.filter(F.col("doc_id").isNull()).select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.apply(spark, docs.select(*COLUMNS))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and their digests."""
    return bpe.encode(docs.select("doc_id", "source", "lang", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("source_mix", mix_sources),
    ("byte_bpe", tokenize),
]

#: Connected near-copies and dependent rounding have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs, before = read(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        with scratch():
            docs = work.table(stage(spark, docs, sf_dir), f"{k}-{name}")
        if before:
            work.drop(before)
        before = f"{k}-{name}"
    return docs
