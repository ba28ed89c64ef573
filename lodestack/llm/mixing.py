"""Mixing sources to target weights by pivotal dependent rounding.

Targets: every source gets a share of all words by weight; a share above ``cap`` times the source's own size stops there,
and the excess is reshared by weight (water filling). A document of source s is wanted ``target / size`` times; the whole
part is certain, the fraction is a copy probability. Probabilities are rounded in pairs: mass in words moves from one
document to the other, with the two directions' odds chosen so that no expectation changes, until one of the two is
integral. Each bucket of a source (at most ``BUCKET`` documents, whatever the source's share of the rows) leaves one
fractional document; residuals meet in the next level of a reduction tree, and the last one of a source is rounded alone.
The words taken from a source thus differ from its target by less than one document. Randomness is a hash of ids, so reruns
agree.

Edge cases: null text has size 0, and very long texts count whole; a null source is a source of its own, last in order; a
source without words has target 0; documents of size 0 take nothing; equal rows are rounded one by one, and so are rows that
share an id; rows without an id are documents like others; ties of the hash are broken by id, key and size; an empty table
gives an empty one. ``report`` ignores extra columns, ``apply`` passes them through.
"""

from __future__ import annotations

import zlib
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .quality_rules import WORD_GAP
from .runtime import Workspace

BUCKET = 4096
BROADCAST_SOURCES = 100_000
NO_ID = -(1 << 63)  # stands for a null id inside the rounding


def word_count(text):
    """Runs of characters other than ASCII white space (null: 0), as long."""
    spaced = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), WORD_GAP, " "))
    return F.when(spaced == "", F.lit(0)).otherwise(F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit(""))) + 1).cast("bigint")


def _weighted(sizes: DataFrame, weights: tuple[float, ...], work: Workspace, part_rows: int) -> DataFrame:
    """``sizes`` with the weight ``w`` of each source by its place in order: ranges of at most about ``part_rows`` sources are
    numbered on their own, and the driver adds up the ranges' counts only."""
    order = F.col("source").asc_nulls_last()
    sizes = work.table(sizes, "sizes")
    parts = max(1, ceil(sizes.count() / part_rows))
    dealt = work.table(sizes.repartitionByRange(parts, order).withColumn("part", F.spark_partition_id()), "ranges")
    before, offset = {}, 0
    for r in sorted(dealt.groupBy("part").count().collect()):
        before[r.part], offset = offset, offset + r["count"]
    place = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    first = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.col("part")] if before else F.lit(0)
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((place + first) % len(weights) + 1).cast("int"))
    return work.table(dealt.withColumn("w", pick).drop("part"), "weighted")


def targets(sizes: DataFrame, work: Workspace, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3, part_rows: int = 50_000) -> DataFrame:
    """(source, n_docs, source_size, target) from (source, n_docs, source_size), one row per source.

    Water filling by rounds: sources whose limit lies under the level of the others are full, which raises the level; a round
    is one sum over the sources, and the rounds end when no further source is full.
    """
    d = _weighted(sizes, weights, work, part_rows).withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    level, n_full = 0.0, -1
    while True:
        full = F.col("limit") < F.lit(level) * F.col("w")
        r = d.agg(F.sum("source_size").alias("total"), F.count(F.when(full, 1)).alias("n"), F.sum(F.when(full, F.col("limit"))).alias("gone"), F.sum(F.when(~full, F.col("w"))).alias("free")).first()
        if r.n == n_full or not r.free:
            return d.select("source", "n_docs", "source_size", F.least("limit", F.lit(level) * F.col("w")).alias("target"))
        level, n_full = (float(r.total) - (r.gone or 0.0)) / r.free, r.n


def _round(bucket: int):
    """Pivotal rounding of one bucket: (copies, residual p or null) of its documents."""

    def run(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(["h", "doc_id", "key", "other", "ord", "size"], kind="stable").reset_index(drop=True)
        seed = zlib.crc32(repr((d["depth"].iat[0], *[str(x) for x in key])).encode())
        rng = np.random.Generator(np.random.PCG64([seed, int(d["h"].iat[0]) & 0xFFFFFFFF]))
        p, size = d["p"].to_numpy(float).copy(), d["size"].to_numpy(float)
        u = rng.random(len(d) + 1)
        free = (p > 1e-9) & (p < 1 - 1e-9)
        p[~free] = np.round(p[~free])
        empty = free & (size <= 0)
        p[empty] = u[:-1][empty] < p[empty]
        held = -1
        for i in np.flatnonzero(free & ~empty).tolist():
            if held < 0:
                held = i
                continue
            a, b = size[held], size[i]
            up, down = min((1 - p[held]) * a, p[i] * b), min(p[held] * a, (1 - p[i]) * b)
            move = up if u[i] * (up + down) < down else -down
            p[held] += move / a
            p[i] -= move / b
            for x in (held, i):
                if p[x] < 1e-9 or p[x] > 1 - 1e-9:
                    p[x] = round(p[x])
            open_ = [x for x in (held, i) if 0 < p[x] < 1]
            held = open_[0] if open_ else -1
        if held >= 0 and d["buckets"].iat[0] <= 1:  # nothing is left to pair with
            p[held] = float(u[-1] < p[held])
        return d.assign(p=p, bucket=d["bucket"] // bucket, buckets=np.ceil(d["buckets"] / bucket).astype("int64"), depth=d["depth"] + 1)

    return run


_ROW = "source string, source_size long, target double, doc_id long, key long, other long, ord long, size long, base long, p double, h long, bucket long, buckets long, depth int"


def mix(spark: SparkSession, sized: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3, bucket: int = BUCKET) -> DataFrame:
    """``sized`` (doc_id, key, other, source, size) with source_size, target and ``copies``.

    key is a hash of the text and other one of whatever else tells rows apart. Rows equal in all columns are counted, which
    needs no window over a key, and numbered by ``ord``.
    """
    work = Workspace(spark, "mix")
    names = ["doc_id", "key", "other", "source", "size"]
    sized = sized.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    sized = work.table(sized.select(*names, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("ord")), "sized")
    per = work.table(targets(sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size")), work, weights, cap), "targets")
    n_sources, most = per.agg(F.count(F.lit(1)), F.max("n_docs")).first()
    side = F.broadcast(per) if n_sources <= BROADCAST_SOURCES else per
    rows = sized.alias("d").join(side.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.*", "s.n_docs", "s.source_size", "s.target")
    wish = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    base = F.floor(wish + F.lit(1e-9))
    h = F.xxhash64("doc_id", "key", "ord", F.lit(17))
    rows = rows.withColumn("base", base.cast("bigint")).withColumn("p", F.greatest(F.lit(0.0), wish - base)).withColumn("h", h)
    rows = rows.withColumn("buckets", F.ceil(F.col("n_docs") / F.lit(bucket))).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "key", "other", "ord"), F.col("buckets"))).withColumn("depth", F.lit(0))
    rows = rows.selectExpr(*[f"cast({c.split()[0]} as {c.split()[1]}) as {c.split()[0]}" for c in _ROW.split(", ")])
    done, level, n = None, rows, ceil((most or 0) / bucket)
    for depth in range(64):
        level = work.table(level.groupBy("source", "bucket").applyInPandas(_round(bucket), _ROW), f"level-{depth}")
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        closed = level.filter(~open_)
        done = closed if done is None else done.unionByName(closed)
        if n <= 1:
            break
        level, n = level.filter(open_), ceil(n / bucket)
    for name in ("sized", "sizes", "ranges", "weighted", "targets"):
        work.drop(name)
    return done.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "key", "other", "source", "size", "source_size", "target", (F.col("base") + F.col("p")).cast("bigint").alias("copies"))


def report(spark: SparkSession, docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3, bucket: int = BUCKET) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (size times copies), source, copies."""
    sized = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_hash(), F.lit(0).cast("bigint").alias("other"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    out = mix(spark, sized, weights, cap, bucket)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def text_hash(name: str = "key"):
    return F.xxhash64("text", F.col("text").isNull()).alias(name)


KEY, OTHER, COPIES, TIMES = "__mix_key", "__mix_other", "__mix_copies", "__mix_times"


def apply(spark: SparkSession, docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with its columns unchanged.

    A row goes by two 64-bit hashes, of its text and of all its columns. Equal rows are rounded one by one; as they are equal,
    their copies are added up and given out from one of them. Only the last join moves texts.
    """
    work = Workspace(spark, "taken")
    cells = [x for c in docs.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    keyed = docs.withColumn(KEY, text_hash()).withColumn(OTHER, F.xxhash64(*cells))
    sized = keyed.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(KEY).alias("key"), F.col(OTHER).alias("other"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    taken = mix(spark, sized, weights, cap).groupBy(F.col("key").alias("k"), F.col("other").alias("o")).agg(F.sum("copies").alias(COPIES), F.count(F.lit(1)).alias(TIMES))
    taken = work.table(taken.filter(F.col(COPIES) > 0), "copies")
    joined = keyed.join(taken, (F.col(KEY) == F.col("k")) & (F.col(OTHER) == F.col("o"))).drop("k", "o")
    once = joined.filter(F.col(TIMES) == 1).unionByName(joined.filter(F.col(TIMES) > 1).dropDuplicates([KEY, OTHER]))
    return once.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(COPIES)))).select(*[F.col(f"`{c}`") for c in docs.columns])
