"""Fusion of ranked lists (id, score) into one.

Scores are float32. Ranks are by score, ids breaking ties. A missing side counts 0. Where one list is empty the other is
returned untouched (``combine``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring



def f32(c):
    return c.cast("float")


def _zero():
    return F.lit(0.0).cast("float")


def ranked(results: DataFrame) -> DataFrame:
    """With 1-based ``rank`` by score. The lists are top-k results, so one sort is bounded."""
    return results.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.asc("id"))))


def _joined(vector: DataFrame, keyword: DataFrame) -> DataFrame:
    """Both lists side by side, each evaluated once: raw (vs, ks), normalised (vn, kn), ranks (vr, kr) and sizes (nv, nk)."""

    def side(results: DataFrame, s: str, n: str, r_: str) -> DataFrame:
        ranked_ = ranked(results.select("id", f32(F.col("score")).alias("score")))
        return normalize(ranked_.withColumn("raw", F.col("score"))).select("id", F.col("raw").alias(s), F.col("score").alias(n), F.col("rank").alias(r_))

    both = side(vector, "vs", "vn", "vr").join(side(keyword, "ks", "kn", "kr"), "id", "full_outer")
    every = Window.partitionBy()
    return both.withColumn("nv", F.count("vr").over(every)).withColumn("nk", F.count("kr").over(every))


def _score(strategy: str, alpha: float, k: int):
    """(score, vector score, keyword score) of a fused row."""
    c = lambda name: F.coalesce(name, _zero())
    if strategy == "weighted":
        score = F.lit(alpha).cast("float") * c("vn") + F.lit(1 - alpha).cast("float") * c("kn")
        return score, c("vn"), c("kn")
    if strategy == "max":
        return F.greatest(c("vs"), c("ks")), c("vs"), c("ks")
    return scoring.rrf(F.col("vr"), k) + scoring.rrf(F.col("kr"), k), c("vs"), c("ks")


def normalize(results: DataFrame, col: str = "score") -> DataFrame:
    """Min-max to [0, 1] over the whole list; equal scores stay as they are."""
    every = Window.partitionBy()
    s = F.col(col)
    low, high = F.min(s).over(every), F.max(s).over(every)
    return results.withColumn(col, F.when(high == low, s).otherwise(F.try_divide(s - low, high - low)).cast("float"))


def fuse(vector: DataFrame, keyword: DataFrame, strategy: str = "rrf", alpha: float = 0.7, k: int = 60) -> DataFrame:
    """Fusion by strategy name: rrf (also for unknown names), weighted or max."""
    score, vs, ks = _score(strategy, alpha, k)
    return _joined(vector, keyword).select("id", f32(score).alias("score"), F.lit("hybrid").alias("source"), vs.alias("vector_score"), ks.alias("keyword_score"))


def rrf(vector: DataFrame, keyword: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: sum of 1 / (k + rank)."""
    return fuse(vector, keyword, "rrf", k=k)


def weighted(vector: DataFrame, keyword: DataFrame, alpha: float = 0.7) -> DataFrame:
    """alpha * normalised vector score + (1 - alpha) * normalised keyword score."""
    return fuse(vector, keyword, "weighted", alpha)


def maximum(vector: DataFrame, keyword: DataFrame) -> DataFrame:
    return fuse(vector, keyword, "max")


def combine(vector: DataFrame, keyword: DataFrame, strategy: str = "rrf", alpha: float = 0.7, k: int = 60) -> DataFrame:
    """Fusion where both lists have rows, else the one that has; one plan, no job to look first."""
    score, vs, ks = _score(strategy, alpha, k)
    only_v, only_k = F.col("nk") == 0, F.col("nv") == 0
    pick = lambda v, w, both: F.when(only_v, v).when(only_k, w).otherwise(both)
    return _joined(vector, keyword).select(
        "id",
        f32(pick(F.col("vs"), F.col("ks"), score)).alias("score"),
        pick(F.lit("vector"), F.lit("keyword"), F.lit("hybrid")).alias("source"),
        f32(pick(_zero(), _zero(), vs)).alias("vector_score"),
        f32(pick(_zero(), F.col("ks"), ks)).alias("keyword_score"),
    )


def dedup_first(results: DataFrame, order_col: str = "rank") -> DataFrame:
    """The first row of each id."""
    w = Window.partitionBy("id").orderBy(order_col)
    return results.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def truncate(results: DataFrame, k: int) -> DataFrame:
    """The first k rows by rank; k of 0 or less keeps all."""
    return results.orderBy("rank").limit(k) if k > 0 else results
