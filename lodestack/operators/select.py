"""Filters and cuts on results: language, top-k, per-file cap, prompt budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUDGET_SHARE = 0.8


def language_filter(results: DataFrame, language: str) -> DataFrame:
    """Applied after fusion, so it never widens the candidates."""
    wanted = (language or "").strip().lower()
    return results.filter(F.lower(F.col("language")) == wanted) if wanted else results


def candidate_limit(k: int, language: str = "") -> int:
    """Rows each branch fetches for k results: 4k, or 10k with a language filter."""
    return k * (10 if (language or "").strip() else 4)


def finalize(results: DataFrame, k: int) -> DataFrame:
    """The k best by score with relevance set to the score; k of 0 or less means 10."""
    return results.withColumn("relevance_score", F.col("score").cast("float")).orderBy(F.desc("score"), F.asc("id")).limit(k if k > 0 else 10)


def per_file_cap(results: DataFrame, n: int = 3, path_col: str = "file_path") -> DataFrame:
    """The n most relevant rows of each file (n of 0 or less means 3)."""
    w = Window.partitionBy(path_col).orderBy(F.desc("relevance_score"), F.asc("id"))
    return results.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= (n if n > 0 else 3)).drop("_n")


def budget_bytes(max_tokens: int, chars_per_token: int = 4) -> int:
    return int(float(max_tokens * chars_per_token) * BUDGET_SHARE)


def prompt_fit(results: DataFrame, max_tokens: int, chars_per_token: int = 4, partition: str | None = None) -> DataFrame:
    """Rows by relevance while their bytes fit the budget; the first row always stays. Adds ``prompt_rank``.

    Results of one query are few; for a table of queries ``partition`` names the query column.
    """
    base = Window.partitionBy(partition) if partition else Window.partitionBy(F.lit(1))
    order = base.orderBy(F.desc("relevance_score"), F.asc("id"))
    out = results.withColumn("prompt_rank", F.row_number().over(order))
    if max_tokens <= 0:
        return out
    used = F.sum(F.octet_length("content")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = out.withColumn("_used", used)
    return out.filter((F.col("_used") <= budget_bytes(max_tokens, chars_per_token)) | (F.col("prompt_rank") == 1)).drop("_used")
