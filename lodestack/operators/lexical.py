"""BM25 over the inverted index, for one query or a table of queries."""

from __future__ import annotations

import functools
import operator
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring, text


def query_terms(queries: DataFrame, id_col: str = "query_id", text_col: str = "text") -> DataFrame:
    """(query_id, term, qtf) of a table of queries; repeated terms count."""
    toks = queries.select(F.col(id_col).alias("query_id"), F.explode(text.query_tokens(F.col(text_col))).alias("term"))
    return toks.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def bm25_batch(terms: DataFrame, posts: DataFrame, stats: DataFrame, corpus: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, id, score) of every document that shares a term with a query.

    Postings are first reduced to the queries' terms, so document frequencies and joins see matching rows only. Where postings
    have their document's length (``dl``), ``stats`` isn't read.
    """
    hit = posts.join(terms.select("term").distinct(), "term", "left_semi")
    freq = hit.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))  # reads tf, so both reads of the postings are one exchange
    rows = hit.join(freq, "term").join(terms, "term")
    rows = (rows if "dl" in posts.columns else rows.join(stats.select("id", "dl"), "id")).crossJoin(F.broadcast(corpus.select("n", "avgdl")))
    part = scoring.idf(F.col("n"), F.col("df")) * scoring.tf_part(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b) * F.col("qtf")
    return rows.groupBy("query_id", "id").agg(F.sum(part).alias("score"))


def bm25_docs(terms: DataFrame, posts: DataFrame, stats: DataFrame, corpus: DataFrame, ids: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, id, score) of the given documents for every query; 0 where they share no term. Frequencies are the corpus's."""
    freq = posts.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    wanted = ids.select("id").distinct()
    hit = posts.join(wanted, "id", "left_semi").join(freq, "term").join(terms, "term").join(stats.select("id", "dl"), "id").crossJoin(F.broadcast(corpus.select("n", "avgdl")))
    part = scoring.idf(F.col("n"), F.col("df")) * scoring.tf_part(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b) * F.col("qtf")
    found = hit.groupBy("query_id", "id").agg(F.sum(part).alias("score"))
    every = wanted.crossJoin(F.broadcast(terms.select("query_id").distinct()))  # one row a query and given document is what is asked for
    return every.join(found, ["query_id", "id"], "left").select("query_id", "id", F.coalesce("score", F.lit(0.0)).alias("score"))


def bm25_scan(docs: DataFrame, query: str, k1: float = 1.2, b: float = 0.75, id_col: str = "id", text_col: str = "content", toks: list[str] | None = None) -> DataFrame:
    """(id, score) straight from texts: term counts stay in the row, and one small aggregate gives the statistics.

    No row is shuffled; the plan is two scans, a map-side aggregate and a broadcast of one row. The second scan splits only texts
    that hold a term somewhere.
    """
    counts = Counter(local_query_tokens(query) if toks is None else toks)
    terms = list(counts)

    def counted(rows: DataFrame) -> DataFrame:
        t = rows.select(F.col(id_col).alias("id"), text.once(text.tokens(F.col(text_col))).alias("t"))
        return t.select("id", F.size("t").cast("bigint").alias("dl"), *[(F.size("t") - F.size(F.array_remove("t", w))).alias(f"tf{i}") for i, w in enumerate(terms)])

    base = counted(docs)
    have = [F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(terms))]
    stats = base.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *have)
    if not terms:
        return base.filter(F.lit(False)).select("id", F.lit(0.0).alias("score"))
    lower = F.lower(F.trim(F.col(text_col)))
    held = functools.reduce(operator.or_, [F.contains(lower, F.lit(w)) for w in terms])
    hit = counted(docs.filter(held)).filter(F.greatest(F.lit(0), *[F.col(f"tf{i}") for i in range(len(terms))]) > 0).crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for i, w in enumerate(terms):
        part = scoring.idf(F.col("n"), F.col(f"df{i}")) * scoring.tf_part(F.col(f"tf{i}"), F.col("dl"), F.col("avgdl"), k1, b) * F.lit(counts[w])
        score = score + F.when((F.col(f"tf{i}") > 0) & (F.col(f"df{i}") > 0), part).otherwise(F.lit(0.0))
    return hit.select("id", score.alias("score"))


def local_query_tokens(query: str) -> list[str]:
    """Filtered tokens of one query, on the driver (same rules as the columns)."""
    import unicodedata

    out, word = [], []
    for c in query.lower() + " ":
        if c.isspace() and c not in "\x1c\x1d\x1e\x1f" or unicodedata.category(c).startswith("P"):
            if word:
                out.append("".join(word))
                word = []
        else:
            word.append(c)
    return [t for t in out if t not in text.STOP_WORDS and len(t.encode()) > 1]


def topk(scored: DataFrame, k: int, score_col: str = "score", by: str | None = None) -> DataFrame:
    """The k best rows by score, ids breaking ties; per ``by`` where given."""
    order = [F.col(score_col).desc(), F.col("id").asc()]
    if by is None:
        return scored.orderBy(*order).limit(k)
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return scored.withColumn("_r", rank).filter(F.col("_r") <= k).drop("_r")


def explain(posts: DataFrame, stats: DataFrame, corpus: DataFrame, toks: list[str], doc_id, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """One row (explanation) with the parts of one document's score, three decimals each."""
    spark = posts.sparkSession
    terms = spark.createDataFrame(list(enumerate(toks)), "pos int, term string")
    hit = posts.filter(F.col("term").isin(toks) if toks else F.lit(False))
    freq = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    one = stats.filter(F.col("id") == F.lit(doc_id)).select("dl")
    head = corpus.select("n", "avgdl").join(one, how="left").withColumn("dl", F.coalesce("dl", F.lit(0)))
    rows = terms.join(hit.filter(F.col("id") == F.lit(doc_id)).select("term", "tf"), "term", "left").join(freq, "term", "left").crossJoin(F.broadcast(head))
    i, t = scoring.idf(F.col("n"), F.col("df")), scoring.tf_part(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)
    found = F.format_string("  '%s':\n    TF: %d\n    DF: %d\n    IDF: %.3f\n    TF component: %.3f\n    Term score: %.3f\n", "term", "tf", "df", i, t, i * t)
    line = F.when(F.col("tf").isNull(), F.format_string("  '%s': not found in document\n", "term")).otherwise(found)
    parts = rows.select("pos", line.alias("line"), F.when(F.col("tf").isNotNull(), i * t).otherwise(F.lit(0.0)).alias("s"))
    body = parts.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "").alias("body"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("total"))
    text_ = F.format_string(
        "BM25 Score Breakdown:\n--------------------\nParameters:\n  k1 (term freq saturation): %.3f\n  b (length normalization): %.3f\n\nCollection Stats:\n  Total documents: %d\n"
        "  Avg document length: %.3f\n  This document length: %d\n\nTerm Scores:\n%s\nTotal BM25 Score: %.3f\n",
        F.lit(k1), F.lit(b), "n", "avgdl", "dl", "body", "total",
    )
    return head.crossJoin(body).select(text_.alias("explanation"))
