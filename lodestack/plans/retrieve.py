"""Hybrid retrieval as one lazy plan: BM25 and cosine candidates, fusion, filter, rerank, cap, expansion."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import check_range
from ..operators import fusion, graph, index, lexical, rerank, select, vector

RESULT = ["id", "rank", "file_path", "language", "content", "chunk_type", "start_line", "end_line", "score", "source", "vector_score", "keyword_score", "relevance_score"]


@dataclass
class Query:
    text: str
    max_results: int = 5
    language: str = ""
    expand: bool = True


def keyword_candidates(posts: DataFrame, docs: DataFrame, toks: list[str], limit: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Best ``limit`` chunks by BM25; the term filter reaches the postings scan."""
    spark = posts.sparkSession
    terms = spark.createDataFrame([(0, t, toks.count(t)) for t in dict.fromkeys(toks)], "query_id int, term string, qtf bigint")
    hit = posts.filter(F.col("term").isin(toks) if toks else F.lit(False))
    scored = lexical.bm25_batch(F.broadcast(terms), hit, docs, index.corpus_stats(docs), k1, b)
    return lexical.topk(scored.select("id", "score"), limit)


def retrieve(chunks: DataFrame, posts: DataFrame, docs: DataFrame, edges: DataFrame | None, query: Query, query_vector: list[float] | None, strategy: str = "rrf", alpha: float = 0.7, max_per_file: int = 3, manifest: DataFrame | None = None, as_of: float | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Ranked results of a query. Without a query vector only keywords count.

    The list is in order of relevance; an order for diversity would be lost to it, so it is left to callers (``rerank.with_mmr``).
    """
    check_range(query.max_results, 1, 10_000, "max_results")
    k = query.max_results
    limit = select.candidate_limit(k, query.language)
    key = lexical.topk(keyword_candidates(posts, docs, lexical.local_query_tokens(query.text), limit, k1, b), limit)
    if query_vector is None:
        vec = key.filter(F.lit(False))
    else:
        vec = vector.cosine_topk(chunks.filter(F.col("embedding").isNotNull()), query_vector, limit)
    fused = fusion.combine(vec, key, strategy, alpha)
    rows = chunks.join(F.broadcast(fused), "id")  # at most two candidate lists
    top = select.finalize(select.language_filter(rows, query.language), k)
    if manifest is not None:
        top = top.join(manifest.select(F.col("path").alias("file_path"), "mtime"), "file_path", "left")
    best = rerank.heuristic(top, query.text, time.time() if as_of is None else as_of, "mtime" if manifest is not None else None)
    capped = fusion.ranked(select.per_file_cap(best, max_per_file).drop("score").withColumn("score", F.col("relevance_score")))
    capped = capped.join(top.select("id", F.col("score").alias("fused")), "id").withColumn("score", F.col("fused"))
    cols = ["id", "rank", "score", "source", "vector_score", "keyword_score", "relevance_score"]
    kept = capped.select(*cols)
    if edges is not None and query.expand:
        more = graph.expand(kept.select("id", "rank"), edges, chunks.select("id")).filter(F.col("source").isNotNull())
        none = F.lit(0.0).cast("float")
        kept = kept.unionByName(more.select("id", "rank", "score", "source", none.alias("vector_score"), none.alias("keyword_score"), F.col("score").alias("relevance_score")))
    return chunks.drop("embedding").join(F.broadcast(kept), "id").select(*RESULT).orderBy("rank")
