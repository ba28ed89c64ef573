"""Every engine operator as a query over the driver tables, with the SQL that gives the same rows.

``documents`` stand for chunks: doc_id is the id, source the file path, lang the language, text the content; the chunk type
follows from the id, and the metadata (name, calls, types, receiver, imports) from the first tokens of the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import language as lang
from .functions import scoring, text
from .operators import fusion, graph, index, lexical, rerank, select, vector
from .plans import prompt
from .schema import CHUNK_TYPES
from .session import spread
from .sources import chunker, parsers
from .streaming import changes

QUERY = "Anat worthless thtion the and elle"
TERMS = ["anat", "worthless", "thtion", "elle"]
K = 10
DEPTH, LANGUAGE_DEPTH = select.candidate_limit(K), select.candidate_limit(K, "en")  # rows a list gives to a fusion
AS_OF = "2024-06-01 00:00:00"
EXTENSIONS = [".go", ".PY", ".rs", ".tsx", ".md", ".yaml", ".cc", ".unknown", "", ".env", ".hs", ".vue"]

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in CHUNK_TYPES])
    d = spread(table(spark, sf_dir, "documents"), "doc_id")
    return d.select(F.col("doc_id").alias("id"), F.col("source").alias("file_path"), F.col("lang").alias("language"), F.col("text").alias("content"), F.element_at(kinds, (F.col("doc_id") % 6 + 1).cast("int")).alias("chunk_type"))


def r(c, digits: int = 5):
    return F.round(c.cast("double"), digits)


# SQL building blocks -----------------------------------------------------------------------------------------------------
_TOK = r"list_filter(string_split_regex(lower({0}), '[\p{{P}}\p{{Z}}\s\x{{0B}}\x{{85}}]+'), lambda x: x <> '')".format
_KIND = "['function', 'class', 'method', 'import', 'comment', 'other'][(doc_id % 6 + 1)::INT]"
_STOPS = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in text.STOP_WORDS) + "]"
_TERMS = "(" + ", ".join(f"'{t}'" for t in TERMS) + ")"
_T = f"t AS MATERIALIZED (SELECT doc_id AS id, {_TOK('text')} AS toks FROM documents)"
_P = "p AS MATERIALIZED (SELECT term, id, count(*) AS tf FROM (SELECT id, unnest(toks) AS term FROM t) GROUP BY ALL)"
_BM = f"""{_T}, {_P},
st AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM t),
df AS (SELECT term, count(*) AS df FROM p WHERE term IN {_TERMS} GROUP BY term),
bm AS MATERIALIZED (SELECT p.id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(toks) / avgdl))) AS score
  FROM p JOIN df USING (term) JOIN t ON t.id = p.id, st GROUP BY p.id),
kw AS MATERIALIZED (SELECT id, score::FLOAT AS score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM bm ORDER BY score DESC, id LIMIT {DEPTH})"""
_VEC = f"""vs AS (SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS score FROM embeddings),
vc AS MATERIALIZED (SELECT id, score::FLOAT AS score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM vs ORDER BY score DESC, id LIMIT {DEPTH})"""
_RRF = f"""{_BM}, {_VEC},
fu AS MATERIALIZED (SELECT coalesce(v.id, k.id) AS id, (coalesce((1.0::DOUBLE / (60 + v.rank))::FLOAT, 0) + coalesce((1.0::DOUBLE / (60 + k.rank))::FLOAT, 0))::FLOAT AS score,
  coalesce(v.score, 0)::FLOAT AS vscore, coalesce(k.score, 0)::FLOAT AS kscore FROM vc v FULL OUTER JOIN kw k ON v.id = k.id)"""
_DEEP = lambda sql: sql.replace(f"LIMIT {DEPTH})", f"LIMIT {LANGUAGE_DEPTH})")  # noqa: E731  lists as a query with a language filter takes them
_CH = f"ch AS (SELECT doc_id AS id, source AS file_path, lang AS language, text AS content, {_KIND} AS chunk_type FROM documents)"
_NORM = lambda name, src: f"{name} AS (SELECT id, (CASE WHEN max(score) OVER () = min(score) OVER () THEN score ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END)::FLOAT AS score FROM {src})"


# lists that the ranking queries share ------------------------------------------------------------------------------------
def keyword_list(spark, sf_dir, limit: int = DEPTH) -> DataFrame:
    """At most ``limit`` rows, held by the driver: plans read the list more than once, which would score all texts each time."""
    best = lexical.topk(lexical.bm25_scan(chunks(spark, sf_dir), QUERY), limit)
    return spark.createDataFrame(best.collect(), best.schema)


def vector_list(spark, sf_dir, limit: int = DEPTH) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    q = e.filter("id = 0").select("embedding").first()
    return vector.cosine_topk(e, list(q.embedding), limit)


# tokens and index ----------------------------------------------------------------------------------------------------------
@query(f"WITH {_T}, {_P} SELECT term, id, tf FROM p")
def tokenize_tf(spark, sf_dir):
    return index.postings(chunks(spark, sf_dir))


@query(f"WITH {_T} SELECT id, len(toks)::BIGINT AS n_tokens, len(list_filter(toks, lambda x: NOT list_contains({_STOPS}, x) AND strlen(x) > 1))::BIGINT AS n_filtered FROM t")
def token_filter_stopwords(spark, sf_dir):
    t = index.tokenized(chunks(spark, sf_dir))
    return t.select("id", F.col("dl").alias("n_tokens"), F.size(text.without_stop_words(F.col("tokens"))).cast("bigint").alias("n_filtered"))


@query(
    r"SELECT doc_id AS id, md5(array_to_string(list_filter(flatten(list_transform(list_filter(string_split_regex(text, '[\p{P}\p{Z}\s\x{0B}\x{85}]+'), lambda x: x <> ''), "
    r"lambda w: string_split(lower(regexp_replace(w, '([a-z0-9])([A-Z])', '\1 \2', 'g')), ' '))), lambda x: x <> ''), ' ')) AS camel FROM documents"
)
def camel_split(spark, sf_dir):
    return chunks(spark, sf_dir).select("id", F.md5(F.array_join(text.camel_tokens(F.col("content")), " ")).alias("camel"))


@query(f"WITH {_T} SELECT id, len(toks)::BIGINT AS dl FROM t")
def doc_stats(spark, sf_dir):
    return index.doc_stats(chunks(spark, sf_dir)).select("id", "dl")


@query("SELECT doc_id AS id, substr(hex(encode(text)), 1, 400) AS bytes FROM documents")
def preview(spark, sf_dir):
    return chunks(spark, sf_dir).select("id", F.hex(F.substring(F.encode("content", "UTF-8"), 1, text.PREVIEW_BYTES)).alias("bytes"))


@query(f"WITH {_T}, {_P} SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term")
def term_df(spark, sf_dir):
    return index.document_frequencies(chunks(spark, sf_dir))


@query(f"WITH {_T} SELECT count(*)::BIGINT AS n, sum(len(toks))::BIGINT AS total, round(avg(len(toks)), 6) AS avgdl FROM t")
def corpus_stats(spark, sf_dir):
    return index.corpus_stats(index.tokenized(chunks(spark, sf_dir))).select("n", "total", r(F.col("avgdl"), 6).alias("avgdl"))


@query(f"WITH {_T} SELECT count(*)::BIGINT AS n, sum(len(toks))::BIGINT AS total, round(avg(len(toks)), 6) AS avgdl FROM t")
def corpus_stats_merged(spark, sf_dir):
    t = index.tokenized(chunks(spark, sf_dir))
    parts = [index.corpus_stats(t.filter(F.col("id") % 3 == k)) for k in range(3)]
    out = index.merge_corpus_stats(index.merge_corpus_stats(parts[0], parts[1]), parts[2])
    return out.select("n", "total", r(F.col("avgdl"), 6).alias("avgdl"))


@query(f"WITH {_T}, {_P} SELECT DISTINCT id FROM p WHERE term IN {_TERMS}")
def posting_union(spark, sf_dir):
    return index.matching_ids(index.postings(chunks(spark, sf_dir), terms=TERMS), TERMS)


@query(f"WITH {_T}, {_P} SELECT q.term, d.doc_id AS id, coalesce(p.tf, 0)::BIGINT AS tf FROM (SELECT unnest(['anat', 'elle', 'missing']) AS term) q, documents d LEFT JOIN p ON p.term = q.term AND p.id = d.doc_id")
def term_lookup(spark, sf_dir):
    c = chunks(spark, sf_dir)
    pairs = c.select("id", F.explode(F.array(*[F.lit(x) for x in ("anat", "elle", "missing")])).alias("term"))
    return index.lookup_tf(index.postings(c, terms=["anat", "elle"]), pairs)


@query(f"WITH {_T}, {_P} SELECT term, count(*)::BIGINT AS df FROM p WHERE id % 5 <> 0 GROUP BY term")
def remove_documents(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return index.document_frequencies(index.remove(c, c.filter("id % 5 = 0").select("id")))


@query(f"WITH {_T} SELECT 'docs' AS \"table\", to_json({{'id': id, 'dl': len(toks)}})::VARCHAR AS value FROM t")
def export_json(spark, sf_dir):
    return index.export_json(index.doc_stats(chunks(spark, sf_dir)).select("id", "dl"), "docs")


# BM25 and vectors ----------------------------------------------------------------------------------------------------------
@query(f"WITH {_BM} SELECT id, round(score, 5) AS score FROM bm ORDER BY bm.score DESC, id LIMIT 20")
def bm25_topk(spark, sf_dir):
    return lexical.topk(lexical.bm25_scan(chunks(spark, sf_dir), QUERY), 20).select("id", r(F.col("score")).alias("score"))


@query(f"WITH {_BM} SELECT id, round(score, 5) AS score FROM bm")
def bm25_indexed(spark, sf_dir):
    c = chunks(spark, sf_dir)
    terms = lexical.query_terms(spark.createDataFrame([(0, QUERY)], "query_id int, text string"))
    stats = index.tokenized(c).select("id", "dl")
    out = lexical.bm25_batch(terms, index.postings(c, terms=TERMS), stats, index.corpus_stats(stats))
    return out.select("id", r(F.col("score")).alias("score"))


@query(f"WITH {_BM} SELECT 0 AS query_id, d.doc_id AS id, round(coalesce(bm.score, 0), 5) AS score FROM documents d LEFT JOIN bm ON bm.id = d.doc_id WHERE d.doc_id IN (SELECT doc_id FROM labels)")
def bm25_given_docs(spark, sf_dir):
    """Scores of a list of documents: those of the labels."""
    c = chunks(spark, sf_dir)
    terms = lexical.query_terms(spark.createDataFrame([(0, QUERY)], "query_id int, text string"))
    stats = index.tokenized(c).select("id", "dl")
    given = c.select("id").join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")), "id", "left_semi")
    out = lexical.bm25_docs(terms, index.postings(c, terms=TERMS), stats, index.corpus_stats(stats), given)
    return out.select("query_id", "id", r(F.col("score")).alias("score"))


@query(
    f"""WITH {_T}, {_P},
qt AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(list_filter({_TOK('text')}, lambda x: NOT list_contains({_STOPS}, x) AND strlen(x) > 1)) AS term FROM benchmark) GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM t), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT item_id, p.id, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(toks) / avgdl))) AS score
      FROM qt JOIN p USING (term) JOIN df USING (term) JOIN t ON t.id = p.id, st GROUP BY ALL)
SELECT item_id AS query_id, id, round(score, 4) AS score FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(score, 4) DESC, id) <= 3"""
)
def bm25_batch(spark, sf_dir):
    c = chunks(spark, sf_dir)
    terms = lexical.query_terms(table(spark, sf_dir, "benchmark"), "item_id")
    stats = index.tokenized(c).select("id", "dl")
    scored = lexical.bm25_batch(terms, index.postings(c, lengths=True), stats, index.corpus_stats(stats)).withColumn("score", r(F.col("score"), 4))
    return lexical.topk(scored, 3, by="query_id")


@query(
    f"""WITH {_T}, {_P}, st AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM t),
q AS (SELECT unnest(['anat', 'thtion', 'the', 'missing']) AS term, unnest([0, 1, 2, 3]) AS pos),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term), one AS (SELECT len(toks) AS dl FROM t WHERE id = 2),
x AS (SELECT pos, q.term, tf, df, ln((n - df + 0.5) / (df + 0.5) + 1) AS i, tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS c
      FROM q LEFT JOIN (SELECT * FROM p WHERE id = 2) p USING (term) LEFT JOIN df USING (term), st, one)
SELECT 'BM25 Score Breakdown:' || chr(10) || '--------------------' || chr(10) || 'Parameters:' || chr(10) || '  k1 (term freq saturation): 1.200' || chr(10) || '  b (length normalization): 0.750' || chr(10) || chr(10)
  || 'Collection Stats:' || chr(10) || printf('  Total documents: %d', any_value(n)) || chr(10) || printf('  Avg document length: %.3f', any_value(avgdl)) || chr(10) || printf('  This document length: %d', any_value(dl)) || chr(10) || chr(10)
  || 'Term Scores:' || chr(10) || string_agg(CASE WHEN tf IS NULL THEN '  ''' || term || ''': not found in document' || chr(10) ELSE '  ''' || term || ''':' || chr(10) || printf('    TF: %d', tf) || chr(10)
  || printf('    DF: %d', df) || chr(10) || printf('    IDF: %.3f', i) || chr(10) || printf('    TF component: %.3f', c) || chr(10) || printf('    Term score: %.3f', i * c) || chr(10) END, '' ORDER BY pos)
  || chr(10) || printf('Total BM25 Score: %.3f', coalesce(sum(i * c), 0)) || chr(10) AS explanation FROM x, st, one"""
)
def bm25_explain(spark, sf_dir):
    c = chunks(spark, sf_dir)
    stats = index.tokenized(c).select("id", "dl")
    toks = ["anat", "thtion", "the", "missing"]
    return lexical.explain(index.postings(c, terms=toks), stats, index.corpus_stats(stats), toks, 2)


@query(f"WITH {_VEC} SELECT id, round(vs.score, 5) AS score FROM vs ORDER BY vs.score DESC, id LIMIT 20")
def cosine_topk(spark, sf_dir):
    return vector_list(spark, sf_dir, 20).select("id", r(F.col("score")).alias("score"))


@query(f"WITH {_VEC} SELECT id, round(score, 5) AS score FROM vs")
def cosine_scores(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    q = list(e.filter("id = 0").first().embedding)
    return vector.cosine_scores(e, q).select("id", r(F.col("score")).alias("score"))


# fusion --------------------------------------------------------------------------------------------------------------------
_FUSED = "id, round(score::DOUBLE, 5) AS score, round(vscore::DOUBLE, 4) AS vector_score, round(kscore::DOUBLE, 4) AS keyword_score, 'hybrid' AS source"


def _shown(df: DataFrame, digits: int = 5) -> DataFrame:
    return df.select("id", r(F.col("score"), digits).alias("score"), r(F.col("vector_score"), 4).alias("vector_score"), r(F.col("keyword_score"), 4).alias("keyword_score"), "source")


@query(f"WITH {_RRF} SELECT {_FUSED} FROM fu")
def rrf_fusion(spark, sf_dir):
    return _shown(fusion.rrf(vector_list(spark, sf_dir), keyword_list(spark, sf_dir)))


@query(
    f"WITH {_BM}, {_VEC}, {_NORM('nv', 'vc')}, {_NORM('nk', 'kw')}, fu AS (SELECT coalesce(v.id, k.id) AS id, 0.7::FLOAT * coalesce(v.score, 0)::FLOAT + 0.3::FLOAT * coalesce(k.score, 0)::FLOAT AS score, "
    f"coalesce(v.score, 0) AS vscore, coalesce(k.score, 0) AS kscore FROM nv v FULL OUTER JOIN nk k ON v.id = k.id) SELECT {_FUSED.replace('DOUBLE, 5', 'DOUBLE, 4')} FROM fu"
)
def weighted_fusion(spark, sf_dir):
    return _shown(fusion.weighted(vector_list(spark, sf_dir), keyword_list(spark, sf_dir), 0.7), 4)


@query(f"WITH {_RRF}, mx AS (SELECT id, greatest(vscore, kscore) AS score, vscore, kscore FROM fu) SELECT {_FUSED.replace('DOUBLE, 5', 'DOUBLE, 4')} FROM mx")
def max_fusion(spark, sf_dir):
    return _shown(fusion.maximum(vector_list(spark, sf_dir), keyword_list(spark, sf_dir)), 4)


@query(f"WITH {_BM}, {_NORM('nk', 'kw')} SELECT id, round(score::DOUBLE, 4) AS score FROM nk")
def minmax_normalize(spark, sf_dir):
    k = keyword_list(spark, sf_dir).withColumn("score", F.col("score").cast("float"))
    return fusion.normalize(k).select("id", r(F.col("score"), 4).alias("score"))


@query(f"WITH {_BM} SELECT id, round(score::DOUBLE, 4) AS score, 0.0::DOUBLE AS vector_score, round(score::DOUBLE, 4) AS keyword_score, 'keyword' AS source FROM kw")
def fallback_fusion(spark, sf_dir):
    k = keyword_list(spark, sf_dir)
    return _shown(fusion.combine(k.filter("id < 0"), k), 4)


@query(f"WITH {_BM}, u AS (SELECT id, rank FROM kw UNION ALL SELECT id, rank + 5 FROM kw) SELECT id, min(rank)::INT AS rank FROM u GROUP BY id ORDER BY rank LIMIT 15")
def dedup_truncate(spark, sf_dir):
    k = fusion.ranked(keyword_list(spark, sf_dir)).select("id", "rank")
    twice = k.unionByName(k.withColumn("rank", F.col("rank") + 5))
    return fusion.truncate(fusion.dedup_first(twice), 15)


# selection and reranking ---------------------------------------------------------------------------------------------------
def fused_chunks(spark, sf_dir, language: str = "") -> DataFrame:
    limit = select.candidate_limit(K, language)
    fused = fusion.combine(vector_list(spark, sf_dir, limit), keyword_list(spark, sf_dir, limit))
    return chunks(spark, sf_dir).join(F.broadcast(fused), "id")  # two lists of at most 10 K rows


@query(f"WITH {_DEEP(_RRF)}, {_CH} SELECT id, language, round(score::DOUBLE, 5) AS score FROM fu JOIN ch USING (id) WHERE lower(language) = 'en'")
def language_postfilter(spark, sf_dir):
    return select.language_filter(fused_chunks(spark, sf_dir, "en"), " EN ").select("id", "language", r(F.col("score")).alias("score"))


@query(f"WITH {_RRF}, {_CH} SELECT id, round(fu.score::DOUBLE, 5) AS relevance_score FROM fu JOIN ch USING (id) ORDER BY fu.score DESC, id LIMIT {K}")
def topk_results(spark, sf_dir):
    return select.finalize(fused_chunks(spark, sf_dir), K).select("id", r(F.col("relevance_score")).alias("relevance_score"))


_TOKENS = QUERY.lower().split()
_HEUR = (
    "(score::FLOAT * (CASE chunk_type WHEN 'function' THEN 1.2 WHEN 'class' THEN 1.1 WHEN 'method' THEN 1.15 WHEN 'import' THEN 0.8 WHEN 'comment' THEN 0.5 ELSE 1.0 END)::FLOAT"
    f" * (CASE WHEN contains(lower(content), '{QUERY.lower()}') THEN 1.5 ELSE 1 END)::FLOAT * (1::FLOAT + 0.3::FLOAT * (("
    + " + ".join(f"contains(lower(content), '{t}')::INT" for t in _TOKENS if len(t) >= 3)
    + f")::FLOAT / {len(_TOKENS)}::FLOAT)::FLOAT) * (CASE WHEN "
    + " OR ".join(f"contains(lower(file_path), '{t}')" for t in _TOKENS if len(t) >= 3)
    + " THEN 1.1 ELSE 1 END)::FLOAT * (CASE WHEN "
    + " OR ".join(f"contains(lower(file_path), '{p}')" for p in scoring.PRIORITY_PATHS)
    + " THEN 1.15 ELSE 1 END)::FLOAT)::DOUBLE"
)
_TOP = f"{_RRF}, {_CH}, top AS MATERIALIZED (SELECT ch.*, fu.score::DOUBLE AS score FROM fu JOIN ch USING (id)), re AS MATERIALIZED (SELECT *, {_HEUR} AS relevance FROM top)"


@query(f"WITH {_TOP} SELECT id, round(relevance, 5) AS relevance_score FROM re")
def heuristic_rerank(spark, sf_dir):
    return rerank.heuristic(fused_chunks(spark, sf_dir), QUERY).select("id", r(F.col("relevance_score")).alias("relevance_score"))


@query(f"SELECT event_id, round((1 + 0.3::DOUBLE * exp(-greatest(0, epoch(TIMESTAMP '{AS_OF}') - epoch(ts)) / 2592000.0))::FLOAT::DOUBLE, 5) AS bonus FROM events")
def recency_bonus(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / F.lit(1e6)
    return e.select("event_id", r(scoring.recency(seconds(F.col("ts")), seconds(F.lit(AS_OF)))).alias("bonus"))


@query(f"WITH {_TOP} SELECT id, file_path FROM re QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY round(relevance, 6) DESC, id) <= 2")
def per_file_cap(spark, sf_dir):
    best = rerank.heuristic(fused_chunks(spark, sf_dir), QUERY).withColumn("relevance_score", r(F.col("relevance_score"), 6))
    return select.per_file_cap(best, 2).select("id", "file_path")


_FIT = f"""{_TOP}, o AS (SELECT *, row_number() OVER (ORDER BY round(relevance, 6) DESC, id) AS rn,
  sum(strlen(content)) OVER (ORDER BY round(relevance, 6) DESC, id ROWS UNBOUNDED PRECEDING) AS used FROM re),
fit AS MATERIALIZED (SELECT * FROM o WHERE rn = 1 OR used <= 26214)"""


def ranked_chunks(spark, sf_dir) -> DataFrame:
    best = rerank.heuristic(fused_chunks(spark, sf_dir), QUERY)
    return best.withColumn("relevance_score", r(F.col("relevance_score"), 6))


@query(f"WITH {_FIT} SELECT id, rn::INT AS prompt_rank FROM fit")
def prompt_fit(spark, sf_dir):
    return select.prompt_fit(ranked_chunks(spark, sf_dir), 8192).select("id", "prompt_rank")


_HEAD = prompt.DEFAULT_TEMPLATE.split("{{range")[0].replace("'", "''").replace("\n", "' || chr(10) || '")
_TAIL = f"' || chr(10) || chr(10) || 'Question: {QUERY}' || chr(10) || 'Answer:"


@query(
    f"""WITH {_FIT}, f AS (SELECT string_agg(DISTINCT file_path, ', ' ORDER BY file_path) AS files, count(*) AS n FROM fit)
SELECT '<!-- RAG context: generated_at=2024-06-01T00:00:00Z | model=m | context_results=' || n || ' | total_results=' || (SELECT count(*) FROM re) || ' | max_tokens=8192 | source_files=' || files || ' -->' || chr(10)
 || '{_HEAD}' || (SELECT string_agg(chr(10) || '--- ' || file_path || ' (Lines 1-2) ---' || chr(10) || content || chr(10), '' ORDER BY rn) FROM fit) || '{_TAIL}' AS prompt, n::BIGINT AS context_results, files AS source_files FROM f"""
)
def prompt_render(spark, sf_dir):
    rows = ranked_chunks(spark, sf_dir).withColumn("start_line", F.lit(1)).withColumn("end_line", F.lit(2))
    return prompt.generate(rows, QUERY, prompt.DEFAULT_TEMPLATE, 8192, model="m", generated_at=F.lit(AS_OF).cast("timestamp"))


@query(
    f"""WITH RECURSIVE {_TOP}, mc AS MATERIALIZED (SELECT id, round(relevance, 6) AS rel, embedding::DOUBLE[] AS v, row_number() OVER (ORDER BY round(relevance, 6) DESC, id) AS n FROM re LEFT JOIN embeddings ON vec_id = id),
sim AS MATERIALIZED (SELECT a.n AS a, b.n AS b, coalesce(list_cosine_similarity(a.v, b.v), 0) AS s FROM mc a, mc b),
rec AS (SELECT 0 AS step, n, rel, 0::DOUBLE AS near, 0 AS rank FROM mc UNION ALL
 SELECT step + 1, o.n, rel, greatest(near, s), CASE WHEN o.n = best THEN step + 1 ELSE rank END
 FROM (SELECT *, first_value(n) OVER (ORDER BY rank > 0, 0.7::DOUBLE * rel - (1 - 0.7::DOUBLE) * near DESC, n) AS best FROM rec WHERE step < (SELECT count(*) FROM mc)) o JOIN sim ON sim.a = best AND sim.b = o.n)
SELECT id, rec.rel AS relevance_score, rank::INT AS mmr_rank FROM rec JOIN mc USING (n) WHERE step = (SELECT count(*) FROM mc)"""
)
def mmr_select(spark, sf_dir):
    rows = ranked_chunks(spark, sf_dir).select("id", "relevance_score").withColumn("query_id", F.lit(0))
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return rerank.mmr(rows.join(e, "id", "left")).select("id", "relevance_score", "mmr_rank")


@query(f"WITH {_DEEP(_TOP)} SELECT id, row_number() OVER (ORDER BY round(relevance, 6) DESC, id)::INT AS rank, round(relevance, 5) AS relevance_score, file_path FROM (SELECT * FROM re WHERE language = 'en' ORDER BY score DESC, id LIMIT {K}) ORDER BY rank")
def hybrid_search(spark, sf_dir):
    """The flagship: candidates of both kinds, fusion, language filter, top-k, rerank, rank."""
    top = select.finalize(select.language_filter(fused_chunks(spark, sf_dir, "en"), "en"), K)
    best = rerank.heuristic(top, QUERY)
    rank = F.row_number().over(Window.orderBy(F.round(F.col("relevance_score").cast("double"), 6).desc(), "id"))
    return best.select("id", rank.alias("rank"), r(F.col("relevance_score")).alias("relevance_score"), "file_path")


# graph ---------------------------------------------------------------------------------------------------------------------
def graph_chunks(spark, sf_dir) -> DataFrame:
    c = chunks(spark, sf_dir).withColumn("t", text.once(text.first_tokens(F.col("content"), 8)))
    pair = lambda i: F.concat_ws("_", F.get("t", F.lit(i)), F.get("t", F.lit(i + 1)))
    calls = F.array_join(F.array(*[pair(i) for i in range(1, 7)]), ",")
    meta = F.map_filter(
        F.create_map(
            F.lit("name"), pair(0), F.lit("calls"), calls,
            F.lit("types"), F.when(F.col("chunk_type") == "class", F.concat_ws(",", pair(0), pair(1))),
            F.lit("receiver"), F.when(F.col("chunk_type") == "method", pair(0)),
            F.lit("imports"), F.when(F.col("chunk_type") == "import", F.concat_ws(",", pair(0), pair(2))),
        ),
        lambda k, v: v.isNotNull(),
    )
    return c.select("id", "file_path", "chunk_type", meta.alias("metadata"))


_PAIR = lambda i: f"array_to_string(list_filter([toks[{i + 1}], toks[{i + 2}]], lambda x: x IS NOT NULL), '_')"
_G = f"""g AS MATERIALIZED (SELECT d.doc_id AS id, source AS file_path, {_KIND} AS type, {_PAIR(0)} AS name, [{', '.join(_PAIR(i) for i in range(1, 7))}] AS calls, {_PAIR(1)} AS p1, {_PAIR(2)} AS p2
  FROM documents d JOIN (SELECT doc_id AS i, {_TOK('text')} AS toks FROM documents) ON i = d.doc_id),
ce AS (SELECT src, b.id AS dst, 'call' AS relation, 1 AS kind, pos FROM (SELECT id AS src, trim(unnest(calls)) AS target, unnest(generate_series(0, 5)) AS pos FROM g) a JOIN g b ON b.name = a.target AND b.name <> '' WHERE target <> ''),
ie AS (SELECT src, b.id AS dst, 'import' AS relation, 0 AS kind, pos FROM (SELECT id AS src, trim(unnest([name, p2])) AS target, unnest([0, 1]) AS pos FROM g WHERE type = 'import') a JOIN g b ON b.name = a.target AND b.name <> '' WHERE target <> ''),
ow AS (SELECT id, name AS target FROM g WHERE type = 'class' AND name <> '' UNION SELECT id, trim(unnest([name, p1])) FROM g WHERE type = 'class'),
de AS (SELECT DISTINCT ow.id AS src, g.id AS dst, 'define' AS relation, 2 AS kind, 0 AS pos FROM ow JOIN g ON g.name = ow.target WHERE g.type = 'method' AND g.name <> '' AND ow.target <> ''),
e AS MATERIALIZED (SELECT src, dst, relation, row_number() OVER (PARTITION BY src ORDER BY kind, pos, dst) AS seq FROM (SELECT * FROM ce UNION ALL SELECT * FROM ie UNION ALL SELECT * FROM de))"""


def links(spark, sf_dir) -> graph.Links:
    """The graph over a table of its nodes, written once as the engine does, so that texts are read once; so are its sides."""
    def keep(d: DataFrame) -> DataFrame:
        path = scratch(spark, "graph")
        d.write.parquet(path)
        return spark.read.schema(d.schema).parquet(path)

    return graph.Links(keep(graph.nodes(graph_chunks(spark, sf_dir))), keep)


@query(f"WITH {_G} SELECT id, type, name, file_path FROM g")
def graph_nodes(spark, sf_dir):
    return graph.nodes(graph_chunks(spark, sf_dir)).drop("metadata")


@query(f"WITH {_G} SELECT id, name FROM g WHERE id = 5 OR name = (SELECT name FROM g WHERE id = 7)")
def graph_lookup(spark, sf_dir):
    """A node by its id and all nodes of a name."""
    ns = graph.nodes(graph_chunks(spark, sf_dir))
    name = graph.by_id(ns, 7).first().name
    return graph.by_id(ns, 5).unionByName(graph.by_name(ns, name)).select("id", "name").distinct()


for _rel in ("call", "import", "define"):

    def _edges(spark, sf_dir, rel=_rel):
        return links(spark, sf_dir).edges(rel).select("src", "dst", "seq")

    _edges.__name__ = f"{_rel}_edges"
    query(f"WITH {_G} SELECT src, dst, seq::INT AS seq FROM e WHERE relation = '{_rel}'")(_edges)


@query(f"WITH {_G} SELECT src, dst, name, file_path, seq::INT AS seq FROM e JOIN g ON g.id = dst WHERE relation = 'call'")
def neighbors_out(spark, sf_dir):
    return links(spark, sf_dir).related("call").select("src", "dst", "name", "file_path", "seq")


@query(f"WITH {_G} SELECT DISTINCT dst, src, name, file_path FROM e JOIN g ON g.id = src WHERE relation = 'call'")
def neighbors_in(spark, sf_dir):
    return links(spark, sf_dir).incoming("call").select("dst", "src", "name", "file_path")


@query(f"WITH {_G} SELECT src, dst, name, file_path, min(seq)::INT AS seq FROM e JOIN g ON g.id = dst GROUP BY ALL")
def neighbors_all(spark, sf_dir):
    return links(spark, sf_dir).related().select("src", "dst", "name", "file_path", "seq")


@query(f"WITH {_G} SELECT DISTINCT dst, file_path FROM e JOIN g ON g.id = src WHERE relation IN ('call', 'import')")
def parent_files(spark, sf_dir):
    return links(spark, sf_dir).parent_files()


@query(f"WITH {_G} SELECT (SELECT count(*) FROM g)::BIGINT AS nodes, (SELECT count(*) FROM e)::BIGINT AS edges")
def graph_stats(spark, sf_dir):
    return links(spark, sf_dir).stats()


_X = f"""{_BM}, {_G}, orig AS (SELECT id, rank FROM kw WHERE rank <= {K}),
nb AS (SELECT src AS o, dst AS id, 0 AS c, seq FROM e WHERE relation = 'call'
 UNION ALL SELECT o, id, c, row_number() OVER (PARTITION BY o, c ORDER BY s, id) FROM (SELECT dst AS o, src AS id, CASE relation WHEN 'call' THEN 1 ELSE 2 END AS c, min(seq) AS s FROM e WHERE relation IN ('call', 'define') GROUP BY ALL)
 UNION ALL SELECT src, dst, 3, seq FROM e WHERE relation = 'define' UNION ALL SELECT src, dst, 4, seq FROM e WHERE relation = 'import'),
cand AS (SELECT nb.id, rank, c, seq FROM nb JOIN orig ON o = orig.id WHERE nb.id NOT IN (SELECT id FROM orig) QUALIFY row_number() OVER (PARTITION BY nb.id ORDER BY rank, c, seq) = 1),
pl AS (SELECT id, c, row_number() OVER (ORDER BY rank, c, seq, id) AS n FROM cand)"""


@query(
    f"WITH {_X} SELECT id, rank::INT AS rank, NULL::DOUBLE AS score, NULL AS source FROM orig UNION ALL SELECT id, ({K} + n)::INT, [0.5, 0.4, 0.55, 0.55, 0.3][c + 1]::DOUBLE, "
    f"'expansion:' || ['callee', 'caller', 'parent_type', 'child_method', 'import'][c + 1] FROM pl WHERE {K} + n <= 50"
)
def expand_depth1(spark, sf_dir):
    es = links(spark, sf_dir)
    top = fusion.ranked(keyword_list(spark, sf_dir, K)).select("id", "rank")
    return graph.expand(top, es, es.ns.select("id")).withColumn("score", r(F.col("score"), 4))


@query(
    f"""WITH RECURSIVE {_X}, nx AS MATERIALIZED (SELECT o, id, c, seq FROM nb QUALIFY row_number() OVER (PARTITION BY o, id ORDER BY c, seq) = 1),
kids AS MATERIALIZED (SELECT o, list({{'id': id, 'c': c}} ORDER BY c, seq, id) AS found FROM nx GROUP BY o),
d1 AS MATERIALIZED (SELECT nx.id, c, row_number() OVER (ORDER BY rank, c, seq, nx.id) AS n FROM nx JOIN orig ON o = orig.id),
rec AS (SELECT 0 AS n, [{{'id': id, 'c': -1}} FOR id IN (SELECT list(id ORDER BY rank) FROM orig)] AS seen UNION ALL
 SELECT rec.n + 1, CASE WHEN len(list_filter(seen, lambda x: x.id = d1.id)) > 0 THEN seen
  ELSE seen || [{{'id': d1.id, 'c': d1.c}}] || CASE WHEN d1.c = 0 THEN list_filter(coalesce(found, []), lambda y: y.id <> d1.id AND NOT list_contains(list_transform(seen, lambda x: x.id), y.id)) ELSE [] END END
 FROM rec JOIN d1 ON d1.n = rec.n + 1 LEFT JOIN kids ON kids.o = d1.id),
walk AS (SELECT unnest(seen) AS x, generate_subscripts(seen, 1) AS rank FROM (SELECT seen FROM rec ORDER BY n DESC LIMIT 1))
SELECT x.id AS id, rank::INT AS rank, CASE WHEN x.c >= 0 THEN [0.5, 0.4, 0.55, 0.55, 0.3][x.c + 1]::DOUBLE END AS score,
 CASE WHEN x.c >= 0 THEN 'expansion:' || ['callee', 'caller', 'parent_type', 'child_method', 'import'][x.c + 1] END AS source FROM walk WHERE rank <= 50"""
)
def expand_depth2(spark, sf_dir):
    es = links(spark, sf_dir)
    top = fusion.ranked(keyword_list(spark, sf_dir, K)).select("id", "rank")
    return graph.expand_deep(top, es, es.ns.select("id"), 2).withColumn("score", r(F.col("score"), 4))


@query(
    f"WITH RECURSIVE {_BM}, {_G}, rc AS (SELECT id AS origin, id, 0 AS depth FROM kw WHERE rank <= {K} UNION SELECT rc.origin, e.dst, depth + 1 FROM rc JOIN e ON e.src = rc.id WHERE relation = 'call' AND depth < 2) "
    "SELECT origin, id, min(depth)::INT AS depth FROM rc GROUP BY ALL"
)
def reachable_depth2(spark, sf_dir):
    return links(spark, sf_dir).reachable(keyword_list(spark, sf_dir, K).select("id"), 2)


# files, parsing and chunking -----------------------------------------------------------------------------------------------
_EXT = "[" + ", ".join(f"'{e}'" for e in EXTENSIONS) + "]"
_LANG = "CASE " + " ".join(f"WHEN e IN ({', '.join(repr('.' + x) for x in v.split())}) THEN '{k}'" for k, v in lang.EXTENSIONS.items()) + " ELSE 'unknown' END"


@query(f"SELECT path, {_LANG} AS language FROM (SELECT path, lower(regexp_extract(path, '(\\.[^./]*)$', 1)) AS e FROM (SELECT 'v1.2/' || source || '/f' || doc_id || {_EXT}[(doc_id % {len(EXTENSIONS)} + 1)::INT] AS path FROM documents))")
def language_detect(spark, sf_dir):
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("id") % len(EXTENSIONS) + 1).cast("int"))
    c = chunks(spark, sf_dir).select(F.concat(F.lit("v1.2/"), "file_path", F.lit("/f"), F.col("id").cast("string"), ext).alias("path"))
    return c.select("path", lang.language(F.col("path")).alias("language"))


def as_files(spark, sf_dir, ext: str, content) -> DataFrame:
    return chunks(spark, sf_dir).select(F.concat(F.lit("f"), F.col("id").cast("string"), F.lit(ext)).alias("path"), content.alias("content"), F.lit(lang.language_of_path(f"x{ext}")).alias("language"))


@query(
    r"""WITH l AS (SELECT doc_id, string_split(replace(text, ' ', chr(10)), chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, ls, unnest(generate_series(0, greatest(0, ceil((len(ls) - 50) / 45.0)::BIGINT))) AS k FROM l),
x AS (SELECT doc_id, k, array_to_string(list_slice(ls, k * 45 + 1, k * 45 + 50), chr(10)) AS content, (k * 45 + 1)::INT AS start_line, least(k * 45 + 50, len(ls))::INT AS end_line FROM w)
SELECT 'f' || doc_id || '.md' AS file_path, md5(content) AS content_md5, start_line, end_line FROM x WHERE regexp_matches(content, '[^\s\p{Z}\x{0B}\x{85}]')"""
)
def line_windows(spark, sf_dir):
    files = as_files(spark, sf_dir, ".md", F.replace("content", F.lit(" "), F.lit("\n")))
    return parsers.line_windows(files).select("file_path", F.md5("content").alias("content_md5"), "start_line", "end_line")


_DEFS = r"""l AS (SELECT doc_id, string_split(replace(text, chr(10), chr(10) || 'def '), chr(10)) AS ls FROM documents),
m AS (SELECT doc_id, ls, list_filter(generate_series(1, len(ls)), lambda i: regexp_matches(ls[i], '^(async\s+def\s+\w+|def\s+\w+|class\s+\w+)')) AS marks FROM l),
b AS (SELECT doc_id, ls, marks[k] AS s, coalesce(marks[k + 1] - 1, len(ls)) AS e FROM (SELECT *, unnest(generate_series(1, len(marks))) AS k FROM m WHERE len(marks) > 0)),
x AS (SELECT doc_id, s, regexp_replace(array_to_string(list_slice(ls, s, e), chr(10)), '(\n[\s\p{Z}\x{0B}\x{85}]*)+\z', '') AS content, ls[s] AS line FROM b)"""


@query(
    f"WITH {_DEFS}" + r" SELECT 'f' || doc_id || '.py' AS file_path, md5(content) AS content_md5, s::INT AS start_line, (s + length(content) - length(replace(content, chr(10), '')))::INT AS end_line,"
    r" CASE WHEN regexp_matches(lower(line), '(class|interface|trait|protocol|struct|enum|impl) ') THEN 'class' ELSE 'function' END AS chunk_type FROM x"
)
def regex_boundaries(spark, sf_dir):
    files = as_files(spark, sf_dir, ".py", F.replace("content", F.lit("\n"), F.lit("\ndef ")))
    out = parsers.pattern_blocks(files).filter("chunk_type <> 'other'")
    return out.select("file_path", F.md5("content").alias("content_md5"), "start_line", "end_line", "chunk_type")


@query(
    r"""WITH l AS (SELECT doc_id AS id, 'N' || CASE WHEN doc_id % 2 = 0 THEN regexp_replace(text, '[^A-Za-z0-9]', '', 'g') ELSE regexp_replace(split_part(text, chr(10), 1), '[\s\p{Z}\x{0B}\x{85}]+$', '') END AS line FROM documents)
SELECT id, CASE WHEN regexp_matches(line, '^[^ \t(<{:\[=]+[ \t(<{:\[=]') THEN regexp_extract(line, '^[^ \t(<{:\[=]+', 0) WHEN octet_length(encode(line)) <= 64 THEN line
  WHEN id % 2 = 0 THEN substr(line, 1, 64) END AS name FROM l"""
)
def symbol_names(spark, sf_dir):
    """Names up to a delimiter on the first line, and, for even ids, of letters and digits alone, cut at 64 bytes."""
    first = F.substring_index("content", "\n", 1)
    bare = F.regexp_replace("content", "[^A-Za-z0-9]", "")
    c = chunks(spark, sf_dir).withColumn("line", F.concat(F.lit("N"), F.when(F.col("id") % 2 == 0, bare).otherwise(first)))
    name = lang.declaration_name(F.concat(F.lit("export async function "), "line"))
    odd_cut = (F.col("id") % 2 == 1) & ~lang.trimmed(F.col("line")).rlike(r"^[^ \t(<{:\[=]+[ \t(<{:\[=]") & (F.octet_length(lang.trimmed(F.col("line"))) > 64)
    return c.select("id", F.when(~odd_cut, name).alias("name"))


@query("SELECT doc_id AS id, substr(sha256(source || ':1:' || n_chars || ':' || text), 1, 32) AS chunk_id, substr(sha256(source || ':7'), 1, 16) AS parser_id FROM documents")
def chunk_ids(spark, sf_dir):
    c = table(spark, sf_dir, "documents")
    return c.select(F.col("doc_id").alias("id"), text.chunk_id(F.col("source"), F.lit(1), F.col("n_chars"), F.col("text")).alias("chunk_id"), text.parser_id(F.col("source"), F.lit(7)).alias("parser_id"))


@query("SELECT doc_id AS id, md5(text) AS md5, md5(substr(text, 1, 384)) AS embed_md5 FROM documents")
def content_md5(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return c.select("id", F.md5("content").alias("md5"), F.md5(text.embedding_text(F.col("content"))).alias("embed_md5"))


def parsed_chunks(spark, sf_dir) -> DataFrame:
    meta = F.create_map(F.lit("name"), F.concat(F.lit("n"), F.col("id").cast("string")), F.lit("own"), F.col("language"))
    return chunks(spark, sf_dir).select("file_path", "language", "content", "chunk_type", F.col("id").cast("int").alias("start_line"), (F.col("id") + 1).cast("int").alias("end_line"), meta.alias("metadata"), F.col("id").cast("int").alias("seq"))


@query(
    f"""WITH c AS (SELECT doc_id AS id, source, text, {_KIND} AS k, lead({_KIND}) OVER w AS nk, lead(text) OVER w AS nt, lead(doc_id) OVER w AS ni, lag({_KIND}) OVER w AS pk FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id))
SELECT source AS file_path, id::INT AS start_line, (CASE WHEN k = 'comment' AND nk IN ('function', 'class', 'method') THEN ni + 1 ELSE id + 1 END)::INT AS end_line,
 CASE WHEN k = 'comment' AND nk IN ('function', 'class', 'method') THEN nk ELSE k END AS chunk_type, md5(CASE WHEN k = 'comment' AND nk IN ('function', 'class', 'method') THEN text || chr(10) || nt ELSE text END) AS content_md5,
 CASE WHEN k = 'comment' AND nk IN ('function', 'class', 'method') THEN 'n' || ni ELSE 'n' || id END AS name, CASE WHEN k = 'comment' AND nk IN ('function', 'class', 'method') THEN 'true' END AS merged
FROM c WHERE NOT (coalesce(pk, '') = 'comment' AND k IN ('function', 'class', 'method'))"""
)
def chunk_merge(spark, sf_dir):
    out = chunker.merge_comments(parsed_chunks(spark, sf_dir))
    at = lambda k: F.element_at("metadata", F.lit(k))
    return out.select("file_path", "start_line", "end_line", "chunk_type", F.md5("content").alias("content_md5"), at("name").alias("name"), at("merged_from_comment").alias("merged"))


@query()
def chunk_split(spark, sf_dir):
    return chunker.chunk(parsed_chunks(spark, sf_dir)).select("id", "file_path", "chunk_type", "start_line", "end_line", F.md5("content").alias("content_md5"))


# incremental work and events -----------------------------------------------------------------------------------------------
@query("SELECT 'f' || doc_id AS path FROM documents WHERE doc_id % 3 = 0")
def incremental_changed(spark, sf_dir):
    from .sources.files import changed

    files = chunks(spark, sf_dir).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"), F.md5("content").alias("md5"), "id")
    manifest = files.select("path", F.when(F.col("id") % 3 == 0, F.lit("old")).otherwise(F.col("md5")).alias("md5"))
    return changed(files, manifest).select("path")


@query(f"WITH {_T}, {_P} SELECT term, count(*)::BIGINT AS df, sum(tf)::BIGINT AS tf FROM p JOIN documents d ON d.doc_id = p.id WHERE source NOT IN ('src0', 'src7') GROUP BY term")
def delete_cascade(spark, sf_dir):
    c = chunks(spark, sf_dir)
    gone = c.select("file_path").distinct().filter("file_path IN ('src0', 'src7')")
    kept = c.join(gone, "file_path", "left_anti")
    return index.postings(kept).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


@query(
    "SELECT CASE WHEN doc_id % 21 = 0 THEN 'error' WHEN doc_id % 3 = 0 THEN 'indexed' ELSE 'skipped' END AS status, count(*)::BIGINT AS files, sum(CASE WHEN doc_id % 21 <> 0 AND doc_id % 3 = 0 THEN 1 + doc_id % 4 ELSE 0 END)::BIGINT AS chunks, "
    "count(CASE WHEN doc_id % 21 = 0 THEN 1 END)::BIGINT AS errors FROM documents GROUP BY 1"
)
def index_metrics(spark, sf_dir):
    """Counters of an indexing run: files scanned, changed (every third), failed and cut into chunks, as the engine adds them up."""
    from .plans.engine import Engine

    files = chunks(spark, sf_dir).select("id", F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"))
    todo = files.filter("id % 3 = 0")
    failed = todo.filter("id % 21 = 0").select("path", F.lit("syntax error").alias("error"))
    cut = todo.filter("id % 21 <> 0").select(F.col("path").alias("file_path"), F.explode(F.sequence(F.lit(0), (F.col("id") % 4).cast("int"))))
    done = Engine._status(files, todo, failed, cut)
    return done.groupBy("status").agg(F.count(F.lit(1)).alias("files"), F.sum("chunks").alias("chunks"), F.count("error").alias("errors"))


# sources on disk: written to the shared folder first, then read by the engine's own readers ----------------------------------
def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see: under the session's checkpoint folder, or on this machine in a local session."""
    import tempfile
    import uuid

    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="lodestack-")
    return f"{where.rstrip('/')}/catalog-{name}-{uuid.uuid4().hex}"


@query(f"WITH {_T}, {_P} SELECT term, count(*)::BIGINT AS df, sum(tf)::BIGINT AS tf FROM p JOIN documents d ON d.doc_id = p.id WHERE source NOT IN ('src0', 'src7') AND doc_id % 6 <> 4 GROUP BY term")
def store_cycle(spark, sf_dir):
    """Chunks written to a store, one file's replaced and two files' deleted; then what its index holds."""
    from .sources.store import ChunkStore

    c = chunks(spark, sf_dir)
    none = F.create_map().cast("map<string,string>")
    rows = c.select(F.col("id").cast("string").alias("id"), "file_path", "language", "content", "chunk_type", F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), none.alias("metadata"), F.array().cast("array<string>").alias("dependencies"))
    store = ChunkStore(spark, scratch(spark, "store"), buckets=4)
    store.upsert(rows.filter("file_path <> 'src1'").unionByName(rows.filter("file_path = 'src1'").withColumn("content", F.lit("stale words"))))
    store.upsert(rows.filter("chunk_type <> 'comment'"), rows.select("file_path"))  # every file again, now without its comments
    store.delete_files(spark.createDataFrame([("src0",), ("src7",)], "file_path string"))
    return store.postings().groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


_FILES = """f AS (SELECT doc_id AS id, text, CASE doc_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.go' WHEN 2 THEN '.unknown' WHEN 3 THEN '.md' ELSE '.rs' END AS ext,
  CASE doc_id % 7 WHEN 0 THEN 'node_modules/' WHEN 1 THEN '.git/' WHEN 2 THEN 'a/b/' ELSE '' END AS dir FROM documents)"""


@query(f"WITH {_FILES} SELECT dir || 'f' || id || ext AS path, md5(text) AS md5, CASE ext WHEN '.py' THEN 'python' WHEN '.go' THEN 'go' WHEN '.md' THEN 'markdown' ELSE 'rust' END AS language FROM f WHERE ext <> '.unknown' AND dir NOT IN ('node_modules/', '.git/')")
def file_scan(spark, sf_dir):
    """A tree of files with known, unknown and left-out places, scanned from disk."""
    from .sources import files

    root = scratch(spark, "tree").removeprefix("file://")
    kind = F.element_at(F.array(*[F.lit(x) for x in (".py", ".go", ".unknown", ".md", ".rs")]), (F.col("id") % 5 + 1).cast("int"))
    folder = F.coalesce(F.get(F.array(*[F.lit(x) for x in ("node_modules/", ".git/", "a/b/")]), (F.col("id") % 7).cast("int")), F.lit(""))
    named = chunks(spark, sf_dir).select(F.concat(F.lit(f"{root}/"), folder, F.lit("f"), F.col("id").cast("string"), kind).alias("path"), "content")

    def write(rows) -> None:
        import os

        for row in rows:
            os.makedirs(os.path.dirname(row.path), exist_ok=True)
            with open(row.path, "w", encoding="utf-8", newline="") as f:
                f.write(row.content or "")

    named.foreachPartition(write)
    return files.scan(spark, root).select(F.substring("path", len(root) + 2, 1000).alias("path"), "md5", "language")


_GO = (
    ("import", "import (\n\t\"fmt\"\n\t\"m{a}/x\"\n)", 3, 6, {"imports": "fmt,m{a}/x"}),
    ("class", "type T{id} struct {{\n\tn int\n}}", 8, 10, {"name": "T{id}", "types": "T{id}"}),
    ("function", "func F{id}(a int) int {{\n\treturn G{b}(a) + p.H{a}(a)\n}}", 13, 15, {"name": "F{id}", "calls": "G{b},p.H{a}"}),
    ("method", "func (t *T{id}) M{b}() {{ fmt.Println(t.n) }}", 17, 17, {"receiver": "T{id}", "name": "M{b}", "calls": "fmt.Println"}),
)


def _go_text(template: str, quote: str) -> str:
    """A template over id, a (id % 3) and b (id % 7) as an SQL concatenation."""
    parts = template.replace("{{", "\x01").replace("}}", "\x02")
    for name, value in (("{id}", "doc_id"), ("{a}", "doc_id % 3"), ("{b}", "doc_id % 7")):
        parts = parts.replace(name, f"' || CAST({value} AS {quote}) || '")
    text_ = parts.replace("\x01", "{").replace("\x02", "}")
    for c, code in (("\n", 10), ("\t", 9)):
        text_ = text_.replace(c, f"' || chr({code}) || '")
    return f"('{text_}')"


def _go_row(chunk_type: str, content: str, start: int, end: int, meta: dict, quote: str) -> str:
    at = lambda k: _go_text(meta[k], quote) if k in meta else f"CAST(NULL AS {quote})"
    return (
        f"SELECT 'f' || CAST(doc_id AS {quote}) || '.go' AS file_path, '{chunk_type}' AS chunk_type, md5({_go_text(content, quote)}) AS content_md5, CAST({start} AS INT) AS start_line, CAST({end} AS INT) AS end_line, "
        f"{at('name')} AS name, {at('calls')} AS calls, {at('imports')} AS imports, {at('types')} AS types, {at('receiver')} AS receiver FROM documents"
    )


@query(" UNION ALL ".join(_go_row(*x, "VARCHAR") for x in _GO))
def go_declarations(spark, sf_dir):
    """Import, type, function and method chunks of generated Go files, with names, callees, imports and receivers."""
    decl = [x[1] for x in _GO]
    source = "package p\n\n" + decl[0] + "\n\n" + decl[1] + "\n\n// F{id} calls.\n" + decl[2] + "\n\n" + decl[3] + "\n"
    d = spread(table(spark, sf_dir, "documents"), "doc_id").select(F.expr("'f' || CAST(doc_id AS STRING) || '.go'").alias("path"), F.encode(F.expr(_go_text(source, "STRING")), "UTF-8").alias("content"))
    at = lambda k: F.element_at("metadata", F.lit(k)).alias(k)
    return parsers.parse(d).select("file_path", "chunk_type", F.md5("content").alias("content_md5"), "start_line", "end_line", *[at(k) for k in ("name", "calls", "imports", "types", "receiver")])


_OPS = "['CREATE', 'WRITE', 'REMOVE', 'RENAME', 'CREATE|WRITE', 'CHMOD'][(event_id % 6 + 1)::INT]"
_EV = f"""ev AS (SELECT event_id, user_id::VARCHAR AS path, ts, CASE WHEN contains({_OPS}, 'CREATE') THEN 'create' WHEN contains({_OPS}, 'WRITE') THEN 'modify' WHEN contains({_OPS}, 'REMOVE') THEN 'delete' END AS event FROM events)"""


def file_events(spark, sf_dir) -> DataFrame:
    ops = F.array(*[F.lit(o) for o in ("CREATE", "WRITE", "REMOVE", "RENAME", "CREATE|WRITE", "CHMOD")])
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").cast("string").alias("path"), F.col("ts").cast("timestamp").alias("ts"), changes.classify(F.element_at(ops, (F.col("event_id") % 6 + 1).cast("int"))).alias("event"))


@query(f"WITH {_EV} SELECT event_id, path, event FROM ev")
def event_classes(spark, sf_dir):
    return file_events(spark, sf_dir).select("event_id", "path", "event")


@query(
    f"""WITH {_EV}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM ev WHERE event IS NOT NULL WINDOW w AS (PARTITION BY path ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts, event_id) AS k FROM g)
SELECT path, arg_max(event, (ts, event_id)) AS event, count(*)::BIGINT AS n_events, CASE WHEN arg_max(event, (ts, event_id)) = 'delete' THEN 'delete' ELSE 'index' END AS action FROM s GROUP BY path, k"""
)
def debounce_sessions(spark, sf_dir):
    out = changes.debounce(file_events(spark, sf_dir), "30 minutes", order_col="event_id")
    return changes.actions(out).select("path", "event", "n_events", "action")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
