"""SQL statements (DuckDB) for the queries that SQL can express over whole tables."""

from __future__ import annotations

from .quality_rules import DEFAULT_RULES, STOP_WORDS

_STOP = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))


def _rule_sql() -> str:
    out = []
    for r in DEFAULT_RULES:
        ratio = f"(CASE WHEN {r.denominator} = 0 THEN 0.0 ELSE {r.numerator} / {r.denominator}::DOUBLE END)" if r.denominator else r.numerator
        out += [f"{ratio} >= {r.low}"] if r.low is not None else []
        out += [f"{ratio} <= {r.high}"] if r.high is not None else []
    return " AND ".join(out)


QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
pos AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 7)) AS p FROM w WHERE len(ws) >= 8),
win AS (SELECT doc_id, p, list_slice(ws, p, p + 7) AS x FROM pos),
dup AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, x) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM dup, (SELECT unnest(generate_series(0, 7)) AS k) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(ws, lambda x: x IN ({_STOP})))::BIGINT AS n_stop_words,
    len(list_filter(generate_series(2, len(ws)), lambda i: ws[i] = ws[i - 1]))::BIGINT AS n_stutters,
    len(ls)::BIGINT AS n_lines,
    len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$')))::BIGINT AS n_open_lines
  FROM w LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m)
SELECT *, (NOT base_failed AND {_rule_sql()}) AS kept FROM f
"""

LINE_DEDUP = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(generate_series(1, len(ls))) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
h AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
s AS (SELECT k.*, h.key IS NOT NULL AND doc_id <> keeper AS gone FROM k LEFT JOIN h USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM s GROUP BY doc_id
"""

NGRAM_JOIN = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 2))) AS i FROM w WHERE len(ws) > 0),
s AS MATERIALIZED (SELECT DISTINCT doc_id, list_slice(ws, i, i + 2) AS x FROM p),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r AS (SELECT doc_id AS d, doc_id AS t FROM documents UNION SELECT r.d, l.b FROM r JOIN l ON l.a = r.t)
SELECT d AS doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(t) AS component_id FROM r LEFT JOIN n ON n.doc_id = d GROUP BY d
"""
