"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lodestack import catalog

WITHOUT_SQL = {"chunk_split"}


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(row[i] for i in order) for row in data), key=repr)


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1.01e-5)
    return a == b


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, sf, con, name):
    got = catalog.queries()[name](spark, sf)
    have = rows(got.columns, [tuple(r) for r in got.collect()])
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert name in WITHOUT_SQL and have
        return
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows(names, cur.fetchall())
    assert sorted(got.columns) == sorted(names)
    assert len(have) == len(want)
    assert all(same(x, y) for a, b in zip(have, want) for x, y in zip(a, b))


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == WITHOUT_SQL


def test_plans_push_down_and_avoid_shuffles(spark, sf, tmp_path):
    big = str(tmp_path)
    spark.read.parquet(f"{sf}/documents.parquet").repartition(16).write.parquet(f"{big}/documents.parquet")  # more splits than cores
    plan = catalog.index.doc_stats(catalog.chunks(spark, big))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    top = catalog.lexical.topk(catalog.lexical.bm25_scan(catalog.chunks(spark, big), catalog.QUERY), 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in top and "hashpartitioning" not in top
    posts = spark.createDataFrame([("a", 1, 1)], "term string, id long, tf long")
    assert "SortMergeJoin" not in catalog.index.matching_ids(posts, ["a"])._jdf.queryExecution().executedPlan().toString()
