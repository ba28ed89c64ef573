"""Texts are split as seldom as the plans allow, and postings are shuffled only where they are asked for."""

from lodestack import catalog


def plan(spark, sf, name: str) -> str:
    return catalog.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_keyword_list_is_scored_once(spark, sf):
    assert "FileScan" not in plan(spark, sf, "fallback_fusion")


def test_terms_are_counted_without_postings(spark, sf):
    for name in ("term_df", "remove_documents"):
        assert "hashpartitioning(term" in plan(spark, sf, name) and ", id#" not in plan(spark, sf, name).split("hashpartitioning(term", 1)[1].split(")")[0]


def test_batch_reads_lengths_from_postings(spark, sf):
    assert plan(spark, sf, "bm25_batch").count("ReadSchema: struct<doc_id:bigint,text:string>") <= 2


def test_filters_do_not_split_texts_again(spark, sf):
    found = catalog.lexical.bm25_scan(catalog.chunks(spark, sf), catalog.QUERY)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") == 2  # statistics and hits
