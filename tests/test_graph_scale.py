"""The graph's queries work on the two sides of its edges: results by brute force, and plans that shuffle no edges."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestack import catalog
from lodestack.operators import graph


def random_nodes(n: int, seed: int) -> list[tuple]:
    rng, names = random.Random(seed), ["a", "b", "c", "d", ""]
    some = lambda k: ",".join(rng.choice([*names, "x.a", "zz"]) for _ in range(rng.randint(0, k)))
    out = []
    for i in range(n):
        kind = rng.choice(["function", "class", "method", "import"])
        meta = {"calls": some(4), "imports": some(2) if kind == "import" else "", "types": some(2), "receiver": rng.choice(names) if kind == "method" else ""}
        out.append((i, kind, rng.choice(names), f"f{i % 3}", meta))
    return out


def plain_edges(rows: list[tuple]) -> list[tuple]:
    """(src, dst, relation, seq) by nested loops."""
    out = []
    for i, kind, name, _, meta in rows:
        listed = lambda key: [x for x in meta[key].split(",") if x]
        found = [(0, p, d, "import") for p, t in enumerate(listed("imports")) for d, _, n, _, _ in rows if n and n == t]
        found += [(1, p, d, "call") for p, t in enumerate(listed("calls")) for d, _, n, _, _ in rows if n and n == t.rsplit(".", 1)[-1]]
        own = {name} | set(listed("types")) if kind == "class" else set()
        found += [(2, 0, d, "define") for d, k, _, _, m in rows if k == "method" and m["receiver"] and m["receiver"] in own]
        out += [(i, d, r, s) for s, (_, _, d, r) in enumerate(sorted(found), 1)]
    return out


@pytest.mark.parametrize("seed", [1])
def test_links_equal_nested_loops(spark, monkeypatch, seed):
    monkeypatch.setattr(graph, "BLOCK", 3)  # names of more nodes than a block holds
    rows = random_nodes(40, seed)
    ns = spark.createDataFrame(rows, "id long, type string, name string, file_path string, metadata map<string,string>").localCheckpoint()
    want, links = plain_edges(rows), graph.Links(ns, lambda d: d.localCheckpoint())
    name, path = {r[0]: r[2] for r in rows}, {r[0]: r[3] for r in rows}
    assert sorted(tuple(r)[:4] for r in links.edges().collect()) == sorted(want)
    for relation in ("call", "import", "define"):
        assert sorted(tuple(r) for r in links.related(relation).collect()) == sorted((s, d, q, name[d], path[d]) for s, d, r, q in want if r == relation)
    first: dict = {}
    for s, d, _, q in want:
        first[s, d] = min(q, first.get((s, d), q))
    assert sorted((r.src, r.dst, r.seq, r.name) for r in links.related().collect()) == sorted((s, d, q, name[d]) for (s, d), q in first.items())
    assert sorted((r.dst, r.src) for r in links.incoming("call").collect()) == sorted({(d, s) for s, d, r, _ in want if r == "call"})
    assert sorted(tuple(r) for r in links.parent_files().collect()) == sorted({(d, path[s]) for s, d, r, _ in want if r != "define"})
    assert tuple(links.stats().first()) == (len(rows), len(want))

    es = spark.createDataFrame(want, "src long, dst long, relation string, seq int").localCheckpoint()
    origins = spark.createDataFrame([(0,), (5,), (9,), (11,)], "origin long")
    near = sorted(tuple(r) for r in graph.neighbours(es, origins).collect())
    assert sorted(tuple(r) for r in links.neighbours(origins).collect()) == near
    best = defaultdict(list)
    for o, i, k, q in near:
        best[o, k].append((q, i))
    some = {tuple(r) for r in links.neighbours(origins, 2).collect()}
    assert some <= set(near) and all((o, i, k, q) in some for (o, k), v in best.items() for q, i in sorted(v)[:2])
    top = spark.createDataFrame([(5, 1), (11, 2)], "id long, rank int")
    assert sorted(tuple(r) for r in links.reachable(top.select("id"), 2).collect()) == sorted(tuple(r) for r in graph.reachable(top.select("id"), es, 2).collect())
    for cap in (7,):
        assert sorted(tuple(r) for r in graph.expand(top, links, ns.select("id"), cap).collect()) == sorted(tuple(r) for r in graph.expand(top, es, ns.select("id"), cap).collect())
        assert sorted(tuple(r) for r in graph.expand_deep(top, links, ns.select("id"), 2, cap).collect()) == sorted(tuple(r) for r in graph.expand_deep(top, es, ns.select("id"), 2, cap).collect())


def test_near_rows_of_hubs_are_bounded(spark):
    ns = spark.range(400).select("id", F.lit("method").alias("type"), F.lit("hub").alias("name"), F.lit("f").alias("file_path"), F.create_map(F.lit("calls"), F.lit("hub,hub"), F.lit("receiver"), F.lit("hub")).alias("metadata"))
    links = graph.Links(ns.localCheckpoint(), lambda d: d.localCheckpoint())
    assert links.stats().first().edges == 2 * 400 * 400
    assert links.neighbours(ns.select(F.col("id").alias("origin")), 3).count() == 400 * (3 + 3)  # callees and callers


@pytest.mark.parametrize("name", ["neighbors_all", "parent_files", "define_edges", "import_edges", "call_edges", "neighbors_in", "neighbors_out"])
def test_edges_are_not_shuffled(spark, sf, name):
    plan = catalog.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Join")]
    assert "Exchange" not in above and "Window" not in above and "Aggregate" not in above


def test_edges_are_counted_by_sides(spark, sf):
    plan = catalog.queries()["graph_stats"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "_lb" not in plan


def test_first_tokens(spark):
    from lodestack.functions import text

    texts = [(t,) for t in (None, "", " ", "a", " .a b", "..A b-c_d e f g h i j k", "a b c d e f g h", "a b c d e f g h..", "x" * 9)]
    for n in (1, 3, 8):
        for r in spark.createDataFrame(texts, "t string").select("t", text.first_tokens(F.col("t"), n).alias("a"), F.slice(text.tokens(F.col("t")), 1, n).alias("b")).collect():
            assert r.a == r.b, r.t
