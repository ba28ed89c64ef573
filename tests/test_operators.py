"""Unit values of text functions, ranking, fusion, selection, graph and prompts."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack import config, errors
from lodestack.functions import language, scoring, text
from lodestack.operators import fusion, graph, index, lexical, rerank, select, vector
from lodestack.plans import prompt
from lodestack.sources import models


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols))
    return df.select(expr.alias("x")).first().x


def test_tokens(spark):
    t = lambda s, f: one(spark, f(F.col("s")), s=s)
    assert t("Get User By ID", text.query_tokens) == ["get", "user", "id"]
    assert t("snake_case", text.camel_tokens) == ["snake", "case"]
    assert t("camelCase", text.camel_tokens) == ["camel", "case"]
    assert t("api.endpoint", text.camel_tokens) == ["api", "endpoint"]
    assert t("camelCase", text.tokens) == ["camelcase"]
    assert t("a+b=$x <div> don't é", text.tokens) == ["a+b=$x", "<div>", "don", "t", "é"]
    assert t("a+b=$x <div> don't é", text.query_tokens) == ["a+b=$x", "<div>", "don", "é"]
    assert t("", text.tokens) == [] and t(" _.,! ", text.tokens) == []


def test_driver_tokens_equal_column_tokens(spark):
    rng = random.Random(5)
    alphabet = "abcXYZ _-.,;+=$<>'\u00a0\u2003\u2026é漢ß\x0b\x1c1²"
    lines = ["".join(rng.choice(alphabet) for _ in range(40)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, s string").select("i", text.query_tokens(F.col("s")).alias("t"))
    for r in df.collect():
        assert lexical.local_query_tokens(lines[r.i]) == r.t


def test_utf8_and_ids(spark):
    raw = bytearray(b"ab\xff\xfe\xc3\xa9\xe2\x82z")
    df = spark.createDataFrame([(raw,)], "b binary")
    assert df.select(text.valid_utf8(F.col("b"))).first()[0] == "ab\ufffdé\ufffdz"
    ids = lambda c: one(spark, text.chunk_id(F.col("p"), F.lit(1), F.lit(10), F.col("c")), p="test.go", c=c)
    assert ids("content") == "30d5595faff6c6a9aa841852ba67fe06" and ids("diff") == "774dbcc7e0df05e1a0cc0cbf4db3182b"
    assert len(one(spark, text.embedding_text(F.col("s")), s="é" * 500)) == 384
    assert one(spark, text.comma_list(F.col("s")), s=" a, ,b,") == ["a", "b"]


def test_bm25_value(spark):
    d = spark.createDataFrame([(100, 50.0, 45, 3, 10)], "n long, avgdl double, dl long, tf long, df long")
    got = d.select(scoring.idf(F.col("n"), F.col("df")), scoring.tf_part(F.col("tf"), F.col("dl"), F.col("avgdl"))).first()
    assert got[0] == pytest.approx(2.263745, abs=1e-6) and got[1] == pytest.approx(1.605839, abs=1e-6)


DOCS = [("doc1", "hello world"), ("doc2", "hello universe hello hello")]


def test_inverted_index(spark):
    c = spark.createDataFrame(DOCS, "id string, content string")
    posts, stats = index.postings(c), index.doc_stats(c)
    assert {r.id for r in index.matching_ids(posts, ["hello"]).collect()} == {"doc1", "doc2"}
    assert index.matching_ids(posts, []).count() == 0
    tf = {(r.term, r.id): r.tf for r in posts.collect()}
    assert tf[("hello", "doc2")] == 3
    pairs = spark.createDataFrame([("hello", "doc1"), ("missing", "doc1")], "term string, id string")
    assert {r.term: r.tf for r in index.lookup_tf(posts, pairs).collect()} == {"hello": 1, "missing": 0}
    row = index.corpus_stats(stats).first()
    assert (row.n, row.avgdl) == (2, 3.0)
    assert {r.term: r.df for r in index.term_stats(posts).collect()}["hello"] == 2
    gone = spark.createDataFrame([("doc1",)], "id string")
    assert index.corpus_stats(index.remove(stats, gone)).first().n == 1
    assert index.corpus_stats(stats.limit(0)).first().avgdl == 0
    assert index.previews(stats, gone).first().preview == "hello world"
    assert '"term":"hello"' in "".join(r.value for r in index.export_json(posts, "postings").collect())


def test_bm25_paths_agree(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(30)]
    c = spark.createDataFrame([(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 40)))) for i in range(80)], "id long, content string")
    q = "w1 w2 w2 w29 missing the"
    stats = index.tokenized(c).select("id", "dl")
    a = {r.id: r.score for r in lexical.bm25_scan(c, q).collect()}
    terms = lexical.query_terms(spark.createDataFrame([(7, q)], "query_id int, text string"))
    b = {r.id: r.score for r in lexical.bm25_batch(terms, index.postings(c), stats, index.corpus_stats(stats)).collect()}
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k]) for k in a)
    assert lexical.bm25_scan(c, "the").count() == 0
    for k in (1, 5):  # a longer list starts with the shorter one
        short = [r.id for r in lexical.topk(lexical.bm25_scan(c, q), k).collect()]
        assert short == [r.id for r in lexical.topk(lexical.bm25_scan(c, q), 10).collect()][:k]
    assert "not found in document" in lexical.explain(index.postings(c), stats, index.corpus_stats(stats), ["w1", "zz"], 0).first().explanation


def test_cosine(spark):
    rng = np.random.default_rng(2)
    data = [(i, rng.normal(size=8).tolist()) for i in range(50)] + [(90, [0.0] * 8), (91, [1.0]), (92, None)]
    df = spark.createDataFrame(data, "id long, embedding array<float>")
    q = [1.0, 0, 2, 0, 0, 1, 0, 3]
    want = {i: (np.dot(np.float32(v), q) / np.linalg.norm(np.float32(v)) / np.linalg.norm(q) if v and len(v) == 8 and any(v) else 0.0) for i, v in data}
    top = vector.cosine_topk(df, q, 10).collect()
    assert [r.id for r in top] == sorted(want, key=lambda i: (-want[i], i))[:10]
    assert all(r.score == pytest.approx(want[r.id], abs=1e-6) for r in top)
    assert {r.id: r.score for r in vector.cosine_scores(df.filter("id < 50"), q).collect()} == pytest.approx({i: want[i] for i in range(50)}, abs=1e-6)


def lists(spark):
    v = spark.createDataFrame([(1, 0.9), (2, 0.8)], "id long, score double")
    return v, spark.createDataFrame([(2, 0.9), (3, 0.7)], "id long, score double")


@pytest.mark.parametrize("strategy,want", [("rrf", {1: 0.016393, 2: 0.032522, 3: 0.016129}), ("weighted", {1: 0.5, 2: 0.5, 3: 0.0}), ("max", {1: 0.9, 2: 0.9, 3: 0.7})])
def test_fusion(spark, strategy, want):
    v, k = lists(spark)
    assert {r.id: r.score for r in fusion.fuse(v, k, strategy, 0.5).collect()} == pytest.approx(want, abs=1e-6)
    both = fusion.combine(v, k, strategy, 0.5).collect()
    assert {r.id: r.score for r in both} == pytest.approx(want, abs=1e-6) and {r.source for r in both} == {"hybrid"}


def test_one_sided_fusion(spark):
    v, k = lists(spark)
    only = fusion.combine(v, k.limit(0)).collect()
    assert {r.id: (r.source, round(r.score, 4), r.vector_score) for r in only} == {1: ("vector", 0.9, 0.0), 2: ("vector", 0.8, 0.0)}
    only = fusion.combine(v.limit(0), k).collect()
    assert {r.id: (r.source, round(r.keyword_score, 4)) for r in only} == {2: ("keyword", 0.9), 3: ("keyword", 0.7)}
    assert fusion.combine(v.limit(0), k.limit(0)).count() == 0


def test_normalize_dedup_truncate(spark):
    f = lambda *x: spark.createDataFrame([(i, float(s)) for i, s in enumerate(x)], "id long, score float")
    assert [r.score for r in fusion.normalize(f(10, 0)).orderBy("id").collect()] == [1.0, 0.0]
    assert [r.score for r in fusion.normalize(f(3, 3)).collect()] == [3.0, 3.0]
    d = spark.createDataFrame([(1, 0.9, 1), (2, 0.8, 2), (1, 0.7, 3)], "id long, score double, rank int")
    assert sorted((r.id, r.score) for r in fusion.dedup_first(d).collect()) == [(1, 0.9), (2, 0.8)]
    assert [r.rank for r in fusion.truncate(d, 2).collect()] == [1, 2] and fusion.truncate(d, 0).count() == 3


def results(spark):
    data = [(1, "func solve() {}", "function", "solver.go", 0.8), (2, "// this solves nothing", "comment", "helper.go", 0.9), (3, "type Solver struct {}", "class", "models.go", 0.7)]
    return spark.createDataFrame(data, "id long, content string, chunk_type string, file_path string, score float")


def test_heuristic_rerank(spark):
    got = {r.id: r.relevance_score for r in rerank.heuristic(results(spark), "solve").collect()}
    assert got == pytest.approx({1: 2.0592, 2: 0.8775, 3: 1.5015}, abs=1e-4)
    assert len(rerank.heuristic(results(spark), "").collect()) == 3


def test_recency(spark):
    d = spark.createDataFrame([(0.0,), (30 * 86400.0,), (1e12,), (None,)], "m double")
    got = [r[0] for r in d.select(scoring.recency(F.col("m"), F.lit(30 * 86400.0))).collect()]
    assert got == pytest.approx([1 + 0.3 * math.exp(-1), 1.3, 1.3, 1.0], abs=1e-6)


def greedy(rel, vec, lam):
    left, out = list(range(len(rel))), []
    cos = lambda a, b: 0.0 if not (np.linalg.norm(a) and np.linalg.norm(b)) else float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    while left:
        best = max(left, key=lambda i: (lam * rel[i] - (1 - lam) * max([0.0, *(cos(vec[i], vec[j]) for j in out)]), -i))
        left.remove(best)
        out.append(best)
    return out


def test_mmr(spark):
    rng = np.random.default_rng(4)
    rel, vec = rng.random(12), np.abs(rng.normal(size=(12, 4)))
    assert rerank.mmr_order(rel, list(vec), 0.6) == greedy(rel, vec, 0.6)
    assert rerank.mmr_order(rel, [None] * 12, 0.6) == sorted(range(12), key=lambda i: -rel[i])
    d = spark.createDataFrame([(0, i, float(rel[i]), vec[i].tolist()) for i in range(12)], "query_id int, id long, relevance_score double, embedding array<float>")
    got = rerank.mmr(d, 7.0).orderBy("mmr_rank").collect()
    order = sorted(range(12), key=lambda i: -rel[i])
    assert [r.id for r in got] == [order[k] for k in greedy(rel[order], vec[order], 0.7)]
    out = rerank.with_mmr(rerank.heuristic)(results(spark).withColumn("embedding", F.array(F.lit(1.0)).cast("array<float>")), "solve")
    assert out.filter("mmr_rank = 1").first().id == 1 and "query_id" not in out.columns


def test_caps_and_budget(spark):
    d = spark.createDataFrame([(1, "file1", 0.9, "a" * 10), (2, "file1", 0.8, "b" * 10), (3, "file1", 0.7, "c"), (4, "file2", 0.85, "d" * 500)], "id long, file_path string, relevance_score double, content string")
    assert [r.id for r in select.per_file_cap(d, 2).orderBy(F.desc("relevance_score")).collect()] == [1, 4, 2]
    assert select.per_file_cap(d, 0).count() == 4
    assert select.budget_bytes(4096) == 13107
    assert [r.id for r in select.prompt_fit(d, 10).orderBy("prompt_rank").collect()] == [1]
    assert [r.id for r in select.prompt_fit(d, 1).collect()] == [1]  # the first always stays
    assert select.prompt_fit(d, 0).count() == 4
    assert (select.candidate_limit(5), select.candidate_limit(5, "go")) == (20, 50)
    rng = random.Random(3)
    for budget in (5, 40, 90):
        sizes = [rng.randint(1, 40) for _ in range(12)]
        rows = spark.createDataFrame([(i, float(-i), "x" * s) for i, s in enumerate(sizes)], "id long, relevance_score double, content string")
        used, want = 0, []
        for i, s in enumerate(sizes):
            if want and used + s > int(budget * 4 * 0.8):
                break
            want.append(i)
            used += s
        assert sorted(r.id for r in select.prompt_fit(rows, budget).collect()) == want


def chunk_rows(spark, *rows):
    return spark.createDataFrame(rows, "id string, chunk_type string, file_path string, metadata map<string,string>")


def test_graph_edges(spark):
    c = chunk_rows(spark, ("c1", "function", "a.go", {"name": "main", "calls": "helper,fmt.Println"}), ("c2", "function", "b.go", {"name": "helper"}), ("c3", "import", "a.go", {"imports": "fmt,strings"}))
    ns = graph.nodes(c)
    es = graph.edges(c, ns)
    assert ns.count() == 3 and [(r.src, r.dst, r.relation) for r in es.collect()] == [("c1", "c2", "call")]
    assert [r.src for r in graph.incoming(es, ns, "call").collect()] == ["c1"] and [r.file_path for r in graph.parent_files(es, ns).collect()] == ["a.go"]
    assert tuple(graph.stats(es, ns).first()) == (3, 1)
    d = chunk_rows(spark, ("t", "class", "a.go", {"name": "MyStruct", "types": "MyStruct, Other"}), ("m", "method", "a.go", {"name": "DoWork", "receiver": "MyStruct"}), ("n", "method", "a.go", {"name": "X", "receiver": "Other"}))
    es = graph.edges(d)
    assert sorted((r.src, r.dst, r.relation) for r in es.collect()) == [("t", "m", "define"), ("t", "n", "define")]
    top = spark.createDataFrame([("m", 1)], "id string, rank int")
    assert [(r.id, r.source) for r in graph.expand(top, es, d).orderBy("rank").collect()] == [("m", None), ("t", "expansion:parent_type")]


def edge_table(spark, edges):
    return spark.createDataFrame([(a, b, r, k) for k, (a, b, r) in enumerate(edges)], "src string, dst string, relation string, seq int")


@pytest.mark.parametrize("edges,start,depth,cap,want", [
    ([("1", "2", "call"), ("2", "3", "call")], ["1"], 1, 50, ["1", "2"]),
    ([("1", "2", "call"), ("2", "3", "call")], ["1"], 2, 50, ["1", "2", "3"]),
    ([("1", "3", "call"), ("1", "4", "call"), ("3", "2", "call"), ("4", "2", "call")], ["1"], 2, 50, ["1", "3", "2", "4"]),
    ([(str(i), str(i + 1), "call") for i in range(1, 5)], ["1"], 10, 3, ["1", "2", "3"]),
])
def test_expansion_depth(spark, edges, start, depth, cap, want):
    es = edge_table(spark, edges)
    ids = spark.createDataFrame([(x,) for x in sorted({x for a, b, _ in edges for x in (a, b)})], "id string")
    top = spark.createDataFrame([(x, i + 1) for i, x in enumerate(start)], "id string, rank int")
    assert [r.id for r in graph.expand_deep(top, es, ids, depth, cap).orderBy("rank").collect()] == want
    if depth == 1:
        assert [r.id for r in graph.expand(top, es, ids, cap).orderBy("rank").collect()] == want


def test_set_based_expansion_equals_the_walk(spark):
    rng = random.Random(11)
    names = [f"n{i}" for i in range(25)]
    edges = [(rng.choice(names), rng.choice(names), rng.choice(["call", "define", "import"])) for _ in range(90)]
    es, ids = edge_table(spark, edges), spark.createDataFrame([(n,) for n in names[:22]], "id string")
    top = spark.createDataFrame([(n, i + 1) for i, n in enumerate(names[:4])], "id string, rank int")
    for cap in (6, 12, 50):
        a = [(r.id, r.source) for r in graph.expand(top, es, ids, cap).orderBy("rank").collect()]
        b = [(r.id, r.source) for r in graph.expand_deep(top, es, ids, 1, cap).orderBy("rank").collect()]
        assert a == b


def test_prompt(spark):
    d = spark.createDataFrame([("1", "a.go", 1, 9, "code", 0.5)], "id string, file_path string, start_line int, end_line int, content string, relevance_score double")
    out = prompt.generate(d, "why?", prompt.template_by_name("professional"), 4096, model="m").first()
    assert out.prompt.startswith("<!-- RAG context: generated_at=") and "| model=m | context_results=1 | total_results=1 | max_tokens=4096 | source_files=a.go -->\n" in out.prompt
    assert "--- a.go (Lines 1-9) ---\ncode\n" in out.prompt and "User question: why?" in out.prompt
    assert "reviewer" in prompt.template_by_name("") and "reviewer" in prompt.template_by_name("x") and "reviewer" not in prompt.template_by_name(" Default ")
    assert prompt.generate(d.limit(0), "q", "{{.Query}}!").first().prompt.endswith(" -->\nq!")
    for bad in ("{{invalid", "{{.Nope}}", "{{range .Results}}", "{{end}}"):
        with pytest.raises(errors.AppError):
            prompt.Template(bad)


def test_models_and_settings(monkeypatch):
    e = models.HashingEmbedder(16)
    assert e.embed_batch(["a b", "a b"])[0] == e.embed("a b") and e.embed_batch([]) == [] and e.embed("") == [0.0] * 16
    waits, tries = [], []

    def failing():
        tries.append(1)
        raise OSError("no")

    with pytest.raises(OSError):
        models.with_retry(failing, sleep=waits.append)
    assert len(tries) == 3 and waits == pytest.approx([0.1, 0.4])
    assert models.EchoGenerator().generate([{"role": "system", "content": "s"}, {"role": "user", "content": "hi"}]) == "hi"
    assert config.Config().bm25_k1 == 1.2 and config.Config().prompt_template == "professional"
    monkeypatch.setenv("BM25_K1", "x")
    monkeypatch.setenv("USE_MMR", "yes")
    monkeypatch.setenv("EMBEDDING_WORKERS", "3 or so")
    c = config.Config()
    assert (c.bm25_k1, c.use_mmr, c.embedding_workers) == (0.0, False, 3)


def test_http_models():
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if body.get("prompt") == "fail":
                self.send_response(503)
                self.end_headers()
                return
            self.send_response(200)
            self.end_headers()
            if "prompt" in body:
                out = b"{" if body["prompt"] == "bad" else json.dumps({"embedding": [0.1, 0.2, 0.3]}).encode()
            elif body["stream"]:
                out = b"".join(json.dumps({"message": {"content": w}, "done": w == "!"}).encode() + b"\n" for w in ("a", "b", "!", "never"))
            else:
                out = json.dumps({"message": {"content": "answer"}}).encode()
            self.wfile.write(out)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    e, g = models.HttpEmbedder(url, "m"), models.HttpGenerator(url, "m")
    assert e.embed("x") == [0.1, 0.2, 0.3] and len(e.embed_batch(["x", "y"])) == 2
    for bad in ("fail", "bad"):
        with pytest.raises(errors.AppError):
            e.embed_batch(["x", bad])
    assert g.generate([{"role": "user", "content": "q"}]) == "answer" and list(g.stream([])) == ["a", "b", "!"]
    server.shutdown()


def test_batches_are_embedded_side_by_side():
    import threading
    import time

    class Slow(models.HttpEmbedder):
        open_, top, lock = 0, 0, threading.Lock()

        def _ask(self, one):
            with Slow.lock:
                Slow.open_ += 1
                Slow.top = max(Slow.top, Slow.open_)
            time.sleep(0.02)
            with Slow.lock:
                Slow.open_ -= 1
            if one == "fail":
                raise errors.AppError(errors.EXTERNAL, "no")
            return [float(one)]

    assert Slow("http://a", "m", workers=4, most=3).embed_batch([str(i) for i in range(24)]) == [[float(i)] for i in range(24)]
    assert 1 < Slow.top <= 3
    with pytest.raises(errors.AppError):
        Slow("http://a", "m").embed_batch(["1", "fail", "2"])
    assert Slow("http://a", "m").embed_batch([]) == []


def test_env_file(tmp_path, monkeypatch):
    for n in ("SERVER_PORT", "LOG_LEVEL", "FUSION_STRATEGY", "LLM_MODEL"):
        monkeypatch.delenv(n, raising=False)
    monkeypatch.setenv("NUM_WORKERS", "9")
    monkeypatch.setattr(os, "environ", dict(os.environ))
    path = tmp_path / ".env"
    path.write_text("# a comment\nSERVER_PORT=9001 # the port\nexport LOG_LEVEL='debug'\nFUSION_STRATEGY=\"max\"\n\nNUM_WORKERS=3\nno value\nLLM_MODEL=a=b\n")
    config.load_env(str(path))
    config.load_env(str(tmp_path / "none"))
    c = config.Config()
    assert (c.port, c.log_level, c.fusion, c.workers, c.llm_model, c.log_format) == (9001, "debug", "max", 9, "a=b", "text")


def plain_walk(edges, originals, known, depth, cap):
    """Depth-first expansion from an edge list, one edge at a time: (id, class) after the originals."""
    order = {"callee": 0, "caller": 1, "parent_type": 2, "child_method": 3, "import": 4}

    def around(node):
        out = {}
        for src, dst, relation, seq in edges:
            ways = {"call": [("callee", src, dst), ("caller", dst, src)], "define": [("parent_type", dst, src), ("child_method", src, dst)], "import": [("import", src, dst)]}[relation]
            for kind, here, there in ways:
                if here == node and there in known:
                    out[order[kind], there] = min(seq, out.get((order[kind], there), seq))
        return [(k, there) for (k, there), _ in sorted(out.items(), key=lambda x: (x[0][0], x[1], x[0][1]))]

    seen, out = set(originals), []

    def visit(node, level):
        for k, other in around(node):
            if len(originals) + len(out) >= cap:
                return
            if other not in seen:
                seen.add(other)
                out.append((other, k))
                if k == 0 and level + 1 < depth:
                    visit(other, level + 1)

    for o in originals:
        visit(o, 0)
    return out


def test_deep_expansion_equals_a_plain_walk(spark):
    rng = random.Random(5)
    names = [f"n{i:02}" for i in range(40)]
    edges = [(rng.choice(names[:12]), rng.choice(names), rng.choice(["call", "call", "define", "import"])) for _ in range(200)]
    es = edge_table(spark, edges)
    rows = [tuple(r) for r in es.select("src", "dst", "relation", "seq").collect()]
    ids, tops = names[:36], ["n03", "n30", "n07"]
    top = spark.createDataFrame([(n, i + 1) for i, n in enumerate(tops)], "id string, rank int")
    for depth, cap in ((2, 5), (2, 12), (3, 50)):
        got = graph.expand_deep(top, es, spark.createDataFrame([(n,) for n in ids], "id string"), depth, cap).orderBy("rank").collect()
        assert [r.id for r in got] == tops + [i for i, _ in plain_walk(rows, tops, set(ids), depth, cap)]


def test_checks():
    with pytest.raises(errors.AppError):
        errors.check_range(0, 1, 5, "k")
    with pytest.raises(errors.AppError):
        errors.check_one_of("x", ["a"], "kind")
    with pytest.raises(errors.AppError):
        errors.check_directory("../x")
    e = errors.AppError(errors.EXTERNAL, "down", ValueError("why")).with_context("url", "u")
    assert str(e) == "EXTERNAL: down (caused by: why)" and e.context == {"url": "u"} and errors.is_kind(e, errors.EXTERNAL) and not errors.is_kind(None, errors.INTERNAL)


def test_languages_by_path():
    assert language.language_of_path("a/b.GO") == "go" and language.language_of_path("dir.py/file") == "unknown" and language.language_of_path(".env") == "config"
