"""Indexing, retrieval, deletes and the change feed end to end on a small tree."""

import os

import pytest

from lodestack.config import Config
from lodestack.errors import NOT_FOUND, VALIDATION, AppError, is_kind
from lodestack.plans.engine import Engine
from lodestack.streaming import changes

GO = """package main

import (
\t"fmt"
\t"strings"
)

// helper says hello.
func helper(name string) string { return strings.ToUpper(name) }

type Server struct{ n int }

func (s *Server) Handle(x int) { fmt.Println(helper("a")) }

func main() {
\ts := &Server{}
\ts.Handle(1)
\thelper("x")
}
"""


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("code")
    (root / "main.go").write_text(GO)
    (root / "bad.go").write_text("package main\nfunc broken( {\n")
    (root / "util.py").write_text("import os\n\ndef read_config(path):\n    return open(path).read()\n\nclass Loader:\n    pass\n")
    (root / ".env").write_text("KEY=value\n")
    (root / "README.md").write_text("# Title\n\nHow the retrieval engine works.\n" * 30)
    (root / "notes.xyz").write_text("nothing")
    for skip in (".git", "node_modules", "vendor"):
        (root / skip).mkdir()
        (root / skip / "x.py").write_text("def hidden(): pass\n")
    return str(root)


@pytest.fixture(scope="module")
def engine(spark, tree, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("store")), config=Config(max_tokens=500))
    e.first = {os.path.basename(r.path): r for r in e.index(tree).collect()}
    return e


def test_first_run_reports_each_file(engine):
    assert {k: r.status for k, r in engine.first.items()} == {"main.go": "indexed", "bad.go": "error", "util.py": "indexed", ".env": "indexed", "README.md": "indexed"}
    assert engine.first["main.go"].chunks == 5 and "bracket" in engine.first["bad.go"].error


def test_second_run_skips(engine, tree):
    again = {os.path.basename(r.path): r.status for r in engine.index(tree).collect()}
    assert set(again.values()) == {"skipped", "error"}


def test_graph_of_the_tree(engine):
    name = {r.id: r.name for r in engine.nodes().collect()}
    got = {(name[r.src], name[r.dst], r.relation) for r in engine.edges().collect()}
    assert {("main", "helper", "call"), ("main", "Handle", "call"), ("Handle", "helper", "call"), ("Server", "Handle", "define")} <= got


def test_query(engine):
    out = engine.query("how does helper work", max_results=3)
    assert out["results"] and out["results"][0]["rank"] == 1
    assert "helper" in out["response"] and out["response"].startswith("<!-- RAG context: generated_at=")
    assert any(r["source"].startswith("expansion:") for r in out["results"])
    only = engine.retrieve("config loader", language="Python", expand=False).collect()
    assert only and {r.language for r in only} == {"python"}
    assert [r.rank for r in only] == sorted(r.rank for r in only)


def test_point_reads_and_errors(engine):
    row = engine.store.chunks().first()
    assert engine.store.get(row.id).content == row.content
    with pytest.raises(AppError) as e:
        engine.store.get("missing")
    assert is_kind(e.value, NOT_FOUND)
    with pytest.raises(AppError) as e:
        engine.retrieve(" ")
    assert is_kind(e.value, VALIDATION)
    with pytest.raises(AppError):
        engine.index("/no/such/place")
    assert engine.status()["files"] == 4


def test_change_feed(spark, engine, tree, tmp_path):
    path = os.path.join(tree, "late.py")

    def run():
        q = changes.start(engine, tree, str(tmp_path / "cp"), {"availableNow": True})
        q.awaitTermination(120)
        assert q.exception() is None

    run()
    with open(path, "w") as f:
        f.write("def arrives_late():\n    return 1\n")
    run()
    assert engine.store.chunks().filter("content LIKE '%arrives_late%'").count() == 1
    assert engine.store.postings().filter("term = 'arrives'").count() == 1
    os.remove(path)
    run()
    assert engine.store.chunks().filter("content LIKE '%arrives_late%'").count() == 0
    assert engine.store.postings().filter("term = 'arrives'").count() == 0
    assert engine.store.manifest().filter(f"path = '{path}'").count() == 0


def test_jobs_and_service(spark, tmp_path):
    import threading
    import time
    import urllib.request

    from lodestack import __main__ as service

    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("def answer():\n    return 42\n")
    config = Config(target=str(tmp_path / "src"), port=0)
    engine = Engine(spark, str(tmp_path / "store"), config=config)
    record = engine.run_job(config.target, "one")
    assert record["state"] == "completed" and record["files"] == {"indexed": 1} and engine.job("one") == record
    with pytest.raises(AppError) as e:
        engine.job("two")
    assert is_kind(e.value, NOT_FOUND)
    with pytest.raises(AppError):
        engine.run_job(str(tmp_path / "none"), "three")
    assert engine.job("three")["state"] == "failed"
    stop, ports = threading.Event(), []
    serve = service.http_api.serve

    def noted(*a):
        ports.append(serve(*a))
        return ports[-1]

    service.http_api.serve = noted
    try:
        thread = threading.Thread(target=service.run, args=(engine, config, stop))
        thread.start()
        for _ in range(100):
            if ports:
                break
            time.sleep(0.1)
        with urllib.request.urlopen(f"http://127.0.0.1:{ports[0].server_port}/api/status", timeout=10) as r:
            assert r.status == 200
    finally:
        stop.set()
        thread.join(120)
        service.http_api.serve = serve
    assert not thread.is_alive()
