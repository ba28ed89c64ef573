"""The HTTP front over a stand-in engine, and logging."""

import io
import json
import time
import urllib.error
import urllib.request

from lodestack import logs
from lodestack.errors import EXTERNAL, AppError, not_found, validation
from lodestack.plans.http_api import Api, serve


class Engine:
    def __init__(self):
        self.jobs = {}

    def run_job(self, path, job_id):
        self.jobs[job_id] = {"path": path, "state": "failed" if path == "/bad" else "completed"}
        if path == "/bad":
            raise AppError(EXTERNAL, "no such thing")

    def job(self, job_id):
        if job_id not in self.jobs:
            raise not_found("no such job")
        return self.jobs[job_id]

    def query(self, text, k, language):
        if text == "fail":
            raise AppError(EXTERNAL, "model is down")
        if not text:
            raise validation("query must not be empty")
        return {"response": f"{text}:{k}:{language}", "results": []}


def test_calls():
    api = Api(Engine())
    server = serve(api, port=0)
    base = f"http://127.0.0.1:{server.server_port}"

    def call(path, body=None, raw=None):
        data = raw if raw is not None else None if body is None else json.dumps(body).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, data), timeout=10) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    assert call("/api/status") == (200, {"status": "alive"}) and call("/nope")[0] == 404 and call("/nope", {})[0] == 404
    assert call("/api/index", {"path": "/x"})[0] == 202 and call("/api/index", {})[0] == 400 and call("/api/index", raw=b"{")[0] == 400
    assert call("/api/query", {"query": "how"}) == (200, {"response": "how:5:", "results": []})
    assert call("/api/query", {"query": "how", "max_results": 2, "language": "go"})[1]["response"] == "how:2:go"
    assert call("/api/query", {"query": "fail"})[0] == 500 and call("/api/query", {"query": ""})[0] == 400 and call("/api/query", raw=b"[]")[0] == 400
    for path, state in (("/x", "completed"), ("/bad", "failed")):
        code, started = call("/api/index", {"path": path})
        assert code == 202 and started["status"] == "indexing_started" and started["path"] == path
        for _ in range(100):
            code, job = call(f"/api/jobs/{started['job_id']}")
            if code == 200:
                break
            time.sleep(0.05)
        assert job == {"path": path, "state": state}
    assert call("/api/jobs/none")[0] == 404
    paths = call("/swagger/doc.json")[1]["paths"]
    assert set(paths) == {"/api/index", "/api/query", "/api/status", "/api/jobs/{id}"} and set(paths["/api/index"]["post"]["responses"]) == {"202", "400"}
    server.shutdown()
    api.close()


def test_logging():
    out = io.StringIO()
    logs.init("warn", "json", out)
    logs.with_fields(path="a.py").warning("slow %s", "read")
    logs.with_fields().info("hidden")
    row = json.loads(out.getvalue())
    assert row["msg"] == "slow read" and row["path"] == "a.py" and row["level"] == "WARNING"
    assert logs.init("nonsense").level == 20
