"""HTTP front of an engine, on the driver: POST /api/index, POST /api/query, GET /api/status, GET /api/jobs/<id>, GET /swagger/doc.json.

Indexing is accepted at once (202) and runs in the background, one run at a time and for ten minutes at most; its outcome is
logged and kept under its job's id. Bad requests give 400, what is not there 404, failures 500.
"""

from __future__ import annotations

import json
import logging
import threading
import uuid
from concurrent.futures import ThreadPoolExecutor
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from ..errors import NOT_FOUND, VALIDATION, is_kind
from ..logs import NAME

DEFAULT_RESULTS = 5
log = logging.getLogger(NAME)


def _call(summary: str, codes: dict[str, str], **fields: str) -> dict:
    out: dict = {"summary": summary, "responses": {c: {"description": d} for c, d in codes.items()}}
    if fields:
        properties = {k: {"type": v} for k, v in fields.items()}
        out["requestBody"] = {"content": {"application/json": {"schema": {"type": "object", "properties": properties}}}}
    return out


DESCRIPTION = {
    "openapi": "3.0.0",
    "info": {"title": NAME, "version": "1.0"},
    "paths": {
        "/api/index": {"post": _call("Index a file or directory", {"202": "accepted", "400": "no path"}, path="string")},
        "/api/query": {"post": _call("Answer a question", {"200": "answer and results", "400": "bad request", "500": "failure"}, query="string", max_results="integer", language="string")},
        "/api/status": {"get": _call("Whether the service is alive", {"200": "alive"})},
        "/api/jobs/{id}": {"get": _call("The record of an indexing job", {"200": "record", "404": "no such job"})},
    },
}


class Api:
    """The calls, each giving (HTTP status, body)."""

    def __init__(self, engine):
        self.engine = engine
        self._pool = ThreadPoolExecutor(max_workers=1)

    def index(self, body: dict) -> tuple[int, dict]:
        path = body.get("path")
        if not isinstance(path, str) or not path:
            return 400, {"error": "path is required"}
        job_id = uuid.uuid4().hex
        self._pool.submit(self._run, path, job_id)
        return 202, {"status": "indexing_started", "path": path, "job_id": job_id}

    def _run(self, path: str, job_id: str) -> None:
        try:
            self.engine.run_job(path, job_id)
        except Exception:  # the client is gone; the outcome is for the log and the job's record
            log.exception("indexing %s failed", path)

    def job(self, job_id: str) -> tuple[int, dict]:
        try:
            return 200, self.engine.job(job_id)
        except Exception as e:
            if is_kind(e, NOT_FOUND):
                return 404, {"error": str(e)}
            raise

    def query(self, body: dict) -> tuple[int, dict]:
        text, k = body.get("query"), body.get("max_results") or DEFAULT_RESULTS
        if not isinstance(text, str) or not isinstance(k, int):
            return 400, {"error": "query must be text and max_results a number"}
        try:
            return 200, self.engine.query(text, k, body.get("language") or "")
        except Exception as e:
            if is_kind(e, VALIDATION):
                return 400, {"error": str(e)}
            log.exception("query failed")
            return 500, {"error": str(e)}

    def status(self) -> tuple[int, dict]:
        return 200, {"status": "alive"}

    def close(self) -> None:
        self._pool.shutdown(wait=True)


def serve(api: Api, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """Start serving in a thread; ``shutdown()`` of the returned server ends it."""

    class Handler(BaseHTTPRequestHandler):
        def _send(self, code: int, body: dict) -> None:
            raw = json.dumps(body, default=str).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self) -> None:
            if self.path == "/api/status":
                self._send(*api.status())
            elif self.path.startswith("/api/jobs/"):
                self._send(*api.job(self.path.removeprefix("/api/jobs/")))
            elif self.path == "/swagger/doc.json":
                self._send(200, DESCRIPTION)
            else:
                self._send(404, {"error": "not found"})

        def do_POST(self) -> None:
            call = {"/api/index": api.index, "/api/query": api.query}.get(self.path)
            if call is None:
                return self._send(404, {"error": "not found"})
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)))
                if not isinstance(body, dict):
                    raise ValueError("not an object")
            except ValueError:
                return self._send(400, {"error": "the body must be a JSON object"})
            self._send(*call(body))

        def log_message(self, form: str, *args) -> None:
            log.debug(form, *args)

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
