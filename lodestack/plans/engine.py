"""The engine's front: index, delete, query, watch, status."""

from __future__ import annotations

import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..errors import check_non_empty, not_found
from ..operators import graph
from ..sources import chunker, files, models, parsers
from ..sources.store import ChunkStore
from . import prompt, retrieve

NODES = "id string, type string, name string, file_path string, metadata map<string,string>"
EDGES = "src string, dst string, relation string, seq int"
JOB_SECONDS = 600.0
STATUS = "path string, status string, chunks bigint, error string"


class Engine:
    """A collection with the models that serve it."""

    def __init__(self, spark: SparkSession, store_path: str, embedder=None, generator=None, config: Config | None = None):
        self.spark, self.config = spark, config or Config()
        self.embedder = embedder or models.HashingEmbedder()
        self.generator = generator or models.EchoGenerator()
        self.store = ChunkStore(spark, store_path, dim=len(self.embedder.embed("x")))
        self._jobs: dict[str, dict] = {}

    @classmethod
    def from_config(cls, spark: SparkSession, config: Config | None = None) -> Engine:
        """An engine with the HTTP models and the collection that the settings name."""
        c = config or Config()
        embedder = models.HttpEmbedder(c.embedder_url, c.embedding_model, workers=c.embedding_workers, most=c.max_embeddings)
        return cls(spark, f"{c.store_path.rstrip('/')}/{c.collection}", embedder, models.HttpGenerator(c.embedder_url, c.llm_model), c)

    def run_job(self, path: str, job_id: str | None = None, ceiling: float = JOB_SECONDS) -> dict:
        """Index ``path`` as a job that is stopped after ``ceiling`` seconds; its record stays for ``job``."""
        job_id = job_id or uuid.uuid4().hex
        record = self._jobs[job_id] = {"id": job_id, "path": path, "state": "running", "started": time.time()}
        sc, done = self.spark.sparkContext, threading.Event()
        sc.addJobTag(f"index-{job_id}")

        def stop() -> None:
            while not done.wait(1):  # jobs that start later are stopped too
                if time.time() - record["started"] > ceiling:
                    sc.cancelJobsWithTag(f"index-{job_id}")

        threading.Thread(target=stop, daemon=True).start()
        try:
            record["files"] = {r["status"]: r["count"] for r in self.index(path).groupBy("status").count().collect()}
            record["state"] = "completed"
        except Exception as e:
            record.update(state="failed", error=str(e))
            raise
        finally:
            done.set()
            sc.removeJobTag(f"index-{job_id}")
            record["ended"] = time.time()
        return record

    def job(self, job_id: str) -> dict:
        """The record of a job; an error where there is none."""
        if job_id not in self._jobs:
            raise not_found(f"no job {job_id}")
        return dict(self._jobs[job_id])

    def index(self, path: str) -> DataFrame:
        """Index a file or directory; unchanged files are skipped. Returns (path, status, chunks, error) per file."""
        return self._index(files.scan(self.spark, path, workers=self.config.workers))

    def index_files(self, paths: list[str]) -> DataFrame:
        """Index given files (of a change feed)."""
        found = [(p, m) for x in paths for p, m, _ in files.list_files(x)]
        listed = self.spark.createDataFrame(found, "path string, mtime double")
        rows = listed.mapInArrow(files._read, "path string, content binary, md5 string, mtime double, error string")
        return self._index(rows.withColumn("language", files.language(F.col("path"))))

    def _index(self, scanned: DataFrame) -> DataFrame:
        scanned = scanned.persist()
        try:
            readable = scanned.filter(F.col("error").isNull())
            todo = files.changed(readable, self.store.manifest())
            failed = parsers.parse_errors(todo.select("path", "content")).unionByName(scanned.filter(F.col("error").isNotNull()).select("path", "error"))
            done = todo.join(failed.select("path"), "path", "left_anti")
            parsed = parsers.parse(done.select("path", "content"))
            cut = chunker.chunk(parsed, self.config.max_chunk_size, self.config.chunk_overlap)
            rows = models.with_embeddings(cut, self.embedder)
            self.store.write_single("status", self._status(scanned, todo, failed, cut))
            paths = done.select(F.col("path").alias("file_path"))
            models.with_retry(lambda: self.store.upsert(rows, paths))  # a write is a new version, so it can be tried again
            fresh = done.select("path", "md5", "mtime")
            manifest = self.store.manifest().join(fresh.select("path"), "path", "left_anti").unionByName(fresh)
            self.store.write_single("manifest", manifest)
            return self.store.single("status", STATUS)
        finally:
            scanned.unpersist()

    @staticmethod
    def _status(scanned: DataFrame, todo: DataFrame, failed: DataFrame, cut: DataFrame) -> DataFrame:
        counts = cut.groupBy(F.col("file_path").alias("path")).agg(F.count(F.lit(1)).alias("chunks"))
        out = scanned.select("path").join(todo.select("path", F.lit(True).alias("new")), "path", "left")
        out = out.join(failed.select("path", F.col("error").alias("problem")), "path", "left").join(counts, "path", "left")
        state = F.when(F.col("problem").isNotNull(), "error").when(F.col("new"), "indexed").otherwise("skipped")
        return out.select("path", state.alias("status"), F.coalesce("chunks", F.lit(0)).cast("bigint").alias("chunks"), F.col("problem").alias("error"))

    def _current_graph(self) -> None:
        """Build the graph where chunks have changed since; many writes in a row cost one build, at the next use."""
        state = self.store.state()
        if self.store.made_of("edges") == state:
            return
        chunks = self.store.chunks()
        self.store.write_single("nodes", graph.nodes(chunks), state)
        self.store.write_single("edges", graph.edges(chunks, self.store.single("nodes", NODES)), state)

    def nodes(self) -> DataFrame:
        self._current_graph()
        return self.store.single("nodes", NODES)

    def edges(self) -> DataFrame:
        self._current_graph()
        return self.store.single("edges", EDGES)

    def delete(self, paths: list[str]) -> None:
        """Remove files from every table."""
        self.store.delete_files(self.spark.createDataFrame([(p,) for p in paths], "file_path string"))

    def retrieve(self, text: str, max_results: int = 5, language: str = "", expand: bool = True, as_of: float | None = None) -> DataFrame:
        """Ranked results of a question."""
        check_non_empty(text, "query")
        c = self.config
        return retrieve.retrieve(
            self.store.chunks(), self.store.postings(), self.store.docs(), self.edges() if expand else None, retrieve.Query(text, max_results, language, expand), self.embedder.embed(text) if c.hybrid else None,
            c.fusion, c.vector_weight, c.max_per_file, self.store.manifest(), as_of, c.bm25_k1, c.bm25_b,
        )

    def prompt(self, text: str, results: DataFrame) -> str:
        row = prompt.generate(results, text, prompt.template_by_name(self.config.prompt_template), self.config.max_tokens, model=self.config.llm_model).first()
        return row.prompt

    def query(self, text: str, max_results: int = 5, language: str = "") -> dict:
        """{response, results}: the generator's answer and the rows it saw."""
        rows = self.retrieve(text, max_results, language).persist()
        try:
            answer = self.generator.generate([{"role": "user", "content": self.prompt(text, rows)}])
            return {"response": answer, "results": [r.asDict() for r in rows.collect()]}  # at most max_results and expansion rows
        finally:
            rows.unpersist()

    def status(self) -> dict:
        """Counts of the collection."""
        chunks = self.store.chunks().agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("file_path").alias("files")).first()
        g = graph.stats(self.edges(), self.nodes()).first()
        return {"status": "ok", "time": time.time(), "chunks": chunks.chunks, "files": chunks.files, "nodes": g.nodes, "edges": g.edges}
