"""Chunk store on Parquet: versioned buckets behind numbered pointer files.

Rows live in hash buckets of their file path. A write builds new versions of the touched buckets only, next to the old ones,
and then adds the next pointer (a small JSON file) by a rename that never replaces a file: readers see the old or the new
state, never a mix, and of two writers that started from one state the second gets a conflict and can try again. ``vacuum``
removes what no recent pointer names. Postings and document statistics are derived per bucket in the same write, so the
inverted index never drifts from the chunks.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import conflict, not_found, validation
from ..functions import text
from ..schema import CHUNKS, MANIFEST, POSTINGS

POINTERS = "pointers"
PART_BYTES = 4 << 20  # of stored chunks, indexed by one task
VERSIONS = ("v-", "manifest-", "status-", "nodes-", "edges-")
TABLES = {"chunks": CHUNKS, "postings": POSTINGS + ", file_path string", "docs": "id string, dl bigint, preview string, file_path string"}


class ChunkStore:
    """Chunks of one collection, their inverted index, the file manifest and the dependency graph."""

    def __init__(self, spark: SparkSession, path: str, dim: int = 384, buckets: int = 64):
        self.spark, self.path, self.dim, self.buckets = spark, path.rstrip("/"), dim, buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        head = self._load()
        if head is None:
            self._save({"dim": dim, "buckets": buckets, "versions": {}, "single": {}})
        elif head["dim"] != dim:
            raise validation(f"the collection has vectors of {head['dim']}, not {dim}")
        else:
            self.buckets = head["buckets"]

    # pointer -------------------------------------------------------------------------------------------------------------
    def _pointers(self) -> list[int]:
        at = self._path(f"{self.path}/{POINTERS}")
        names = [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _pointer(self, n: int):
        return self._path(f"{self.path}/{POINTERS}/{n:012d}.json")

    def _load(self, n: int | None = None) -> dict | None:
        if n is None:
            there = self._pointers()
            if not there:
                return None
            n = there[-1]
        stream = self._fs.open(self._pointer(n))
        try:
            raw = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(raw) | {"n": n}

    def _save(self, head: dict) -> None:
        """Add the pointer that follows the one ``head`` was loaded from; a conflict where another writer was first."""
        head = head | {"n": head.get("n", 0) + 1}
        part = self._path(f"{self.path}/{POINTERS}/part-{uuid.uuid4().hex}")
        out = self._fs.create(part, True)
        out.write(bytearray(json.dumps(head).encode()))
        out.close()
        sc, jvm = self.spark.sparkContext, self.spark.sparkContext._jvm
        how = sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        how[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), sc._jsc.hadoopConfiguration())
        try:
            context.rename(part, self._pointer(head["n"]), how)
        except Py4JJavaError as e:
            self._fs.delete(part, False)
            if e.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                raise
            raise conflict(f"another writer made version {head['n']} of the collection") from e

    def state(self) -> str:
        """A name of the chunks' state; equal states have equal chunks."""
        return hashlib.md5(json.dumps(self._load()["versions"], sort_keys=True).encode()).hexdigest()

    def vacuum(self, keep: int = 10) -> int:
        """Delete versions and pointers that none of the ``keep`` last pointers names; returns how many. Not while others write."""
        numbers = self._pointers()
        used = set()
        for n in numbers[-max(1, keep) :]:
            head = self._load(n)
            used |= set(head["versions"].values()) | set(head["single"].values())
        gone = [self._pointer(n) for n in numbers[: -max(1, keep)]]
        for f in self._fs.listStatus(self._path(self.path)):
            name = f.getPath().getName()
            if f.isDirectory() and any(name.startswith(x) for x in VERSIONS) and name not in used:
                gone.append(f.getPath())
        for at in gone:
            self._fs.delete(at, True)
        return len(gone)

    # reads ---------------------------------------------------------------------------------------------------------------
    def _read(self, table: str, buckets: list[str] | None = None, versions: dict | None = None) -> DataFrame:
        versions = self._load()["versions"] if versions is None else versions
        picked = [f"{self.path}/{v}/{table}/bucket={b}" for b, v in sorted(versions.items()) if buckets is None or b in buckets]
        live = [p for p in picked if self._fs.exists(self._path(p))]
        schema = TABLES[table]
        return self.spark.read.schema(schema).parquet(*live) if live else self.spark.createDataFrame([], schema)

    def chunks(self) -> DataFrame:
        return self._read("chunks")

    def postings(self) -> DataFrame:
        return self._read("postings").drop("file_path")

    def docs(self) -> DataFrame:
        return self._read("docs").drop("file_path")

    def single(self, name: str, schema: str) -> DataFrame:
        """A table kept as a whole (manifest, nodes, edges)."""
        version = self._load()["single"].get(name)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{version}") if version else self.spark.createDataFrame([], schema)

    def manifest(self) -> DataFrame:
        return self.single("manifest", MANIFEST)

    def get(self, chunk_id: str):
        """One chunk by id; an error where there is none."""
        rows = self.chunks().filter(F.col("id") == chunk_id).limit(1).collect()
        if not rows:
            raise not_found(f"no chunk {chunk_id}")
        return rows[0]

    # writes --------------------------------------------------------------------------------------------------------------
    def _bucket(self):
        return F.pmod(F.xxhash64("file_path"), F.lit(self.buckets)).cast("int")

    def _replace(self, new: DataFrame | None, paths: DataFrame) -> None:
        """Replace all rows of the files in ``paths`` by ``new``."""
        head = self._load()
        held = head["versions"]
        gone = paths.select("file_path").distinct()
        touched = [str(r.bucket) for r in gone.select(self._bucket().alias("bucket")).distinct().collect()]  # at most the number of buckets
        if not touched:
            return
        kept = self._read("chunks", touched, held).join(gone, "file_path", "left_anti")
        cols = [c.split(" ")[0] for c in CHUNKS.split(", ")]
        if new is not None:
            if "embedding" not in new.columns:
                new = new.withColumn("embedding", F.lit(None).cast("array<float>"))
            kept = kept.select(*cols).unionByName(new.select(*cols)).dropDuplicates(["id"])
        version = f"v-{uuid.uuid4().hex}"
        rows = kept.withColumn("bucket", self._bucket())
        rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{version}/chunks")
        fresh = self.spark.read.schema(CHUNKS + ", bucket int").parquet(f"{self.path}/{version}/chunks")
        text_rows = self._dealt(fresh.select("id", "file_path", "bucket", "content"), f"{self.path}/{version}/chunks", touched)
        toks = text_rows.select("id", "file_path", "bucket", "part", text.once(text.tokens(F.col("content"))).alias("tokens"))
        posts = toks.select("id", "file_path", "bucket", "part", F.explode("tokens").alias("term")).groupBy("term", "id", "file_path", "bucket", "part").agg(F.count(F.lit(1)).alias("tf"))
        posts.drop("part").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{self.path}/{version}/postings")
        lengths = self.spark.read.schema(POSTINGS + ", bucket int").parquet(f"{self.path}/{version}/postings").groupBy("id").agg(F.sum("tf").alias("dl"))
        docs = fresh.select("id", text.preview(F.col("content")).alias("preview"), "file_path", "bucket").join(lengths, "id", "left")  # texts are split once
        docs.select("id", F.coalesce("dl", F.lit(0)).cast("bigint").alias("dl"), "preview", "file_path", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{version}/docs")
        head["versions"].update({b: version for b in touched})
        self._save(head)

    def _dealt(self, rows: DataFrame, path: str, buckets: list[str]) -> DataFrame:
        """Rows of the buckets just written, dealt to parts of about ``PART_BYTES`` within each: a bucket of any size is indexed by
        as many tasks as it needs, and all rows of a chunk are in one of them, so its postings are counted where they are."""
        size = lambda b: self._fs.getContentSummary(self._path(f"{path}/bucket={b}")).getLength() if self._fs.exists(self._path(f"{path}/bucket={b}")) else 0
        parts = {int(b): -(-size(b) // PART_BYTES) or 1 for b in buckets}
        many = F.create_map(*[F.lit(x) for pair in parts.items() for x in pair])
        part = F.pmod(F.xxhash64("id"), F.element_at(many, F.col("bucket")).cast("bigint")).cast("int")
        return rows.withColumn("part", part).repartition(sum(parts.values()), "bucket", "part")

    def upsert(self, chunks: DataFrame, paths: DataFrame | None = None) -> None:
        """Store chunks; all earlier rows of the files in ``paths`` (default: the chunks' files) go."""
        self._replace(chunks, chunks.select("file_path") if paths is None else paths)

    def delete_files(self, paths: DataFrame) -> None:
        """Remove files from chunks, index and manifest."""
        self._replace(None, paths)
        self.write_single("manifest", self.manifest().join(paths.select(F.col("file_path").alias("path")), "path", "left_anti"))

    def write_single(self, name: str, rows: DataFrame, of: str | None = None) -> None:
        """Write a table that is kept as a whole; ``of`` notes the state of the chunks that it was made from."""
        version = f"{name}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{version}")
        head = self._load()
        head["single"][name] = version
        if of is not None:
            head.setdefault("made_of", {})[name] = of
        self._save(head)

    def made_of(self, name: str) -> str | None:
        return self._load().get("made_of", {}).get(name)

    def clear(self) -> None:
        head = self._load()
        self._save(head | {"versions": {}, "single": {}, "made_of": {}})
