"""Places that every executor can reach, and small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Where the session names none, a session on one machine gets a temporary folder; on a cluster that would be a folder that
    other machines cannot read, so there it is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="lodestack-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings that hold while this is open."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


BATCH_BYTES = 4 << 20
DEFAULT_BATCHES = "67108864b"  # Spark's own value
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python in batches of ``BATCH_BYTES``, unless the session sets its own size: a batch of long texts is held
    several times over, in the executor's JVM and in its Python workers."""
    if spark.conf.get(_BATCHES) == DEFAULT_BATCHES:
        spark.conf.set(_BATCHES, str(BATCH_BYTES))


_open: list[list[Workspace]] = []


@contextmanager
def scratch():
    """Deletes the workspaces made while this is open: for callers who write the operator's result before they close it."""
    _open.append([])
    try:
        yield
    finally:
        for work in _open.pop():
            work.drop()


class Workspace:
    """Tables of one operator run under the shared folder. Written tables cut lineage and survive lost executors.

    Operators drop a table once nothing reads it any more; the few that their result reads stay until its caller is done
    with it (see ``scratch``).
    """

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark = spark
        self.path = f"{shared_dir(spark)}/lodestack-{name}-{uuid.uuid4().hex}"
        if _open:
            _open[-1].append(self)

    def table(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        """Write ``df`` as Parquet and read it back with the same schema."""
        path = f"{self.path}/{name}"
        writer = df.write.mode("overwrite").option("compression", "snappy")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Delete a table, or all of them."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A whole table; one that comes as fewer splits than there are cores is dealt out by its id."""
    small_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spread(df, df.columns[0])


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
