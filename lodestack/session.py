"""Session settings the engine is tuned for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


SPREAD_BYTES = 1 << 30


def tuned(spark: SparkSession) -> SparkSession:
    """Apply the defaults that can be set on a running session."""
    for k, v in DEFAULTS.items():
        spark.conf.set(k, v)
    return spark


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal rows by ``key`` where a small scan has fewer partitions than the session has cores (one small file, one row group).

    Scans of more than ``SPREAD_BYTES`` stay as they are, without a shuffle, whatever the number of cores. Rows without a key go by
    their other columns, so that they don't share a task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution()
    if int(str(plan.optimizedPlan().stats().sizeInBytes())) > SPREAD_BYTES or plan.toRdd().getNumPartitions() >= cores:
        return df
    rest = [F.col(c) for c in df.columns if c != key]
    return df.repartition(cores, F.when(F.col(key).isNull(), F.xxhash64(*rest)).otherwise(F.xxhash64(key)) if rest else F.col(key))
