"""File scans. Listing happens on the driver, reading on the executors.

Directories whose name starts with a dot, ``node_modules`` and ``vendor`` are skipped below the root (never the root
itself); hidden files are kept. Only files of a known language are listed.
"""

from __future__ import annotations

import fnmatch
import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import check_directory
from ..functions.language import language, language_of_path

SKIPPED = ("node_modules", "vendor")
FILES_A_TASK = 10_000  # at most


def skipped_dir(name: str) -> bool:
    return name.startswith(".") or name in SKIPPED


def list_files(root: str, exclude: tuple[str, ...] = ()) -> list[tuple[str, float, int]]:
    """(path, mtime, size) of the files to index under a directory, or of a single file. Any listing error is raised."""
    check_directory(root)
    if os.path.isfile(root):
        paths = [root]
    else:
        paths = []

        def fail(error: OSError) -> None:
            raise error

        for top, dirs, names in os.walk(root, onerror=fail):
            dirs[:] = sorted(d for d in dirs if not skipped_dir(d))
            paths += [os.path.join(top, n) for n in sorted(names)]
    keep = [p for p in paths if language_of_path(p) != "unknown" and not any(fnmatch.fnmatch(p, g) for g in exclude)]
    return [(p, (s := os.stat(p)).st_mtime, s.st_size) for p in keep]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):  # one file in memory at a time
            path, mtime = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            content, error = b"", None
            try:
                with open(path, "rb") as f:
                    content = f.read()
            except OSError as e:
                error = str(e)
            md5 = hashlib.md5(content).hexdigest()
            yield pa.RecordBatch.from_arrays(
                [pa.array([path]), pa.array([content], pa.binary()), pa.array([md5]), pa.array([mtime]), pa.array([error], pa.string())],
                names=["path", "content", "md5", "mtime", "error"],
            )


def scan(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), workers: int = 0) -> DataFrame:
    """(path, content, md5, mtime, error, language) of every file; an unreadable file has its error and no content.

    Read by ``workers`` tasks (default: four a core), or by more where a task would get more than ``FILES_A_TASK`` files.
    """
    listed = list_files(root, exclude)
    paths = spark.createDataFrame([(p, m) for p, m, _ in listed] or [], "path string, mtime double")
    wanted = workers or spark.sparkContext.defaultParallelism * 4
    parts = max(1, min(len(listed), wanted), -(-len(listed) // FILES_A_TASK))
    rows = paths.repartition(parts).mapInArrow(_read, "path string, content binary, md5 string, mtime double, error string")
    return rows.withColumn("language", language(F.col("path")))


def changed(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose content differs from the manifest's (path, md5)."""
    return files.join(manifest.select("path", "md5"), ["path", "md5"], "left_anti")
