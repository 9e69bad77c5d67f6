"""Intermediate tables in the folder that driver and executors share, and how they are given back."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Open scopes of this driver, innermost last: each lists the paths made in it.
_scopes: list[list[str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session of one machine (``local[...]``) that has none gets a
    temporary folder; any other master without the setting is an error, as
    each executor would write to its own disk.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
        root = sc.getCheckpointDir()
    return root.rstrip("/")


def application_root(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/lodestone/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder; nothing is created yet."""
    path = f"{application_root(spark)}/{tag}-{uuid.uuid4().hex}"
    for scope in _scopes[-1:]:
        scope.append(path)
    return path


def written(df: DataFrame, path: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to ``path`` and read it back: lineage ends in shared files."""
    out = df.write.option("compression", "zstd")
    (out.partitionBy(partition_by) if partition_by else out).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(path: str):
    """pyarrow's file system for a URI or plain path of the shared folder, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def dropped(spark: SparkSession, *paths: str) -> None:
    """Remove scratch tables that no remaining plan reads."""
    jvm = spark._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[list[str]]:
    """Scratch tables made inside are removed at the end, so write the result inside: ``written(op(docs), path)``.

    A path that is removed from the yielded list stays. Operators return lazy
    results that may read their scratch tables; outside a scope these stay
    until ``cleared``.
    """
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield paths
    finally:
        _scopes.remove(paths)
        dropped(spark, *paths)


def cleared(spark: SparkSession) -> None:
    """Remove all scratch tables of this application; results that still read them become unreadable."""
    dropped(spark, application_root(spark))
