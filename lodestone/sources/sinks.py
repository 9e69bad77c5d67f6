"""Sinks: JSON payloads, wrapped scripts, CSV in fixed forms, and batch upserts."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.scratch import dropped, filesystem
from lodestone.sources.documents import json_rows, write_document
from lodestone.sources.files import exists


def json_payload(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def wrapped_script(df: DataFrame, path: str, variable: str, *order: Column) -> None:
    """``window.<variable> = [...];`` as one file, the rows in their order; tasks write them, and no row meets another."""
    write_document(path, [f"window.{variable} = [", "];\n"], [(df, json_rows(df), list(order))])


def copy_if_present(spark: SparkSession, source: str, target: str) -> bool:
    """A verbatim copy, if the source exists."""
    if not exists(spark, source):
        return False
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    a, b = (jvm.org.apache.hadoop.fs.Path(x) for x in (source, target))
    return jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf)


def crlf_csv(df: DataFrame, path: str) -> None:
    """One UTF-8 CSV with a header and CRLF line ends, for small exports."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("lineSep", "\r\n").csv(path)


def ordered_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """CSV with a header and the fields in this order; absent fields are empty."""
    have = set(df.columns)
    df.select(*(F.col(f) if f in have else F.lit(None).cast("string").alias(f) for f in fields)).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def roster_line(columns: list[str], grade: str):
    """A comma-joined roster line; a null grade is empty, others are rounded half to even."""
    shown = F.coalesce(F.bround(F.col(grade), 0).cast("long").cast("string"), F.lit(""))
    return F.concat_ws(",", *(shown if c == grade else F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))


def upserted(df: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with changed non-null columns by key, and new keys' rows. Keys must be unique in ``changes``."""
    other = [c for c in df.columns if c not in keys]
    new = changes.select(*keys, *(F.col(c).alias(f"__new_{c}") for c in other if c in changes.columns))
    out = df.withColumn("__old", F.lit(True)).join(new, keys, "full_outer")
    return out.select(*keys, *(F.coalesce(f"__new_{c}", c).alias(c) if c in changes.columns else F.col(c) for c in other))


def ensured(df: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the rows whose key is absent; the rows there are stay as they are."""
    return df.unionByName(rows.dropDuplicates(keys).join(df.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def published(df: DataFrame, path: str, audit: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """Write a new version of the table at ``path``, audit what was written, then let readers see it by one move of a pointer file.

    ``audit`` gets the written version and raises to refuse it: the version goes,
    and the table that was there stays. A crash at any point leaves the old
    version current. ``current`` reads the table, ``rolled_back`` takes the last
    publication back.
    """
    name = f"v-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(f"{path}/{name}")
    new = df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}")
    try:
        if audit is not None:
            audit(new)
    except Exception:
        dropped(df.sparkSession, f"{path}/{name}")
        raise
    _pointed(path, [*_versions(path), name])
    return new


def _versions(path: str) -> list[str]:
    """The published versions, the current one last."""
    from pyarrow.fs import FileType

    fs, at = filesystem(f"{path}/CURRENT")
    if fs.get_file_info(at).type != FileType.File:
        return []
    with fs.open_input_file(at) as f:
        return f.read().decode().split()


def _pointed(path: str, versions: list[str]) -> None:
    fs, at = filesystem(f"{path}/CURRENT")
    with fs.open_output_stream(part := f"{at}.{uuid.uuid4().hex}") as out:
        out.write("\n".join(versions).encode())
    fs.move(part, at)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The published table."""
    versions = _versions(path)
    if not versions:
        raise FileNotFoundError(f"nothing is published at {path}")
    return spark.read.parquet(f"{path}/{versions[-1]}")


def rolled_back(spark: SparkSession, path: str) -> DataFrame:
    """Make the version before the current one current again; the one taken back is removed."""
    versions = _versions(path)
    if len(versions) < 2:
        raise ValueError(f"no earlier version at {path}")
    _pointed(path, versions[:-1])
    dropped(spark, f"{path}/{versions[-1]}")
    return current(spark, path)


def refreshed(df: DataFrame, path: str, least: int = 50, most: int = 200) -> int:
    """Publish a table, unless its number of rows is out of bounds (ValueError, and the old table stays). The plan runs once."""
    counted = []

    def audit(new: DataFrame) -> None:
        counted.append(new.count())
        if not least <= counted[0] <= most:
            raise ValueError(f"{counted[0]} rows are not within {least} and {most}")

    published(df, path, audit)
    return counted[0]
