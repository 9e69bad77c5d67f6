"""Unions of unlike shapes, differences and field-wise merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_shapes(*frames: DataFrame, tag: str | None = None, tags: list[str] | None = None) -> DataFrame:
    """Rows of all frames; columns that one lacks are null. With ``tag`` a column names each frame."""
    named = [f.withColumn(tag, F.lit(t)) for f, t in zip(frames, tags, strict=True)] if tag else list(frames)
    out = named[0]
    for f in named[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def id_union(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).union(b.select(key)).distinct()


def id_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key), key, "left_anti")


def merged(earlier: DataFrame, later: DataFrame, key: str) -> DataFrame:
    """Per key, column by column, the later value unless it is null or ''; keys of either side. Keys must be unique."""
    columns = [c for c in earlier.columns if c != key] + [c for c in later.columns if c != key and c not in earlier.columns]
    kinds = dict(earlier.dtypes) | dict(later.dtypes)
    a, b = (d.select(key, *(F.col(c).alias(f"__{s}_{c}") for c in d.columns if c != key)) for s, d in (("a", earlier), ("b", later)))

    def pick(c: str):
        sides = []
        if c in later.columns:
            sides.append(F.nullif(F.col(f"__b_{c}"), F.lit("")) if kinds[c] == "string" else F.col(f"__b_{c}"))
        if c in earlier.columns:
            sides.append(F.col(f"__a_{c}"))
        return F.coalesce(*sides).alias(c)

    return a.join(b, key, "full_outer").select(key, *map(pick, columns))
