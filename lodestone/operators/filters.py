"""Filters that are built at run time, and visibility rewrites."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def filled(df: DataFrame, name: str) -> Column:
    """Not null and, for strings, not ''; for arrays and maps, not empty."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        return c.isNotNull() & (c != "")
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return c.isNotNull() & (F.size(c) > 0)
    return c.isNotNull()


def with_filled(df: DataFrame, *names: str) -> DataFrame:
    return df.where(reduce(and_, (filled(df, n) for n in names), F.lit(True)))


def any_filled(df: DataFrame, names: list[str]) -> Column:
    return reduce(or_, (filled(df, n) for n in names), F.lit(False))


def all_empty(df: DataFrame, names: list[str]) -> Column:
    return ~any_filled(df, names)


def optional(df: DataFrame, **wanted) -> DataFrame:
    """Equality on each given column; None means no filter."""
    return df.where(reduce(and_, (F.col(k) == v for k, v in wanted.items() if v is not None), F.lit(True)))


def starts_with(c: Column, prefix: str, negate: bool = False) -> Column:
    """Prefix match without regard to case; wildcards in the prefix are literal."""
    hit = F.lower(c).startswith(prefix.lower())
    return ~hit if negate else hit


def same_text(c: Column, value: str | Column) -> Column:
    """Equality of trimmed texts without regard to case."""
    other = value if isinstance(value, Column) else F.lit(value)
    return F.lower(F.btrim(c)) == F.lower(F.btrim(other))


def hidden_unless(df: DataFrame, keep: Column, reason: str) -> DataFrame:
    """Visible rows that fail ``keep`` become hidden with a reason (if they have none); no row goes."""
    turn = (F.lower(F.coalesce("visibility", F.lit(""))) == "visible") & ~F.coalesce(keep, F.lit(False))
    why = F.when(turn & (F.coalesce("hide_reason", F.lit("")) == ""), F.lit(reason)).otherwise(F.col("hide_reason"))
    return df.withColumns({"hide_reason": why, "visibility": F.when(turn, "hidden").otherwise(F.col("visibility"))})


def defended(confidence: Column, least: float = 0.75) -> Column:
    return F.coalesce(confidence, F.lit(0.0)) >= least


def focused(df: DataFrame, holds: Column) -> DataFrame:
    """The rows that hold the focus; all rows if none does. The choice is made in the plan, by a one-row aggregate."""
    any_ = df.agg(F.coalesce(F.bool_or(holds), F.lit(False)).alias("__any"))
    return df.crossJoin(F.broadcast(any_)).where(~F.col("__any") | F.coalesce(holds, F.lit(False))).drop("__any")
