"""Arrays, JSON, numbers and bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def move_to_front(a: Column, x: Column) -> Column:
    return F.concat(F.array(x), F.array_remove(F.coalesce(a, F.array().cast("array<string>")), x))


def json_number(c: Column, path: str) -> Column:
    """A number at a JSON path; null if the JSON, the path or the number is bad."""
    return F.get_json_object(c, path).try_cast("double")


def json_strings(c: Column) -> Column:
    """A JSON array of strings; null if malformed."""
    return F.from_json(c, "array<string>", {"mode": "PERMISSIVE"})


def half_open_bin(c: Column, edges: list[float]) -> Column:
    """'[a,b)' of the bin that holds a value, null outside."""
    out = F.lit(None).cast("string")
    for a, b in zip(edges, edges[1:], strict=False):
        out = F.when((c >= a) & (c < b), f"[{a:g},{b:g})").otherwise(out)
    return out


def capped_ratio(a: Column, b: Column) -> Column:
    """100 a / b, rounded half up, at most 100; 0 where b is 0."""
    return F.when(F.coalesce(b, F.lit(0)) == 0, 0).otherwise(F.least(F.lit(100), F.floor(100 * a / b + 0.5))).cast("int")


def rounded(c: Column, places: int) -> Column:
    """A double to so many decimals as SQL's round: the scaled double to the nearest whole number, halves away from zero.

    Spark's own round and bround judge the decimal digits that show the double.
    """
    return F.round(c * F.lit(10.0**places), 0) / F.lit(10.0**places)


def lexicon_score(text: Column, hints: list[tuple[str, str]], weight: float = 1.0) -> Column:
    """map<node, score>: ``weight`` for each (node, hint) whose hint the lower-cased text holds."""
    low = F.lower(F.coalesce(text, F.lit("")))
    by_node: dict[str, list[str]] = {}
    for node, hint in hints:
        by_node.setdefault(node, []).append(hint)
    scores = [F.struct(F.lit(n).alias("key"), (sum((low.contains(h).cast("int") for h in hs), F.lit(0)) * F.lit(weight)).alias("value")) for n, hs in by_node.items()]
    return F.map_from_entries(F.filter(F.array(*scores), lambda x: x["value"] > 0))


def dedupe_key(*cs: Column) -> Column:
    return F.concat_ws("::", *(F.coalesce(c.cast("string"), F.lit("")) for c in cs))
