"""Pipe tables of a Markdown index: a stateful scan over lines and headings, as a Python table function."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "section string, section_code string, kind string, id string, name string, file string, frameworks array<string>, maturity string, temporal string, primary array<string>, secondary array<string>"
_HEADING = re.compile(r"##\s+([^(]+?)\s*(?:\(([A-Z]+)\))?\s*")


def _listed(cell: str) -> list[str]:
    return [x.strip() for x in cell.split(",") if x.strip()]


def table_rows(text: str) -> Iterator[dict]:
    """Rows of every table: a mechanism of a framework, a cross-framework mechanism, or a construct's lookup."""
    name, code, kind, head, ruled = "", "", "framework", [], False
    for line in (text or "").splitlines():
        found = _HEADING.fullmatch(line)
        if found:
            name, code, head, ruled = found[1].strip(), found[2] or "", [], False
            kind = "cross" if name.startswith("Cross-Framework") else "construct" if name.startswith("Quick Lookup") else "framework"
            code = code or (name.split()[0].upper() if kind == "framework" else "")
            continue
        inner = line.strip()
        if not (len(inner) > 2 and inner[0] == inner[-1] == "|"):
            head, ruled = [], False
            continue
        cells = [c.strip() for c in inner.strip("|").split("|")]
        if all(set(c) <= set("-: ") for c in cells):
            ruled = bool(head)
            continue
        if not ruled:
            head = [c.lower() for c in cells]
            continue
        if len(cells) < 2:
            continue
        cells += [""] * (6 - len(cells))
        row = dict.fromkeys((x.split()[0] for x in SCHEMA.split(", ")), None) | {"section": name, "section_code": code, "kind": kind, "id": cells[0], "name": cells[1]}
        if kind == "construct":
            row |= {"name": None, "primary": _listed(cells[1]), "secondary": _listed(cells[2])}
        elif kind == "cross":
            row |= {"file": cells[2], "frameworks": _listed(cells[3]), "maturity": cells[4], "temporal": cells[5]}
        elif name:
            row |= {"file": cells[2], "maturity": cells[3], "temporal": cells[4]}
        else:
            continue
        yield row


def markdown_index(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all tables of Markdown files (a row a file is read whole)."""

    @F.udtf(returnType=SCHEMA)
    class Tables:
        def eval(self, text: str):
            for row in table_rows(text):
                yield tuple(row.values())

    spark.udtf.register("lodestone_markdown_tables", Tables)
    spark.read.text(path, wholetext=True).createOrReplaceTempView("lodestone_markdown")
    return spark.sql("SELECT t.* FROM lodestone_markdown, LATERAL lodestone_markdown_tables(value) t")
