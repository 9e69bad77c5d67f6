"""Small tables for the tests of the training-text operators, and the given test documents."""

import re

import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"
WORDS = re.compile("[^\x20\x09-\x0d]+")


def table(name, sf=SF):
    return pq.read_table(f"{sf}/{name}.parquet").to_pylist()


def given(spark, rows, schema="doc_id long, text string, id long, row string, lines string, chunk string, fp string, rid string"):
    """A table with null, empty and blank texts, repeated rows and extra columns with clashing names."""
    extra = schema.count(",") - 1
    return spark.createDataFrame([(a, b, *([None] * 1), *(["x"] * (extra - 1))) for a, b in rows], schema)


ODD = [
    (1, None), (2, ""), (3, " \n\t\n "), (4, "one two three"), (4, "one two three"), (None, "one two three"), (5, "ONE Two three\nNav | nav\n\nlast line."),
    (6, "a b été\r\nx\x0by"), (7, "word " * 3000), (8, " ".join(f"w{i % 977}x{i % 31}" for i in range(20000))), (9, "!!! $$$ ### |||"), (10, "ÉCOLE école ZÉ"),
]
