"""File sources: JSON, JSON lines, per-paper files, CSV rosters, Markdown, HTML, YAML, PDF bytes and JDBC tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import body, front_matter, html_page, markdown_headings


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or a glob names anything, by the file system of its scheme."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_document(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A whole-file JSON document; no rows if the file is absent or malformed."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType, strict: bool = False) -> DataFrame:
    """JSON lines; bad lines are dropped, or fail the read if ``strict``. No rows if the file is absent."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def per_paper(spark: SparkSession, glob: str, schema: str | T.StructType, key: str = "paper_id", recursive: bool = False) -> DataFrame:
    """One JSON document a file; a missing key is the file's name up to its first full stop."""
    if not recursive and not exists(spark, glob):
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED")
    if recursive:
        folder, _, pattern = glob.rpartition("/")
        reader, glob = reader.option("recursiveFileLookup", True).option("pathGlobFilter", pattern), folder
        if not exists(spark, folder):
            return spark.createDataFrame([], schema)
    named = F.substring_index(F.col("_metadata.file_name"), ".", 1)
    return reader.json(glob).withColumn(key, F.coalesce(F.nullif(F.btrim(F.col(key)), F.lit("")), named))


def named_files(spark: SparkSession, catalogue: DataFrame, path_col: str, schema: str | T.StructType, wanted: DataFrame, key: str = "paper_id") -> DataFrame:
    """Rows of JSON-lines files that a table names, for wanted keys; of a key's rows the first (by path, then line) stays.

    The list of distinct paths goes through the driver, as any list of inputs
    does; rows never do.
    """
    from pyspark.sql import Window

    paths = sorted(r[0] for r in catalogue.select(path_col).where(F.col(path_col).isNotNull()).distinct().collect())
    paths = [p for p in paths if exists(spark, p)]
    if not paths:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(paths).withColumns({"__path": F.col("_metadata.file_path"), "__line": F.monotonically_increasing_id()})
    rows = rows.join(wanted.select(key).distinct(), key, "left_semi")
    first = F.row_number().over(Window.partitionBy(key).orderBy("__path", "__line"))
    return rows.withColumn("__n", first).where("__n = 1").drop("__n", "__path", "__line")


def items(df: DataFrame, *columns: str) -> DataFrame:
    """The elements of the first non-null container of ``columns``: arrays, or a map's values."""
    kinds = dict(df.dtypes)
    lists = [F.map_values(c) if kinds[c].startswith("map") else F.col(c) for c in columns]
    return df.select(F.explode(F.coalesce(*lists)).alias("item")).select("item.*")


def roster_csv(spark: SparkSession, path: str, aliases: dict[str, tuple[str, ...]], required: tuple[str, ...]) -> DataFrame:
    """A CSV whose headers are matched by alias, without regard to case, blanks or a byte-order mark.

    Missing required columns raise ValueError.
    """
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    plain = {re.sub(r"^﻿", "", c).strip().lower(): c for c in raw.columns}
    found = {name: next((plain[a.lower()] for a in (name, *options) if a.lower() in plain), None) for name, options in aliases.items()}
    lacking = [name for name in required if not found.get(name)]
    if lacking:
        raise ValueError(f"columns not found: {', '.join(lacking)}")
    return raw.select(*(F.btrim(F.col(f"`{c}`")).alias(name) for name, c in found.items() if c))


def html_tree(spark: SparkSession, folder: str, skip_folders: tuple[str, ...] = (), skip_files: tuple[str, ...] = (), decode: bool = True) -> DataFrame:
    """One row a page below ``folder``: path, title, headings, excerpt, full_len, size_kb."""
    pages = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.html").text(folder, wholetext=True)
    pages = pages.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_size").alias("size"))
    for part in skip_folders:
        pages = pages.where(~F.col("path").contains(f"/{part}/"))
    if skip_files:
        pages = pages.where(~F.col("name").isin(*skip_files))
    fields = html_page(F.col("value"), decode)
    return pages.select("path", *(c.alias(k) for k, c in fields.items()), F.floor(F.col("size") / 1024).alias("size_kb"))


#: Labels of article types.
TYPE_LABELS = {"empirical_research": "Empirical", "review": "Review", "meta_analysis": "Meta-analysis", "meta-analysis": "Meta-analysis", "theoretical": "Theoretical", "book_chapter": "Book chapter", "case_study": "Case study", "narrative_review": "Narrative review", "systematic_review": "Systematic review", "design_guideline": "Design guideline", "methodology": "Methodology"}


def markdown_entries(spark: SparkSession, folder: str, least_words: int = 80) -> DataFrame:
    """Search entries of Markdown files with front matter; files of fewer words than ``least_words`` give none."""
    files = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.md$", "")
    rows = files.select(stem.alias("stem"), front_matter(F.col("value")).alias("meta"), F.btrim(body(F.col("value")), F.lit(" \t\r\n")).alias("body"))
    words = F.size(F.filter(F.split("body", r"(?U)\s+"), lambda w: w != ""))
    heading = F.nullif(F.btrim(F.regexp_extract("body", r"(?m)^#+\s+(.+)$", 1)), F.lit(""))
    get = lambda k: F.try_element_at("meta", F.lit(k))
    key = F.coalesce(get("pdf_id"), F.col("stem"))
    kind = F.coalesce(get("article_type"), F.lit(""))
    label = F.coalesce(*(F.when(kind == k, v) for k, v in TYPE_LABELS.items()), F.initcap(F.replace(kind, F.lit("_"), F.lit(" "))))
    return rows.withColumn("word_count", words).where(F.col("word_count") >= least_words).select(
        key.alias("pdf_id"), F.concat(F.lit("research/"), key).alias("path"), F.coalesce(F.nullif(get("title"), F.lit("")), heading, key).alias("title"),
        F.coalesce(get("authors"), F.lit("")).alias("authors"), F.coalesce(get("year"), F.lit("")).alias("year"), label.alias("article_type"),
        F.substring(F.regexp_replace("body", r"\s+", " "), 1, 1200).alias("excerpt"), markdown_headings(F.col("body")).alias("headings"), F.length("body").alias("full_len"), "word_count",
    )


def yaml_rows(spark: SparkSession, path: str, key: str, schema: str | T.StructType) -> DataFrame:
    """The items of the list under a top-level key of YAML files (a path or pattern), each file parsed where it is read.

    A file without the key gives no row. Needs the yaml package.
    """
    fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator) -> Iterator:
        import pandas as pd
        import yaml

        for batch in batches:
            items = [x for text in batch["value"] for x in (yaml.safe_load(text) or {}).get(key) or []]
            yield pd.DataFrame([[x.get(f.name) for f in fields] for x in items], columns=[f.name for f in fields], dtype=object)

    return spark.read.text(path, wholetext=True).mapInPandas(run, fields)


def first_available(spark: SparkSession, paths: list[str], schema: str | T.StructType) -> DataFrame:
    """The JSON document at the first path that exists; no rows if none does."""
    path = next((p for p in paths if exists(spark, p)), None)
    return json_document(spark, path, schema) if path else spark.createDataFrame([], schema)


def jdbc_table(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A database table; predicates and columns are pushed down. Its driver must be on the class path."""
    return spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options).load()


def pdf_files(spark: SparkSession, glob: str) -> DataFrame:
    """path, content (binary) and length of PDF files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", True).load(glob).select("path", "content", "length")


def pdf_text(files: DataFrame, most: int | None = None) -> DataFrame:
    """path, text and status of PDF bytes, in Arrow batches: by pypdf where it is installed, else the literal strings of uncompressed streams.

    ``status`` is 'text', 'empty' (no text found) or the reason why a file
    could not be read. ``most`` cuts the text; by default it is whole.
    """

    def plain(data: bytes) -> tuple[str, str]:
        try:
            import io

            import pypdf
        except ImportError:
            found = " ".join(x.decode("latin-1") for x in re.findall(rb"\(((?:[^()\\]|\\.)*)\)\s*Tj", data))
        else:
            try:
                found = " ".join((page.extract_text() or "") for page in pypdf.PdfReader(io.BytesIO(data)).pages)
            except Exception as e:  # noqa: BLE001 - any damage of a file is its row's status
                return "", f"unreadable: {type(e).__name__}: {e}"
        return found, "text" if found.strip() else "empty"

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            read = [plain(bytes(x)) for x in pdf["content"]]
            yield pdf[["path"]].assign(text=[t[:most] for t, _ in read], status=[s for _, s in read])

    return files.select("path", "content").mapInPandas(run, "path string, text string, status string")
