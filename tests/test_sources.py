"""Sources and sinks over files that the tests write."""

import json
import sqlite3

import pytest
from conftest import SF
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.sources import files, sinks
from lodestone.sources.documents import json_rows, write_document
from lodestone.sources.markdown_tables import markdown_index
from lodestone.sources.papers import write_papers
from lodestone.sources.sqlite import SqliteReader, sqlite_table
from lodestone.streaming.events import append_log, event_stream, windowed_counts


def test_json(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1}\n\nnot json\n{"k": 2}\n')
    assert sorted(r[0] for r in files.json_lines(spark, f"{tmp_path}/a.jsonl", "k int").collect()) == [1, 2]
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        files.json_lines(spark, f"{tmp_path}/a.jsonl", "k int", strict=True).collect()
    assert files.json_document(spark, f"{tmp_path}/none.json", "k int").count() == 0
    for n, doc in (("P1.x.json", {"v": 1}), ("P2.x.json", {"paper_id": "Q", "v": 2})):
        (tmp_path / n).write_text(json.dumps(doc))
    rows = files.per_paper(spark, f"{tmp_path}/*.x.json", "paper_id string, v int")
    assert sorted((r["paper_id"], r["v"]) for r in rows.collect()) == [("P1", 1), ("Q", 2)]
    (tmp_path / "box.json").write_text('{"nodes": null, "topics": {"a": {"id": "1"}, "b": {"id": "2"}}}')
    box = files.json_document(spark, f"{tmp_path}/box.json", "nodes array<struct<id:string>>, topics map<string,struct<id:string>>")
    assert sorted(r["id"] for r in files.items(box, "nodes", "topics").collect()) == ["1", "2"]
    catalogue = spark.createDataFrame([(f"{tmp_path}/a.jsonl",), (f"{tmp_path}/lost.jsonl",)], "p string")
    assert files.named_files(spark, catalogue, "p", "k int", spark.createDataFrame([(2,)], "k int"), "k").count() == 1


def test_roster(spark, tmp_path):
    (tmp_path / "r.csv").write_text("﻿Student ID, E-Mail ,x\n7, a@b ,1\n")
    names = {"sid": ("student id", "pid"), "email": ("e-mail",), "section": ("sec",)}
    assert [tuple(r) for r in files.roster_csv(spark, f"{tmp_path}/r.csv", names, ("sid",)).collect()] == [("7", "a@b")]
    with pytest.raises(ValueError, match="section"):
        files.roster_csv(spark, f"{tmp_path}/r.csv", names, ("section",))


def test_pages(spark, tmp_path):
    (tmp_path / "docs" / "skip").mkdir(parents=True)
    (tmp_path / "docs" / "a.html").write_text("<title>T &amp; x</title><h1>H</h1>body")
    (tmp_path / "docs" / "skip" / "b.html").write_text("<title>No</title>")
    rows = files.html_tree(spark, f"{tmp_path}/docs", ("skip",)).collect()
    assert [(r["title"], r["headings"]) for r in rows] == [("T & x", ["H"])]
    (tmp_path / "md").mkdir()
    (tmp_path / "md" / "PDF-1.md").write_text("---\narticle_type: review\nyear: 2020\n---\n# Head one\n" + "word " * 90)
    (tmp_path / "md" / "PDF-2.md").write_text("short")
    row = files.markdown_entries(spark, f"{tmp_path}/md").collect()
    assert [(r["pdf_id"], r["title"], r["year"], r["article_type"], r["headings"]) for r in row] == [("PDF-1", "Head one", "2020", "Review", ["Head one"])]


def test_markdown_tables(spark, tmp_path):
    (tmp_path / "i.md").write_text("# Index\n## Predictive Processing (PP)\n| ID | Name | File | Maturity | Temporal |\n| --- | --- | --- | --- | --- |\n| P1 | One | p1.md | high | fast |\n\n## Cross-Framework Mechanisms\n| ID | Name | File | Frameworks | Maturity | Temporal |\n|---|---|---|---|---|---|\n| X1 | Ex | x.md | PP, AA | low | slow |\n\n## Quick Lookup\n| Construct | Primary | Secondary |\n|---|---|---|\n| stress | P1, X1 | |\n")
    rows = {r["id"]: r for r in markdown_index(spark, f"{tmp_path}/i.md").collect()}
    assert (rows["P1"]["section_code"], rows["P1"]["maturity"]) == ("PP", "high") and rows["X1"]["frameworks"] == ["PP", "AA"]
    assert (rows["stress"]["kind"], rows["stress"]["primary"], rows["stress"]["secondary"]) == ("construct", ["P1", "X1"], [])


def test_database_and_pdf(spark, tmp_path):
    with sqlite3.connect(tmp_path / "x.db") as db:
        db.execute("CREATE TABLE t (a TEXT, n INTEGER)")
        db.executemany("INSERT INTO t VALUES (?, ?)", [("x", 1), ("y", None)])
    assert sorted(r["a"] for r in sqlite_table(spark, f"{tmp_path}/x.db", "t").collect()) == ["x", "y"]
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4\nBT (Hello) Tj ET\n%%EOF")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4 no text")
    rows = {r["path"][-5:]: r["status"] for r in files.pdf_text(files.pdf_files(spark, str(tmp_path))).collect()}
    assert set(rows) == {"a.pdf", "b.pdf"} and rows["b.pdf"] != "text"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 88.5), ("b", None)], "name string, grade double")
    sinks.crlf_csv(df, f"{tmp_path}/c")
    assert b"".join(p.read_bytes() for p in (tmp_path / "c").glob("part*")).startswith(b"name,grade\r\na,88.5\r\n")
    assert [r[0] for r in df.select(sinks.roster_line(["name", "grade"], "grade")).collect()] == ["a,88", "b,"]
    sinks.wrapped_script(df, f"{tmp_path}/data.js", "DATA", F.col("name"))
    assert (tmp_path / "data.js").read_text() == 'window.DATA = [{"name":"a","grade":88.5},{"name":"b","grade":null}];\n'
    sinks.ordered_csv(df, f"{tmp_path}/o", ["grade", "lost", "name"])
    assert "".join(p.read_text() for p in (tmp_path / "o").glob("part*")).splitlines()[0] == "grade,lost,name"
    base = spark.createDataFrame([(1, "x", "p"), (2, "y", "q")], "k int, a string, b string")
    changes = spark.createDataFrame([(2, "z"), (3, "n")], "k int, a string")
    assert sorted(map(tuple, sinks.upserted(base, changes, ["k"]).collect())) == [(1, "x", "p"), (2, "z", "q"), (3, "n", None)]
    assert sorted(r["k"] for r in sinks.ensured(base, changes, ["k"]).collect()) == [1, 2, 3]
    with pytest.raises(ValueError, match="not within"):
        sinks.refreshed(base, f"{tmp_path}/t")
    with pytest.raises(FileNotFoundError):
        sinks.current(spark, f"{tmp_path}/t")
    assert sinks.refreshed(base, f"{tmp_path}/t", 1, 9) == 2
    # A table may be refreshed from itself; a refused version leaves the current one, and a publication can be taken back.
    more = sinks.current(spark, f"{tmp_path}/t").union(base)
    assert sinks.refreshed(more, f"{tmp_path}/t", 1, 9) == 4
    with pytest.raises(ValueError, match="not within"):
        sinks.refreshed(base.limit(0), f"{tmp_path}/t", 1, 9)
    assert sinks.current(spark, f"{tmp_path}/t").count() == 4 and sinks.rolled_back(spark, f"{tmp_path}/t").count() == 2
    assert len([p for p in (tmp_path / "t").iterdir() if p.is_dir()]) == 1
    with pytest.raises(ValueError, match="no earlier"):
        sinks.rolled_back(spark, f"{tmp_path}/t")
    sinks.json_payload(df, f"{tmp_path}/j")
    assert sinks.copy_if_present(spark, f"{tmp_path}/j", f"{tmp_path}/j2") and not sinks.copy_if_present(spark, f"{tmp_path}/none", f"{tmp_path}/j3")


def test_yaml_files(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("rooms:\n  - {name: hall, size: 3}\n  - name: attic\nother: 1\n")
    (tmp_path / "b.yaml").write_text("rooms:\n  - {name: yard, size: 9, extra: x}\n")
    (tmp_path / "c.yaml").write_text("")
    got = files.yaml_rows(spark, f"{tmp_path}/*.yaml", "rooms", "name string, size long").collect()
    assert sorted(map(tuple, got)) == [("attic", None), ("hall", 3), ("yard", 9)]


def test_jdbc_table_pushes_filters_and_columns(spark):
    url = "jdbc:derby:memory:lodestone;create=true"
    spark.range(100).selectExpr("id", "concat('n', id) AS name", "id % 3 AS k").write.format("jdbc").option("url", url).option("dbtable", "rooms").save()
    df = files.jdbc_table(spark, url, "rooms", partitionColumn="id", lowerBound="0", upperBound="100", numPartitions="4")
    out = df.where("k = 1").select("name")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(k,1)" in plan and "ReadSchema: struct<NAME:string>" in plan.replace("name", "NAME") and out.rdd.getNumPartitions() == 4
    assert sorted(r[0] for r in out.collect()) == sorted(f"n{i}" for i in range(100) if i % 3 == 1)


def test_sqlite_partitions_filters_and_columns(spark, tmp_path):
    at = f"{tmp_path}/big.db"
    with sqlite3.connect(at) as db:
        db.execute("CREATE TABLE t (a TEXT COLLATE NOCASE, n INTEGER, x REAL, b BLOB, [odd name] TEXT)")
        db.execute("WITH RECURSIVE c(i) AS (SELECT 1 UNION ALL SELECT i + 1 FROM c WHERE i < 1000000) INSERT INTO t SELECT CASE i % 3 WHEN 0 THEN 'Ab' WHEN 1 THEN 'aB' END, i % 1000, i / 4.0, NULL, 'é' FROM c")
        db.execute("INSERT INTO t VALUES ('aB', 'no number', 'text', 'b', NULL)")
        db.execute("CREATE TABLE w (k TEXT PRIMARY KEY, v INTEGER) WITHOUT ROWID")
        db.execute("INSERT INTO w VALUES ('k', 1), ('l', 2)")
        db.execute("CREATE TABLE e (a TEXT)")
    whole = sqlite_table(spark, at, "t")
    assert whole.dtypes == [("a", "string"), ("n", "bigint"), ("x", "double"), ("b", "binary"), ("odd name", "string")]
    assert whole.rdd.getNumPartitions() >= 8
    some = sqlite_table(spark, at, "t", "a string, n long", [("a", "=", "aB"), ("n", "<", 5)])
    assert some.rdd.getNumPartitions() >= 8
    with sqlite3.connect(at) as db:
        want = db.execute("SELECT count(*), sum(n) FROM t WHERE a = 'aB' COLLATE BINARY AND n < 5 AND typeof(n) = 'integer'").fetchone()
    assert some.agg(F.count("*"), F.sum("n")).first()[:] == want
    count = lambda *w: sqlite_table(spark, at, "t", where=list(w)).count()
    assert count(("a", "null", None)) == 333_333 and count(("n", "in", [1, 7])) == 2000 and count(("n", ">=", 990), ("a", "not null", None)) == 6667
    assert whole.where("n IN (1, 7)").count() == 2000 and whole.count() == 1_000_001
    with pytest.raises(ValueError, match="no comparison"):
        count(("n", "like", 1))
    assert whole.where("`odd name` IS NULL").select("n", "x").first()[:] == (None, None)
    assert sqlite_table(spark, at, "w").orderBy("k").collect()[1][:] == ("l", 2) and sqlite_table(spark, at, "e").collect() == []
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("n", T.LongType())])
    reader = SqliteReader(schema, {"path": at, "table": "t", "where": json.dumps([["a", "=", "aB"], ["n", "<", 5], ["n", "=", "5"]])})
    assert reader.where == ['"a" COLLATE BINARY = ?', '"n" < ?'] and reader.values == ["aB", 5]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) < 3000


def test_one_document_from_many_tasks(spark, tmp_path):
    rows = [{"topic_id": f"t{i:04d}", "label": f"Lighting é {i} \"x\"", "paper_ids": [f"P{i}", f"P{i + 1}"], "paper_count": i % 7, "note": None} for i in range(2000)]
    df = spark.createDataFrame(rows, "topic_id string, label string, paper_ids array<string>, paper_count long, note string").repartition(11)
    index = df.groupBy("paper_count").agg(F.count("*").alias("n"))
    order = [F.desc("paper_count"), F.col("topic_id")]
    write_document(f"{tmp_path}/d.json", ['{"summary":{"default_view":"defended"},"rows":[', '],"index":[', "]}"], [(df, json_rows(df), order), (index, json_rows(index), [F.col("paper_count")])], tasks=16)
    counts = {}
    for r in rows:
        counts[r["paper_count"]] = counts.get(r["paper_count"], 0) + 1
    want = {"summary": {"default_view": "defended"}, "rows": sorted(rows, key=lambda r: (-r["paper_count"], r["topic_id"])), "index": [{"paper_count": k, "n": n} for k, n in sorted(counts.items())]}
    assert (tmp_path / "d.json").read_text() == json.dumps(want, separators=(",", ":"), ensure_ascii=False)
    write_document(f"{tmp_path}/d.json", ["[", "]"], [(df.limit(0), json_rows(df), [])])
    assert (tmp_path / "d.json").read_text() == "[]" and [p.name for p in tmp_path.iterdir()] == ["d.json"]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/in")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema)
    append_log(event_stream(spark, f"{tmp_path}/in", schema), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == events.count()
    q = windowed_counts(event_stream(spark, f"{tmp_path}/in", schema)).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").agg(F.sum("n")).first()[0] == events.count() == windowed_counts(events).agg(F.sum("n")).first()[0]


def test_a_file_a_paper_from_many_tasks(spark, tmp_path):
    rows = [(f"p{i}", "é\n\"x\"" if i % 2 else None, ["a", "b/c d%", "_x", "..", "", None][i % 6]) for i in range(500)] + [("p1", "again", "a"), ("p1", "again", "a")]
    df = spark.createDataFrame(rows, "paper_id string, v string, folder string").coalesce(1)
    read = lambda: sorted((tuple(r) for r in files.per_paper(spark, f"{tmp_path}/out/*.json", "paper_id string, v string", recursive=True).collect()), key=repr)
    write_papers(df.limit(0), f"{tmp_path}/out", "folder")
    assert read() == []
    write_papers(df, f"{tmp_path}/out", "folder")
    want = sorted(((k, v) for k, v, _ in rows), key=repr)
    found = list((tmp_path / "out").rglob("*.json"))
    assert read() == want and len(found) == len(rows) and all(len(f.read_text().splitlines()) == 1 for f in found)
    assert len({f.relative_to(tmp_path / "out").parts[0] for f in found}) > 32
    with pytest.raises(Exception, match="no such row"):
        write_papers(df.withColumn("v", F.when(F.col("paper_id") == "p77", F.raise_error(F.lit("no such row"))).otherwise(F.col("v"))), f"{tmp_path}/out", "folder")
    assert read() == want and not list((tmp_path / "out").glob(".parts-*"))
    write_papers(df, f"{tmp_path}/out", "folder", tasks=3)
    assert read() == sorted(want * 2, key=repr)


def test_papers_of_a_table_in_one_partition_are_written_by_several_tasks(spark):
    import re

    import __spark_entry__ as entry

    out = entry.queries()["q63_per_paper"](spark, SF)
    assert out.count() == 10 and len({re.search(r"part-\d+|\d{8}-\d+", f.rsplit("/lodestone/")[-1]).group() for f in out.inputFiles()}) > 1
