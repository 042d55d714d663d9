from __future__ import annotations

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from parsewarden.sources import files, ingest, sinks
from parsewarden.streaming import ingest as stream


def make_parser():
    def parse(path, content):
        if b"broken" in content:
            raise ValueError("can't read it")
        return {"json": "{}", "markdown": "# m", "text": content.decode(), "page_count": 2, "table_count": 1, "conversion_status": "partial_success" if b"part" in content else "success"}

    return parse


def missing_library():
    raise ModuleNotFoundError("No module named 'reader'")


@pytest.fixture
def raw(tmp_path):
    for name, data in {"a/x.v1.pdf": b"one", "a-1/y.pdf": b"part", "b c/z.pdf": b"broken", "b c/n.PDF": b"", "b c/n.txt": b"x", "_h.pdf": b"h", "b c/e.pdf": b""}.items():
        p = tmp_path / "raw" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    (tmp_path / "raw" / "dir.pdf").mkdir()
    return str(tmp_path / "raw")


def test_discovery_in_path_order(spark, raw):
    found = files.discover_pdfs(spark, raw)
    assert [r["relative_path"] for r in files.in_path_order(found).collect()] == ["a/x.v1.pdf", "a-1/y.pdf", "b c/z.pdf"]
    assert [r["sha256"] for r in files.fingerprints(files.discover_pdfs(spark, raw, content=True)).filter("relative_path like 'a/%'").collect()] == [hashlib.sha256(b"one").hexdigest()]


def test_listing_has_hidden_empty_and_directory_entries(spark, raw):
    spark.dataSource.register(files.AllFiles)
    got = {(r["relative_path"], r["is_directory"]) for r in spark.read.format("all_files").load(raw).collect()}
    assert got == {("a/x.v1.pdf", False), ("a-1/y.pdf", False), ("b c/z.pdf", False), ("b c/e.pdf", False), ("_h.pdf", False), ("dir.pdf", True)}


def test_ingestion_isolates_failures_and_is_read_back(spark, raw, tmp_path):
    parsed = ingest.ingest(files.discover_pdfs(spark, raw, content=True), "own", make_parser, files_a_task=2).cache()
    rows = {r["source"]["relative_path"]: r for r in parsed.collect()}
    assert rows["b c/z.pdf"]["error"].asDict() == {"type": "ValueError", "message": "can't read it"} and rows["b c/z.pdf"]["parser"]["status"] == "failed"
    assert rows["a/x.v1.pdf"]["source"]["sha256"] == hashlib.sha256(b"one").hexdigest() and rows["a/x.v1.pdf"]["directory"] == "a/x.v1"
    out = str(tmp_path / "processed")
    assert sinks.export_files(ingest.artifacts(parsed), out) == 9
    assert json.load(open(f"{out}/a-1/y/metadata.json"))["parser"]["conversion_status"] == "partial_success"
    assert set(json.load(open(f"{out}/b c/z/error.json"))) == {"source", "parser", "error"}
    log = files.ingestion_log(spark, out)
    assert sorted((r["directory"], r["kind"]) for r in log.collect()) == [("a-1/y", "metadata"), ("a/x.v1", "metadata"), ("b c/z", "error")]
    os.remove(f"{out}/a/x.v1/document.json")
    os.remove(f"{raw}/a-1/y.pdf")
    stored = spark.createDataFrame([("a-1/y",)], "directory string")
    checked = files.check_sources(files.processed_documents(log), files.discover_pdfs(spark, raw), stored)
    got = {r["directory"]: (r["early_status"], r["error_message"]) for r in checked.collect()}
    assert got == {"a-1/y": ("FAIL", "Source PDF not found: a-1/y.pdf"), "a/x.v1": ("FAIL", "Parsed document not found: a/x.v1")}
    again = files.new_files(files.fingerprints(files.discover_pdfs(spark, raw, content=True)), log)
    assert [r["relative_path"] for r in again.collect()] == ["b c/z.pdf"]


def test_stale_metadata_counts_unless_strict(spark):
    log = spark.createDataFrame([("d", "metadata"), ("d", "error"), ("e", "metadata"), ("f", "error")], "directory string, kind string")
    assert {r["directory"] for r in files.processed_documents(log).collect()} == {"d", "e"}
    assert {r["directory"] for r in files.processed_documents(log, strict=True).collect()} == {"e"}


def test_missing_library_fails_files_only(spark, raw):
    out = ingest.ingest(files.discover_pdfs(spark, raw, content=True), "own", missing_library)
    assert {r["error"]["type"] for r in out.collect()} == {"ModuleNotFoundError"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "k long, v string")
    sinks.write_table(df, str(tmp_path / "t"), ["k"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    sinks.write_json_lines(df.select(F.struct("k", "v").alias("s")), "s", str(tmp_path / "j"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "j")).collect()) == ['{"k":1,"v":"x"}', '{"k":2,"v":null}']
    sinks.write_corpus_summary(df.limit(1), str(tmp_path / "c"))
    assert len([f for f in os.listdir(tmp_path / "c") if f.endswith(".json")]) == 1
    reports = df.select("k", F.struct("v").alias("report"))
    assert {r["file_name"] for r in sinks.report_files(reports, "k").collect()} == {"validation_report.json"}


def test_stream_takes_each_file_once(spark, raw, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    run = lambda: stream.stream_ingest(stream.stream_files(spark, raw), "own", make_parser, out, checkpoint).awaitTermination(120)
    run()
    assert spark.read.parquet(out).count() == 3
    open(f"{raw}/a/new.pdf", "wb").write(b"new")
    run()
    assert spark.read.parquet(out).count() == 4


def test_stream_of_pages(spark, tmp_path):
    from tests.test_validation import PAGES, page

    spark.createDataFrame([page(), page(primary="")], PAGES).withColumn("ts", F.timestamp_seconds(F.lit(7200))).write.parquet(str(tmp_path / "pages"))
    pages = spark.readStream.schema(f"{PAGES}, ts timestamp").parquet(str(tmp_path / "pages"))
    counts = stream.stream_status_counts(stream.stream_verdicts(pages), "ts")
    counts.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert {(r["status"], r["pages"]) for r in spark.table("counts").collect()} == {("PASS", 1), ("FAIL", 1)}
