from __future__ import annotations

import json

from pyspark.sql import functions as F

from parsewarden.operators import extract
from parsewarden.plans import pipelines
from parsewarden.schema import IMAGES
from parsewarden.sources import files
from tests.test_sources import make_parser

TEXT = " ".join(f"word{i}" for i in range(60))


def stored(pages, tables):
    return json.dumps({"pages": {str(i): {"page_no": i, "size": {}} for i in range(1, pages + 1)}, "tables": [{"prov": [{"page_no": t}] if t else []} for t in tables]})


def test_ingestion_then_log(spark, tmp_path):
    raw, out = tmp_path / "raw", str(tmp_path / "out")
    raw.mkdir()
    for k in range(3):
        (raw / f"{k}.pdf").write_bytes(b"broken" if k == 1 else b"fine")
    assert tuple(pipelines.run_ingestion(spark, str(raw), out, "own", make_parser, export=True).first()) == (3, 2, 1)
    assert files.processed_documents(files.ingestion_log(spark, out)).count() == 2


def test_validation_end_to_end(spark):
    source = lambda d: (d, (f"{d}.pdf", f"{d}.pdf", 1, "x"))
    documents = spark.createDataFrame([source(d) for d in ("good", "nopdf", "noparse", "blind", "short")], "directory string, source struct<file_name:string,relative_path:string,file_size_bytes:long,sha256:string>")
    sources = spark.createDataFrame([(f"{d}.pdf",) for d in ("good", "noparse", "blind", "short")], "relative_path string")
    parsed = spark.createDataFrame([("good", stored(2, [1, None])), ("nopdf", stored(1, [])), ("blind", stored(1, [])), ("short", stored(1, []))], "directory string, json string")
    primary = spark.createDataFrame([("good", 1, TEXT), ("good", 2, TEXT), ("blind", 1, TEXT), ("short", 1, TEXT)], "directory string, page_number int, text string")
    one = lambda d, p, tables: (d, p, TEXT, 500, 600.0, 800.0, [], tables)
    reference = spark.createDataFrame([one("good", 1, 3), one("good", 2, 0), one("short", 1, 0), one("short", 2, 0)], f"directory string, page_number int, text string, char_objects int, width double, height double, images {IMAGES}, tables int")
    reports, summary = pipelines.run_validation(documents, sources, parsed, primary, reference)
    rows = {r["directory"]: r for r in reports.collect()}
    assert {k: r["status"] for k, r in rows.items()} == {"good": "PASS", "nopdf": "FAIL", "noparse": "FAIL", "blind": "REVIEW", "short": "REVIEW"}
    assert rows["nopdf"]["error_message"] == "Source PDF not found: nopdf.pdf" and rows["noparse"]["report"] is None
    good = rows["good"]["report"]
    assert good["summary"]["docling_total_tables"] == 2 and good["summary"]["docling_tables_without_page_provenance"] == 1
    assert [p["page_number"] for p in good["pages"]] == [1, 2] and len(rows["short"]["report"]["pages"]) == 1
    assert [i["code"] for i in rows["blind"]["report"]["issues"]] == ["CROSS_PARSER_UNAVAILABLE"]
    assert tuple(summary.first()) == (5, 1, 2, 2)


def test_glyphs_and_graphics(spark):
    chars = spark.createDataFrame([(1, "a", "f", 9.0, 10.0, 5.0), (1, "a", "f", 9.0, 10.2, 5.1), (1, "a", "f", 9.0, 12.0, 5.0), (2, "a", "f", 9.0, 10.0, 5.0)], "page int, text string, fontname string, size double, x0 double, top double")
    assert extract.dedupe_chars(chars, ["page"]).groupBy("page").count().orderBy("page").collect() == [(1, 2), (2, 1)]
    graphics = spark.createDataFrame([(1, "line"), (1, "rect"), (1, "line")], "page int, kind string")
    assert tuple(extract.graphics_counts(graphics, ["page"]).first()) == (1, 2, 1, 0)
    assert extract.stored_documents(spark.createDataFrame([("d", None)], "directory string, json string")).select("primary_pages", F.size("tables")).first() == (0, 0)


def test_glyphs_on_one_spot_enter_the_windows_once(spark):
    glyphs = spark.range(900).selectExpr("1 as page", "'a' as text", "'f' as fontname", "9.0D as size", "cast(id % 3 * 5 as double) as x0", "0.0D as top")
    out = extract.dedupe_chars(glyphs, ["page"])
    assert sorted(r["x0"] for r in out.collect()) == [0.0, 5.0, 10.0]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.rindex("Window") :]


def test_previews_make_rows_of_the_first_items_only(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "c"]), (1, ["d", "e", "f"]), (2, ["g"]), (3, []), (4, None)], "doc_id long, words array<string>")
    out = extract.item_previews(rows, ["doc_id"], F.col("words"), 2, "i", "w")
    got = sorted((r["doc_id"], r["i"]) for r in out.collect())
    assert got == [(1, 0), (1, 0), (2, 0)]
    assert "slice(" in out._jdf.queryExecution().optimizedPlan().toString()
