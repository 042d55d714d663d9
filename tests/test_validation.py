"""Rules just under, at and above each threshold, and what documents make of pages."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from parsewarden.config import ValidationConfig
from parsewarden.operators import rollup
from parsewarden.operators.profile import page_type, profile_pages
from parsewarden.operators.rules import validate_pages

PAGES = "doc_id long, page_number int, primary_text string, reference_text string, char_objects int, width double, height double, images array<struct<x0:double,x1:double,top:double,bottom:double>>, primary_tables int, reference_tables int"
WORDS = [f"word{i:03}" for i in range(100)]
TEXT = " ".join(WORDS)


def page(primary=TEXT, reference=TEXT, chars=1000, images=(), primary_tables=0, reference_tables=0):
    return (1, 1, primary, reference, chars, 100.0, 100.0, list(images), primary_tables, reference_tables)


def verdicts(spark, *pages, **config):
    df = spark.createDataFrame([(p[0], i, *p[2:]) for i, p in enumerate(pages)], PAGES)
    c = ValidationConfig(**config)
    out = validate_pages(profile_pages(df, c), c).orderBy("page_number").collect()
    return [(r["status"], [i["code"] for i in r["issues"]], r["cross_validation"]) for r in out]


def keep(n):
    """n of the words, with as many others of the same length."""
    return " ".join(WORDS[:n] + ["other" + w[5:] for w in WORDS[n:]])


def test_coverage_thresholds(spark):
    got = verdicts(spark, page(keep(59)), page(keep(60)), page(keep(84)), page(keep(85)))
    assert [g[1] for g in got] == [["LOW_TOKEN_COVERAGE"], ["MODERATE_TOKEN_COVERAGE"], ["MODERATE_TOKEN_COVERAGE"], []]
    assert [g[0] for g in got] == ["FAIL", "REVIEW", "REVIEW", "PASS"]


def test_length_and_replacement_thresholds(spark):
    base = "x" * 1000
    long = lambda n: base + " " + "y" * (n - 1)
    got = verdicts(spark, page(long(1000), base), page(base + " " + "y" * 427, base), page(base + " " + "y" * 428, base))
    assert [g[1] for g in got] == [["TEXT_LENGTH_MISMATCH"], [], ["TEXT_LENGTH_MISMATCH"]]
    marks = lambda n: ("word " * 199)[: 1000 - n] + "�" * n
    got = verdicts(spark, page(marks(5), ("word " * 199)), page(marks(6), ("word " * 199)))
    assert [g[1] for g in got] == [[], ["REPLACEMENT_CHARACTERS"]]


def test_empty_primary(spark):
    got = verdicts(spark, page(""), page("", "z" * 99), page(None, ". " * 200), page("", "!" * 100))
    assert got[0][1] == ["DOCLING_EMPTY_REFERENCE_NONEMPTY", "LOW_TOKEN_COVERAGE", "TEXT_LENGTH_MISMATCH"]
    assert got[1][1] == ["LOW_TOKEN_COVERAGE", "TEXT_LENGTH_MISMATCH"]
    # a reference without tokens has no coverage, so the empty primary is the only critical issue
    assert got[3] == ("FAIL", ["DOCLING_EMPTY_REFERENCE_NONEMPTY", "TEXT_LENGTH_MISMATCH"], "AVAILABLE")


def test_tables(spark):
    got = verdicts(spark, page(reference_tables=2), page(primary_tables=1, reference_tables=2), page(primary_tables=1))
    assert [g[1] for g in got] == [["TABLE_MISSED_BY_DOCLING"], [], []]
    assert verdicts(spark, page(reference_tables=2), check_tables=False)[0][1] == []


def test_branches(spark):
    scan = [(0.0, 100.0, 0.0, 80.0)]
    got = verdicts(spark, page(reference="", images=scan), page("", "", images=scan), page(reference="x" * 79), page(chars=19), page("", "y" * 80, images=scan, chars=20))
    assert got[0] == ("REVIEW", ["OCR_CROSS_VALIDATION_UNAVAILABLE"], "UNAVAILABLE")
    assert got[1][1] == ["OCR_CROSS_VALIDATION_UNAVAILABLE", "DOCLING_OCR_OUTPUT_EMPTY"]
    assert got[2] == got[3] == ("REVIEW", ["REFERENCE_TEXT_INSUFFICIENT"], "INSUFFICIENT_REFERENCE")
    assert got[4][2] == "AVAILABLE" and got[4][0] == "FAIL"


@pytest.mark.parametrize(("usable", "coverage", "kind"), [(True, 0.8, "OCR_TEXT_OVER_IMAGE"), (True, 0.79999, "MIXED"), (True, 0.2, "MIXED"), (True, 0.19999, "DIGITAL"), (False, 0.8, "SCANNED_OR_IMAGE_BASED"), (False, 0.79, "LOW_TEXT_OR_UNKNOWN")])
def test_page_types(spark, usable, coverage, kind):
    assert spark.range(1).select(page_type(F.lit(usable), F.lit(coverage), ValidationConfig())).first()[0] == kind


def roll(spark, statuses, primary=None, reference=None, kinds=None):
    rows = [(1, s, k, 0.5, None) for s, k in zip(statuses, kinds or ["DIGITAL"] * len(statuses), strict=True)]
    pages = spark.createDataFrame(rows, "doc_id long, status string, page_type string, token_coverage double, character_length_ratio double")
    n = len(statuses)
    counts = spark.createDataFrame([(1, n if primary is None else primary, n if reference is None else reference)], "doc_id long, primary_pages int, reference_pages int")
    return rollup.roll_up(pages, counts).first()


@pytest.mark.parametrize(("n", "failed", "status"), [(1, 1, "REVIEW"), (2, 2, "FAIL"), (9, 1, "REVIEW"), (10, 2, "FAIL"), (11, 2, "REVIEW"), (11, 3, "FAIL"), (5, 0, "PASS")])
def test_document_status(spark, n, failed, status):
    assert roll(spark, ["FAIL"] * failed + ["PASS"] * (n - failed))["status"] == status


def test_page_counts(spark):
    assert roll(spark, ["PASS"], 1, 2)["status"] == "REVIEW"
    blind = roll(spark, [], 0, 0)
    assert (blind["status"], blind["document_type"], blind["issues"][0]["code"]) == ("REVIEW", "UNKNOWN", "CROSS_PARSER_UNAVAILABLE")
    assert roll(spark, [], 0, 3)["status"] == "FAIL"


@pytest.mark.parametrize(("kinds", "kind"), [
    (["LOW_TEXT_OR_UNKNOWN"], "UNKNOWN"), (["DIGITAL", "LOW_TEXT_OR_UNKNOWN"], "DIGITAL"), (["OCR_TEXT_OVER_IMAGE"], "OCR_TEXT_OVER_IMAGE"),
    (["SCANNED_OR_IMAGE_BASED"], "SCANNED_OR_IMAGE_BASED"), (["SCANNED_OR_IMAGE_BASED", "OCR_TEXT_OVER_IMAGE"], "SCANNED_OR_IMAGE_BASED"), (["MIXED"], "MIXED"), (["DIGITAL", "OCR_TEXT_OVER_IMAGE"], "MIXED"),
])
def test_document_type(spark, kinds, kind):
    assert roll(spark, ["PASS"] * len(kinds), kinds=kinds)["document_type"] == kind


def test_corpus_and_ingestion_counts(spark):
    df = spark.createDataFrame([("PASS",), ("REVIEW",), ("odd",), (None,)], "status string")
    assert tuple(rollup.corpus_summary(df).first()) == (4, 1, 1, 2)
    log = spark.createDataFrame([("failed",), (None,), ("partial_success",)], "parser_status string")
    assert tuple(rollup.ingestion_counts(log).first()) == (3, 2, 1)


def test_filters_on_verdicts_compute_them_once(spark):
    df = spark.createDataFrame([page()], PAGES)
    plan = validate_pages(profile_pages(df)).filter("status = 'FAIL'")._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 60_000 and plan.count("regexp_extract_all") == 2


def test_reports_have_explicit_nulls(spark):
    from parsewarden.functions.json_text import to_json

    df = spark.createDataFrame([page(), (1, 2, *page(reference="")[2:])], PAGES)
    counts = spark.createDataFrame([(1, 2, 2)], "doc_id long, primary_pages int, reference_pages int")
    tables = spark.createDataFrame([(1, 1), (1, None)], "doc_id long, page_no int")
    docs = rollup.roll_up(validate_pages(profile_pages(df)), counts, tables=tables, pages=True)
    report = json.loads(rollup.document_report(docs).select(to_json(F.col("report"))).first()[0])
    assert [p["page_number"] for p in report["pages"]] == [1, 2] and report["pages"][1]["metrics"]["token_coverage"] is None
    assert report["summary"]["docling_total_tables"] == 2 and report["thresholds"]["min_usable_text_chars"] == 80
