"""Pages to documents, documents to the corpus."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parsewarden.config import ValidationConfig
from parsewarden.functions.numbers import failure_limit, safe_mean
from parsewarden.operators.rules import issue, page_result
from parsewarden.schema import ISSUES


def document_status(match: Column, config: ValidationConfig) -> Column:
    """Of a row with pages, failed_pages and review_pages."""
    pages, failed = F.col("pages"), F.col("failed_pages")
    limit = failure_limit(pages, config.max_critical_page_fraction, config.minimum_critical_pages_for_document_failure)
    return F.when(pages == 0, "FAIL").when(failed >= limit, "FAIL").when(~match, "REVIEW").when((failed > 0) | (F.col("review_pages") > 0), "REVIEW").otherwise("PASS")


def document_type() -> Column:
    """Of a row with a flag for each page type that some page has."""
    digital, mixed, ocr, scanned = (F.col(c) for c in ("has_digital", "has_mixed", "has_ocr", "has_scanned"))
    return (
        F.when(~(digital | mixed | ocr | scanned), "UNKNOWN")
        .when(digital & ~mixed & ~ocr & ~scanned, "DIGITAL")
        .when(ocr & ~digital & ~mixed & ~scanned, "OCR_TEXT_OVER_IMAGE")
        .when(scanned & ~digital & ~mixed, "SCANNED_OR_IMAGE_BASED")
        .otherwise("MIXED")
    )


def roll_up(verdicts: DataFrame, counts: DataFrame, key: str = "doc_id", config: ValidationConfig = ValidationConfig(), tables: DataFrame | None = None, pages: bool = False) -> DataFrame:
    """A row for each document of counts (key, primary_pages, reference_pages): type, status and means of its pages.

    One shuffle by document; counters combine before it. tables: key, page_no of each primary table. pages adds the page
    results as an array in order of number: all of one document meet there, as in its report.
    """
    kinds = {"has_digital": "DIGITAL", "has_mixed": "MIXED", "has_ocr": "OCR_TEXT_OVER_IMAGE", "has_scanned": "SCANNED_OR_IMAGE_BASED"}
    more = [F.array_sort(F.collect_list(page_result())).alias("page_results")] if pages else []
    sums = verdicts.groupBy(key).agg(
        F.count("*").alias("pages"),
        *[F.count_if(F.col("status") == s).alias(c) for c, s in (("pass_pages", "PASS"), ("review_pages", "REVIEW"), ("failed_pages", "FAIL"))],
        *[F.bool_or(F.col("page_type") == t).alias(c) for c, t in kinds.items()],
        safe_mean(F.col("token_coverage")).alias("average_token_coverage"),
        safe_mean(F.col("character_length_ratio")).alias("average_character_length_ratio"),
        *more,
    )
    out = counts.join(sums, key, "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("pages", "pass_pages", "review_pages", "failed_pages")} | {c: F.coalesce(c, F.lit(False)) for c in kinds})
    match = F.col("primary_pages") == F.col("reference_pages")
    blind = F.col("reference_pages") == 0
    out = out.withColumns(
        {
            "page_count_match": ~blind & match,
            "document_type": F.when(blind, "UNKNOWN").otherwise(document_type()),
            "status": F.when(blind, "REVIEW").otherwise(document_status(match, config)),
            "issues": F.when(blind, F.array(issue("CROSS_PARSER_UNAVAILABLE"))).otherwise(F.array()).cast(ISSUES),
        }
    )
    if tables is not None:
        out = out.join(total_tables(tables, key), key, "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("total_tables", "tables_without_page")})
    return out.drop(*kinds)


def table_counts(tables: DataFrame, key: str = "doc_id") -> DataFrame:
    """Primary tables by page of their first provenance."""
    return tables.filter(F.col("page_no").isNotNull()).groupBy(key, F.col("page_no").alias("page_number")).agg(F.count("*").alias("primary_tables"))


def total_tables(tables: DataFrame, key: str = "doc_id") -> DataFrame:
    return tables.groupBy(key).agg(F.count("*").alias("total_tables"), F.count_if(F.col("page_no").isNull()).alias("tables_without_page"))


def corpus_summary(documents: DataFrame) -> DataFrame:
    """One row; what is neither PASS nor REVIEW counts as failed."""
    passed, review = (F.count_if(F.col("status") == s) for s in ("PASS", "REVIEW"))
    return documents.agg(F.count("*").alias("total_documents"), passed.alias("pass"), review.alias("review"), (F.count("*") - passed - review).alias("fail"))


def ingestion_counts(log: DataFrame) -> DataFrame:
    """One row; only a parser status of ``failed`` counts as failure, so partial conversions are successes."""
    failed = F.count_if(F.col("parser_status").eqNullSafe("failed"))
    return log.agg(F.count("*").alias("total"), (F.count("*") - failed).alias("successful"), failed.alias("failed"))


def document_report(documents: DataFrame, config: ValidationConfig = ValidationConfig(), key: str = "doc_id") -> DataFrame:
    """key and report (struct) of documents that roll_up has made with tables and pages."""
    summary = F.struct(
        "pass_pages", "review_pages", "failed_pages", "average_token_coverage", "average_character_length_ratio",
        F.col("total_tables").alias("docling_total_tables"), F.col("tables_without_page").alias("docling_tables_without_page_provenance"),
    )
    counts = F.struct(F.col("primary_pages").alias("docling"), F.col("reference_pages").alias("pdfplumber"), F.col("page_count_match").alias("match"))
    limits = F.schema_of_json(F.lit(json.dumps(asdict(config))))
    report = F.struct(F.struct(F.col(key).cast("string").alias("source_file")).alias("document"), "document_type", "status", counts.alias("page_counts"), summary.alias("summary"), F.from_json(F.lit(json.dumps(asdict(config))), limits).alias("thresholds"), "issues", F.col("page_results").alias("pages"))
    return documents.select(key, report.alias("report"))
