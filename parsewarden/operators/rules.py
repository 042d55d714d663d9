"""Page verdicts: coded issues in a fixed order, status and the metrics of a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parsewarden.config import ValidationConfig
from parsewarden.functions.numbers import rounded
from parsewarden.functions.text import char_ratio, normalize_text, replacement_ratio
from parsewarden.operators.barrier import barrier
from parsewarden.operators.coverage import with_token_coverage
from parsewarden.schema import ISSUES

# Codes, severities and messages of issues, as reports carry them.
MESSAGES = {
    "OCR_CROSS_VALIDATION_UNAVAILABLE": "The page appears to be scanned or image-based. pdfplumber does not provide a usable native text layer, so Docling OCR output cannot be cross-validated with pdfplumber.",
    "DOCLING_OCR_OUTPUT_EMPTY": "Docling produced no text for an image-based page. Manual review may be required.",
    "REFERENCE_TEXT_INSUFFICIENT": "The page does not contain enough native PDF text for reliable pdfplumber cross-validation. Manual review may be required.",
    "DOCLING_EMPTY_REFERENCE_NONEMPTY": "Docling extracted no text while pdfplumber found %d characters.",
    "LOW_TOKEN_COVERAGE": "Low token agreement between Docling and pdfplumber.",
    "MODERATE_TOKEN_COVERAGE": "Moderate token disagreement between Docling and pdfplumber.",
    "TEXT_LENGTH_MISMATCH": "Large difference between Docling and pdfplumber text lengths.",
    "REPLACEMENT_CHARACTERS": "Docling output contains suspicious Unicode replacement characters.",
    "TABLE_MISSED_BY_DOCLING": "pdfplumber detected %d table(s), while Docling detected none.",
    "CROSS_PARSER_UNAVAILABLE": "pdfplumber could not enumerate the PDF pages. Docling output cannot be cross-validated using pdfplumber for this document.",
}
CRITICAL = ("DOCLING_EMPTY_REFERENCE_NONEMPTY", "LOW_TOKEN_COVERAGE")


def issue(code: str, *values: Column) -> Column:
    text = F.format_string(MESSAGES[code], *values) if values else F.lit(MESSAGES[code])
    return F.struct(F.lit("critical" if code in CRITICAL else "warning").alias("severity"), F.lit(code).alias("code"), text.alias("message"))


def page_issues(config: ValidationConfig) -> Column:
    """Issues of a page that has profile, coverage and ratios."""
    scanned, primary, reference = F.col("page_type") == "SCANNED_OR_IMAGE_BASED", F.col("primary_chars"), F.col("reference_chars")
    coverage, fail, review = F.col("token_coverage"), config.token_coverage_fail_threshold, config.token_coverage_review_threshold
    tables = F.lit(config.check_tables) & (F.col("reference_tables_seen") > 0) & (F.col("primary_tables") == 0)
    compared = F.array(
        F.when((reference >= config.empty_docling_reference_chars) & (primary == 0), issue("DOCLING_EMPTY_REFERENCE_NONEMPTY", reference)),
        F.when(coverage < fail, issue("LOW_TOKEN_COVERAGE")).when(coverage < review, issue("MODERATE_TOKEN_COVERAGE")),
        F.when(F.col("character_length_ratio") < config.char_ratio_review_threshold, issue("TEXT_LENGTH_MISMATCH")),
        F.when(F.col("replacement_character_ratio") > config.max_replacement_char_ratio, issue("REPLACEMENT_CHARACTERS")),
        F.when(tables, issue("TABLE_MISSED_BY_DOCLING", F.col("reference_tables_seen"))),
    )
    image_only = F.array(issue("OCR_CROSS_VALIDATION_UNAVAILABLE"), F.when(primary == 0, issue("DOCLING_OCR_OUTPUT_EMPTY")))
    each = F.when(scanned, image_only).when(~F.col("usable"), F.array(issue("REFERENCE_TEXT_INSUFFICIENT"))).otherwise(compared)
    return F.filter(each, lambda x: x.isNotNull()).cast(ISSUES)


def validate_pages(pages: DataFrame, config: ValidationConfig = ValidationConfig()) -> DataFrame:
    """pages, profiled, with cross_validation, status, issues and unrounded metrics. Row by row, without a shuffle.

    pages: primary_text, primary_tables, reference_tables and what profile_pages gives. Reference tables count only on
    usable pages; texts are compared only there.
    """
    usable = F.col("usable")
    out = pages.withColumn("norm_primary", normalize_text(F.col("primary_text"))).withColumn("primary_chars", F.length("norm_primary"))
    out = with_token_coverage(out.withColumn("__p", F.when(usable, F.col("norm_primary"))).withColumn("__q", F.when(usable, F.col("norm_reference"))), "__p", "__q").drop("__p", "__q")
    out = out.withColumn("character_length_ratio", F.when(usable, char_ratio(F.col("norm_primary"), F.col("norm_reference"))))
    out = out.withColumn("replacement_character_ratio", F.when(usable, replacement_ratio(F.col("primary_text"))))
    out = out.withColumn("reference_tables_seen", F.when(usable, F.coalesce("reference_tables", F.lit(0))))
    out = out.withColumn("primary_tables", F.coalesce("primary_tables", F.lit(0)))
    out = barrier(barrier(out).withColumn("issues", page_issues(config)))
    kind = F.when(F.col("page_type") == "SCANNED_OR_IMAGE_BASED", "UNAVAILABLE").when(~usable, "INSUFFICIENT_REFERENCE").otherwise("AVAILABLE")
    worst = F.when(F.exists("issues", lambda i: i["severity"] == "critical"), "FAIL").when(F.size("issues") > 0, "REVIEW").otherwise("PASS")
    return out.withColumn("cross_validation", kind).withColumn("status", F.when(kind == "AVAILABLE", worst).otherwise("REVIEW"))


def page_result() -> Column:
    """A page of a report, from a row that validate_pages has made."""
    metrics = F.struct(
        F.col("primary_chars").alias("docling_characters"),
        F.col("reference_chars").alias("pdfplumber_characters"),
        F.col("char_objects").alias("pdf_character_objects"),
        "image_count",
        rounded(F.col("largest_coverage")).alias("largest_image_coverage"),
        rounded(F.col("total_coverage")).alias("total_image_coverage"),
        rounded(F.col("token_coverage")).alias("token_coverage"),
        rounded(F.col("character_length_ratio")).alias("character_length_ratio"),
        rounded(F.col("replacement_character_ratio"), 6).alias("replacement_character_ratio"),
        F.col("primary_tables").alias("docling_tables"),
        F.col("reference_tables_seen").alias("pdfplumber_tables"),
    )
    return F.struct("page_number", "page_type", "cross_validation", "status", metrics.alias("metrics"), "issues")
