"""Page profiles: text layer, image coverage and page type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parsewarden.config import ValidationConfig
from parsewarden.functions.geometry import image_coverages, largest, total
from parsewarden.functions.text import normalize_text
from parsewarden.operators.barrier import barrier


def page_type(usable: Column, coverage: Column, config: ValidationConfig) -> Column:
    scan, mixed = config.scanned_image_coverage_threshold, config.mixed_image_coverage_threshold
    return (
        F.when(usable & (coverage >= scan), "OCR_TEXT_OVER_IMAGE")
        .when(usable & (coverage >= mixed), "MIXED")
        .when(usable, "DIGITAL")
        .when(coverage >= scan, "SCANNED_OR_IMAGE_BASED")
        .otherwise("LOW_TEXT_OR_UNKNOWN")
    )


def profile_pages(pages: DataFrame, config: ValidationConfig = ValidationConfig()) -> DataFrame:
    """pages with norm_reference, reference_chars, usable, image_count, largest_coverage, total_coverage and page_type.

    pages: reference_text, char_objects, width, height, images. Row by row.
    """
    out = pages.withColumn("norm_reference", normalize_text(F.col("reference_text"))).withColumn("__coverages", image_coverages(F.col("images"), F.col("width"), F.col("height")))
    out = out.select(
        *[c for c in out.columns if c != "__coverages"],
        F.length("norm_reference").alias("reference_chars"),
        F.coalesce(F.size("images"), F.lit(0)).alias("image_count"),
        largest(F.col("__coverages")).alias("largest_coverage"),
        total(F.col("__coverages")).alias("total_coverage"),
    )
    usable = (F.col("reference_chars") >= config.min_usable_text_chars) & (F.coalesce("char_objects", F.lit(0)) >= config.min_pdf_character_objects)
    return barrier(out.withColumn("usable", usable).withColumn("page_type", page_type(F.col("usable"), F.col("largest_coverage"), config)))
