"""Ingestion and validation of streams. An extension: what it computes is what the batch operators compute."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parsewarden.config import ValidationConfig
from parsewarden.operators.profile import profile_pages
from parsewarden.operators.rules import validate_pages
from parsewarden.sources.files import relative_path
from parsewarden.sources.ingest import Parser, ingest

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def stream_files(spark: SparkSession, root: str, files_a_trigger: int = 1000) -> DataFrame:
    """relative_path and content of PDFs as they arrive below root."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").option("maxFilesPerTrigger", files_a_trigger).load(root)
    return files.select(relative_path(F.col("path"), root).alias("relative_path"), "content")


def stream_ingest(files: DataFrame, name: str, factory: Callable[[], Parser], out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Parse files of a stream into a Parquet table; each file once, by the checkpoint."""
    return ingest(files, name, factory).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stream_verdicts(pages: DataFrame, config: ValidationConfig = ValidationConfig()) -> DataFrame:
    """Verdicts of a stream of page pairs: row by row, so without state."""
    return validate_pages(profile_pages(pages, config), config)


def stream_status_counts(verdicts: DataFrame, time: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Pages by status in windows of their time; state of a window goes once the watermark has passed it."""
    return verdicts.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), "status").agg(F.count("*").alias("pages"))
