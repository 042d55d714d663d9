"""Source files, their fingerprints, and what ingestion has stored about them."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from parsewarden.operators.alignment import path_order
from parsewarden.schema import INGESTION_LOG


def relative_path(path: Column, root: str) -> Column:
    """Path below root, without a scheme."""
    plain = lambda c: F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.\-]*:(?://[^/]*)?/+", "/")
    return F.regexp_replace(plain(path), F.concat(F.lit("^\\Q"), plain(F.lit(root.rstrip("/") + "/")), F.lit("\\E")), "")


def discover_pdfs(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """relative_path, length and modificationTime (and content) of all files *.pdf below root, in no order.

    Reads by Spark's file scan, so names that begin with _ or . and empty files are left out; see ``AllFiles`` for a
    listing that has them. Without content nothing but the listing is read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(root)
    return files.select(relative_path(F.col("path"), root).alias("relative_path"), "length", "modificationTime", *(["content"] if content else []))


def in_path_order(files: DataFrame) -> DataFrame:
    """Sorted part by part, as paths are."""
    return files.orderBy(path_order(F.col("relative_path")))


def fingerprints(files: DataFrame) -> DataFrame:
    """files, with content, by their SHA-256; content is dropped in the scan's own stage."""
    return files.select("relative_path", "length", F.sha2("content", 256).alias("sha256"))


class AllFiles(DataSource):
    """A listing of a local folder that has hidden, empty and directory entries too: ``format("all_files")``.

    Each folder of the first level is a partition. For stores that only Spark reads use discover_pdfs.
    """

    @classmethod
    def name(cls) -> str:
        return "all_files"

    def schema(self) -> str:
        return "relative_path string, length bigint, is_directory boolean"

    def reader(self, schema) -> DataSourceReader:
        return _Listing(self.options["path"], self.options.get("suffix", ".pdf"))


class _Listing(DataSourceReader):
    def __init__(self, root: str, suffix: str):
        self.root, self.suffix = root.removeprefix("file://"), suffix

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(name) for name in sorted(os.listdir(self.root))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        top = Path(self.root, partition.value)
        for p in [top, *(top.rglob("*") if top.is_dir() else ())]:
            if p.name.endswith(self.suffix):
                yield str(p.relative_to(self.root)), p.stat().st_size, p.is_dir()


def ingestion_log(spark: SparkSession, root: str) -> DataFrame:
    """Every stored metadata.json and error.json below root: INGESTION_LOG with directory and kind."""
    own = spark.read.schema(INGESTION_LOG).option("multiLine", "true").option("recursiveFileLookup", "true")
    out = None
    for kind in ("metadata", "error"):
        df = own.option("pathGlobFilter", f"{kind}.json").json(root).select("*", F.col("_metadata.file_path").alias("__path"))
        directory = F.regexp_replace(relative_path(F.url_decode("__path"), root), r"/?[^/]+$", "")
        df = df.select("source", "document", "parser", "outputs", "error", directory.alias("directory"), F.lit(kind).alias("kind"))
        out = df if out is None else out.unionByName(df)
    return out


def processed_documents(log: DataFrame, strict: bool = False) -> DataFrame:
    """Directories to validate: those with metadata. strict leaves out those whose last run failed, if it left an error."""
    own = log.filter("kind = 'metadata'")
    return own.join(log.filter("kind = 'error'").select("directory"), "directory", "left_anti") if strict else own


def check_sources(documents: DataFrame, sources: DataFrame, parsed: DataFrame) -> DataFrame:
    """documents (directory, source) with error: the PDF is looked for first, then the stored parse; both missing FAIL.

    sources: relative_path of existing PDFs; parsed: directory of existing parses.
    """
    out = documents.withColumn("relative_path", F.col("source.relative_path"))
    out = out.join(sources.select("relative_path", F.lit(True).alias("__pdf")), "relative_path", "left").join(parsed.select("directory", F.lit(True).alias("__parse")), "directory", "left")
    error = F.when(F.col("__pdf").isNull(), F.concat(F.lit("Source PDF not found: "), F.col("relative_path"))).when(F.col("__parse").isNull(), F.concat(F.lit("Parsed document not found: "), F.col("directory")))
    return out.withColumn("error_message", error).withColumn("early_status", F.when(error.isNotNull(), "FAIL")).drop("__pdf", "__parse")


def new_files(files: DataFrame, log: DataFrame) -> DataFrame:
    """Fingerprinted files whose content no successful run has seen. An extension: plain ingestion takes every file again."""
    seen = log.filter("kind = 'metadata'").select(F.col("source.sha256").alias("sha256")).distinct()
    return files.join(seen, "sha256", "left_anti")
