"""Where reports, parses and artifacts go."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parsewarden.functions.json_text import to_json


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet: what a cluster writes by default, with Spark's commit protocol."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_json_lines(df: DataFrame, column: str, path: str) -> None:
    """One line of JSON, with explicit nulls, for each row of a struct column."""
    df.select(to_json(F.col(column)).alias("value")).write.mode("overwrite").text(path)


def write_corpus_summary(summary: DataFrame, path: str) -> None:
    """One file of one line; the summary is one row."""
    summary.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def export_files(files: DataFrame, root: str) -> int:
    """A file for each row (directory, file_name, content) below root, a folder that all executors share.

    On request only: many small files. Each is written beside its place and moved there, so a task that runs twice does no
    harm. Returns the number of files.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for directory, name, content in zip(b["directory"], b["file_name"], b["content"], strict=True):
                place = os.path.join(root, directory, name)
                os.makedirs(os.path.dirname(place), exist_ok=True)
                part = f"{place}.{os.getpid()}.part"
                with open(part, "w", encoding="utf-8") as f:
                    f.write(content or "")
                os.replace(part, place)
            yield pd.DataFrame({"n": [len(b)]})

    return files.select("directory", "file_name", "content").mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def report_files(reports: DataFrame, key: str = "doc_id") -> DataFrame:
    """validation_report.json of each report, for export_files."""
    return reports.select(F.col(key).cast("string").alias("directory"), F.lit("validation_report.json").alias("file_name"), to_json(F.col("report"), pretty=True).alias("content"))
