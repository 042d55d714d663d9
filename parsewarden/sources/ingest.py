"""Ingestion: each file through a parser plug-in, failures kept as rows.

A parser is a function from path and bytes to a dict with ``json``, ``markdown`` and ``text`` (strings), ``page_count``,
``table_count`` and ``conversion_status``. It is made once for each worker by a factory, which may load models; a missing
library fails the file and not the job.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parsewarden.functions.json_text import to_json
from parsewarden.functions.text import output_path
from parsewarden.schema import INGESTION_LOG

Parser = Callable[[str, bytes], dict]

PARSED = f"{INGESTION_LOG}, json string, markdown string, text string"
OUTPUTS = {"json": "document.json", "markdown": "document.md", "text": "document.txt"}


@lru_cache(maxsize=4)
def _made(factory: Callable[[], Parser]) -> Parser:
    return factory()


def parse_one(name: str, factory: Callable[[], Parser], path: str, content: bytes) -> dict:
    """One row of PARSED. Time covers parsing, not the fingerprint."""
    source = {"file_name": path.rsplit("/", 1)[-1], "relative_path": path, "file_size_bytes": None, "sha256": None}
    began = time.perf_counter()
    out = {"source": source, "document": None, "outputs": None, "error": None, "json": None, "markdown": None, "text": None}
    try:
        got = _made(factory)(path, content)
        seconds = time.perf_counter() - began
        source |= {"file_size_bytes": len(content), "sha256": hashlib.sha256(content).hexdigest()}
        parser = {"name": name, "conversion_status": got.get("conversion_status", "success"), "status": None, "processing_time_seconds": round(seconds, 3)}
        return out | {"document": {"page_count": got.get("page_count"), "table_count": got.get("table_count")}, "parser": parser, "outputs": OUTPUTS, **{k: got.get(k) for k in OUTPUTS}}
    except Exception as e:
        parser = {"name": name, "conversion_status": None, "status": "failed", "processing_time_seconds": round(time.perf_counter() - began, 3)}
        return out | {"parser": parser, "error": {"type": type(e).__name__, "message": str(e)}}


def ingest(files: DataFrame, name: str, factory: Callable[[], Parser], files_a_task: int = 0) -> DataFrame:
    """PARSED with directory, for files (relative_path, content). Sizes of tasks follow the scan, or files_a_task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["source", "document", "parser", "outputs", "error", *OUTPUTS]
        for b in batches:
            for path, content in zip(b["relative_path"], b["content"], strict=True):
                yield pd.DataFrame([parse_one(name, factory, path, bytes(content))], columns=columns)

    own = files.select("relative_path", "content")
    if files_a_task:
        own = own.repartition(max(1, -(-own.count() // files_a_task)))
    return own.mapInPandas(run, PARSED).withColumn("directory", output_path(F.col("source.relative_path")))


def artifacts(parsed: DataFrame) -> DataFrame:
    """directory, file_name and content of what a run stores: three outputs and metadata, or an error."""
    ok = F.col("error").isNull()
    parser = F.struct("parser.name", "parser.conversion_status", "parser.processing_time_seconds")
    metadata = to_json(F.struct("source", "document", parser.alias("parser"), "outputs"), pretty=True)
    failed = to_json(F.struct(F.struct("source.file_name", "source.relative_path").alias("source"), F.struct("parser.name", "parser.status", "parser.processing_time_seconds").alias("parser"), "error"), pretty=True)
    file = lambda n, c: F.struct(F.lit(n).alias("file_name"), c.alias("content"))
    good = F.array(*[file(n, F.col(k)) for k, n in OUTPUTS.items()], file("metadata.json", metadata))
    return parsed.select("directory", F.explode(F.when(ok, good).otherwise(F.array(file("error.json", failed)))).alias("f")).select("directory", "f.*")
