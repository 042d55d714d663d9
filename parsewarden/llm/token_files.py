"""Token ids in Parquet list columns, in order of the documents, for selective reads of tokens or metadata alone.

Documents are dealt out by ranges of their id and sorted before they are encoded, so the one shuffle carries texts, and
the written files and the rows in them are in ascending order of id. Spark's own writer and commit protocol make the
files, so a lost executor leaves no partial file behind. Layout of a file:

- ``ids`` LIST<INT32>: dictionary encoding (ids of a small vocabulary take two bytes or less), or delta encoding;
- ``doc_id``, ``n_tokens``, ``ids_crc32``: metadata that reads without touching ``ids``;
- row groups of ``row_group_rows`` rows at most, pages of ``page_rows`` rows at most, each with column and offset index,
  so that a reader skips to the pages of an id range.

Reading back, the start of each document comes from the sums of its files (a row for each file), from the metadata column
alone, and a running sum within each file of what was read.

Where the tokenizer drops white space, each worker encodes a distinct piece once and puts the ids of texts together again
(``pieces``); whether it does is told from the tokenizer itself, and others get whole texts.

Defined results: a null text counts as empty and has the end id alone; null ids come first; rows of an equal id follow
each other in order of a hash of their text (so many rows of one id, or without, spread over tasks), each with its own
start; an empty table gives an empty result; other columns are not written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parsewarden.llm.common import checkpointed, eager, give_back, sliced, table, temporary
from parsewarden.llm.pieces import by_bytes, text_tokens

SCHEMA = "doc_id long, n_tokens long, ids_crc32 long, ids array<int>"


def with_end(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """ids with end_id after each text, and the offsets of the texts."""
    ends = np.cumsum(sizes)
    out = np.insert(ids, ends, end_id).astype(np.int32)
    return out, np.concatenate([[0], ends + np.arange(1, len(sizes) + 1)])


def crc32_of(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))


def write_tokens(df: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text: str = "text", encoding: str = "dictionary", row_group_rows: int = 20_000, page_rows: int = 2_000, batch_bytes: int = 1 << 22) -> None:
    """Write the table of df's token ids to path; see the module for its layout."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = text_tokens(tokenizer_path)
        for b in sliced(batches):
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            for start, end in by_bytes(np.fromiter(map(len, texts), np.int64, len(texts)), batch_bytes):
                ids, at = with_end(*tokens.ids(texts[start:end]), end_id)
                crc = np.fromiter((crc32_of(ids[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)), np.int64, end - start)
                yield pa.RecordBatch.from_arrays([b.column(0)[start:end], pa.array(np.diff(at)), pa.array(crc), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))], names=["doc_id", "n_tokens", "ids_crc32", "ids"])
        give_back()

    if encoding not in ("dictionary", "delta"):
        raise ValueError("encoding is dictionary or delta")
    own = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    spread = F.xxhash64("text")
    own = own.repartitionByRange("doc_id", spread).sortWithinPartitions("doc_id", spread, "text")
    writer = own.mapInArrow(run, SCHEMA).write.option("parquet.block.row.count.limit", row_group_rows).option("parquet.page.row.count.limit", page_rows)
    if encoding == "delta":
        writer = writer.option("parquet.enable.dictionary", "false").option("parquet.writer.version", "v2")
    with eager(df.sparkSession):
        writer.option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Rows of the table; those of an id range alone, by the page index, if first or last is given."""
    df = spark.read.schema(SCHEMA).parquet(path)
    for bound, keep in ((first, F.col("doc_id") >= F.lit(first)), (last, F.col("doc_id") <= F.lit(last))):
        df = df if bound is None else df.filter(keep)
    return df


def verified(df: DataFrame) -> DataFrame:
    """doc_id, n_tokens and ids_crc32 as they follow from the ids that were read, with the file and row they stand in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            lists = b.column(1)
            at, ids = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            crc = np.fromiter((crc32_of(ids[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(at).astype(np.int64)), pa.array(crc), *b.columns[2:]], names=["doc_id", "n_tokens", "ids_crc32", "file", "at"])

    own = df.select("doc_id", "ids", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
    return own.mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, file string, at long")


def with_starts(rows: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """rows (file, at, n_tokens) with start, the ids of all rows before. Sums by file go through one task: a row a file.

    meta: the same file and n_tokens from elsewhere, if reading rows twice is dear.
    """
    files = (rows if meta is None else meta).groupBy("file").agg(F.sum("n_tokens").alias("__sum"))
    number = F.regexp_extract("file", r"^part-(\d+)", 1).cast("long")
    before = F.coalesce(F.sum("__sum").over(Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = files.select("file", before.alias("__before"))
    own = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("__own", own).join(F.broadcast(files), "file").withColumn("start", F.col("__before") + F.col("__own")).drop("__before", "__own")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with temporary(spark, "tokens") as path:
        write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
        meta = spark.read.schema(SCHEMA).parquet(path).select("n_tokens", F.col("_metadata.file_name").alias("file"))
        return checkpointed(with_starts(verified(read_tokens(spark, path)), meta).select("doc_id", "start", "n_tokens", "ids_crc32"))
