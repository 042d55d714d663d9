"""Token counts of whole texts, by batches of about equal bytes in Arrow functions that return lengths only.

Texts are taken in batches of ``batch_bytes`` bytes of UTF-8. Where a tokenizer drops white space (``pieces.boundaries``
tells from its description), a text longer than ``batch_bytes`` is split there, at safe boundaries: no token, normal form
or special string reaches across one. Each worker encodes a distinct piece once, so a batch costs the library its new
pieces alone. For other tokenizers texts are encoded whole. Memory is bounded by a batch, the pieces remembered, and the
longest stretch that can't be split.

Defined results: a null text counts as empty (0 bytes, 0 tokens); an empty table gives an empty result; repeated rows
are counted one by one; of other columns only those named in ``keep`` are passed on, and a clash with the added names
raises ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parsewarden.llm.common import sliced, table
from parsewarden.llm.pieces import TextTokens, by_bytes, text_tokens
from parsewarden.llm.shingles import SPACE

ADDED = ("n_bytes", "n_tokens", "over_limit")


def split_safely(text: bytes, most: int) -> list[bytes]:
    """Parts of about most bytes, cut at ASCII white space alone; joined they are the text."""
    if len(text) <= most:
        return [text]
    space = np.flatnonzero(SPACE[np.frombuffer(text, np.uint8)])
    cuts, last = [0], 0
    while len(text) - last > most:
        # the last white space that keeps the part short enough, else the next there is
        k = int(np.searchsorted(space, last + most, side="right")) - 1
        if k < 0 or space[k] <= last:
            k += 1
        if k == len(space):
            break
        last = int(space[k])
        cuts.append(last)
    return [text[i:j] for i, j in zip(cuts, [*cuts[1:], len(text)], strict=True)]


def count_tokens(texts: list[bytes | None], own: TextTokens, batch_bytes: int = 1 << 22) -> np.ndarray:
    """Tokens of each text, null as empty."""
    parts: list[bytes] = []
    owner: list[int] = []
    for i, text in enumerate(texts):
        if text:
            cut = split_safely(text, batch_bytes) if own.cut != "none" else [text]
            parts += cut
            owner += [i] * len(cut)
    counts = np.zeros(len(texts), np.int64)
    for start, end in by_bytes(np.fromiter(map(len, parts), np.int64, len(parts)), batch_bytes):
        np.add.at(counts, owner[start:end], own.counts(parts[start:end]))
    return counts


def token_counts(df: DataFrame, tokenizer_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 2048, batch_bytes: int = 1 << 22) -> DataFrame:
    """keep, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row. No shuffle."""
    if set(keep) & set(ADDED):
        raise ValueError(f"columns {sorted(set(keep) & set(ADDED))} clash with those added")
    own = df.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    schema = T.StructType([*own.select(*[F.col(f"`{c}`") for c in keep]).schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = text_tokens(tokenizer_path)
        for b in sliced(batches):
            texts = b.column(b.num_columns - 1).cast(pa.binary())
            n = count_tokens(texts.to_pylist(), tokens, batch_bytes)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pc.binary_length(texts).cast(pa.int64()), pa.array(n), pa.array(n > limit)], names=[*keep, *ADDED])

    return own.mapInArrow(run, schema)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
