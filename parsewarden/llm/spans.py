"""Removal of byte spans from texts, shared by the substring operators."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parsewarden.llm.common import row_key, sliced


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the spans; spans that touch are one run."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    first = np.concatenate([[True], starts[1:] > reach[:-1]])
    return starts[first], reach[np.concatenate([np.flatnonzero(first)[1:] - 1, [len(starts) - 1]])]


def unnested(lists: pa.ListArray, *names: str) -> tuple[np.ndarray, ...]:
    """Of a column of lists of structs the row that each struct stands in, and those of its fields, as longs."""
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    return np.repeat(np.arange(len(lists)), counts), *[pc.struct_field(flat, k).to_numpy(zero_copy_only=False).astype(np.int64) for k in names]


def without_spans(df: DataFrame, spans: DataFrame, text: str, id_col: str, replace: bool = False) -> DataFrame:
    """Cut spans out of the texts of df.

    spans: __id, __row (row_key of the text) and __spans (array of struct<s,e>, byte offsets). Rows of df that it doesn't
    name stay whole. Returns id_col, n_bytes, n_removed, n_spans and kept_sha256; with replace instead the columns of df,
    the remaining text in place of text (incomplete characters at a cut are dropped).
    """
    names = df.columns
    left = df.withColumn("__row", row_key(text)).withColumn("__text", F.coalesce(F.col(f"`{text}`"), F.lit("")))
    if not replace:
        left = left.select(F.col(f"`{id_col}`"), "__row", "__text")
    out = left.join(spans, (left[id_col] == spans["__id"]) & (left["__row"] == spans["__row"]), "left").drop("__id", spans["__row"])
    keep = names if replace else [id_col]
    own = out.select(*[F.col(f"`{c}`") for c in keep], "__text", "__spans")
    fields = [f for f in df.schema.fields if f.name in keep]
    if replace:
        schema = T.StructType(fields)
    else:
        schema = T.StructType([*fields, *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept_sha256", T.StringType())])
    at = keep.index(text) if replace else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = b.column(len(keep)).cast(pa.binary()).to_pylist()
            numbers, hashes, left = [], [], b.column(at).to_pylist() if replace else []
            # spans of all rows at once: the row is the upper half of a place, so those of different rows never touch
            of, s, e = unnested(b.column(len(keep) + 1), "s", "e")
            s, e = merged(of << 32 | s, of << 32 | e)
            edge = np.searchsorted(s >> 32, np.arange(b.num_rows + 1)).tolist()
            s, e = (s & 0xFFFFFFFF).tolist(), (e & 0xFFFFFFFF).tolist()
            for i, data in enumerate(texts):
                j, k = edge[i], edge[i + 1]
                kept = b"".join([data[x:y] for x, y in zip([0, *e[j:k]], [*s[j:k], len(data)], strict=True)]) if j < k else data
                if not replace:
                    numbers.append((len(data), len(data) - len(kept), k - j))
                    hashes.append(hashlib.sha256(kept).hexdigest())
                elif j < k:
                    left[i] = kept.decode(errors="ignore")
            if replace:
                columns = [*b.columns[:at], pa.array(left, pa.string()), *b.columns[at + 1 : len(keep)]]
            else:
                columns = [b.column(0), *[pa.array([x[k] for x in numbers], pa.int64()) for k in range(3)], pa.array(hashes, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return own.mapInArrow(run, schema)
