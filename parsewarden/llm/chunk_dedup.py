"""Substring dedup by content-defined chunks: boundaries from a gear rolling hash, chunks told apart by digest.

A boundary lies where the top bits of the gear hash of the last 16 bytes are zero, moved on to the next start of a
character, if the chunk has ``min_bytes``; a chunk without any is cut at about ``max_bytes``. Boundaries depend on the
bytes near them alone, so an insertion shifts no boundary beyond the next. The hash of all positions of a batch of texts
comes from four shifts and additions of whole arrays.

A chunk is a repeat if a document of smaller id has one of the same 128-bit digest. The smallest id of each digest comes
from one aggregation that combines before its shuffle, so a chunk that a third of all documents share costs a row for
each task. On the way back the fewer than ``HOT`` digests that hold more than one in ``HOT`` of all repeated chunks are looked
up where texts are cut again: their chunks don't meet in one task, and neighbours that repeat make one row; the others are joined. Runs of repeats of at
least ``min_run_bytes`` are removed, so chance repeats of a phrase stay, and documents of nothing but repeats, however short.

Defined results: a null text counts as empty; rows without id are never cut and never cut others; rows of one id never
cut each other, and equal rows are cut alike; an empty table gives an empty result; further columns stay where texts are
replaced and never clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parsewarden.llm.common import checkpointed, handing_back, row_key, sliced, table
from parsewarden.llm.spans import without_spans

#: Bytes that the hash looks back on; it has as many bits.
LOOK_BACK = 16
#: Never in UTF-8; stands between texts, and its gear value is 0.
GAP = b"\xff" * LOOK_BACK
BATCH_BYTES = 1 << 22
#: A digest is hot if it holds more than one in so many repeated chunks; there are fewer than so many.
HOT = 1000
#: Shorter runs of repeated chunks stay, unless they are a whole text: chance repeats of a phrase, see README.
MIN_RUN_BYTES = 50


def gear_table(seed: int = 7) -> np.ndarray:
    out = np.random.default_rng(seed).integers(0, 1 << 16, 256).astype(np.uint16)
    out[255] = 0
    return out


GEAR = gear_table()


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte the gear hash (h = 2 h + GEAR[byte], 16 bits) of it and those before it."""
    h = GEAR[data]
    for k in (1, 2, 4, 8):
        h[k:] += h[:-k] << np.uint16(k)
    return h


def boundaries(data: np.ndarray, bits: int) -> np.ndarray:
    """Sorted offsets at which a chunk may begin."""
    hit = np.flatnonzero(gear_hashes(data) >> np.uint16(LOOK_BACK - bits) == 0) + 1
    hit = hit[hit < len(data)]
    for _ in range(3):
        hit = np.where(((data[hit] & 0xC0) == 0x80) & (hit + 1 < len(data)), hit + 1, hit)
    return np.unique(hit)


def chunk_ends(cuts: list[int], start: int, end: int, data: bytes, min_bytes: int, max_bytes: int) -> list[int]:
    """Ends of the chunks of data[start:end], given where chunks may begin."""
    out, last = [], start
    for cut in [*cuts, end]:
        while cut - last > max_bytes:
            at = last + max_bytes
            while at > last + 1 and data[at] & 0xC0 == 0x80:
                at -= 1
            out.append(at)
            last = at
        if cut - last >= min_bytes or cut == end:
            if cut > last:
                out.append(cut)
            last = cut
    return out


def chunk_rows(texts: list[str | None], bits: int, min_bytes: int, max_bytes: int) -> Iterator[tuple[int, list[int], list[bytes]]]:
    """For each text with bytes its index, the offsets of its chunks and of its end, and the digests of its chunks."""
    own: list[tuple[int, bytes]] = []
    total = 0

    def flush() -> Iterator[tuple[int, list[int], list[bytes]]]:
        data = GAP.join([b"", *[t for _, t in own]])
        cuts, at, k = boundaries(np.frombuffer(data, np.uint8), bits).tolist(), LOOK_BACK, 0
        for i, t in own:
            end = at + len(t)
            while k < len(cuts) and cuts[k] <= at:
                k += 1
            first = k
            while k < len(cuts) and cuts[k] < end:
                k += 1
            ends = [at, *chunk_ends(cuts[first:k], at, end, data, min_bytes, max_bytes)]
            yield i, [x - at for x in ends], [xxhash.xxh3_128_digest(data[x:y]) for x, y in zip(ends, ends[1:], strict=False)]
            at = end + LOOK_BACK

    for i, text in enumerate(texts):
        if text:
            own.append((i, text.encode()))
            total += len(own[-1][1])
            if total >= BATCH_BYTES:
                yield from flush()
                own, total = [], 0
    if own:
        yield from flush()


def settled_runs(starts: list[int], ends: list[int], digests: list[bytes], id_: int, settled: dict[bytes, int]) -> tuple[list[int], list[int], list[bytes | None]]:
    """The chunks of a text without those of settled digests; runs of those that a smaller id has are a row without digest."""
    if settled.keys().isdisjoint(digests):
        return starts, ends, digests
    s, e, left = [], [], []
    for start, end, d in zip(starts, ends, digests, strict=True):
        first = settled.get(d)
        if first is not None and first >= id_:
            continue
        if first is not None and left and left[-1] is None and e[-1] == start:
            e[-1] = end
            continue
        s.append(start)
        e.append(end)
        left.append(d if first is None else None)
    return s, e, left


def chunks(df: DataFrame, text: str, id_col: str, bits: int, min_bytes: int, max_bytes: int, settled: dict[bytes, int] | None = None) -> DataFrame:
    """A row for each chunk: __id, __row, s, e (byte offsets; the end of a text is -e), digest.

    settled: smallest ids of some digests; see ``settled_runs`` for their chunks.
    """
    own = df.filter(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("__id"), row_key(text).alias("__row"), F.col(f"`{text}`").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            of, starts, ends, digests = [], [], [], []
            ids = b.column(0).to_pylist()
            for i, at, own in chunk_rows(b.column(2).to_pylist(), bits, min_bytes, max_bytes):
                s, e = at[:-1], [*at[1:-1], -at[-1]]
                if settled:
                    s, e, own = settled_runs(s, e, own, ids[i], settled)
                of += [i] * len(own)
                starts += s
                ends += e
                digests += own
            of = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(digests, pa.binary())], names=["__id", "__row", "s", "e", "digest"])

    return own.mapInArrow(handing_back(run), "__id long, __row long, s int, e int, digest binary")


def repeated_spans(df: DataFrame, text: str = "text", id_col: str = "doc_id", bits: int = 5, min_bytes: int = 16, max_bytes: int = 256, min_run_bytes: int = MIN_RUN_BYTES) -> DataFrame:
    """__id, __row and __spans (runs of repeated chunks, as byte offsets) of each row that has any."""
    every = chunks(df, text, id_col, bits, min_bytes, max_bytes)
    first = every.groupBy("digest").agg(F.min("__id").alias("first"), F.max("__id").alias("last"), F.count("*").alias("n")).filter("first < last").select("digest", "first", "n")
    first = checkpointed(first)
    total = first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = {bytes(r["digest"]): r["first"] for r in first.filter(F.col("n") * HOT > total).select("digest", "first").collect()}
    every = chunks(df, text, id_col, bits, min_bytes, max_bytes, hot)
    own = every.filter("digest is not null").join(first.filter(F.col("n") * HOT <= total), "digest").filter("first < __id")
    again = own.select("__id", "__row", "s", "e").union(every.filter("digest is null").select("__id", "__row", "s", "e"))
    own = again.groupBy("__id", "__row").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("c"))
    c = F.col("c")
    # a run begins where no repeat ends, and ends where the last repeat before the next beginning does
    begins = F.filter(F.transform(c, lambda x, i: F.when((i > 0) & (F.get(c, i - 1)["e"] == x["s"]), F.lit(None)).otherwise(x["s"])), lambda x: x.isNotNull())
    finish = F.filter(F.transform(c, lambda x, i: F.when(F.get(c, i + 1)["s"] == x["e"], F.lit(None)).otherwise(x["e"])), lambda x: x.isNotNull())
    long = F.filter(F.arrays_zip(begins.alias("s"), finish.alias("e")), lambda x: (F.abs(x["e"]) - x["s"] >= min_run_bytes) | ((x["s"] == 0) & (x["e"] < 0)))
    runs = F.transform(long, lambda x: F.struct(x["s"].alias("s"), F.abs(x["e"]).alias("e")))
    return own.select("__id", "__row", runs.alias("__spans")).filter(F.size("__spans") > 0)


def chunk_dedup(df: DataFrame, text: str = "text", id_col: str = "doc_id", **how) -> DataFrame:
    """df with the repeats cut out of its texts."""
    return without_spans(df, repeated_spans(df, text, id_col, **how), text, id_col, replace=True)


def op3_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_spans(docs, repeated_spans(docs), "text", "doc_id")
