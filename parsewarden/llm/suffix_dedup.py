"""Exact substring dedup: bytes covered by a string of ``length`` bytes that also starts in a document of smaller id.

1. ``anchors`` picks positions of each text by winnowing: of any ``length - GRAM + 1`` neighbouring GRAMs the one of
   smallest hash. Equal strings of ``length`` bytes pick equal anchors, so each is found at an anchor that it contains.
   The context of an anchor is the bytes of all strings of ``length`` bytes around it. Long texts are taken in pieces that
   overlap by ``length - 1`` bytes, so that memory is bounded and each string lies within a piece.
2. ``classes``: anchors, without their bytes, are sorted by (anchor, context, id) over range partitions, so even an anchor
   that a third of all documents have spreads over tasks. Occurrences of one context are one class; of them those of the
   smallest id stay, the others are covered by it as a whole. Anchors of one class are done. What a partition hands on to
   the next is one row, which tells rows of a class that goes on there whose smallest id came before.
3. ``contexts``: what is left of anchors with several classes gets its bytes, by one join with the texts. Two contexts
   that share a string agree on ``length - GRAM`` bytes around the anchor in all, so on half of it on the left or on the
   right: each is dealt out by either half with the anchor, a core of 35 bytes, whose bytes themselves are the key.
4. ``starts_again``: contexts of a core are cut down to the stretches that may repeat; the suffix array of the distinct
   stretches (``suffix_groups``) brings suffixes that agree on ``length`` bytes together, and the smallest id of such a
   run says which starts are covered.

Every size takes the same path. A core's contexts meet in one task, one for each distinct context that no other equals.

Defined results: a null text counts as empty; rows without id are never cut and never cut others; rows of one id never
cut each other, and equal rows are cut alike; texts shorter than ``length`` stay; an empty table gives an empty result;
further columns stay where texts are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parsewarden.llm.common import checkpointed, row_key, sliced, table, temporary, written
from parsewarden.llm.shingles import BYTE_VALUE, mix, powers
from parsewarden.llm.spans import merged, unnested, without_spans
from parsewarden.llm.suffix_groups import suffix_array

GRAM = 20
#: Bytes that are hashed at once: arrays of 8 bytes each fit into a cache.
SLICE = 1 << 17
#: Pieces of a longer text.
PIECE = 1 << 22
#: Contexts that go into one suffix array, besides the rest of a core's.
ROWS_A_CALL = 4_000


def sliding(a: np.ndarray, w: int, op: np.ufunc) -> np.ndarray:
    """op over a[i : i + w] at each i; the last w - 1 places hold less."""
    a, n = a.copy(), 1
    while 2 * n <= w:
        op(a[:-n], a[n:].copy(), out=a[:-n])
        n *= 2
    if n < w:
        op(a[: n - w], a[w - n :].copy(), out=a[: n - w])
    return a


def window_hashes(sums: np.ndarray, inverse: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(sums: np.ndarray, inverse: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n bytes at each place that has as many."""
    count = max(0, len(sums) - n)
    h = sums[n:] - sums[:count]
    h *= inverse[:count]
    h += np.uint64(n)
    return mix(h)


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p, inverse = powers(len(data) + 1)
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(BYTE_VALUE[data] * p[: len(data)], out=out[1:])
    return out, inverse


def anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Where each text (of length bytes at least) starts, with gaps between them, and of each anchor its place, text and hash.

    Also the prefix sums of the data, for further hashes.
    """
    gap = b"\xff"
    data = np.frombuffer(gap.join([*texts, b""]), np.uint8)
    sums, inverse = prefix_sums(data)
    h = gram_hashes(sums, inverse, GRAM)
    begin = np.cumsum([0, *[len(t) + 1 for t in texts]])
    low = (h >> np.uint64(32)).astype(np.uint32)
    worst = np.uint32(2**32 - 1)
    low[low == worst] -= np.uint32(1)
    # 0 marks closed windows below
    low[low == 0] = 1
    # no GRAM that meets a gap counts, and no window that does
    w = length - GRAM + 1
    ends = begin[1:] - 1
    for e in range(GRAM):
        x = ends - e
        low[x[(x >= 0) & (x < len(low))]] = worst
    least = sliding(low, w, np.minimum)
    for e in range(length):
        x = ends - e
        least[x[(x >= 0) & (x < len(least))]] = 0
    back = sliding(least[::-1], w, np.maximum)[::-1]
    places = np.flatnonzero((back == low) & (low != worst) & (back > 0))
    return begin, places, np.searchsorted(begin, places, side="right") - 1, h[places], (sums, inverse)


def batches_of_bytes(column: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Rows, offsets and bytes of the texts of length bytes at least, or of their pieces, about SLICE bytes at a time."""
    at: list[int] = []
    offset: list[int] = []
    own: list[bytes] = []
    total = 0
    for i, t in enumerate(column.cast(pa.binary()).to_pylist()):
        for k in range(0, max(1, len(t or b"") - length + 1), PIECE):
            if t and len(t) >= length:
                at.append(i)
                offset.append(k)
                own.append(t[k : k + PIECE + length - 1])
                total += len(own[-1])
                if total >= SLICE:
                    yield np.array(at), np.array(offset), own
                    at, offset, own, total = [], [], [], 0
    if own:
        yield np.array(at), np.array(offset), own


#: where: start of the context, its length and the anchor's place in it, in one number.
OCCURRENCES = "fp long, ctx long, id long, row long, where long"
NAMES = [x.split()[0] for x in OCCURRENCES.split(", ")]
FOUND = f"kind int, part int, {OCCURRENCES}"
#: Kinds of FOUND: a span that is covered, a context to look into, a row of the class that a partition begins with, and
#: the first and the last class of a partition.
COVERED, OPEN, PENDING, FIRST, LAST = range(5)


def occurrences(docs: DataFrame, length: int) -> DataFrame:
    """OCCURRENCES: hashes of each anchor and its context, id and row of the text, and where."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            for at, offset, own in batches_of_bytes(b.column(2), length):
                begin, place, text, h, (sums, inverse) = anchors(own, length)
                s, e = np.maximum(begin[text], place - (length - GRAM)), np.minimum(begin[text + 1] - 1, place + length)
                ctx = window_hashes(sums, inverse, s, e) ^ mix((place - s).astype(np.uint64))
                rows, start = pa.array(at[text]), s + offset[text] - begin[text]
                where = start << 32 | (e - s) << 16 | (place - s)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ctx.view(np.int64)), b.column(0).take(rows), b.column(1).take(rows), pa.array(where)], names=NAMES)

    return docs.mapInArrow(run, OCCURRENCES)


def found_rows(kind: int, part: int, rows: pa.RecordBatch | pa.Table) -> pa.RecordBatch:
    n = rows.num_rows
    columns = [rows.column(c) for c in NAMES]
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
    if kind == COVERED:
        columns[:2] = [pa.nulls(n, pa.int64())] * 2
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, part, np.int32)), *columns], names=["kind", "part", *NAMES])


def classes(occ: DataFrame) -> DataFrame:
    """FOUND of the occurrences, by one shuffle; see the module."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last: tuple[int, int] | None = None  # anchor and context of the row before
        least = 0  # smallest id of that class
        count, opening, pending = 0, True, True  # classes of that anchor; is it the first anchor here; is it the first class
        held: list[pa.RecordBatch] = []  # rows of smallest id of the only class of that anchor
        tail: pa.RecordBatch | None = None
        for b in batches:
            if not b.num_rows:
                continue
            fp, ctx, ids = (b.column(i).to_numpy() for i in range(3))
            if last is None:
                yield found_rows(FIRST, part, b.slice(0, 1))
                last, least, count = (int(fp[0]), int(ctx[0])), int(ids[0]), 1
            prior_fp, prior_ctx = np.concatenate([[last[0]], fp[:-1]]), np.concatenate([[last[1]], ctx[:-1]])
            new_anchor = fp != prior_fp
            new_class = new_anchor | (ctx != prior_ctx)
            of, anchor = np.cumsum(new_class), np.cumsum(new_anchor)
            smallest = np.concatenate([[least], ids[new_class]])[of]
            many = np.bincount(anchor, new_class, anchor[-1] + 1)
            many[0] += count
            several = many > 1
            several[0] |= opening
            waits = pending & (of == 0)
            later = ~waits & (ids > smallest)
            mine = ~waits & ~later
            yield found_rows(COVERED, part, b.filter(pa.array(later)))
            yield found_rows(PENDING, part, b.filter(pa.array(waits)))
            if several[0]:
                yield from (found_rows(OPEN, part, x) for x in held)
            if several[0] or len(many) > 1:
                held = []
            yield found_rows(OPEN, part, b.filter(pa.array(mine & several[anchor])))
            if not several[-1]:
                held.append(b.filter(pa.array(mine & (anchor == anchor[-1]))))
            opening &= len(many) == 1
            pending &= of[-1] == 0
            last, least, count = (int(fp[-1]), int(ctx[-1])), int(smallest[-1]), int(many[-1])
            tail = b.slice(b.num_rows - 1)
        # the anchor may go on in the next partition
        yield from (found_rows(OPEN, part, x) for x in held)
        if tail is not None:
            row = pa.RecordBatch.from_arrays([*tail.columns[:2], pa.array([least]), *tail.columns[3:]], names=NAMES)
            yield found_rows(LAST, part, row)

    return occ.repartitionByRange("fp", "ctx", "id").sortWithinPartitions("fp", "ctx", "id").mapInArrow(run, FOUND)


def settled(found: DataFrame) -> DataFrame:
    """found, with each PENDING row COVERED or OPEN. What partitions hand on is a row each, so it may be broadcast."""
    spark = found.sparkSession
    ends = found.filter(F.col("kind") >= FIRST).select("part", "kind", "fp", "ctx", "id").orderBy("part", "kind").collect()
    handed, before = {}, None
    for first, last in zip(ends[::2], ends[1::2], strict=True):
        name = first["fp"], first["ctx"]
        least = before[1] if before and before[0] == name else first["id"]
        handed[first["part"]] = least
        own = last["fp"], last["ctx"]
        before = own, least if own == name else last["id"]
    handed = F.broadcast(spark.createDataFrame(list(handed.items()), "part int, least long"))
    kind = F.when(F.col("kind") != PENDING, F.col("kind")).when(F.col("id") > F.col("least"), COVERED).otherwise(OPEN)
    return found.filter(F.col("kind") <= PENDING).join(handed, "part").withColumn("kind", kind).select(found.columns)


CORES = "core binary, id long, row long, s int, at int, part binary"


def contexts(docs: DataFrame, open_: DataFrame, length: int) -> DataFrame:
    """CORES: for each open context one or two stretches of it with their core, where that is in it, and where they start."""
    half = (length - GRAM) // 2
    rest = length - GRAM - half

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = b.column(2).cast(pa.binary()).to_pylist()
            of, s, e, at = unnested(b.column(3), "s", "e", "at")
            a = s + at
            # strings with half of the rest or more before the anchor, then those with less
            of, s, e = np.tile(of, 2), np.tile(s, 2), np.tile(e, 2)
            c, end = np.concatenate([a - half, a]), np.concatenate([a + GRAM, a + GRAM + rest + 1])
            lo, hi = s.copy(), e.copy()
            hi[: len(a)] = np.minimum(hi[: len(a)], a + GRAM + rest)
            lo[len(a) :] = np.maximum(lo[len(a) :], a - half + 1)
            has = (c >= s) & (end <= e) & (hi - lo >= length)
            of, c, end, lo, hi = of[has], c[has], end[has], lo[has], hi[has]
            own = of.tolist()
            core = [texts[i][x:y] for i, x, y in zip(own, c.tolist(), end.tolist(), strict=True)]
            parts = [texts[i][x:y] for i, x, y in zip(own, lo.tolist(), hi.tolist(), strict=True)]
            rows = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(core, pa.binary()), b.column(0).take(rows), b.column(1).take(rows), pa.array(lo.astype(np.int32)), pa.array((c - lo).astype(np.int32)), pa.array(parts, pa.binary())], names=[x.split()[0] for x in CORES.split(", ")])

    grouped = open_.groupBy("id", "row").agg(F.collect_set(F.struct("s", "e", "at")).alias("spans"))
    return docs.join(grouped, ["id", "row"]).select("id", "row", "t", "spans").mapInArrow(run, CORES)


def starts_again(parts: list[bytes], at: list[int], cores: list[bytes], ids: np.ndarray, length: int) -> list[np.ndarray]:
    """For each part the starts in it of strings of length bytes, around its core, that also start in a part of smaller id.

    parts come sorted by their core, which is at the offset ``at``, and those strings hold it. Hashes of the strings pick
    the stretch of each part that may repeat, without deciding; equal stretches of a core are one, with the smallest id.
    The suffix array of the distinct stretches decides, with the bytes of the core as a single one. Its order is kept
    within each core, where suffixes that agree on a string stand together.
    """
    none = np.empty(0, np.int64)
    out = [none] * len(parts)
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    begin = np.concatenate([[0], np.cumsum(sizes)])
    sums, inverse = prefix_sums(data)
    h = gram_hashes(sums, inverse, length)
    count = np.maximum(0, sizes - length + 1)
    of = np.repeat(np.arange(len(parts)), count)
    place = begin[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    own_h = h[place]
    order = np.argsort(own_h)
    same = own_h[order[1:]] == own_h[order[:-1]]
    twice = np.zeros(len(place), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    place, of = place[twice], of[twice]
    if not len(place):
        return out
    edge = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    own = of[edge].tolist()
    lo, hi = (place[edge] - begin[own]).tolist(), (np.concatenate([place[edge[1:] - 1], place[-1:]]) + length - begin[own]).tolist()
    stretches: dict[tuple[bytes, int, bytes], list[int]] = {}
    for k, i in enumerate(own):
        if lo[k] <= at[i] and at[i] + len(cores[i]) <= hi[k]:
            stretches.setdefault((cores[i], at[i] - lo[k], parts[i][lo[k] : hi[k]]), []).append(k)
    # a stretch that one id alone has, of a core with no other stretch, repeats nowhere
    alone: dict[bytes, tuple[int, int]] = {}
    for (core, _, _), members in stretches.items():
        low, high = alone.get(core, (2**63 - 1, -(2**63)))
        alone[core] = min(low, *(ids[own[k]] for k in members)), max(high, *(ids[own[k]] for k in members))
    keys = [x for x in stretches if alone[x[0]][0] < alone[x[0]][1]]
    if not keys:
        return out
    width = np.array([len(c) for c, _, _ in keys], np.int64)
    where = np.cumsum([0, *[len(x) - len(c) + 1 for c, _, x in keys]])
    text = b"".join(x[:y] + b"\xff" + x[y + len(c) :] for c, y, x in keys)
    array = suffix_array(text, where[:-1].tolist())
    string = np.searchsorted(where, array, side="right") - 1
    # bytes of a string of length bytes, its core counting as one
    short = length - width + 1
    middle = where[:-1] + np.array([y for _, y, _ in keys], np.int64)
    full = (array + short[string] <= where[string + 1]) & (array <= middle[string]) & (middle[string] < array + short[string])
    array, string = array[full], string[full]
    values = np.frombuffer(text + b"\0" * length, np.uint8)
    number: dict[bytes, int] = {}
    name = np.array([number.setdefault(c, len(number)) for c, _, _ in keys], np.int64)
    # strings of other cores stand between those of one, where what follows them differs
    by_core = np.argsort(name[string], kind="stable")
    array, string = array[by_core], string[by_core]
    same = name[string[1:]] == name[string[:-1]]
    for k in range(int(short.max())):
        same &= (values[array[1:] + k] == values[array[:-1] + k]) | (k >= short[string[1:]])
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    least = np.array([min(ids[own[k]] for k in stretches[x]) for x in keys])
    smallest = np.repeat(np.minimum.reduceat(least[string], first), np.diff([*first, len(array)])) if len(array) else least[:0]
    by_string = np.lexsort((array, string))
    cut = np.searchsorted(string[by_string], np.arange(len(keys) + 1))
    for j, x in enumerate(keys):
        mine = by_string[cut[j] : cut[j + 1]]
        starts, low = array[mine] - where[j], smallest[mine]
        for k in stretches[x]:
            out[own[k]] = starts[low < ids[own[k]]] + lo[k]
    return out


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that come sorted by their first column, about ROWS_A_CALL at a time, equal ones together."""
    held: list[pa.RecordBatch] = []
    total, last = 0, None
    for b in sliced(batches, ROWS_A_CALL):
        key = b.column(0)
        begins = np.flatnonzero(pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False)) + 1
        if held and key[0].as_py() != last:
            begins = np.append(0, begins)
        if total + b.num_rows >= ROWS_A_CALL and len(begins):
            cut = int(begins[-1])
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held, total, b = [], 0, b.slice(cut)
        held.append(b)
        total += b.num_rows
        last = key[-1].as_py()
    if held:
        yield pa.Table.from_batches(held)


def partial_repeats(rows: DataFrame, length: int) -> DataFrame:
    """id, row, s and e of the spans of CORES that a context of smaller id covers."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        cores, ids = t.column("core").to_pylist(), t.column("id").to_numpy()
        found = starts_again(t.column("part").to_pylist(), t.column("at").to_pylist(), cores, ids, length)
        s = t.column("s").to_numpy()
        at, starts, ends = [], [], []
        for i, x in enumerate(found):
            if len(x):
                a, b = merged(x, x + length)
                at.append(np.full(len(a), i))
                starts.append(a + s[i])
                ends.append(b + s[i])
        flat = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        own = t.select(["id", "row"]).take(pa.array(flat(at), pa.int64())).combine_chunks()
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in own.columns]
        return pa.RecordBatch.from_arrays([*columns, pa.array(flat(starts).astype(np.int32)), pa.array(flat(ends).astype(np.int32))], names=["id", "row", "s", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            yield solve(t)

    return rows.repartition("core").sortWithinPartitions("core").mapInArrow(run, "id long, row long, s int, e int")


def repeated_spans(df: DataFrame, text: str = "text", id_col: str = "doc_id", length: int = 50) -> DataFrame:
    """__id, __row and __spans (byte offsets, may overlap) of each row that has any."""
    if not GRAM + 2 <= length < 1 << 14:
        raise ValueError(f"strings must have {GRAM + 2} bytes at least, and less than {1 << 14}")
    spark = df.sparkSession
    docs = df.filter(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), row_key(text).alias("row"), F.col(f"`{text}`").alias("t"))
    with temporary(spark, "classes") as path:
        found = settled(written(classes(occurrences(docs, length)), path))
        start = F.shiftright("where", 32)
        end = start + F.shiftright("where", 16).bitwiseAND(F.lit(0xFFFF))
        found = found.select("kind", "id", "row", start.cast("int").alias("s"), end.cast("int").alias("e"), F.col("where").bitwiseAND(F.lit(0xFFFF)).cast("int").alias("at"))
        open_ = found.filter(F.col("kind") == OPEN).drop("kind")
        spans = found.filter(F.col("kind") == COVERED).select("id", "row", "s", "e").union(partial_repeats(contexts(docs, open_, length), length))
        spans = spans.groupBy(F.col("id").alias("__id"), F.col("row").alias("__row")).agg(F.collect_list(F.struct("s", "e")).alias("__spans"))
        return checkpointed(spans)


def suffix_dedup(df: DataFrame, text: str = "text", id_col: str = "doc_id", length: int = 50) -> DataFrame:
    """df with the repeats cut out of its texts."""
    return without_spans(df, repeated_spans(df, text, id_col, length), text, id_col, replace=True)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_spans(docs, repeated_spans(docs), "text", "doc_id")
