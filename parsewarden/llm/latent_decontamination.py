"""Benchmark decontamination by latent semantic retrieval, then word checks.

1. ``word_table``: one read of all texts. Words become 32-bit numbers (hashes of their lower-case form), kept as a binary
   column; their top bits are the feature that a word counts as. The same pass counts the passages (stretches of ``half``
   words) that each feature is in. Features in more than ``common`` of the passages get no weight, but for the rarest few
   of each item's parts.
2. ``fit``: distributed randomised SVD of the TF-IDF matrix A of all passages, in one pass over those numbers: the sketch
   B = A'G, with a few random signs for each passage in G, spans what A's leading right singular vectors do; those of B
   stand for them. ``rank`` is fixed, and well below the number of items of a benchmark; items take no part in the fit, so
   words that stand together in the corpus come together in the space. A task's sketch is of fixed size.
3. ``search``: each passage, and each with the next, against all items by cosine in the latent space.
   An item longer than a window is looked for by its parts: overlapping stretches of at most a window. For each candidate
   whose surroundings hold enough of the item's words at all, the longest common subsequence of the whole item's words
   with the window, widened by the item's length on either side.

Items are searched ``block_parts`` parts at a time, so what goes to the executors is bounded; further blocks read the
table of numbers again, never the texts.

An item has leaked into a document if ``strong`` of its words are in common in order, or ``weak`` of them and all of its
answer: the words of the column ``answer``, else of the last sentence of the item, or the last ``answer_words`` words if
it has fewer. This finds paraphrases that keep the answer. Two words of one number count as equal: odds of some one in a
million for a candidate.

Defined results: null or empty texts and items without words match nothing; repeated rows are each searched; rows are
told apart by id and text; null ids are returned as null; an empty table on either side gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parsewarden.llm.common import checkpointed, handing_back, row_key, sliced, table, temporary, written
from parsewarden.llm.pieces import by_bytes
from parsewarden.llm.shingles import SLICE, mix, word_hashes

#: Features, and rows of an array that are summed together.
FEATURE_BITS = 15
FEATURES = 1 << FEATURE_BITS
ROWS_A_BLOCK = 256
#: Random columns of the sketch that a passage counts in.
SIGNS = 4
#: Words of a task that are sketched at once.
WORDS_AT_ONCE = 1 << 20
#: Bits of the bitmap of a stretch, which bounds the words that an item has in common with it.
SIGNATURE = 2048
#: Stretches whose bitmaps are held at once.
STRETCHES = 4096
#: Punctuation of ASCII, to white space. Words have their A-Z lower-cased where they are hashed, other letters before.
PLAIN = bytes(32 if 33 <= i < 48 or 58 <= i < 65 or 91 <= i < 97 or 123 <= i < 127 else i for i in range(256))
RESULT = "doc_id long, item_id long, cosine double, lcs int, n_item_words int, answer_found boolean"
WORDS = "doc_id long, __row long, words binary, block int, data binary"


@dataclass(frozen=True)
class Settings:
    half: int = 32
    rank: int = 40
    width: int = 64
    common: float = 0.002
    always: int = 20
    rarest: int = 8
    cosine: float = 0.45
    lowest: float = 0.2
    strong: float = 0.7
    weak: float = 0.6
    answer_words: int = 5
    block_parts: int = 20_000


def plain(text: str | bytes) -> bytes:
    data = text.encode() if isinstance(text, str) else text
    return (data if data.isascii() else data.decode().lower().encode()).translate(PLAIN)


def words_of(texts: pa.Array):
    """Indexes of the texts, their word hashes and the offsets of the texts among these, about SLICE bytes at a time."""
    at: list[int] = []
    own: list[bytes] = []
    total = 0
    for i, t in enumerate(texts.cast(pa.binary()).to_pylist()):
        if t:
            at.append(i)
            own.append(plain(t))
            total += len(own[-1])
            if total >= SLICE:
                yield at, *word_hashes(own)
                at, own, total = [], [], 0
    if own:
        yield at, *word_hashes(own)


def stretches(n: int, half: int) -> list[tuple[int, int]]:
    """Parts of an item of n words: all of it if it fits into a window, else pairs of neighbours of an even number of stretches."""
    if n <= 2 * half:
        return [(0, n)]
    m = 2 * -(-n // (2 * half))
    cuts = [n * i // m for i in range(m + 1)]
    return list(zip(cuts, cuts[2:], strict=False))


def numbers_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype(np.uint32)


def features_of(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint32(32 - FEATURE_BITS)).astype(np.int64)


@dataclass
class Items:
    ids: list[int]
    words: list[list[int]]
    answers: list[list[int]]
    parts: list[tuple[int, list[int]]]  # number of the item, words

    @staticmethod
    def of(rows: list[tuple[int, str, str | None]], answer_words: int, half: int) -> Items:
        answer = [a if a else next((x for x in reversed(re.split(r"[.!?\n]+", t)) if plain(x).split()), "") for _, t, a in rows]
        hashed = lambda texts: (lambda h, at: [numbers_of(h[i:j]).tolist() for i, j in zip(at[:-1], at[1:], strict=True)])(*word_hashes([plain(t) for t in texts]))
        words = hashed([t for _, t, _ in rows])
        answers = [a if len(a) >= answer_words or given else w[-answer_words:] for a, w, (_, _, given) in zip(hashed(answer), words, rows, strict=True)]
        parts = [(k, x[i:j]) for k, x in enumerate(words) if x for i, j in stretches(len(x), half)]
        return Items([i for i, _, _ in rows], words, answers, parts)


def passages(offsets: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of each text's first passage (and of the last's end), and of the passage of each word."""
    sizes = np.diff(offsets)
    first = np.concatenate([[0], np.cumsum((sizes + half - 1) // half)])
    within = np.arange(offsets[-1]) - np.repeat(offsets[:-1], sizes)
    return first, np.repeat(first[:-1], sizes) + within // half


def blocks_of(total: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    blocks = np.ascontiguousarray(total).reshape(len(total) // ROWS_A_BLOCK, -1)
    used = np.flatnonzero(blocks.any(axis=1))
    return used.astype(np.int32), [blocks[i].tobytes() for i in used]


def summed_rows(parts: DataFrame, dtype, width: int) -> np.ndarray:
    """Sum of the arrays of FEATURES rows whose blocks (block int, data binary) are the rows of parts; its size is fixed.

    Blocks are added up as they come, so a task holds one of each.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = np.frombuffer(x.as_buffer(), dtype)
                if k in sums:
                    sums[k] += own
                else:
                    sums[k] = own.astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in sums.values()], pa.binary())], names=["block", "data"])

    out = np.zeros((FEATURES, width), np.float32)
    for r in parts.select("block", "data").repartition("block").mapInArrow(add, "block int, data binary").collect():
        out[r["block"] * ROWS_A_BLOCK : (r["block"] + 1) * ROWS_A_BLOCK] = np.frombuffer(r["data"], np.float32).reshape(ROWS_A_BLOCK, width)
    return out


def word_table(docs: DataFrame, half: int) -> DataFrame:
    """WORDS: a row for each text that has words, and rows (block, data) of counts: passages by feature, and all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((FEATURES, 2), np.float32)
        for b in sliced(batches):
            for at, hashes, offsets in words_of(b.column(2)):
                words = numbers_of(hashes)
                first, of = passages(offsets, half)
                # the passages of a batch are few enough for a number of 64 bits, mostly for one of 32, which sorts faster
                pairs = (of << FEATURE_BITS) + features_of(words)
                pairs = np.sort(pairs.astype(np.uint32) if first[-1] < 1 << (32 - FEATURE_BITS) else pairs)
                seen[:, 0] += np.bincount(pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] & (FEATURES - 1), minlength=FEATURES)
                seen[0, 1] += first[-1]
                rows = pa.array(at, pa.int64())
                data = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((4 * offsets).astype(np.int32)), pa.py_buffer(words)])
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), data, pa.nulls(len(at), pa.int32()), pa.nulls(len(at), pa.binary())], names=WORD_NAMES)
        used, data = blocks_of(seen)
        none = pa.nulls(len(used), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.nulls(len(used), pa.binary()), pa.array(used), pa.array(data, pa.binary())], names=WORD_NAMES)

    return docs.mapInArrow(handing_back(run), WORDS)


WORD_NAMES = [x.split()[0] for x in WORDS.split(", ")]


def read_words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, words and offsets of a number of texts, about WORDS_AT_ONCE words at a time."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 4
    data = np.frombuffer(column.buffers()[2] or b"", np.uint32)
    for start, end in by_bytes(np.diff(ends), WORDS_AT_ONCE):
        yield start, data[ends[start] : ends[end]], ends[start : end + 1] - ends[start]


def weights(table_: DataFrame, items: list[Items], s: Settings) -> np.ndarray:
    """Weight of each feature: inverse document frequency over all passages, 0 for those that are common."""
    seen = summed_rows(table_.filter("block is not null"), np.float32, 2)
    df, every = seen[:, 0].astype(np.float64), float(seen[0, 1])
    keep = df <= max(s.always, s.common * every)
    for block in items:
        for _, x in block.parts:
            own = np.unique(features_of(np.array(x, np.uint32)))
            keep[own[np.argsort(df[own], kind="stable")[: s.rarest]]] = True
    return np.where(keep, np.log((1 + every) / (1 + df)) + 1e-3, 0).astype(np.float32)


def sketched(words: np.ndarray, offsets: np.ndarray, weight: np.ndarray, half: int, width: int, total: np.ndarray) -> None:
    """Add the passages of some texts to total, the array A'G laid flat."""
    feature = features_of(words)
    w = weight[feature]
    at = np.flatnonzero(w)
    if not len(at):
        return
    first, of = passages(offsets, half)
    feature, w, of = feature[at], w[at], of[at]
    norm = np.sqrt(np.bincount(of, w.astype(np.float64) ** 2, minlength=first[-1]))
    w = w / norm[of]
    name = np.zeros(first[-1], np.uint64)
    np.add.at(name, of, mix(words[at].astype(np.uint64)))
    for k in range(SIGNS):
        h = mix(name * np.uint64(2 * k + 3) + np.uint64(k))
        column, sign = (h % np.uint64(width)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)
        total += np.bincount(feature * width + column[of], w * sign[of], minlength=FEATURES * width).astype(np.float32)


def fit(table_: DataFrame, weight: np.ndarray, s: Settings) -> np.ndarray:
    """Latent vectors of all features (FEATURES x rank), times their weights."""
    sent = table_.sparkSession.sparkContext.broadcast(weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FEATURES * s.width, np.float32)
        for b in batches:
            for _, words, offsets in read_words(b.column(0)):
                sketched(words, offsets, sent.value, s.half, s.width, total)
        used, data = blocks_of(total.reshape(FEATURES, s.width))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(data, pa.binary())], names=["block", "data"])

    sketch = summed_rows(table_.filter("block is null").select("words").mapInArrow(handing_back(run), "block int, data binary"), np.float32, s.width).astype(np.float64)
    value, vector = np.linalg.eigh(sketch.T @ sketch)
    order = [k for k in np.argsort(-value)[: s.rank] if value[k] > 1e-9 * max(1e-30, value.max())]
    return (sketch @ (vector[:, order] / np.sqrt(value[order])) * weight[:, None]).astype(np.float32)


def common_length(item: list[int], text: list[int]) -> int:
    """Length of the longest common subsequence, by one addition of long integers a word of text."""
    where: dict[int, int] = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << i
    full = v = (1 << len(item)) - 1
    for w in text:
        if m := where.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


class Searcher:
    def __init__(self, items: Items, latent: np.ndarray, s: Settings):
        self.items, self.latent, self.s = items, latent, s
        self.of = np.array([k for k, _ in items.parts])
        image = np.stack([latent[features_of(np.array(x, np.uint32))].sum(axis=0) for _, x in items.parts])
        norm = np.linalg.norm(image, axis=1, keepdims=True)
        self.image = (image / np.where(norm > 0, norm, 1)).T.astype(np.float32)
        # a short part is a small share of a window
        self.least = np.array([min(s.cosine, max(s.lowest, 0.77 * len(x) / (2 * s.half))) for _, x in items.parts], np.float32)
        self.sizes = np.array([len(x) for x in items.words])
        self.weighty = latent.any(axis=1)
        # the items' words, one item after another
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])
        self.bits = np.array([w & (SIGNATURE - 1) for x in items.words for w in x], np.int64)

    def candidates(self, words: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Text, first and last word of the window's surroundings, item and cosine of candidates, some windows at a time."""
        first, of = passages(offsets, self.s.half)
        feature = features_of(words)
        some = np.flatnonzero(self.weighty[feature])
        if not len(some):
            return
        begin = np.flatnonzero(np.concatenate([[True], np.diff(of[some]) != 0]))
        vector = np.zeros((first[-1], self.latent.shape[1]), np.float32)
        vector[of[some][begin]] = np.add.reduceat(self.latent[feature[some]], begin, axis=0)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        norm = np.linalg.norm(vector, axis=1)
        # of each passage with the next; the last of a text has none
        two = np.zeros(len(text), np.float32)
        two[:-1] = np.where(text[1:] == text[:-1], np.linalg.norm(vector[:-1] + vector[1:], axis=1), 0)
        rows = max(1, (1 << 22) // self.image.shape[1])
        for k in range(0, len(text), rows):
            end = min(k + rows, len(text))
            dot = vector[k : end + 1] @ self.image
            one, both = dot[: end - k], dot[: end - k].copy()
            both[: len(dot) - 1] += dot[1 : end - k + 1]
            alone, paired = norm[k:end, None], two[k:end, None]
            i, part = np.nonzero(((one >= self.least * alone) & (alone > 0)) | ((both >= self.least * paired) & (paired > 0)))
            if not len(i):
                continue
            c = np.maximum(one[i, part] / np.maximum(alone[i, 0], 1e-9), np.where(paired[i, 0] > 0, both[i, part] / np.maximum(paired[i, 0], 1e-9), 0))
            item, at = self.of[part], k + i
            t = text[at]
            lo = offsets[t] + (at - first[t]) * self.s.half
            hi = lo + 2 * self.s.half
            around = lambda n, lo=lo, hi=hi, t=t: (np.maximum(offsets[t], lo - n), np.minimum(offsets[t + 1], hi + n))
            # for the bound, items of like length share a stretch
            enough = self.enough(words, *around(-(-self.sizes[item] // self.s.half) * self.s.half), item)
            lo, hi = around(self.sizes[item])
            yield t[enough], lo[enough], hi[enough], item[enough], c[enough]

    def enough(self, words: np.ndarray, lo: np.ndarray, hi: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Whether so many of the item's words stand between lo and hi at all that enough can be in common, in any order.

        Words are looked up in a bitmap of each stretch, by some of their bits, so no stretch is ruled out wrongly.
        """
        out = np.zeros(len(lo), bool)
        # windows of one stretch share its bitmap
        key, of = np.unique(lo * (len(words) + 1) + hi, return_inverse=True)
        order = np.argsort(of, kind="stable")
        edges = np.searchsorted(of[order], np.arange(0, len(key) + STRETCHES, STRETCHES))
        low = (words & np.uint32(SIGNATURE - 1)).astype(np.int64)
        for k in range(0, len(key), STRETCHES):
            a, b = np.divmod(key[k : k + STRETCHES], len(words) + 1)
            size = b - a
            ends = np.cumsum(size)
            place = np.repeat(a - (ends - size), size) + np.arange(ends[-1])
            bitmap = np.zeros((len(a), SIGNATURE), bool)
            bitmap[np.repeat(np.arange(len(a)), size), low[place]] = True
            own = order[edges[k // STRETCHES] : edges[k // STRETCHES + 1]]
            for start in range(0, len(own), STRETCHES):
                mine = own[start : start + STRETCHES]
                n = self.sizes[item[mine]]
                ends = np.cumsum(n)
                bit = self.bits[np.repeat(self.at[item[mine]] - (ends - n), n) + np.arange(ends[-1])]
                hits = np.add.reduceat(bitmap[np.repeat(of[mine] - k, n), bit].astype(np.int32), ends - n)
                out[mine] = hits >= self.s.weak * n
        return out

    def leaks(self, words: np.ndarray, offsets: np.ndarray) -> dict[tuple[int, int], tuple[float, int, bool]]:
        """By text and item: cosine, common length and whether the answer is there, of its best window."""
        found: dict[tuple[int, int], tuple[float, int, bool]] = {}
        for some in self.candidates(words, offsets):
            for text, lo, hi, item, cosine in zip(*(x.tolist() for x in some), strict=True):
                own, n = self.items.words[item], len(self.items.words[item])
                if found.get((text, item), (0, 0, False))[1:] == (n, True):
                    continue
                near = words[lo:hi].tolist()
                common = common_length(own, near)
                if common < self.s.weak * n:
                    continue
                answer = self.items.answers[item]
                there = bool(answer) and common_length(answer, near) == len(answer)
                if (common >= self.s.strong * n or there) and found.get((text, item), (0, 0, False))[1:] < (common, there):
                    found[text, item] = (cosine, common, there)
        return found


def search(table_: DataFrame, items: Items, latent: np.ndarray, s: Settings) -> DataFrame:
    sent = table_.sparkSession.sparkContext.broadcast((items, latent, s))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(*sent.value)
        own = searcher.items
        for b in batches:
            out = [(start + t, i, *x) for start, words, offsets in read_words(b.column(2)) for (t, i), x in searcher.leaks(words, offsets).items()]
            rows = pa.array([x[0] for x in out], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array([own.ids[x[1]] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.float64()), pa.array([x[3] for x in out], pa.int32()), pa.array([len(own.words[x[1]]) for x in out], pa.int32()), pa.array([x[4] for x in out], pa.bool_())], names=["doc_id", "__row", "item_id", "cosine", "lcs", "n_item_words", "answer_found"])

    return table_.filter("block is null").select("doc_id", "__row", "words").mapInArrow(handing_back(run), FOUND)


FOUND = RESULT.replace("item_id", "__row long, item_id", 1)


def blocks_of_items(benchmark: DataFrame, s: Settings) -> Iterator[Items]:
    """Items in the order of their ids, about block_parts parts at a time."""
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    rows = benchmark.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("i"), "text", answer.alias("a")).orderBy("i", "text")
    block, size = [], 0
    for r in rows.toLocalIterator():
        block.append((r["i"], r["text"], r["a"]))
        size += len(stretches(len(plain(r["text"]).split()), s.half))
        if size >= s.block_parts:
            yield Items.of(block, s.answer_words, s.half)
            block, size = [], 0
    if block:
        yield Items.of(block, s.answer_words, s.half)


def find_leaks(df: DataFrame, benchmark: DataFrame, text: str = "text", id_col: str = "doc_id", settings: Settings = Settings()) -> DataFrame:
    """RESULT and __row (row_key of the text): a row for each document and each item that has leaked into it."""
    spark = df.sparkSession
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), row_key(text).alias("__row"), F.col(f"`{text}`").alias("text"))
    blocks = [x for x in blocks_of_items(benchmark, settings) if x.parts]
    if not blocks:
        return spark.createDataFrame([], FOUND)
    with temporary(spark, "words") as path:
        table_ = written(word_table(docs, settings.half), path)
        latent = fit(table_, weights(table_, blocks, settings), settings)
        if not latent.shape[1]:
            return spark.createDataFrame([], FOUND)
        return checkpointed(reduce(DataFrame.union, [search(table_, x, latent, settings) for x in blocks]))


def decontaminate(df: DataFrame, benchmark: DataFrame, text: str = "text", id_col: str = "doc_id", settings: Settings = Settings()) -> DataFrame:
    """The rows of df into which no item has leaked."""
    leaks = find_leaks(df, benchmark, text, id_col, settings).select(F.col("doc_id").alias("__id"), "__row").distinct()
    return df.join(leaks, (df[id_col].cast("long").eqNullSafe(leaks["__id"])) & (row_key(df[text]) == leaks["__row"]), "left_anti")


def op7_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RESULT: a row for each document and each benchmark item that has leaked into it."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(*[x.split()[0] for x in RESULT.split(", ")])
