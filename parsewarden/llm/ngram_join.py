"""Similarity self-join of documents on their sets of word shingles, by a grouped prefix join.

Sets x and y link when Jaccard is at least 3/4, that is 7 |x & y| >= 3 (|x| + |y|). All steps are exact; a sketch decides
only in which order the shingles of a set stand.

1. ``frequency_ranks`` counts all shingles of all documents in 2^20 cells (one array a task, summed by blocks). Shingles
   are put in order of the rank of their cell, rare ones first, ties by hash: any fixed order keeps the prefix filter
   exact, and this one keeps text that many documents share out of the prefixes.
2. ``shared_prefixes``: of a set of n shingles the first n - ceil(3n/4) + 1 are its prefix; sets that link share one.
   Documents of identical prefix and size are one group, and only groups are indexed. One shuffle by shingle brings the
   groups of each prefix shingle together in a sorted stream; shingles of one group end there, so nothing is collected.
3. Documents of one set are one class, known by its smallest id. In ``link``, round 1 pairs the groups of each shingle
   that only two have, each group with the hub (smallest group of a shingle) that it shares most prefix shingles with,
   and the classes of a group with its first. Verified pairs make components.
   A star round takes the shingles whose groups aren't yet in one component: each such group meets a few hubs more, so
   groups of near copies grow together by a number of pairs in proportion to rows. The last round pairs all groups of
   different components that share one of those left and pass the size and the position filter, and a bound by the parity bitmaps of their sets, which is exact
   too and leaves few pairs of a large group of near copies that don't link. Pairs within a component need no
   check: they add no link between components.
4. ``verified`` expands pairs to classes, joins whole texts and counts intersections.

Defined results: a null or empty text, or one without words, has 0 shingles and is its own component; fewer words than
``n`` make one shingle; rows without id get a null component; rows of one id are one node, whatever their texts; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parsewarden.llm.common import checkpointed, eager, handing_back, sliced, table, temporary, written
from parsewarden.llm.components import components, few, merged_components
from parsewarden.llm.shingles import shingle_sets

CELL_BITS = 20
BLOCK_CELLS = 1024
BITMAP_BITS = 24
#: Pairs for which a text is copied once more.
PAIRS_A_COPY = 1000
#: Rows of classes and groups, and pairs with texts, for which one task more is taken than the session has cores.
ROWS_A_TASK, TEXTS_A_TASK = 20_000, 1000
#: 64-bit words of the parity bitmap of a set.
PARITY_WORDS = 16
SHARED = "token long, gid long, n int, pos int, hub long, hub_n int, hub_pos int, big boolean, doc_id long, hi long, lo long, bits array<long>"


def summed_blocks(counts: DataFrame) -> dict[int, np.ndarray]:
    """The sum of the arrays whose blocks (block int, data binary of int64) are the rows of counts; fixed in size.

    Blocks are added up as they come, so a task holds one of each.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = np.frombuffer(x.as_buffer(), np.int64)
                sums[k] = sums[k] + own if k in sums else own
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["block", "data"])

    rows = counts.repartition("block").mapInArrow(add, "block int, data binary").collect()
    return {r["block"]: np.frombuffer(r["data"], np.int64) for r in rows}


def frequency_ranks(docs: DataFrame, n: int) -> np.ndarray:
    """For each cell its rank by the number of documents' shingles in it: 16 log2 of it, rounded down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << CELL_BITS, np.int64)
        for b in sliced(batches):
            own = [s for _, s in shingle_sets(b.column(0).to_pylist(), n)]
            if own:
                cells += np.bincount((np.concatenate(own) >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=len(cells))
        blocks = cells.reshape(-1, BLOCK_CELLS)
        used = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([blocks[i].tobytes() for i in used], pa.binary())], names=["block", "data"])

    cells = np.zeros((1 << CELL_BITS) // BLOCK_CELLS * BLOCK_CELLS, np.int64)
    with eager(docs.sparkSession):
        for block, data in summed_blocks(docs.select("text").mapInArrow(handing_back(run), "block int, data binary")).items():
            cells[block * BLOCK_CELLS : (block + 1) * BLOCK_CELLS] = data
    return (16 * np.log2(cells + 1)).astype(np.uint16)


def needed(n: int) -> int:
    """Shingles of a set of n that a set must share at least to link with it."""
    return (3 * n + 3) // 4


def parity_bits(s: np.ndarray) -> list[int]:
    """Bit k tells whether an odd number of shingles hash to k: two sets differ in as many shingles as bits, or more."""
    odd = np.bincount((s >> np.uint64(7)).astype(np.int64) & (64 * PARITY_WORDS - 1), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def shared_prefixes(docs: DataFrame, n: int, ranks: np.ndarray, path: str) -> DataFrame:
    """SHARED, written to path: for each prefix shingle of several groups a row for each of them but the hub, and a row a document."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(ranks)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, seen = sent.value, set()
        shift = np.uint64(64 - CELL_BITS)
        for b in sliced(batches):
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            sizes, his, los, gids, bits = [0] * len(ids), [None] * len(ids), [None] * len(ids), [None] * len(ids), [None] * len(ids)
            tokens, owners, owner_n, lengths = [], [], [], []
            for i, s in shingle_sets(texts, n):
                if not len(s) or ids[i] is None:
                    sizes[i] = len(s)
                    continue
                digest = xxhash.xxh3_128_digest(s.tobytes())
                prefix = s[np.lexsort((s, ranks[s >> shift]))[: len(s) - needed(len(s)) + 1]]
                gid = np.frombuffer(xxhash.xxh3_64_digest(prefix.tobytes() + len(s).to_bytes(8, "little")), np.int64)[0].item()
                sizes[i], gids[i], bits[i] = len(s), gid, parity_bits(s)
                his[i], los[i] = np.frombuffer(digest, np.int64).tolist()
                if gid not in seen:
                    seen.add(gid)
                    tokens.append(prefix.view(np.int64))
                    owners.append(gid)
                    owner_n.append(len(s))
                    lengths.append(len(prefix))
            spread = [xxhash.xxh3_64_intdigest(str(x).encode()) - (1 << 63) for x in ids]
            yield pa.RecordBatch.from_arrays([pa.array(spread, pa.int64()), pa.array(gids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(his, pa.int64()), pa.array(los, pa.int64()), pa.array(bits, pa.list_(pa.int64()))], names=[*INDEXED])
            if tokens:
                each = np.asarray(lengths)
                pos = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                at = (np.repeat(np.asarray(owner_n, np.int64), each) << 32) | pos | (1 << 31)
                none = pa.nulls(len(at), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.repeat(np.asarray(owners, np.int64), each)), pa.array(at), none, none, none, pa.nulls(len(at), pa.list_(pa.int64()))], names=[*INDEXED])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by token. hub: the smallest group of a run of tokens, as far as it stands in one batch."""
        held: tuple[int, int, int] | None = None  # last token so far, its hub and that one's place
        for b in batches:
            index = b.column(2).to_numpy() & (1 << 31) != 0
            if not index.all():
                own = b.filter(pa.array(~index))
                none32, none64 = pa.nulls(own.num_rows, pa.int32()), pa.nulls(own.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(2).cast(pa.int32()), none32, none64, none32, none32, pa.nulls(own.num_rows, pa.bool_()), *own.columns[3:7]], names=NAMES)
            # rows of documents may lack a group; only those of the index can be taken as numbers
            own = b.filter(pa.array(index))
            token, gid, at = (own.column(i).to_numpy() for i in range(3))
            if not len(token):
                continue
            first = np.concatenate([[True], token[1:] != token[:-1]])
            begin = np.flatnonzero(first)
            run = np.cumsum(first) - 1
            hub = np.minimum.reduceat(gid, begin)
            hub_at = np.zeros(len(begin), np.int64)
            is_hub = gid == hub[run]
            hub_at[run[is_hub]] = at[is_hub]
            went_on = bool(held and held[0] == token[0])
            if went_on:
                hub[0], hub_at[0] = held[1], held[2]
            held = (token[-1], hub[-1], hub_at[-1])
            # two groups in all, as far as this batch shows: their pair is all that the shingle can give
            big = np.add.reduceat((gid != hub[run]).astype(np.int64), begin) != 1
            big[0], big[-1] = big[0] or went_on, True
            other = np.flatnonzero(gid != hub[run])
            if len(other):
                h, n_, p_ = hub[run[other]], hub_at[run[other]] >> 32, hub_at[run[other]] & (2**31 - 1)
                none = pa.nulls(len(other), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(token[other]), pa.array(gid[other]), pa.array((at[other] >> 32).astype(np.int32)), pa.array((at[other] & (2**31 - 1)).astype(np.int32)), pa.array(h), pa.array(n_.astype(np.int32)), pa.array(p_.astype(np.int32)), pa.array(big[run[other]]), none, none, none, pa.nulls(len(other), pa.list_(pa.int64()))], names=NAMES)

    own = docs.mapInArrow(handing_back(emit), ", ".join(f"{k} {t}" for k, t in INDEXED.items()))
    every = written(own.repartition("token").sortWithinPartitions("token").mapInArrow(handing_back(meet), SHARED), path)
    sent.destroy()
    return every


INDEXED = {"token": "long", "gid": "long", "at": "long", "doc_id": "long", "hi": "long", "lo": "long", "bits": "array<long>"}
NAMES = [x.split()[0] for x in SHARED.split(", ")]


def passes(n: str, pos: str, m: str, at: str):
    """Size and position filter of sets of n and m shingles whose first common prefix shingle stands at pos and at."""
    n, pos, m, at = (F.col(x) for x in (n, pos, m, at))
    return (4 * F.least(n, m) >= 3 * F.greatest(n, m)) & (7 * (1 + F.least(n - pos - 1, m - at - 1)) >= 3 * (n + m))


def may_link(both, bits: str, other: str):
    """Whether the parity bitmaps of two sets allow them to link, given the sum of their sizes; sets that link pass."""
    unlike = F.aggregate(F.zip_with(bits, other, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    return F.coalesce(unlike <= both - 2 * F.floor((3 * both + 6) / 7), F.lit(True))


def verified(pairs: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """The pairs (a, b: ids) whose texts link. pairs is stored already.

    Texts of ids in no pair are left out before the shuffle by a bitmap of 2^24 hashed ids: 2^18 rows at most, however
    many pairs there are, so it may be broadcast.
    """
    words, count = 1 << (BITMAP_BITS - 6), pairs.count()
    own_few = lambda df: few(df, count, TEXTS_A_TASK)
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << BITMAP_BITS))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).select(bit("id").alias("h"))
    bitmap = ids.groupBy((F.col("h") % words).alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, cast(h div {words} as int)))").alias("bits"))
    bitmap = few(bitmap, min(count, words), ROWS_A_TASK)
    own = docs.filter(F.col("doc_id").isNotNull()).withColumn("h", bit("doc_id"))
    own = own.join(F.broadcast(bitmap), (F.col("h") % words) == F.col("w")).filter(F.expr(f"(shiftright(bits, cast(h div {words} as int)) & 1L) = 1L")).select("doc_id", "text")
    # a hub that very many pairs have is dealt out: its text is copied once for each PAIRS_A_COPY of them
    copies = checkpointed(few(pairs.groupBy("b").agg(F.ceil(F.count("*") / PAIRS_A_COPY).alias("copies")), count, ROWS_A_TASK))
    salted = few(pairs.join(copies, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("copies"))).drop("copies"), count, ROWS_A_TASK)
    # both sides read texts by doc_id, so that exchange runs once
    both = own_few(salted.join(own, F.col("a") == F.col("doc_id")).select("a", "b", "salt", F.col("text").alias("ta")))
    right = own_few(own.join(copies, own["doc_id"] == copies["b"]).select("b", F.col("text").alias("tb"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt")))
    both = own_few(both.join(right, ["b", "salt"]).select("a", "b", "ta", "tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = np.empty(0, np.uint64)
        for b in sliced(batches):
            tb = b.column(3).to_pylist()
            distinct = {t: i for i, t in enumerate(dict.fromkeys(tb))}
            right = dict(shingle_sets(list(distinct), n))
            keep = np.zeros(b.num_rows, bool)
            for i, x in shingle_sets(b.column(2).to_pylist(), n):
                y = right.get(distinct[tb[i]], empty)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = both > 0 and 7 * both >= 3 * (len(x) + len(y))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(handing_back(run), "a long, b long")


def labels_of(classes: DataFrame, found: DataFrame, rows: int) -> DataFrame:
    """gid and label: the component of the classes of each group; null if they are in several."""
    own = few(classes.join(found, classes["class_id"] == found["node"], "left").select("gid", F.coalesce("component", "class_id").alias("c")), rows, ROWS_A_TASK)
    label = F.when(F.min("c") == F.max("c"), F.min("c"))
    return checkpointed(few(own.groupBy("gid").agg(label.alias("label")), rows, ROWS_A_TASK))


def differ(a: str, b: str):
    return F.col(a).isNull() | F.col(b).isNull() | (F.col(a) != F.col(b))


def still_open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """members with label, of those shingles alone whose groups aren't all in one component."""
    own = members.join(labels, "gid")
    range_ = own.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count_if(F.col("label").isNull()).alias("none"))
    return own.join(range_.filter("none > 0 or lo < hi").select("token"), "token").select("token", "gid", "n", "pos", "label")


def star_pairs(members: DataFrame, salt: int, families: int = 4) -> DataFrame:
    """Pairs (gid, hub) of different labels, one for each group and family of shingles at most.

    Each shingle has one hub, the member of smallest hash salted by its family. members: token, gid, n, pos, label.
    """
    family = F.pmod(F.xxhash64("token", F.lit(salt)), F.lit(families))
    own = members.withColumn("family", family)
    as_hub = F.struct(F.col("gid").alias("hub"), F.col("n").alias("hub_n"), F.col("pos").alias("hub_pos"), F.col("label").alias("hub_label"))
    hubs = own.groupBy("token").agg(F.min_by(as_hub, F.xxhash64("gid", F.col("family") + families * (salt + 1))).alias("h")).select("token", "h.*")
    met = own.join(hubs, "token").filter(F.col("gid") != F.col("hub")).filter(differ("label", "hub_label")).filter(passes("n", "pos", "hub_n", "hub_pos"))
    met = met.groupBy("gid", "family", "hub").agg(F.count("*").alias("c"))
    return met.groupBy("gid", "family").agg(F.max_by("hub", F.struct("c", "hub")).alias("hub")).select("gid", "hub").distinct()


def met_pairs(members: DataFrame, parity: DataFrame) -> DataFrame:
    """All pairs (gid, gid_b) of different labels that share a shingle of their prefixes and pass all filters.

    parity: gid and bits (null: not known), for a bound on the difference of two sets: that of n and m shingles that link
    is n + m - 2 ceil(3 (n + m) / 7) at most.
    """
    members = members.join(parity, "gid")
    words = [f"w{k}" for k in range(PARITY_WORDS)]
    members = members.select("token", "gid", "n", "pos", "label", *[F.get("bits", F.lit(k)).alias(w) for k, w in enumerate(words)])
    # both sides are the same plan, so their exchange runs once
    x, y = members.alias("x"), members.alias("y")
    unlike = F.expr(" + ".join(f"bit_count(x.{w} ^ y.{w})" for w in words))
    both = F.col("x.n") + F.col("y.n")
    near = F.coalesce(unlike <= both - 2 * F.floor((3 * both + 6) / 7), F.lit(True))
    met = x.join(y, F.col("x.token") == F.col("y.token")).filter((F.col("x.gid") < F.col("y.gid")) & differ("x.label", "y.label") & passes("x.n", "x.pos", "y.n", "y.pos") & near)
    return met.select(F.col("x.gid").alias("gid"), F.col("y.gid").alias("gid_b")).distinct()


def link(docs: DataFrame, n: int = 5, star_rounds: int = 1) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest id of an equal set) and component_id of every row of docs (doc_id, text)."""
    with temporary(docs.sparkSession, "prefixes") as path:
        return _link(docs, n, star_rounds, path)


def _link(docs: DataFrame, n: int, star_rounds: int, path: str) -> DataFrame:
    every = shared_prefixes(docs, n, frequency_ranks(docs, n), f"{path}/all")
    rows = every.filter("hub is null").select("doc_id", "n", "hi", "lo", "gid", "bits")
    shared = every.filter("hub is not null")
    of_all = every.agg(F.count_if(F.expr("hub is null")).alias("rows"), F.count_if(F.expr("hub is not null")).alias("shared")).first()
    classes = rows.filter("gid is not null").groupBy("n", "hi", "lo", "gid").agg(F.min("doc_id").alias("class_id"), F.first("bits").alias("bits"))
    classes = checkpointed(few(classes, of_all["rows"], ROWS_A_TASK))
    count = classes.count()
    slim = lambda df: few(df, count, ROWS_A_TASK)
    classes = slim(classes)
    groups = checkpointed(slim(classes.groupBy("gid").agg(F.min("class_id").alias("rep"), F.count("*").alias("size"), F.first("n").alias("n"), F.min_by("bits", "class_id").alias("bits"))))

    def between(pairs: DataFrame, gid: str, hub: str) -> DataFrame:
        """Pairs (a, b) of the first classes of two groups, without those whose bitmaps tell that they don't link."""
        x, y = (groups.select(F.col("gid").alias(g), F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}")) for g, c in ((gid, "a"), (hub, "b")))
        both = slim(pairs.join(x, gid)).join(y, hub)
        return slim(both.filter(may_link(F.col("na") + F.col("nb"), "bitsa", "bitsb")).select("a", "b"))

    met = shared.groupBy("gid", "hub").agg(F.count_if(passes("n", "pos", "hub_n", "hub_pos")).alias("c"), F.count_if(passes("n", "pos", "hub_n", "hub_pos") & ~F.col("big")).alias("alone"), F.bool_or("big").alias("big"))
    met = checkpointed(few(met, of_all["shared"], ROWS_A_TASK))
    met = few(met, met.count(), ROWS_A_TASK)
    best = met.filter("c > 0").groupBy("gid").agg(F.max_by("hub", F.struct("c", "hub")).alias("hub"))
    first = best.select("gid", "hub").union(met.filter("alone > 0").select("gid", "hub")).distinct()
    inner = classes.alias("x").join(groups.filter("size > 1").alias("g"), "gid").filter("class_id <> rep").filter(may_link(2 * F.col("x.n"), "x.bits", "g.bits"))
    pairs = between(slim(first), "gid", "hub").union(slim(inner.select(F.col("class_id").alias("a"), F.col("rep").alias("b"))))
    links = checkpointed(verified(checkpointed(pairs), docs, n))
    found = checkpointed(components(links, rows=links.count()))
    labels = labels_of(classes, found, count)

    # shingles of three groups or more, or of a group of several sets, that hold an open pair
    several = groups.filter("size > 1").select("gid")
    crowd = met.filter("big").select("gid", "hub").union(met.join(several, "gid", "left_semi").select("gid", "hub")).union(met.join(several.select(F.col("gid").alias("hub")), "hub", "left_semi").select("gid", "hub"))
    crowd = slim(slim(crowd).distinct())
    crowd = crowd.join(labels, "gid").join(labels.select(F.col("gid").alias("hub"), F.col("label").alias("hub_label")), "hub").filter(differ("label", "hub_label")).select("gid", "hub")
    index = shared.select("token", "gid", "n", "pos", "hub", "hub_n", "hub_pos")
    tokens = index.join(crowd, ["gid", "hub"], "left_semi").select("token").distinct()
    both = F.array(F.struct("gid", "n", "pos"), F.struct(F.col("hub").alias("gid"), F.col("hub_n").alias("n"), F.col("hub_pos").alias("pos")))
    members = index.join(tokens, "token", "left_semi").select("token", F.explode(both).alias("x")).select("token", "x.*").distinct()
    members = written(few(members, of_all["shared"], ROWS_A_TASK), f"{path}/open")
    for salt in range(star_rounds):
        stars = star_pairs(members.join(labels, "gid"), salt)
        pairs = checkpointed(between(slim(stars), "gid", "hub"))
        if pairs.isEmpty():
            break
        links = checkpointed(verified(pairs, docs, n))
        found = checkpointed(slim(merged_components(found, links)))
        labels = labels_of(classes, found, count)

    parity = groups.select("gid", F.when(F.col("size") == 1, F.col("bits")).alias("bits"))
    met = met_pairs(still_open(members, labels), parity)
    side = lambda name: classes.select(F.col("gid").alias(f"gid{name}"), F.col("class_id").alias("b" if name else "a"))
    pairs = slim(slim(slim(met).join(side(""), "gid")).join(side("_b"), "gid_b").select("a", "b"))
    # classes of one group whose pair with its first did not link
    rest = slim(classes.join(labels.filter("label is null"), "gid").select("gid", "class_id"))
    pairs = checkpointed(pairs.union(slim(rest.select("gid", F.col("class_id").alias("a")).join(rest.select("gid", F.col("class_id").alias("b")), "gid").filter("a < b").select("a", "b"))))
    if not pairs.isEmpty():
        found = merged_components(found, checkpointed(verified(pairs, docs, n)))

    out = rows.join(classes, (rows["n"] == classes["n"]) & (rows["hi"] == classes["hi"]) & (rows["lo"] == classes["lo"]), "left").select("doc_id", rows["n"].cast("long").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"))
    out = out.join(found, out["class_id"] == found["node"], "left").select("doc_id", "n_shingles", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    return checkpointed(slim(out))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")
