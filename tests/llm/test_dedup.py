from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from parsewarden.llm import chunk_dedup as cd
from parsewarden.llm import ngram_join as nj
from parsewarden.llm import suffix_dedup as sd
from parsewarden.llm.common import checkpointed
from parsewarden.llm.components import components
from parsewarden.llm.spans import without_spans
from parsewarden.llm.suffix_groups import suffix_array
from tests.llm import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n=5):
    w = WORD.findall(re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    parent = {i: i for i, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {(i, len(x), find(i)) for i, x in sets}


def near_copies(seed, n=60):
    r = random.Random(seed)
    out = []
    for base in range(4):
        own = cases.words(100 * seed + base, 80).split()
        for _ in range(n // 4):
            w = list(own)
            for _ in range(r.choice([0, 0, 1, 2, 3, 4])):
                w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
            out.append(" ".join(w if r.random() < 0.8 else w[: r.randint(3, 80)]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, seed):
    docs = list(enumerate(near_copies(seed) + [t for *_, t in [(r[1],) for r in cases.rows()]]))
    got = {tuple(r) for r in nj.link(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()}
    assert got == brute_components(docs)


def test_link_takes_odd_rows(spark):
    out = nj.link(cases.documents(spark).select("doc_id", "text"))
    assert out.count() == len(cases.rows())
    assert [r["component_id"] for r in out.filter("doc_id is null").collect()] == [None]
    same = {r["doc_id"]: r["component_id"] for r in out.filter("doc_id in (4, 5, 6, 7)").collect()}
    assert same == {4: 4, 5: 4, 6: 6, 7: 6}
    assert nj.link(cases.empty(spark).select("doc_id", "text")).count() == 0


def test_parity_bits_bound_the_difference():
    r = np.random.default_rng(3)
    for _ in range(50):
        x, y = (np.unique(r.integers(0, 1 << 62, 300, dtype=np.uint64)) for _ in range(2))
        y = np.unique(np.concatenate([x[:250], y[:40]]))
        bits = sum((int(a) ^ int(b)).bit_count() if (int(a) ^ int(b)) >= 0 else ((int(a) ^ int(b)) & (2**64 - 1)).bit_count() for a, b in zip(nj.parity_bits(x), nj.parity_bits(y), strict=True))
        assert bits <= len(np.setxor1d(x, y))


def test_texts_of_pairs_that_bitmaps_rule_out_stay(spark, monkeypatch):
    rng = random.Random(3)
    passages = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(30)]
    # each shares two of its three passages with the next: half of all shingles of both
    docs = [(i, " ".join(passages[(i + k) % 30] for k in range(3))) for i in range(30)]
    docs += [(100 + i, docs[i][1] + " end") for i in range(3)]
    compared, own = [], nj.verified
    monkeypatch.setattr(nj, "verified", lambda pairs, *how: compared.append(pairs.count()) or own(pairs, *how))
    out = nj.link(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in out.collect()} == {i: i % 100 if i >= 100 else i for i, _ in docs}
    assert sum(compared) == 3


def test_few_rows_take_few_tasks(spark, monkeypatch):
    held = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    cores, tasks, own = spark.sparkContext.defaultParallelism, [], nj.verified
    monkeypatch.setattr(nj, "verified", lambda pairs, *how: tasks.append(pairs.rdd.getNumPartitions()) or own(pairs, *how))
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        same = " ".join(f"w{i}" for i in range(40))
        out = nj.link(spark.createDataFrame([(i, f"{same} {'x' * i}") for i in range(1, 9)], "doc_id long, text string"))
        assert [r["component_id"] for r in out.collect()] == [1] * 8
        # three sources of pairs at most
        assert out.rdd.getNumPartitions() <= cores and max(tasks) <= 3 * cores < 32
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_few_edges_take_few_tasks_in_every_round(spark, monkeypatch):
    held = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    cores, tasks, own = spark.sparkContext.defaultParallelism, [], nj.checkpointed
    counted = lambda df: tasks.append(df.rdd.getNumPartitions()) or own(df)
    monkeypatch.setattr("parsewarden.llm.components.checkpointed", counted)
    monkeypatch.setattr(nj, "checkpointed", counted)
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        same = " ".join(f"w{i}" for i in range(40))
        out = nj.link(spark.createDataFrame([(i, f"{same} {'x' * i}") for i in range(1, 9)], "doc_id long, text string"))
        assert [r["component_id"] for r in out.collect()] == [1] * 8
        # a checkpoint writes a file for each task; pairs of the first round come from three sources
        assert len(tasks) > 8 and max(tasks) <= 3 * cores < 32
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_connected_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_suffix_arrays():
    r = random.Random(1)
    for _ in range(400):
        strings = [bytes(r.choice(b"abcd"[: r.choice([1, 2, 3, 4])]) for _ in range(r.randint(1, 14))) for _ in range(r.randint(1, 5))]
        data = b"".join(strings)
        starts = np.cumsum([0, *map(len, strings)]).tolist()
        suffix = {i: data[i:e] for s, e in zip(starts, starts[1:], strict=False) for i in range(s, e)}
        got = suffix_array(data, starts[:-1]).tolist()
        assert sorted(got) == sorted(suffix) and [suffix[i] for i in got] == sorted(suffix.values())
        # equal suffixes in order of their strings
        assert all(a < b for a, b in zip(got, got[1:], strict=False) if suffix[a] == suffix[b])
    assert suffix_array(b"", []).tolist() == []


def brute_spans(docs, n=50):
    first, out = {}, []
    for i, t in sorted(docs, key=lambda x: x[0]):
        b = (t or "").encode()
        covered = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if first.setdefault(b[k : k + n], i) < i:
                covered[k : k + n] = b"\1" * n
        runs = sum(1 for k in range(len(b)) if covered[k] and not (k and covered[k - 1]))
        out.append((i, len(b), sum(covered), runs, hashlib.sha256(bytes(x for x, c in zip(b, covered, strict=True) if not c)).hexdigest()))
    return sorted(out)


def repeats(seed):
    r = random.Random(seed)
    parts = [cases.words(1000 + seed * 50 + k, r.randint(4, 40)) for k in range(12)] + ["é" * 60, "ab" * 40]
    return [(i, " ".join(r.choice(parts) for _ in range(r.randint(0, 6))) + cases.words(seed * 991 + i, 20)) for i in range(40)] + [(40, None), (41, ""), (42, "short")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_exact_spans_match_brute_force(spark, monkeypatch, seed):
    docs = repeats(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, without_spans(df, sd.repeated_spans(df), "text", "doc_id").collect())) == brute_spans(docs)


def test_pieces_of_long_texts_miss_nothing(spark, monkeypatch):
    monkeypatch.setattr(sd, "PIECE", 64)
    docs = repeats(4)
    out = []
    column = __import__("pyarrow").array([t for _, t in docs])
    for at, offset, own in sd.batches_of_bytes(column, 50):
        for i, k, t in zip(at.tolist(), offset.tolist(), own, strict=True):
            assert docs[i][1].encode()[k : k + 64 + 49] == t
            out += [(i, k + j) for j in range(len(t) - 49)]
    assert len(out) == len(set(out)) and set(out) == {(i, j) for i, (_, t) in enumerate(docs) for j in range(len((t or "").encode()) - 49)}


@pytest.mark.parametrize("tasks", [1, 3, 9])
def test_classes_hold_across_partitions_and_batches(spark, tasks):
    """A hot anchor and a hot class that span partitions: what is covered, and what is left to look into."""
    r = random.Random(tasks)
    rows = [(r.choice([1, 5, 5, 5, 9]), r.choice([1, 2, 2, 2, 3]), r.randrange(60), 0, k) for k in range(400)]
    rows += [(100 + k, 1, k, 0, 1000 + k) for k in range(20)] + [(200, 1, k, 0, 2000 + k) for k in range(20)]
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    try:
        found = sd.settled(checkpointed(sd.classes(spark.createDataFrame(rows, sd.OCCURRENCES).repartition(4)))).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    least = {}
    for fp, ctx, i, *_ in rows:
        least[fp, ctx] = min(i, least.get((fp, ctx), i))
    several = {fp for fp, _ in least if sum(x == fp for x, _ in least) > 1}
    assert sorted(x["where"] for x in found if x["kind"] == sd.COVERED) == sorted(x[4] for x in rows if x[2] > least[x[0], x[1]])
    open_ = {x["where"] for x in found if x["kind"] == sd.OPEN}
    must = {x[4] for x in rows if x[2] == least[x[0], x[1]] and x[0] in several}
    may = {x[4] for x in rows if x[2] == least[x[0], x[1]]}
    assert must <= open_ <= may and len(open_ - must) <= 2 * tasks


@pytest.mark.parametrize("dedup", [sd.suffix_dedup, cd.chunk_dedup])
def test_texts_are_cut_and_other_columns_stay(spark, dedup):
    docs = cases.documents(spark)
    out = dedup(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    texts = {r["doc_id"]: r["text"] for r in out.filter("doc_id in (0, 4, 5, 8, 9)").collect()}
    assert texts[0] is None and texts[4] == cases.rows()[4][1] and len(texts[5]) < 60
    assert len(texts[8]) > 500 and len(texts[9]) < len(cases.rows()[9][1]) - 150
    assert [r["text"] for r in out.filter("doc_id is null").collect()] == [cases.words(2, 70)]
    assert dedup(cases.empty(spark)).count() == 0


def test_chunks_resist_insertions():
    text = cases.words(77, 2000)
    for cut in (0, 1, 777):
        other = text[:cut] + "inserted" + text[cut:]
        own = [set(d) for _, _, d in cd.chunk_rows([text, other], 5, 16, 256)]
        assert len(own[0] & own[1]) >= len(own[0]) - 4
    for _, at, digests in cd.chunk_rows([text, "é" * 3000, "z"], 5, 16, 256):
        assert len(at) == len(digests) + 1 and max(np.diff(at)) <= 256 + 16


def slow_chunks(data, bits=5, least=16, most=256):
    """Ends of chunks by the definition: a rolling gear hash byte by byte, cuts at starts of characters."""
    h, may = 0, set()
    for i, x in enumerate(data):
        h = (2 * h + int(cd.GEAR[x])) % (1 << 16)
        if h >> (16 - bits) == 0:
            k = i + 1
            while k < len(data) and data[k] & 0xC0 == 0x80:
                k += 1
            may.add(k)
    ends, last = [], 0
    for cut in [*sorted(k for k in may if k < len(data)), len(data)]:
        while cut - last > most:
            k = last + most
            while data[k] & 0xC0 == 0x80:
                k -= 1
            ends.append(k)
            last = k
        if cut - last >= least or cut == len(data):
            if cut > last:
                ends.append(cut)
            last = cut
    return ends


@pytest.mark.parametrize("hot", [1000, 5])
def test_chunk_spans_match_brute_force(spark, monkeypatch, hot):
    """Chunks, repeats and runs from their definitions; with hot digests looked up and with none."""
    monkeypatch.setattr(cd, "HOT", hot)
    docs = [(i, t) for i, t in repeats(3) if t] + [(500 + i, cases.words(5000, 60) + " " + cases.words(600 + i, 30)) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    own, first = {}, {}
    for i, t in docs:
        data = t.encode()
        ends = slow_chunks(data)
        own[i] = [(a, b, data[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
        for *_, piece in own[i]:
            first[piece] = min(i, first.get(piece, i))
    want = {}
    for i, pieces in own.items():
        runs = []
        for a, b, piece in pieces:
            if first[piece] < i:
                if runs and runs[-1][1] == a:
                    runs[-1][1] = b
                else:
                    runs.append([a, b])
        runs = [(a, b) for a, b in runs if b - a >= 50 or (a == 0 and b == pieces[-1][1])]
        if runs:
            want[i] = runs
    assert {r["__id"]: [tuple(x) for x in r["__spans"]] for r in cd.repeated_spans(df).collect()} == want


def test_short_copies_are_cut(spark, tmp_path):
    short = [cases.words(50 + i, 3 + i)[:90] for i in range(8)]
    passages = [cases.words(80 + i, 14 + i) for i in range(16)]
    docs = [(i, t) for i, t in enumerate(short + [f"{cases.words(200 + i, 40)} {t}" for i, t in enumerate(passages)])]
    docs += [(100 + i, t) for i, t in enumerate(short)] + [(200 + i, f"{t} {cases.words(400 + i, 40)}") for i, t in enumerate(passages)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    runs = {r["__id"]: [tuple(x) for x in r["__spans"]] for r in cd.repeated_spans(df, min_run_bytes=0).collect()}
    want = {i: [x for x in s if x[1] - x[0] >= 50 or x == (0, len(dict(docs)[i].encode()))] for i, s in runs.items()}
    # copies under 50 bytes that are whole documents, and runs of 50 to 99 bytes within others
    assert min(x[1] - x[0] for s in want.values() for x in s) < 50 and any(50 <= x[1] - x[0] < 100 for i, s in want.items() if i >= 200 for x in s)
    own = {r["doc_id"]: r for r in cd.op3_chunk_dedup(spark, cases.write(spark, tmp_path, documents=df)).collect()}
    assert {i: r["n_removed"] for i, r in own.items() if r["n_removed"]} == {i: sum(b - a for a, b in s) for i, s in want.items() if s}
    texts = {r["doc_id"]: r["text"] for r in cd.chunk_dedup(df).collect()}
    assert all(texts[100 + i] == "" and texts[i] == short[i] for i in range(8))


def test_every_string_has_an_anchor_where_hashes_begin_with_zeros(monkeypatch):
    hashes = sd.gram_hashes

    def with_zeros(*how):
        h = hashes(*how)
        return np.where(h % np.uint64(7) == 0, h & np.uint64(2**32 - 1), h)

    monkeypatch.setattr(sd, "gram_hashes", with_zeros)
    texts = [cases.words(i, 60).encode() for i in range(5)]
    begin, places, _, h, _ = sd.anchors(texts, 50)
    assert (h >> np.uint64(32) == 0).any()
    for k, t in enumerate(texts):
        for i in range(begin[k], begin[k] + len(t) - 49):
            assert ((places >= i) & (places <= i + 50 - sd.GRAM)).any()


def test_neighbours_of_hot_chunks_make_one_row(spark, monkeypatch):
    same, own = cases.words(1, 200), [cases.words(k, 40) for k in range(2, 32)]
    df = spark.createDataFrame([(i, f"{x}\n{same}\n{x[::-1]}") for i, x in enumerate(own)], "doc_id long, text string")
    how = {"bits": 5, "min_bytes": 16, "max_bytes": 256}
    counts = []
    chunks = cd.chunks
    monkeypatch.setattr(cd, "chunks", lambda *a: counts.append(chunks(*a)) or counts[-1])
    found = cd.repeated_spans(df, "text", "doc_id", **how)
    assert sorted((r["__id"], len(r["__spans"])) for r in found.collect()) == [(i, 1) for i in range(1, 30)]
    # chunks of the common stretch: one row for each text on the way back, not one for each chunk
    assert counts[-1].filter("digest is null").count() == 29
    rows = counts[0].groupBy("digest").count().filter("count > 1").agg({"count": "sum"}).first()[0]
    assert rows > 10 * 29 and counts[0].count() - counts[-1].count() == rows - 29


def test_spans_of_a_batch_are_merged_at_once(spark, monkeypatch):
    import pyarrow as pa

    from parsewarden.llm import spans

    lists = pa.array([None, [{"s": 0, "e": 2}], [], [{"s": 5, "e": 9}, {"s": 1, "e": 5}]], pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))
    assert [x.tolist() for x in spans.unnested(lists, "s", "e")] == [[1, 3, 3], [0, 5, 1], [2, 9, 5]]
    assert [x.tolist() for x in spans.unnested(lists[2:], "e", "s")] == [[1, 1], [9, 5], [5, 1]]
    # a span up to the end of one row, and one from the beginning of the next, are two
    df = spark.createDataFrame([(i, "0123456789") for i in range(4)], "doc_id long, text string").coalesce(1)
    cuts = [(0, [(5, 10), (0, 2)]), (1, [(0, 3), (2, 5), (5, 6)]), (3, [(9, 10)])]
    found = spark.createDataFrame(cuts, "__id long, __spans array<struct<s:int,e:int>>").withColumn("__row", spans.row_key(spans.F.lit("0123456789")))
    assert {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in without_spans(df, found, "text", "doc_id").collect()} == {0: (7, 2), 1: (6, 1), 2: (0, 0), 3: (1, 1)}
    assert {r["doc_id"]: r["text"] for r in without_spans(df, found, "text", "doc_id", replace=True).collect()} == {0: "234", 1: "6789", 2: "0123456789", 3: "012345678"}


def test_strings_of_other_cores_between_those_of_one():
    r = random.Random(5)
    cores = [bytes(r.choice(b"ab") for _ in range(35)) for _ in range(4)]
    rows = sorted((c, i, bytes(r.choice(b"x" * 14 + b"y") for _ in range(15)), bytes(r.choice(b"x" * 14 + b"y") for _ in range(15))) for c in cores for i in range(8))
    parts = [a + c + b for c, _, a, b in rows]
    first = {}
    for (c, i, _, _), p in zip(rows, parts, strict=True):
        for k in range(len(p) - 49):
            first[c, p[k : k + 50]] = min(first.get((c, p[k : k + 50]), i), i)
    want = [[k for k in range(len(p) - 49) if first[c, p[k : k + 50]] < i] for (c, i, _, _), p in zip(rows, parts, strict=True)]
    got = sd.starts_again(parts, [15] * len(parts), [x[0] for x in rows], np.array([x[1] for x in rows]), 50)
    assert [x.tolist() for x in got] == want
