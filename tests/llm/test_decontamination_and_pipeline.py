from __future__ import annotations

import importlib
import sys

import numpy as np
import pytest

from parsewarden.llm import common
from parsewarden.llm import latent_decontamination as ld
from parsewarden.llm.chunk_dedup import chunks
from parsewarden.llm.ngram_join import link
from tests.llm import cases


def planted(spark):
    items = [(i, cases.words(9000 + i, 12 + 3 * i).capitalize() + ".") for i in range(12)]
    docs = [(i, cases.words(i, 150)) for i in range(60)]
    leaks = []
    for i, t in items:
        w = t.split()
        exact = cases.words(500 + i, 70) + " " + t + " " + cases.words(600 + i, 40)
        loud = cases.words(700 + i, 33) + "\n" + " ".join(f"{x}," for x in w).upper()
        changed = cases.words(800 + i, 20) + " " + " ".join("other" if k % 5 == 2 and k < len(w) - 6 else x for k, x in enumerate(w)) + " " + cases.words(900 + i, 90)
        for k, text in enumerate((exact, loud, changed)):
            leaks.append((1000 + 10 * i + k, text))
    return items, docs, leaks


def test_planted_items_are_found_and_clean_texts_left(spark):
    items, docs, leaks = planted(spark)
    df = spark.createDataFrame(docs + leaks, "doc_id long, text string")
    found = ld.find_leaks(df, spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(i, (i - 1000) // 10) for i, _ in leaks}


def rare(seed, n):
    import random

    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(n)]


def brute(docs, items, s=ld.Settings()):
    """Pairs whose whole texts have enough in common, by the table of longest common subsequences over each stretch."""
    out = set()
    for i, t in docs:
        w = ld.plain(t).decode().lower().split()
        for k, x in items:
            own = ld.plain(x).decode().lower().split()
            n = len(own)
            for at in range(0, max(1, len(w)), max(1, n // 4)):
                if ld.common_length([hash(y) for y in own], [hash(y) for y in w[at : at + 2 * n]]) >= s.strong * n:
                    out.add((i, k))
                    break
    return out


@pytest.mark.parametrize("n", [10, 20, 64, 65, 130, 300, 1000])
def test_recall_by_length_against_brute_force(spark, n):
    import random

    r = random.Random(n)
    items = [(k, cases.words(70_000 + 100 * n + k, n)) for k in range(8)]
    docs = [(i, cases.words(80_000 + i, 300)) for i in range(80)]
    for k, x in items:
        w = x.split()
        gone = set(r.sample(range(n), int(0.28 * n)))
        for j, own in enumerate((w, ["another" if i in gone else y for i, y in enumerate(w)])):
            docs.append((1000 + 10 * k + j, " ".join([cases.words(90_000 + 10 * k + j, r.randint(0, 90)), " ".join(own), cases.words(95_000 + 10 * k + j, r.randint(0, 90))])))
    want = brute(docs, items)
    assert len(want) >= 14
    found = ld.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(x["doc_id"], x["item_id"]) for x in found.collect()}
    assert len(got & want) >= 0.9 * len(want)
    assert not {i for i, _ in got} & set(range(1000))


def test_words_that_stand_together_come_together(spark):
    """A paraphrase that has none of the item's weighty words, but words that stand with them elsewhere, is a candidate."""
    import random

    r = random.Random(3)
    topics = [[f"topic{t}word{k}" for k in range(40)] for t in range(6)]
    docs = []
    for i in range(600):
        docs.append((i, " ".join(r.choice(topics[i % 6]) for _ in range(64))))
    words = ld.word_table(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "0L as __row", "text"), 32).persist()
    s = ld.Settings(rank=6, common=1.0)
    own, other, far = topics[0][:20], topics[0][20:], topics[1][20:]
    items = ld.Items.of([(1, " ".join(own), None)], 5, 32)
    latent = ld.fit(words, ld.weights(words, [items], s), s)
    vector = lambda x: latent[ld.features_of(np.array(ld.Items.of([(1, " ".join(x), None)], 5, 32).words[0], np.uint32))].sum(axis=0)
    cosine = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    assert not set(own) & set(other) and cosine(vector(own), vector(other)) > 0.8 > 0.3 > cosine(vector(own), vector(far))
    assert latent.shape[1] <= 6


@pytest.mark.parametrize("n", [65, 300, 2000])
def test_long_items_of_rare_words_are_found(spark, n):
    own = rare(n, n)
    changed = [f"other{k}" if k % 10 in (2, 5, 8) and k < n - 6 else x for k, x in enumerate(own)]
    weak = [f"other{k}" if k % 20 in (2, 5, 8, 11, 13, 16, 19) and k < n - 6 else x for k, x in enumerate(own)]
    broken = [x if k % 2 else f"other{k}" for k, x in enumerate(own)]
    docs = [(i, " ".join([cases.words(i, 45), " ".join(x), cases.words(100 + i, 45)])) for i, x in enumerate((own, changed, weak, broken, own[: n // 2]))]
    # so many passages that all words of the item are rare enough to have weight
    docs += [(100 + i, cases.words(200 + i, 40_000)) for i in range(4)]
    items = [(7, f"{' '.join(own[:-5])}. {' '.join(own[-5:])}"), (8, cases.words(9001, 20)), (9, " ".join(rare(1, 700)))]
    found = ld.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r["doc_id"], r["item_id"]) for r in found.collect()) == [(0, 7), (1, 7), (2, 7)]


def test_parts_cover_an_item_and_fit_into_a_window():
    for n in range(1, 700):
        parts = ld.stretches(n, 32)
        assert max(j - i for i, j in parts) <= 64 and {k for i, j in parts for k in range(i, j)} == set(range(n))
        assert sorted(k for i, j in parts[::2] for k in range(i, j)) == list(range(n))


def test_an_item_of_more_parts_than_a_block_is_found(spark):
    own = rare(5, 1000)
    docs = [(0, " ".join(own))] + [(100 + i, cases.words(200 + i, 150)) for i in range(20)]
    items = [(1, cases.words(9001, 20)), (7, " ".join(own)), (8, cases.words(9002, 20))]
    found = ld.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), settings=ld.Settings(block_parts=5))
    assert [(r["doc_id"], r["item_id"]) for r in found.collect()] == [(0, 7)]


def test_blocks_of_items_find_the_same(spark):
    items, docs, leaks = planted(spark)
    df = spark.createDataFrame(docs + leaks, "doc_id long, text string")
    found = ld.find_leaks(df, spark.createDataFrame(items, "item_id long, text string"), settings=ld.Settings(block_parts=5))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(i, (i - 1000) // 10) for i, _ in leaks}


def test_common_length_is_that_of_the_table():
    import random

    r = random.Random(2)
    for _ in range(200):
        a, b = ([r.randrange(5) for _ in range(r.randint(0, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert ld.common_length(a, b) == t[-1][-1]


def test_odd_rows(spark):
    docs = cases.documents(spark)
    items = spark.createDataFrame([(1, None), (2, ""), (3, " .,! "), (None, cases.words(2, 70))], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in ld.find_leaks(docs, items).collect()}
    assert found == {(8, None), (9, None), (None, None)}
    kept = ld.decontaminate(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3
    assert ld.find_leaks(cases.empty(spark), items).count() == 0 and ld.find_leaks(docs, items.limit(0)).count() == 0


def test_pipeline_keeps_clean_documents_and_drops_the_rest(spark, tmp_path):
    import corpus_pipeline

    items, docs, leaks = planted(spark)
    copies = [(2000 + i, t) for i, t in docs[:10]]
    near = [(3000 + i, " ".join([*t.split()[:-2], "x", "y"])) for i, t in docs[10:20]]
    junk = [(4000 + i, " ".join(f"{x}###" for x in cases.words(i + 3000, 60).split())) for i in range(40)]
    rows = [(i, t, "en", "s", len(t)) for i, t in docs + leaks + copies + near + junk]
    labels = [(i, 1, 0) for i, _ in docs] + [(i, 0, 0) for i, _ in junk[:30]]
    d = cases.write(spark, tmp_path, documents=spark.createDataFrame(rows, cases.DOCS), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), benchmark=spark.createDataFrame(items, "item_id long, text string"))
    own = spark.read.parquet(f"{d}/documents.parquet")
    kept = own
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        kept = stage(spark, kept, d)
        assert kept.columns == own.columns
        kept.write.parquet(str(tmp_path / f"s{k}"))
        kept = spark.read.parquet(str(tmp_path / f"s{k}"))
    # an exact leak of one item comes first; what it shares with later ones has gone before the leaks are looked for
    assert {r["doc_id"] for r in kept.collect()} >= {i for i, _ in docs}
    assert not {r["doc_id"] for r in kept.collect()} & ({i for i, _ in copies + near + junk} | {1000 + 10 * i for i, _ in items})
    out = corpus_pipeline.run(spark, d)
    assert out.filter("not round_trip").count() == 0
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in kept.collect()}


def test_entry_works_without_these_folders(monkeypatch):
    import __spark_entry__ as entry

    every = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 11)} == {q.split("_")[0] + "_" for q in every if q.startswith("op")} and "pipeline" in every
    monkeypatch.setitem(sys.modules, "parsewarden.llm.queries", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    rest = set(importlib.reload(entry).queries())
    assert rest and not any(q.startswith("op") for q in rest) and "pipeline" not in rest
    assert set(entry.oracle_sql()) <= rest


def test_stages_take_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    d = cases.write(spark, tmp_path, documents=cases.empty(spark), labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"), benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert corpus_pipeline.run(spark, d).count() == 0


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_rows(spark, tmp_path, k):
    import corpus_pipeline

    docs = cases.documents(spark)
    d = cases.write(spark, tmp_path, labels=spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int"), benchmark=spark.createDataFrame([(1, cases.words(3, 60))], "item_id long, text string"))
    assert corpus_pipeline.STAGES[k][1](spark, docs, d).count() >= 0


def test_memory_is_handed_back_when_a_task_holds_nothing_more(monkeypatch):
    import weakref

    class Held:
        pass

    seen, alive = [], []

    def run(batches):
        for b in batches:
            x = Held()
            seen.append(weakref.ref(x))
            yield b

    monkeypatch.setattr(common, "give_back", lambda: alive.append(seen[-1]() is not None))
    assert list(common.handing_back(run)(iter("ab"))) == ["a", "b"] and alive == [False]


def test_tasks_over_texts_hand_memory_back(spark, monkeypatch):
    docs = spark.createDataFrame([(i, cases.words(i % 9, 60)) for i in range(12)], "doc_id long, text string")
    kind, runs = type(docs), []
    own = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, run, *a: runs.append(run.__qualname__) or own(self, run, *a))
    link(docs).count()
    chunks(docs, "text", "doc_id", 5, 16, 256).count()
    ld.find_leaks(docs, spark.createDataFrame([(1, cases.words(70, 20))], "item_id long, text string")).count()
    # sums of fixed size are the only ones that needn't
    assert len([r for r in runs if r.startswith("handing_back.")]) >= 8
    assert {r for r in runs if not r.startswith("handing_back.")} == {"summed_blocks.<locals>.add", "summed_rows.<locals>.add"}
