from __future__ import annotations

import re

import pytest

from parsewarden.llm import quality_rules as q
from tests.llm import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    covered = {k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    repeat = len(covered)
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeat, len(w) < 10 or 100 * repeat > 20 * len(w)


def test_statistics_match_brute_force(spark):
    texts = [r[1] for r in cases.rows() if r[1] is None or len(r[1]) < 2000]
    texts += ["a b c d e a b c d e f g h", "x x x x x x x x x x x", "l1 a\nl1 a\n\nl1 a \n#|<", "q " * 300, "a\x0bb\x0cc d e f a\x0bb c d e f\x85g h i"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r["i"]: tuple(r[c] for c in q.BASE) for r in q.with_statistics(df, features=False).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def labelled(spark):
    good = [(i, cases.words(i, 60), 1) for i in range(120)]
    bad = [(1000 + i, " ".join(f"{x}***" for x in cases.words(i, 60).split()), 0) for i in range(60)]
    loud = [(2000 + i, cases.words(i, 60).upper(), 0) for i in range(60)]
    every = good + bad + loud
    docs = spark.createDataFrame([(i, t) for i, t, _ in every], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, k) for i, _, k in every], "doc_id long, quality int")


def test_rules_are_learned_in_order(spark):
    docs, labels = labelled(spark)
    out, rules = q.quality_rules(docs, labels)
    assert {t.feature for r in rules for t in r} >= {"caps_ratio"} and len(rules) >= 2
    wrong = out.join(labels, "doc_id").filter("kept <> (quality = 1)").count()
    assert wrong <= 0.02 * docs.count()


def test_no_labels_keep_what_the_base_keeps(spark):
    docs = cases.documents(spark)
    labels = spark.createDataFrame([(1, None), (None, 0)], "doc_id long, quality int")
    for own in (labels, labels.limit(0)):
        out, rules = q.quality_rules(docs, own)
        assert not rules and out.filter("kept = base_failed").count() == 0 and out.count() == docs.count()
    assert q.quality_rules(cases.empty(spark), labels)[0].count() == 0


def test_no_python_on_the_main_path(spark):
    docs, labels = labelled(spark)
    out, _ = q.quality_rules(docs, labels)
    plan = out._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "Exchange" not in plan


def test_clashing_columns_are_refused(spark):
    with pytest.raises(ValueError):
        q.with_statistics(spark.createDataFrame([("a", 1)], "text string, n_words int"))
    for name in ("rule", "kept"):
        with pytest.raises(ValueError):
            q.quality_rules(spark.createDataFrame([(1, "a", 1)], f"doc_id long, text string, {name} int"), spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    wide = spark.createDataFrame([("a b", 1)], "text string, quality int")
    assert q.with_statistics(wide).first()["quality"] == 1


def test_query_over_whole_tables(spark, tmp_path):
    docs, labels = labelled(spark)
    d = cases.write(spark, tmp_path, documents=docs, labels=labels)
    got = {r["doc_id"]: r for r in q.op1_quality_rules(spark, d).collect()}
    assert {i: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for i, r in got.items()} == {r["doc_id"]: brute(r["text"]) for r in docs.collect()}
    assert not any(r["kept"] and r["base_failed"] for r in got.values())
