"""Functions against independent statements of what they compute."""

from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from parsewarden.functions import geometry, json_text, numbers, tables, text
from parsewarden.operators.coverage import token_coverage_by_shuffle, with_token_coverage

STRINGS = ["", "   ", "a\x1cb", "a\x85b", "a b", "ﬁx ①½", "İ", "ΑΣ", "é", "कि", "😀 x", "ẞ", "a​b", "a‿b", "� x �", "v1.2 3/4 a-b 12.5% end.", "_x _", None, "A\tB\nC", "--a--b..c"]


def normal(t):
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t or "").lower()).strip()


def tokens(t):
    return re.findall(r"\b[\w]+(?:[./%-][\w]+)*\b", normal(t), re.UNICODE)


@pytest.fixture(scope="module")
def pairs(spark):
    r = random.Random(4)
    own = [(a, b) for a in STRINGS for b in STRINGS[:6]]
    for _ in range(100):
        w = [r.choice(["a", "b", "c.d", "e", "f"]) for _ in range(r.randint(0, 30))]
        own.append((" ".join(w), " ".join(r.sample(w, len(w)) if r.random() < 0.5 else w[: r.randint(0, 30)])))
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(own)], "i int, p string, r string").withColumns({"np": text.normalize_text(F.col("p")), "nr": text.normalize_text(F.col("r"))}).cache()


def test_normalize_and_tokens(pairs):
    for r in pairs.withColumn("t", text.tokens_of(F.col("np"))).collect():
        assert r["np"] == normal(r["p"]) and r["t"] == tokens(r["p"]), r["p"]


def test_token_coverage_both_ways(pairs):
    one = {r["i"]: r["token_coverage"] for r in with_token_coverage(pairs, "np", "nr").collect()}
    two = {r["i"]: r["token_coverage"] for r in token_coverage_by_shuffle(pairs, ["i"], "np", "nr").collect()}
    assert one == two and len(one) == pairs.count()
    for r in pairs.collect():
        a, b = Counter(tokens(r["p"])), Counter(tokens(r["r"]))
        want = sum((a & b).values()) / sum(b.values()) if b else None
        assert one[r["i"]] == want


def test_no_shuffle_for_coverage(pairs):
    plan = with_token_coverage(pairs.select("np", "nr"), "np", "nr")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("InMemoryRelation")[0]


def test_ratios(pairs):
    for r in pairs.select("p", "np", "nr", text.char_ratio(F.col("np"), F.col("nr")).alias("c"), text.replacement_ratio(F.col("p")).alias("b")).collect():
        x, y = len(r["np"]), len(r["nr"])
        assert r["c"] == (min(x, y) / max(x, y) if max(x, y) else None)
        assert r["b"] == ((r["p"] or "").count("�") / len(r["p"]) if r["p"] else 0.0)


def test_paths_and_truth(spark):
    df = spark.createDataFrame([("a/x.v1.pdf", "", "m"), ("a.b/x", None, None), ("x.pdf", "v", "m"), ("d/.pdf", "", "")], "p string, v string, m string")
    got = [tuple(r) for r in df.select(text.output_path(F.col("p")), text.first_truthy(F.col("v"), F.col("m"))).collect()]
    assert got == [("a/x.v1", "m"), ("a.b/x", ""), ("x", "v"), ("d/.pdf", "")]


def test_tables(spark):
    rows = [[["a|b", None, " c\n d "], None, ["x"]], [], None, [[]]]
    df = spark.createDataFrame([(r,) for r in rows], "rows array<array<string>>").withColumn("n", tables.normalize_rows(F.col("rows")))
    got = [(r["n"], r["m"]) for r in df.withColumn("m", tables.rows_to_markdown(F.col("n"))).collect()]
    assert got[0] == ([["a|b", "", "c d"], ["x"]], "| a\\|b |  | c d |\n| --- | --- | --- |\n| x |  |  |")
    assert got[1] == ([], None) and got[2] == ([], None) and got[3][0] == [[]]


def test_html_rows():
    assert tables.parse_html_rows(None) == [] and tables.parse_html_rows("<p>x</p>") == []
    assert tables.parse_html_rows("<table><tr><th>a</th><td> b <i>c</i> </td><tr><td>d&amp;e</table><table><tr></tr><tr><td>f</td></tr></table>") == [["a", "b c"], ["d&e"], ["f"]]
    nested = "<table><tr><td>o<table><tr><td>i</td><td>j</td></tr></table></td><td>p</td></tr></table>"
    assert tables.parse_html_rows(nested) == [["o i j", "i", "j", "p"], ["i", "j"]]


def test_boxes(spark):
    df = spark.createDataFrame([([[1.0, 5.0], [3.0, 2.0]], (1.0, 2.0, 3.0, 4.0)), ([[1.0]], (1.0, 2.0, None, 4.0)), ([], None), (None, None)], "p array<array<double>>, b struct<x:double,y:double,w:double,h:double>")
    got = [tuple(r) for r in df.select(geometry.points_to_bbox(F.col("p")), geometry.xywh_to_bbox(F.col("b"))).collect()]
    assert got == [([1.0, 2.0, 3.0, 5.0], [1.0, 2.0, 4.0, 6.0]), (None, None), (None, None), (None, None)]


def test_coverages(spark):
    images = [[(0.0, 50.0, 0.0, 100.0), (90.0, 10.0, 0.0, 10.0), (0.0, None, 0.0, 1.0)], [(0.0, 900.0, 0.0, 900.0)] * 2, None]
    df = spark.createDataFrame([(i, 100.0, 100.0) for i in images] + [(images[0], 0.0, 5.0)], "i array<struct<x0:double,x1:double,top:double,bottom:double>>, w double, h double")
    c = geometry.image_coverages(F.col("i"), F.col("w"), F.col("h"))
    assert [tuple(r) for r in df.select(c, geometry.largest(c), geometry.total(c)).collect()] == [([0.5, 0.0], 0.5, 0.5), ([1.0, 1.0], 1.0, 1.0), ([], 0.0, 0.0), ([], 0.0, 0.0)]


def test_numbers_and_json(spark):
    df = spark.createDataFrame([(0.12345,), (None,), (0.12355,)], "x double")
    assert df.agg(numbers.safe_mean(F.col("x"))).first()[0] == 0.1235
    assert df.limit(0).agg(numbers.safe_mean(F.col("x"))).first()[0] is None
    limits = spark.range(1, 12).select("id", numbers.failure_limit(F.col("id"), 0.2, 2).alias("n")).collect()
    assert [r["n"] for r in limits] == [2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 3]
    one = df.limit(1).select(json_text.to_json(F.struct(F.lit(None).cast("string").alias("a"), F.lit(1).alias("b")))).first()[0]
    assert one == '{"a":null,"b":1}'
    kept = df.limit(1).select(json_text.kept_metadata(F.create_map(F.lit("coordinates"), F.lit("x"), F.lit("k"), F.lit("v")))).first()[0]
    assert kept == {"k": "v"}


def test_composing_stays_in_the_jvm(spark):
    chars = [chr(i) for i in range(1, 0x3100) if unicodedata.category(chr(i)) != "Cn"] + [chr(i) for i in range(0xF900, 0xFFFE) if unicodedata.category(chr(i)) != "Cn"]
    df = spark.createDataFrame([(c,) for c in chars], "t string")
    out = df.select("t", text.nfkc(F.col("t")).alias("n"), text.normalize_text(F.col("t")).alias("all"))
    assert all(r["n"] == unicodedata.normalize("NFKC", r["t"]) for r in out.collect())
    assert "EvalPython" not in out._jdf.queryExecution().executedPlan().toString()


def test_equal_texts_are_not_cut_into_tokens(spark):
    rows = [("a b a", "a b a"), ("a a a b", "b a a c"), ("...", "..."), ("", "a"), ("a", ""), (None, "a"), ("a a", "a")]
    out = with_token_coverage(spark.createDataFrame(rows, "p string, r string"), "p", "r")
    assert [r["token_coverage"] for r in out.collect()] == [1.0, 0.75, None, 0.0, None, None, 1.0]
    assert "CASE WHEN NOT (p" in out._jdf.queryExecution().optimizedPlan().toString()
