"""Quality rules: base tests on whole texts, then a learned decision list of threshold conjunctions.

The list is learned by sequential covering. Each rule grows by the test (feature >= or <= threshold) of highest
information gain on two thirds of the labelled rows, is pruned on the rest, and is kept while it is precise enough
there; the rows that it covers then leave. Candidate thresholds are exact percentiles of either class. The rules become
one ordered CASE expression: the first that fits rejects, else the row is kept.

Only the classifier is fitted on a sample: at most about ``max_labelled`` labelled rows, the ones with the smallest hash
of their id. Statistics and verdicts cover every row. All of it is DataFrame expressions: the driver sees counts by
(feature, bin) alone.

Defined results: a null text has no words, so it fails the base tests; labels of an id that disagree count as the
lower; null labels are left out; without labels of both classes the list is empty and keeps what the base tests keep;
repeated rows are each judged; an empty table gives an empty result; further columns of the input stay unless a name
clashes with a statistic or a verdict, which raises ValueError.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parsewarden.llm.common import WORD, checkpointed, table

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
#: Ratios that rules may test; all come from counts of the whole text.
FEATURES = ("symbol_ratio", "caps_ratio", "bang_ratio", "pipe_ratio", "digit_ratio", "dup_line_ratio", "repeat_ratio", "mean_word", "alpha_ratio")
WINDOW = 5
HELPERS = ("__words", "__hashes", "__windows", "__sorted", "__at", "__lines")


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) >= F.lit(self.threshold) if self.above else F.col(self.feature) <= F.lit(self.threshold)


def with_statistics(df: DataFrame, text: str = "text", features: bool = True) -> DataFrame:
    """df with BASE, and with FEATURES if asked. Row by row, without a shuffle.

    A row has repeated windows only if the hashes of its windows repeat; the positions are then found from the windows
    themselves, so hashes decide nothing. Positions come in order from a sort by (window, position): all in n log n.
    """
    clash = {*BASE, *(FEATURES if features else ())} & set(df.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} clash with statistics")
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    words, hashes = F.col("__words"), F.col("__hashes")
    df = df.withColumn("__words", F.regexp_extract_all(t, F.lit(WORD), F.lit(0)))
    df = df.withColumn("__hashes", F.transform(words, lambda w: F.xxhash64(w)))
    windows = F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - (WINDOW - 1), F.lit(0))), lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, WINDOW)]))
    df = df.withColumn("__windows", windows)
    whole = F.transform(F.sequence(F.lit(1), F.size("__windows")), lambda i: F.struct(F.concat_ws(" ", *[F.get(words, i + (k - 1)) for k in range(WINDOW)]).alias("w"), i.alias("i")))
    df = df.withColumn("__sorted", F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), F.sort_array(whole)))
    s = F.col("__sorted")
    same = lambda x, k: F.coalesce(F.get(s, k)["w"] == x["w"], F.lit(False))
    again = F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1))
    df = df.withColumn("__at", F.sort_array(F.transform(again, lambda x: x["i"])))
    at = F.col("__at")
    covered = F.aggregate(F.transform(at, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    df = df.withColumn("__lines", lines)
    df = df.select(
        "*",
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    df = df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    if features:
        chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
        count = lambda p: F.regexp_count(t, F.lit(p)) / chars
        df = df.select(
            "*",
            (F.col("n_symbols") / chars).alias("symbol_ratio"),
            count(r"\p{Lu}").alias("caps_ratio"),
            count("!").alias("bang_ratio"),
            count(r"\|").alias("pipe_ratio"),
            count("[0-9]").alias("digit_ratio"),
            (F.col("n_dup_lines") / F.greatest(F.size("__lines"), F.lit(1))).alias("dup_line_ratio"),
            (F.col("n_repeat_words") / F.greatest(F.col("n_words"), F.lit(1))).alias("repeat_ratio"),
            (F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))).alias("mean_word"),
            (F.length(F.array_join(F.filter(words, lambda w: w.rlike(r"^\p{L}+[.,;:?]?$")), "")) / chars).alias("alpha_ratio"),
        )
    # a generator of one row: a filter on a statistic is not pushed below it, where it would compute all of this again
    added = [c for c in df.columns if c in (*BASE, *FEATURES)]
    rest = [F.col(f"`{c}`") for c in df.columns if c not in added and c not in HELPERS]
    df = df.select(*rest, F.explode(F.array(F.struct(*added))).alias("__statistics"))
    return df.select(*rest, *[F.col(f"__statistics.{c}").alias(c) for c in added])


def _cuts(stats: DataFrame, bins: int) -> dict[str, list[float]]:
    """Thresholds of each feature: percentiles of either class."""
    steps = F.array(*[F.lit(k / bins) for k in range(bins + 1)])
    rows = stats.groupBy("bad").agg(*[F.percentile(f, steps).alias(f) for f in FEATURES]).collect()
    return {f: sorted({v for r in rows for v in (r[f] or ()) if v is not None}) for f in FEATURES}


def _binned(stats: DataFrame, cuts: dict[str, list[float]]) -> DataFrame:
    """For each feature k the number b<k> of thresholds at or below its value."""
    below = lambda f: F.size(F.filter(F.array(*[F.lit(c) for c in cuts[f]]), lambda c: c <= F.col(f)))
    equal = lambda f: F.array_contains(F.array(*[F.lit(c) for c in cuts[f]]), F.col(f))
    # twice the count, less one where the value is itself a threshold: thresholds are even-1, gaps even
    return stats.select("bad", "grow", *[(2 * below(f) - F.when(equal(f), 1).otherwise(0)).alias(f"b{k}") for k, f in enumerate(FEATURES)])


def _in(test: tuple[int, bool, int]) -> Column:
    k, above, cut = test
    return F.col(f"b{k}") >= 2 * cut + 1 if above else F.col(f"b{k}") <= 2 * cut + 1


def _all(tests: list[tuple[int, bool, int]]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & _in(t)
    return out


def _histogram(rows: DataFrame) -> dict[int, dict[int, list[int]]]:
    """For each feature and bin the rows that are good and bad."""
    long = rows.select("bad", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"b{k}").alias("b")) for k in range(len(FEATURES))])).alias("x"))
    out: dict[int, dict[int, list[int]]] = {k: {} for k in range(len(FEATURES))}
    for r in long.groupBy("x.k", "x.b").agg(F.count_if(~F.col("bad")).alias("good"), F.count_if("bad").alias("bad")).collect():
        out[r["k"]][r["b"]] = [r["good"], r["bad"]]
    return out


def _best(hist: dict[int, dict[int, list[int]]], cuts: dict[str, list[float]]) -> tuple[float, tuple[int, bool, int], int, int]:
    """The test of highest information gain: gain, test, good and bad rows that it covers."""
    good, bad = (sum(v[i] for v in hist[0].values()) for i in (0, 1))
    log = lambda p, n: math.log2((p + 1e-9) / (p + n + 1e-9))
    best = (0.0, (0, True, 0), 0, 0)
    for k, f in enumerate(FEATURES):
        for cut in range(len(cuts[f])):
            for above in (True, False):
                n, p = (sum(v[i] for b, v in hist[k].items() if (b >= 2 * cut + 1 if above else b <= 2 * cut + 1)) for i in (0, 1))
                if p and (gain := p * (log(p, n) - log(bad, good))) > best[0] + 1e-9:
                    best = (gain, (k, above, cut), n, p)
    return best


def learn_rules(stats: DataFrame, max_rules: int = 8, max_tests: int = 3, bins: int = 20, min_precision: float = 0.9, min_covered: int = 5) -> list[list[Test]]:
    """Ordered conjunctions that mark rows with bad = true. stats: id_hash, bad and FEATURES."""
    stats = checkpointed(stats.withColumn("grow", F.pmod(F.col("id_hash"), F.lit(3)) != 0))
    cuts = _cuts(stats, bins)
    if any(not c for c in cuts.values()):
        return []
    rest, rules = checkpointed(_binned(stats, cuts)), []
    for _ in range(max_rules):
        tests: list[tuple[int, bool, int]] = []
        while len(tests) < max_tests:
            gain, test, n, p = _best(_histogram(rest.filter(F.col("grow") & _all(tests))), cuts)
            if not gain or p < min_covered:
                break
            tests.append(test)
            if not n:
                break
        if not tests:
            break
        # prune: the prefix of highest (p - n) / (p + n) on the rows kept aside
        ahead = [_all(tests[: i + 1]) & ~F.col("grow") for i in range(len(tests))]
        seen = rest.agg(*[x.alias(f"{c}{i}") for i, a in enumerate(ahead) for c, x in (("p", F.count_if(a & F.col("bad"))), ("n", F.count_if(a & ~F.col("bad"))))]).first()
        worth = [((seen[f"p{i}"] - seen[f"n{i}"]) / max(1, seen[f"p{i}"] + seen[f"n{i}"]), -i) for i in range(len(tests))]
        keep = -max(worth)[1] + 1
        p, n = seen[f"p{keep - 1}"], seen[f"n{keep - 1}"]
        if p < max(2, min_covered // 2) or p < min_precision * (p + n):
            break
        rules.append([Test(FEATURES[k], above, cuts[FEATURES[k]][cut]) for k, above, cut in tests[:keep]])
        rest = rest.filter(~_all(tests[:keep]))
    return rules


def rules_column(rules: list[list[Test]]) -> Column:
    """The number of the first rule that fits, from 1; 0 if none does."""
    out = F
    for i, rule in enumerate(rules):
        fits = rule[0].column()
        for t in rule[1:]:
            fits = fits & t.column()
        out = out.when(fits, F.lit(i + 1))
    return out.otherwise(F.lit(0)) if rules else F.lit(0)


def labelled_sample(documents: DataFrame, labels: DataFrame, id_col: str, label_col: str, max_labelled: int) -> DataFrame:
    """documents with id_hash and bad, for at most about max_labelled labelled ids: those of smallest hash."""
    own = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg((F.min(label_col) <= 0).alias("bad"))
    share = min(1.0, max_labelled / max(1, own.count()))
    own = own.withColumn("id_hash", F.xxhash64("__id")).filter(F.pmod(F.col("id_hash"), F.lit(1_000_003)) < math.ceil(share * 1_000_003))
    return documents.join(own, documents[id_col] == own["__id"]).drop("__id")


def quality_rules(df: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label_col: str = "quality", max_labelled: int = 10_000, **how) -> tuple[DataFrame, list[list[Test]]]:
    """df with BASE, rule (number of the rule that rejects, 0 for none) and kept; and the rules."""
    if clash := {"rule", "kept"} & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} clash with those added")
    sample = labelled_sample(df.select(F.col(f"`{id_col}`"), F.col(f"`{text}`")), labels, id_col, label_col, max_labelled)
    stats = with_statistics(sample, text).filter(~F.col("base_failed")).select("id_hash", "bad", *FEATURES)
    rules = learn_rules(stats, **how)
    out = with_statistics(df, text).withColumn("rule", rules_column(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)).drop(*FEATURES), rules


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, _ = quality_rules(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", *BASE, "kept", "rule")
