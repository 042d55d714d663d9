"""Token coverage: how many of the reference's tokens, counted as often as they occur, the primary text has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parsewarden.functions.text import TOK, tokens_of
from parsewarden.operators.barrier import barrier


def _runs(tokens: Column) -> Column:
    """Where the runs of equal tokens of a sorted array begin."""
    places = F.sequence(F.lit(0), F.size(tokens) - 1)
    return F.when(F.size(tokens) > 0, F.filter(places, lambda i: (i == 0) | (F.get(tokens, i) != F.get(tokens, i - 1)))).otherwise(F.array().cast("array<int>"))


def _occurrences(tokens: Column, runs: Column) -> Column:
    """Each token with its number among equal ones. Every place is looked at once: time is linear in tokens."""
    size = lambda i, start: F.coalesce(F.get(runs, i + 1), F.size(tokens)) - start
    return F.flatten(F.transform(runs, lambda start, i: F.transform(F.sequence(F.lit(1), size(i, start)), lambda k: F.concat(F.get(tokens, start), F.lit(" "), k.cast("string")))))


def _repeats(tokens: Column) -> Column:
    """Of a sorted array each occurrence of a token but its first."""
    return F.filter(tokens, lambda x, i: (i > 0) & (x == F.get(tokens, i - 1)))


def with_token_coverage(pages: DataFrame, primary: str = "norm_primary", reference: str = "norm_reference") -> DataFrame:
    """pages with token_coverage; null where the reference has no tokens. Texts are normalised.

    A page's tokens meet in its own row: no shuffle, and no page is lost for having no tokens. Equal texts cover each other
    and aren't cut into tokens. Else the common tokens are those of the two sets, and of what repeats, numbered by
    occurrence. Arrays are columns behind barriers, as an expression within a lambda would be computed anew for each element.
    """
    p, r = F.col(primary), F.col(reference)
    a, b = F.col("__tokens"), F.col("__reference_tokens")
    out = barrier(pages.withColumns({"__tokens": F.when(p != r, F.sort_array(tokens_of(p))), "__reference_tokens": F.when(p != r, F.sort_array(tokens_of(r)))}))
    out = barrier(out.withColumns({"__common": F.size(F.array_intersect(a, b)), "__size": F.size(b), "__tokens": _repeats(a), "__reference_tokens": _repeats(b)}))
    both = (F.size(a) > 0) & (F.size(b) > 0)
    out = barrier(out.withColumns({"__runs": F.when(both, _runs(a)), "__reference_runs": F.when(both, _runs(b))}))
    again = F.size(F.array_intersect(_occurrences(a, F.col("__runs")), _occurrences(b, F.col("__reference_runs"))))
    common = F.col("__common") + F.when(both, again).otherwise(0)
    share = F.when(p == r, F.when(r.rlike(TOK), F.lit(1.0))).otherwise(F.try_divide(common.cast("double"), F.col("__size").cast("double")))
    return out.withColumn("token_coverage", share).drop("__tokens", "__reference_tokens", "__common", "__size", "__runs", "__reference_runs")


def token_coverage_by_shuffle(pages: DataFrame, keys: list[str], primary: str = "norm_primary", reference: str = "norm_reference") -> DataFrame:
    """keys and token_coverage of every page, for pages of very many tokens: one shuffle, by the first key, and spillable.

    Both aggregations have the partitioning of the repartition; the join back keeps pages without tokens.
    """
    own = pages.repartition(keys[0])
    each = lambda c, a, b: own.select(*keys, F.explode(tokens_of(F.col(c))).alias("t"), F.lit(a).alias("a"), F.lit(b).alias("b"))
    counts = each(primary, 1, 0).union(each(reference, 0, 1)).groupBy(*keys, "t").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    sums = counts.groupBy(*keys).agg(F.sum(F.least("a", "b")).alias("m"), F.sum("b").alias("r"))
    out = own.select(*keys).join(sums, keys, "left")
    return out.select(*keys, F.try_divide(F.col("m").cast("double"), F.col("r").cast("double")).alias("token_coverage"))
