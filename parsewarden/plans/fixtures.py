"""Extraction tables derived from the test tables, for queries whose real input would be parsed PDFs. Nothing is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parsewarden.functions.text import REPLACEMENT
from parsewarden.schema import IMAGES

SLICE = 1500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mod(k: int, r: int) -> Column:
    return F.col("doc_id") % k == r


def page_images(kind: Column) -> Column:
    """Images of a page of each kind: none, a logo, several, a scan, negative widths, a malformed one."""
    of = {
        1: [(36, 96, 0, 40)],
        2: [(100, 406, 0, 400), (0, 500, 100, 500)],
        3: [(0, 612, 0, 700)],
        4: [(300, 250, 0, 90), (0, 300, 100, 500)],
        5: [(10, None, 0, 90)],
    }
    out = F
    for k, boxes in of.items():
        box = lambda b: F.struct(*[F.lit(v).cast("double").alias(n) for v, n in zip(b, ("x0", "x1", "top", "bottom"), strict=True)])
        out = out.when(kind == k, F.array(*[box(b) for b in boxes]))
    return out.otherwise(F.array()).cast(IMAGES)


def page_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of documents as pages of a reference, and damaged copies of them as those of a primary parser."""
    pages = F.floor((F.length("text") + SLICE - 1) / SLICE).cast("int")
    own = table(spark, sf_dir, "documents").select("doc_id", "text", pages.alias("n")).filter("n > 0")
    own = own.select("doc_id", "text", "n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("page_number"))
    own = own.withColumn("src", F.substring("text", (F.col("page_number") - 1) * SLICE + 1, F.lit(SLICE)))
    reference = F.when(_mod(17, 3), "").when(_mod(19, 4), F.substring("src", 1, 40)).otherwise(F.col("src"))
    primary = F.when(_mod(11, 0), "").when(_mod(5, 0), F.substring("src", 1, 900)).when(_mod(7, 0), F.substring("src", 1, 1100)).when(_mod(13, 0), F.concat(F.lit(REPLACEMENT * 20), "src")).otherwise(F.col("src"))
    kind = (F.col("doc_id") * 5 + F.col("page_number")) % 6
    return own.select(
        "doc_id", "page_number", reference.alias("reference_text"), primary.alias("primary_text"), F.length(reference).alias("char_objects"),
        F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), page_images(kind).alias("images"),
        ((F.col("doc_id") + F.col("page_number")) % 4).cast("int").alias("reference_tables"), ((F.col("doc_id") * F.col("page_number")) % 3).cast("int").alias("primary_tables"),
    )


def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page counts of either parser: now and then the reference sees one page more, or none."""
    n = F.floor((F.length("text") + SLICE - 1) / SLICE).cast("int")
    seen = F.when(_mod(97, 0), F.lit(0)).when(_mod(23, 0), n + 1).otherwise(n)
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("primary_pages"), seen.alias("reference_pages"))


def primary_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each table of the primary parser; every tenth has no page."""
    own = page_pairs(spark, sf_dir).filter("primary_tables > 0").select("doc_id", "page_number", F.explode(F.sequence(F.lit(1), F.col("primary_tables"))).alias("k"))
    index = F.col("page_number") * 10 + F.col("k")
    return own.select("doc_id", index.alias("table_index"), F.when((F.col("doc_id") + index) % 10 != 0, F.col("page_number")).alias("page_no"))


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as elements of pages, every third page missing."""
    own = table(spark, sf_dir, "conversations").filter("turn % 3 <> 1")
    return own.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("element_index"), (F.col("turn") + 1).cast("int").alias("page_number"), "role", "text")


def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the nations of each region, ragged, with nulls, line feeds and pipes."""
    k = F.col("n_nationkey")
    cells = F.when(k % 5 == 0, F.array(F.col("n_name"), F.lit(None).cast("string"))).when(k % 5 == 1, F.array(F.concat(F.lit(" a\n"), "n_name"))).otherwise(F.array(F.concat("n_name", F.lit("|x")), k.cast("string"), F.lit("\tend ")))
    rows = F.array_sort(F.collect_list(F.struct(k.alias("k"), F.when(k % 7 != 6, cells).alias("r"))))
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.transform(rows, lambda x: x["r"]).alias("rows"))


def table_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of the nations of each region as HTML."""
    row = F.concat(F.lit("<tr><td>"), F.col("n_nationkey").cast("string"), F.lit("</td><td> <b>"), "n_name", F.lit("</b> &amp; co </td></tr>"))
    rows = F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("k"), row.alias("r"))))
    html = F.concat(F.lit("<table><tr><th>key</th><th>name</th></tr>"), F.array_join(F.transform(rows, lambda x: x["r"]), ""), F.lit("<tr></tr></table>"))
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(html.alias("html"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points and x, y, w, h boxes from line items; every tenth lacks a coordinate."""
    q, d, t = (F.col(c).cast("double") for c in ("l_quantity", "l_discount", "l_tax"))
    broken = F.col("l_orderkey") % 10 == 3
    points = F.array(F.array(q, d), F.array(d, t), F.when(broken, F.array(t)).otherwise(F.array(t, q)))
    box = F.struct(q.alias("x"), d.alias("y"), F.when(~broken, t).alias("w"), (q + d).alias("h"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", points.alias("points"), box.alias("box"))
