"""What validation needs from stored parses and from glyph tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The parts of a stored document that are read: page numbers, and the provenance of tables.
STORED = "pages map<string,struct<page_no:int>>, tables array<struct<prov:array<struct<page_no:int>>>>"


def stored_documents(parsed: DataFrame, key: str = "directory") -> DataFrame:
    """key, primary_pages and tables (array of page numbers, null where unknown) from a column json of stored parses."""
    doc = F.from_json("json", STORED)
    first = F.transform(F.coalesce(doc["tables"], F.array().cast("array<struct<prov:array<struct<page_no:int>>>>")), lambda t: F.try_element_at(t["prov"], F.lit(1))["page_no"])
    return parsed.select(key, F.coalesce(F.size(doc["pages"]), F.lit(0)).alias("primary_pages"), first.alias("tables"))


def table_provenance(documents: DataFrame, key: str = "directory") -> DataFrame:
    """key, table_index and page_no of each table; an unknown page is null."""
    return documents.select(key, F.posexplode("tables").alias("table_index", "page_no"))


def dedupe_chars(chars: DataFrame, keys: list[str], tolerance: float = 1.0) -> DataFrame:
    """One glyph, the first, of each cluster of those of equal text, font and size on a page.

    Clusters are chains: sorted by the upper edge, a step of more than tolerance parts them; within those, the same by the
    left edge. Windows by page and glyph, so no group is held as one row. Glyphs on the same spot are of one cluster, so one
    of each spot goes into the windows: a group is as long as its spots, not as its glyphs.
    """
    alike = [*keys, "text", "fontname", "size"]

    def clusters(df: DataFrame, within: list[str], by: str, name: str) -> DataFrame:
        order = Window.partitionBy(*within).orderBy(by, "x0" if by == "top" else "top")
        parted = F.coalesce((F.col(by) - F.lag(by).over(order) > tolerance).cast("int"), F.lit(0))
        return df.withColumn("__parted", parted).withColumn(name, F.sum("__parted").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__parted")

    spots = chars.dropDuplicates([*alike, "top", "x0"])
    out = clusters(clusters(spots, alike, "top", "__y"), [*alike, "__y"], "x0", "__x")
    first = F.row_number().over(Window.partitionBy(*alike, "__y", "__x").orderBy("top", "x0"))
    return out.withColumn("__first", first).filter("__first = 1").drop("__x", "__y", "__first")


def reading_order(parts: DataFrame, keys: list[str], name: str = "order") -> DataFrame:
    """parts (x0, top) with their number on the page, from the top, then from the left, as sorted text is read; from 0."""
    order = Window.partitionBy(*keys).orderBy("top", "x0")
    return parts.withColumn(name, F.row_number().over(order) - 1)


def previews(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each group, for people to look at."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__n") <= n).drop("__n")


def item_previews(rows: DataFrame, keys: list[str], items: Column, n: int, index: str, item: str) -> DataFrame:
    """keys, index and item of the first n of each group's items, an array of each row, by their place in it.

    A row has no more than its own first n in them, so the others aren't made into rows.
    """
    return previews(rows.select(*keys, F.posexplode(F.slice(items, 1, n)).alias(index, item)), keys, [index], n)


def graphics_counts(graphics: DataFrame, keys: list[str]) -> DataFrame:
    """Lines, rectangles and curves of each page."""
    return graphics.groupBy(*keys).agg(*[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("line", "rect", "curve")])
