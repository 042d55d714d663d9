"""Pages of several parsers, or of one in parts, brought together by number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def align_pages(primary: DataFrame, reference: DataFrame, counts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pages that both have, up to the smaller page count; pages beyond it are not compared."""
    both = primary.join(reference, [key, "page_number"]).join(counts, key)
    return both.filter(F.col("page_number") <= F.least("primary_pages", "reference_pages"))


def with_table_counts(pages: DataFrame, counts: DataFrame, key: str = "doc_id") -> DataFrame:
    """pages with primary_tables, 0 where none are counted."""
    return pages.join(counts, [key, "page_number"], "left").withColumn("primary_tables", F.coalesce("primary_tables", F.lit(0).cast("long")))


def four_way_pages(text: DataFrame, markdown: DataFrame, items: DataFrame, metadata: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every page number that any part has: text ("" if missing), markdown, items and metadata (null if missing).

    Each part: key, page_number and its value. One aggregation of tagged rows, so one shuffle instead of three joins. Of
    equal numbers the row that comes last by ``seq`` (0 where the part has none) counts.
    """
    parts = {"text": text, "markdown": markdown, "items": items, "metadata": metadata}

    def tagged(name: str, df: DataFrame) -> DataFrame:
        seq = F.col("seq").cast("long") if "seq" in df.columns else F.lit(0).cast("long")
        value = F.struct(seq.alias("seq"), F.col(name).alias("value"))
        return df.select(key, "page_number", *[(value if n == name else F.lit(None)).alias(n) for n in parts])

    rows = None
    for name, df in parts.items():
        own = tagged(name, df)
        rows = own if rows is None else rows.unionByName(own)
    out = rows.groupBy(key, "page_number").agg(*[F.max(F.col(n)).alias(n) for n in parts])
    return out.select(key, "page_number", F.coalesce("text.value", F.lit("")).alias("text"), *[F.col(f"{n}.value").alias(n) for n in ("markdown", "items", "metadata")])


def full_text(pages: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts of a document's pages in order, joined by blank lines."""
    parts = F.array_sort(F.collect_list(F.struct("page_number", F.coalesce(F.col(text), F.lit("")).alias("t"))))
    return pages.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n").alias("full_text"))


def pages_of_elements(elements: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pages 1 to the largest number of each document's elements, with their non-blank texts in order, joined.

    elements: key, element_index, page_number (null: on no page), text. A document without numbered elements has no pages.
    """
    numbered = elements.filter(F.col("page_number").isNotNull())
    parts = F.array_sort(F.collect_list(F.when(F.trim(F.regexp_replace("text", r"\s", " ")) != "", F.struct("element_index", "text"))))
    texts = numbered.groupBy(key, "page_number").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n").alias("text"))
    spine = numbered.groupBy(key).agg(F.max("page_number").alias("last")).filter("last >= 1").select(key, F.explode(F.sequence(F.lit(1), F.col("last").cast("int"))).alias("page_number"))
    return spine.join(texts, [key, "page_number"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def path_order(path: Column) -> Column:
    """Sorts as paths do, part by part."""
    return F.split(path, "/")
