"""Parser outputs to the contract tables: results, pages, elements and tables.

Each adapter takes raw tables of one parser, as an extractor plug-in delivers them, and selects. All raw tables have
source_file; files, one row for each, have success, error, warnings, processing_time_seconds and the metadata columns of
the parser. A file that failed has its row in results and none elsewhere.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parsewarden.functions.geometry import points_to_bbox, xywh_to_bbox
from parsewarden.functions.json_text import kept_metadata, to_json
from parsewarden.functions.tables import html_table_to_rows, normalize_rows, rows_to_markdown
from parsewarden.functions.text import first_truthy
from parsewarden.operators.alignment import four_way_pages, full_text, pages_of_elements
from parsewarden.schema import ELEMENTS, PAGES, RESULTS, TABLES, columns

#: Shorter tuples of a block list are no blocks.
BLOCK_FIELDS = 5


@dataclass
class Parsed:
    results: DataFrame
    pages: DataFrame
    elements: DataFrame
    tables: DataFrame


def typed(df: DataFrame, schema: str) -> DataFrame:
    """The columns of schema, missing ones null, in its types."""
    kinds = dict(x.split(" ", 1) for x in schema.split(", "))
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in columns(schema)])


def metadata(**values: Column | str) -> Column:
    """A map of the values that are not null, as strings."""
    pairs = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), (F.col(v) if isinstance(v, str) else v).cast("string"))])
    return F.map_filter(pairs, lambda _, v: v.isNotNull())


def parsed(name: str, files: DataFrame, pages: DataFrame, elements: DataFrame, tables: DataFrame, texts: DataFrame, info: Column) -> Parsed:
    """Contract tables; texts: source_file, text and, if there is one, markdown. Children of failed files are dropped."""
    good = files.filter("success").select("source_file")
    own = files.join(texts, "source_file", "left").withColumn("text", F.when(F.col("success"), F.coalesce("text", F.lit(""))).otherwise(F.lit("")))
    if "markdown" in texts.columns:
        own = own.withColumn("markdown", F.when(F.col("success"), F.col("markdown")))
    own = own.withColumn("metadata", F.when(F.col("success"), info).otherwise(F.create_map().cast("map<string,string>")))
    child = lambda df, schema: typed(df.join(good, "source_file", "left_semi").withColumn("parser_name", F.lit(name)), schema)
    return Parsed(typed(own.withColumn("parser_name", F.lit(name)), RESULTS), child(pages, PAGES), child(elements, ELEMENTS), child(tables, TABLES))


def joined(pages: DataFrame, column: str = "text") -> DataFrame:
    return full_text(pages, "source_file", column).select("source_file", F.col("full_text").alias(column))


def last_of_pages(parts: DataFrame, column: str) -> DataFrame:
    """One row for each page number: of several the last by seq, if the parts have it."""
    seq = F.col("seq") if "seq" in parts.columns else F.lit(0)
    return parts.groupBy("source_file", "page_number").agg(F.max(F.struct(seq.alias("seq"), F.col(column))).getField(column).alias(column))


def counted(files: DataFrame, pages: DataFrame) -> DataFrame:
    counts = pages.groupBy("source_file").agg(F.count("*").alias("page_count"))
    return files.join(counts, "source_file", "left").withColumn("page_count", F.coalesce("page_count", F.lit(0).cast("long")))


def adapt_docling(files: DataFrame, pages: DataFrame, items: DataFrame, tables: DataFrame) -> Parsed:
    """files: document_name, conversion_status, text, markdown. pages: page_number, text, markdown.

    items: item_index, label, text, level, provenance (array of struct page_no, bbox). tables: table_index, header, rows,
    provenance, html, markdown. Items without text are left out; the first provenance counts.
    """
    first = lambda c: F.try_element_at("provenance", F.lit(1)).getField(c)
    elements = items.filter(F.length("text") > 0).select("source_file", F.col("item_index").alias("element_index"), F.col("label").alias("type"), "text", first("page_no").alias("page_number"), first("bbox").alias("bbox"), metadata(hierarchy_level="level").alias("metadata"))
    rows = normalize_rows(F.when(F.col("header").isNotNull(), F.concat(F.array("header"), F.coalesce("rows", F.array().cast("array<array<string>>")))).otherwise(F.col("rows")))
    own = tables.select("source_file", "table_index", rows.alias("rows"), first("page_no").alias("page_number"), first("bbox").alias("bbox"), "markdown", "html", metadata(table_index="table_index").alias("metadata"))
    texts = files.select("source_file", "text", "markdown")
    return parsed("docling", counted(files.drop("text", "markdown"), pages), pages, elements, own, texts, metadata(page_count="page_count", document_name="document_name", conversion_status="conversion_status"))


def adapt_pdfplumber(files: DataFrame, pages: DataFrame, words: DataFrame, tables: DataFrame) -> Parsed:
    """files: pdf_metadata. pages: page_number, text, width, height. words: word_index, page_number, text, x0, top, x1, bottom.

    tables: page_number, table_index, rows, bbox.
    """
    elements = words.select("source_file", F.col("word_index").alias("element_index"), F.lit("word").alias("type"), F.coalesce("text", F.lit("")).alias("text"), "page_number", F.array("x0", "top", "x1", "bottom").alias("bbox"))
    own = tables.select("source_file", "table_index", normalize_rows(F.col("rows")).alias("rows"), "page_number", "bbox", rows_to_markdown(normalize_rows(F.col("rows"))).alias("markdown"), metadata(table_index_on_page="table_index").alias("metadata"))
    info = metadata(page_count="page_count", pdf_metadata=to_json(F.col("pdf_metadata")))
    return parsed("pdfplumber", counted(files, pages), pages.withColumn("metadata", metadata(width="width", height="height")), elements, own, joined(pages), info)


def adapt_pymupdf(files: DataFrame, pages: DataFrame, blocks: DataFrame, tables: DataFrame) -> Parsed:
    """As pdfplumber, with image_count of pages. blocks: page_number, block_index, fields (array of strings: x0, y0, x1, y1,

    text, and maybe number and type). Blocks of fewer than five fields, or with blank text, are left out.
    """
    field = lambda k: F.try_element_at("fields", F.lit(k))
    good = blocks.filter(F.size("fields") >= BLOCK_FIELDS).withColumn("text", F.coalesce(field(5), F.lit(""))).filter(F.length(F.regexp_replace("text", r"[\s\x1c-\x1f\x85\xa0\p{Z}]", "")) > 0)
    elements = good.select("source_file", F.col("block_index").alias("element_index"), F.lit("text_block").alias("type"), "text", "page_number", F.array(*[field(k).try_cast("double") for k in range(1, 5)]).alias("bbox"), metadata(block_number=field(6), block_type=field(7)).alias("metadata"))
    own = tables.select("source_file", "table_index", normalize_rows(F.col("rows")).alias("rows"), "page_number", "bbox", rows_to_markdown(normalize_rows(F.col("rows"))).alias("markdown"), metadata(table_index_on_page="table_index").alias("metadata"))
    info = metadata(page_count="page_count", pdf_metadata=to_json(F.col("pdf_metadata")))
    return parsed("pymupdf", counted(files, pages), pages.withColumn("metadata", metadata(width="width", height="height", image_count="image_count")), elements, own, joined(pages), info)


def adapt_unstructured(files: DataFrame, raw: DataFrame) -> Parsed:
    """files: strategy, languages (array). raw: element_index, class_name, text, page_number, points, text_as_html, metadata."""
    own = raw.withColumn("text", F.coalesce("text", F.lit("")))
    elements = own.select("source_file", "element_index", F.col("class_name").alias("type"), "text", "page_number", points_to_bbox(F.col("points")).alias("bbox"), kept_metadata(F.col("metadata")).alias("metadata"))
    rows = html_table_to_rows(F.col("text_as_html"))
    tables = own.filter("class_name = 'Table'").withColumn("rows", rows).select("source_file", F.col("element_index").alias("table_index"), "rows", "page_number", points_to_bbox(F.col("points")).alias("bbox"), rows_to_markdown(F.col("rows")).alias("markdown"), F.col("text_as_html").alias("html"))
    pages = pages_of_elements(own.select("source_file", "element_index", F.col("page_number").cast("int").alias("page_number"), "text"), "source_file")
    numbers = own.groupBy("source_file").agg(F.coalesce(F.max("page_number"), F.lit(0)).alias("page_count"), F.count("*").alias("element_count"))
    texts = joined(own.filter(F.length("text") > 0).select("source_file", F.col("element_index").alias("page_number"), "text"))
    info = metadata(page_count=F.coalesce("page_count", F.lit(0)), strategy="strategy", languages=F.array_join("languages", ","), element_count=F.coalesce("element_count", F.lit(0)))
    return parsed("unstructured", files.join(numbers, "source_file", "left"), pages, elements, tables, texts, info)


def adapt_llamaparse(files: DataFrame, text: DataFrame, markdown: DataFrame, items: DataFrame, page_metadata: DataFrame) -> Parsed:
    """Saved results of the service; nothing is uploaded. files: tier, uploaded_file_id, job, usage (JSON strings).

    text, markdown and page_metadata (column metadata, a map): page_number and maybe seq, the order of the parts; items:
    page_number, item_index, type, md, value, bbox (struct x, y, w, h), level, rows, html and maybe seq, that of their page.
    Of parts of one page number the last counts.
    """
    # of several parts of one page number the last counts, with all of its items
    if "seq" in items.columns:
        items = items.withColumn("__last", F.max("seq").over(Window.partitionBy("source_file", "page_number"))).filter(F.col("seq").eqNullSafe(F.col("__last"))).drop("__last", "seq")
    seen = items.groupBy("source_file", "page_number").agg(F.lit(True).alias("items"))
    pages = four_way_pages(text, markdown, seen, page_metadata.withColumn("metadata", to_json(F.col("metadata"))), "source_file")
    pages = pages.withColumn("metadata", F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>")))
    box = xywh_to_bbox(F.col("bbox"))
    elements = items.select("source_file", F.col("item_index").alias("element_index"), "type", first_truthy(F.col("value"), F.col("md")).alias("text"), "page_number", box.alias("bbox"), metadata(item_index="item_index", level="level").alias("metadata"))
    tables = items.filter("type = 'table'").select("source_file", F.col("item_index").alias("table_index"), normalize_rows(F.col("rows")).alias("rows"), "page_number", box.alias("bbox"), F.col("md").alias("markdown"), "html", metadata(item_index="item_index").alias("metadata"))
    texts = joined(last_of_pages(text, "text")).join(joined(last_of_pages(markdown, "markdown"), "markdown"), "source_file", "full")
    info = metadata(page_count="page_count", tier="tier", uploaded_file_id="uploaded_file_id", job="job", usage="usage")
    return parsed("llamaparse", counted(files, pages), pages, elements, tables, texts, info)


def union(parts: list[Parsed]) -> Parsed:
    """All parsers' tables one below the other, told apart by parser_name. Boxes of different parsers don't compare."""
    both = lambda name: reduce(DataFrame.unionByName, [getattr(p, name) for p in parts])
    return Parsed(*[both(n) for n in ("results", "pages", "elements", "tables")])


def parse_results_json(p: Parsed) -> DataFrame:
    """parser_name, source_file and json: each result with its pages, elements and tables, in order."""
    keys = ["parser_name", "source_file"]
    out = p.results
    for name, df, order in (("pages", p.pages, "page_number"), ("elements", p.elements, "element_index"), ("tables", p.tables, "table_index")):
        own = [c for c in df.columns if c not in keys]
        rows = F.array_sort(F.collect_list(F.struct(F.coalesce("page_number", F.lit(0)).alias("p"), F.coalesce(order, F.lit(0)).alias("o"), to_json(F.struct(*own)).alias("j"))))
        out = out.join(df.groupBy(*keys).agg(F.transform(rows, lambda x: x["j"]).alias(name)), keys, "left")
    head = to_json(F.struct(*[c for c in p.results.columns]))
    lists = [F.concat(F.lit(f',"{n}":['), F.coalesce(F.array_join(n, ","), F.lit("")), F.lit("]")) for n in ("pages", "elements", "tables")]
    return out.select(*keys, F.concat(F.regexp_replace(head, r"\}$", ""), *lists, F.lit("}")).alias("json"))
