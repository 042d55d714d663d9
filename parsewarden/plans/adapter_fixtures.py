"""Raw tables of five parsers, derived from conversations: a conversation is a file, a turn a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parsewarden.plans.fixtures import table
from parsewarden.sources import adapters
from parsewarden.sources.adapters import Parsed


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    return table(spark, sf_dir, "conversations").select(name.alias("source_file"), F.col("turn").cast("int").alias("turn"), (F.col("turn") + 1).cast("int").alias("page_number"), "role", "text")


def files(t: DataFrame) -> DataFrame:
    """Every file whose number ends in 7 has failed."""
    failed = F.col("source_file").endswith("7")
    none = lambda kind: F.lit(None).cast(kind)
    return t.select("source_file").distinct().select(
        "source_file", (~failed).alias("success"), F.when(failed, "ValueError: broken").alias("error"), F.array().cast("array<string>").alias("warnings"), F.lit(0.0).alias("processing_time_seconds"),
        none("map<string,string>").alias("pdf_metadata"), F.lit("doc").alias("document_name"), F.lit("success").alias("conversion_status"), F.lit("hi_res").alias("strategy"), F.array(F.lit("eng")).alias("languages"),
        F.lit("agentic").alias("tier"), none("string").alias("uploaded_file_id"), none("string").alias("job"), none("string").alias("usage"),
    )


def box(*values) -> F.Column:
    return F.array(*[F.lit(v).cast("double") if isinstance(v, int) else v.cast("double") for v in values])


def every_parser(spark: SparkSession, sf_dir: str) -> Parsed:
    t = turns(spark, sf_dir)
    f, k = files(t), F.col("turn")
    rows = F.array(F.array(F.lit("a"), F.col("role")), F.array(F.lit(" b\n")))
    pages = t.select("source_file", "page_number", "text", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), F.lit(1).alias("image_count"))
    found = t.filter(k % 3 == 0).select("source_file", "page_number", k.alias("table_index"), rows.alias("rows"), box(1, 2, 3, 4).alias("bbox"))
    words = t.select("source_file", k.alias("word_index"), "page_number", F.col("role").alias("text"), *[F.lit(v).cast("double").alias(n) for n, v in (("x0", 1), ("top", 2), ("x1", 3), ("bottom", 4))])
    fields = F.when(k % 4 == 3, F.array(F.lit("1"))).otherwise(F.array(F.lit("1"), F.lit("2"), F.lit("3"), F.lit("x"), F.when(k % 4 == 2, " \n").otherwise(F.col("text")), k.cast("string"), F.lit("0")))
    blocks = t.select("source_file", "page_number", k.alias("block_index"), fields.alias("fields"))
    provenance = F.when(k % 5 != 0, F.array(F.struct(F.col("page_number").alias("page_no"), box(0, 0, 9, 9).alias("bbox"))))
    items = t.select("source_file", k.alias("item_index"), F.col("role").alias("label"), F.when(k % 4 == 0, "").otherwise(F.col("text")).alias("text"), k.alias("level"), provenance.alias("provenance"))
    primary = t.filter(k % 2 == 0).select("source_file", k.alias("table_index"), F.array(F.lit("h"), F.lit("i")).alias("header"), rows.alias("rows"), provenance.alias("provenance"), F.lit("<table/>").alias("html"), F.lit("|h|").alias("markdown"))
    docling = adapters.adapt_docling(f.withColumn("text", F.lit("whole")).withColumn("markdown", F.lit("# whole")), pages.select("source_file", "page_number", "text", F.concat(F.lit("# "), "text").alias("markdown")), items, primary)
    html = F.when(k % 4 == 1, F.concat(F.lit("<table><tr><td>"), "role", F.lit("</td><td>x|y</td></tr></table>")))
    meta = F.create_map(F.lit("coordinates"), F.lit("c"), F.lit("lang"), F.lit("eng"))
    points = F.array(F.array(F.lit(5.0), F.lit(6.0)), F.array(F.lit(1.0), F.lit(8.0)))
    raw = t.select("source_file", k.alias("element_index"), F.when(k % 4 == 1, "Table").otherwise("NarrativeText").alias("class_name"), "text", F.when(k % 6 != 5, F.col("page_number")).alias("page_number"), F.when(k % 2 == 0, points).alias("points"), html.alias("text_as_html"), meta.alias("metadata"))
    boxed = F.struct(F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), F.when(k % 5 != 2, F.lit(3.0)).alias("w"), F.lit(4.0).alias("h"))
    saved = t.select("source_file", "page_number", F.lit(0).alias("item_index"), F.when(k % 3 == 1, "table").otherwise("text").alias("type"), F.col("role").alias("md"), F.when(k % 2 == 0, F.col("text")).otherwise("").alias("value"), boxed.alias("bbox"), F.when(k % 2 == 1, k).alias("level"), rows.alias("rows"), F.lit(None).cast("string").alias("html"))
    part = lambda r, name, value: t.filter(k % 4 != r).select("source_file", "page_number", value.alias(name))
    # every seventh page has been saved twice: an older part comes first
    older, newer = F.lit(0).alias("seq"), F.lit(1).alias("seq")
    text = part(0, "text", F.col("text")).select("*", newer).unionByName(t.filter((k % 7 == 0) & (k % 4 != 0)).select("source_file", "page_number", F.lit("older").alias("text"), older))
    again = saved.filter("page_number % 4 <> 0 and (page_number - 1) % 7 = 0").withColumn("type", F.lit("older"))
    saved = saved.filter("page_number % 4 <> 0").select("*", newer).unionByName(again.select("*", older))
    llama = adapters.adapt_llamaparse(f, text, part(1, "markdown", F.col("role")), saved, part(3, "metadata", F.create_map(F.lit("n"), k.cast("string"))))
    return adapters.union([docling, adapters.adapt_pdfplumber(f, pages, words, found), adapters.adapt_pymupdf(f, pages, blocks, found), adapters.adapt_unstructured(f, raw), llama])
