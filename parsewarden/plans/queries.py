"""Queries over the test tables, one for each operator or group of operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parsewarden.functions import geometry, numbers, tables, text
from parsewarden.functions.json_text import to_json
from parsewarden.operators import alignment, extract, rollup
from parsewarden.operators.coverage import token_coverage_by_shuffle, with_token_coverage
from parsewarden.operators.profile import profile_pages
from parsewarden.operators.rules import validate_pages
from parsewarden.plans import fixtures
from parsewarden.plans.adapter_fixtures import every_parser
from parsewarden.plans.fixtures import table
from parsewarden.plans.pipelines import run_validation
from parsewarden.sources import files, ingest
from parsewarden.sources.adapters import parse_results_json

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def normalized_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fixtures.page_pairs(spark, sf_dir)
    return own.withColumns({"norm_primary": text.normalize_text(F.col("primary_text")), "norm_reference": text.normalize_text(F.col("reference_text"))})


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate_pages(profile_pages(fixtures.page_pairs(spark, sf_dir)))


def documents(spark: SparkSession, sf_dir: str, pages: bool = False) -> DataFrame:
    """Rolled-up documents: pages beyond the smaller page count are left out."""
    counts = fixtures.page_counts(spark, sf_dir)
    own = verdicts(spark, sf_dir).join(counts, "doc_id").filter(F.col("page_number") <= F.least("primary_pages", "reference_pages")).drop("primary_pages", "reference_pages")
    return rollup.roll_up(own, counts, tables=fixtures.primary_tables(spark, sf_dir), pages=pages)


def rows_text(rows: Column) -> Column:
    """Rows as one string, cells and rows parted by signs that no cell holds."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, "¦")), "¶")


@query
def str_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("normalized"))


@query
def str_tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.explode(text.tokens_of(text.normalize_text(F.col("text"))))
    return table(spark, sf_dir, "documents").select(tokens.alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query
def str_char_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = text.char_ratio(F.col("norm_primary"), F.col("norm_reference"))
    return normalized_pairs(spark, sf_dir).select("doc_id", "page_number", numbers.rounded(ratio).alias("ratio"))


@query
def str_replacement_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.page_pairs(spark, sf_dir).select("doc_id", "page_number", numbers.rounded(text.replacement_ratio(F.col("primary_text")), 6).alias("ratio"))


@query
def str_output_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("dir.v"), (F.col("doc_id") % 7).cast("string"), F.lit("/"), "source", F.when(F.col("doc_id") % 2 == 0, ".v1.pdf").otherwise(".pdf"))
    return table(spark, sf_dir, "documents").select("doc_id", text.output_path(path).alias("path"))


@query
def str_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return own.select("conv_id", "turn", text.error_text(F.col("role"), F.col("text")).alias("error"), text.first_truthy(F.when(F.col("turn") % 2 == 0, F.lit("")), F.col("role")).alias("value"))


@query
def doc_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.sha256(F.col("text")).alias("sha256"))


@query
def doc_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select("doc_id", text.sha256(F.col("text")).alias("sha256"))
    return own.groupBy("sha256").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1")


@query
def agg_token_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_token_coverage(normalized_pairs(spark, sf_dir)).select("doc_id", "page_number", numbers.rounded(F.col("token_coverage")).alias("coverage"))


@query
def agg_token_coverage_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = token_coverage_by_shuffle(normalized_pairs(spark, sf_dir), ["doc_id", "page_number"])
    return own.select("doc_id", "page_number", numbers.rounded(F.col("token_coverage")).alias("coverage"))


@query
def geo_image_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = profile_pages(fixtures.page_pairs(spark, sf_dir))
    return own.select("doc_id", "page_number", numbers.rounded(F.col("largest_coverage")).alias("largest"), numbers.rounded(F.col("total_coverage")).alias("total"), "image_count")


@query
def geo_points_to_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fixtures.boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", geometry.points_to_bbox(F.col("points")).alias("b"))
    return own.select("l_orderkey", "l_linenumber", *[F.get("b", F.lit(i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])


@query
def geo_xywh_to_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fixtures.boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", geometry.xywh_to_bbox(F.col("box")).alias("b"))
    return own.select("l_orderkey", "l_linenumber", *[F.get("b", F.lit(i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])


@query
def cls_page_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_pages(fixtures.page_pairs(spark, sf_dir)).select("doc_id", "page_number", "page_type", "usable")


@query
def val_page_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = verdicts(spark, sf_dir).select("doc_id", "page_number", F.posexplode("issues").alias("idx", "i"))
    return own.select("doc_id", "page_number", "idx", "i.severity", "i.code", "i.message")


@query
def val_page_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark, sf_dir).select("doc_id", "page_number", "cross_validation", "status", F.array_join("issues.code", ",").alias("codes"))


@query
def agg_table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.table_counts(fixtures.primary_tables(spark, sf_dir))


@query
def agg_tables_unassigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.total_tables(fixtures.primary_tables(spark, sf_dir))


@query
def jon_page_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fixtures.page_pairs(spark, sf_dir)
    both = alignment.align_pages(own.select("doc_id", "page_number", "primary_text"), own.select("doc_id", "page_number", "reference_text"), fixtures.page_counts(spark, sf_dir))
    out = alignment.with_table_counts(both, rollup.table_counts(fixtures.primary_tables(spark, sf_dir)))
    return out.select("doc_id", "page_number", F.length("primary_text").alias("primary_length"), F.length("reference_text").alias("reference_length"), "primary_tables")


@query
def jon_fourway_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page_number"), "role", "text")
    part = lambda k, name, value: own.filter(F.col("page_number") % 5 != k).select("doc_id", "page_number", value.alias(name))
    out = alignment.four_way_pages(part(0, "text", F.col("text")), part(1, "markdown", F.concat(F.lit("# "), "text")), part(2, "items", F.concat("role", F.lit(": "), "text")), part(3, "metadata", F.col("role")))
    return out.select("doc_id", "page_number", "text", "markdown", "items", "metadata")


@query
def agg_doc_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", "page_count_match", "pass_pages", "review_pages", "failed_pages", "status")


@query
def agg_doc_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", "document_type")


@query
def agg_doc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", "average_token_coverage", "average_character_length_ratio", "total_tables", "tables_without_page")


@query
def val_document_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.explode("issues").alias("i")).select("doc_id", "i.severity", "i.code", "i.message")


@query
def agg_corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.corpus_summary(documents(spark, sf_dir))


@query
def agg_doc_fulltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_number"), "text")
    return alignment.full_text(own)


@query
def agg_dense_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.pages_of_elements(fixtures.conversation_pages(spark, sf_dir))


@query
def arr_normalize_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.table_rows(spark, sf_dir).select("n_regionkey", rows_text(tables.normalize_rows(F.col("rows"))).alias("rows"))


@query
def arr_rows_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fixtures.table_rows(spark, sf_dir).select("n_regionkey", tables.normalize_rows(F.col("rows")).alias("rows"))
    return own.select("n_regionkey", tables.rows_to_markdown(F.col("rows")).alias("markdown"))


@query
def arr_html_table_to_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.table_html(spark, sf_dir).select("n_regionkey", rows_text(tables.html_table_to_rows(F.col("html"))).alias("rows"))


@query
def ord_path_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers paths part by part within each folder of the first level, so that no task takes all of them."""
    k = F.col("doc_id")
    path = F.concat_ws("/", "source", F.when(k % 3 == 0, "a").when(k % 3 == 1, "a-1").otherwise("a.b"), F.concat(F.lit("f"), k.cast("string"), F.lit(".pdf")))
    own = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "source")
    return own.select("doc_id", "path", F.row_number().over(Window.partitionBy("source").orderBy(alignment.path_order(F.col("path")))).alias("number"))


@query
def ing_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    status = F.when(k % 7 == 0, "failed").when(k % 5 == 0, "partial_success").when(k % 3 == 0, "success")
    return rollup.ingestion_counts(table(spark, sf_dir, "documents").select(status.alias("parser_status")))


REPORT = "document struct<source_file:string>, document_type string, status string, page_counts struct<docling:int,pdfplumber:int,match:boolean>, summary struct<pass_pages:int,review_pages:int,failed_pages:int,average_token_coverage:double,docling_total_tables:int>, issues array<struct<code:string>>, pages array<struct<page_number:int,status:string,metrics:struct<token_coverage:double>,issues:array<struct<code:string>>>>"


@query
def json_report_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports as JSON, read again."""
    own = rollup.document_report(documents(spark, sf_dir, pages=True)).select("doc_id", to_json(F.col("report")).alias("j"))
    own = own.select("doc_id", "j", F.from_json("j", REPORT).alias("r"))
    pages = F.array_join(F.transform("r.pages", lambda p: F.concat(p["page_number"].cast("string"), F.lit(":"), p["status"], F.lit(":"), F.array_join(p["issues"]["code"], "+"))), ",")
    nulls = F.col("j").contains('"average_token_coverage":null').alias("null_coverage")
    return own.select("doc_id", "r.document.source_file", "r.document_type", "r.status", "r.page_counts.docling", "r.page_counts.pdfplumber", "r.page_counts.match", "r.summary.pass_pages", "r.summary.failed_pages", "r.summary.average_token_coverage", "r.summary.docling_total_tables", F.array_join("r.issues.code", ",").alias("issues"), F.coalesce(pages, F.lit("")).alias("pages"), nulls)


@query
def pip_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The validation job: documents as stored parses, some without their PDF or parse, some unreadable."""
    name = F.concat(F.lit("d/"), F.col("doc_id").cast("string"))
    pairs = fixtures.page_pairs(spark, sf_dir).withColumn("directory", name)
    counts = fixtures.page_counts(spark, sf_dir).withColumn("directory", name)
    source = F.struct(F.concat("directory", F.lit(".pdf")).alias("relative_path"))
    own = counts.select("doc_id", "directory", source.alias("source"))
    found = fixtures.primary_tables(spark, sf_dir).withColumn("directory", name).groupBy("directory").agg(F.collect_list(F.struct(F.array(F.struct("page_no")).alias("prov"))).alias("tables"))
    numbers_ = F.map_from_entries(F.transform(F.sequence(F.lit(1), F.col("primary_pages").cast("int")), lambda n: F.struct(n.cast("string").alias("k"), F.struct(n.alias("page_no")).alias("v"))))
    empty = F.from_json(F.lit("[]"), "array<struct<prov:array<struct<page_no:int>>>>")
    stored = F.to_json(F.struct(F.when(F.col("primary_pages") > 0, numbers_).alias("pages"), F.coalesce("tables", empty).alias("tables")))
    parsed = counts.join(found, "directory", "left").filter("doc_id % 29 <> 7").select("directory", stored.alias("json"))
    seen = pairs.select("doc_id", "directory", "page_number", F.col("reference_text").alias("text"), "char_objects", "width", "height", "images", F.col("reference_tables").alias("tables"))
    more = counts.filter("reference_pages > primary_pages").select("doc_id", "directory", F.col("reference_pages").alias("page_number"))
    reference = seen.filter("doc_id % 97 <> 0").unionByName(more, allowMissingColumns=True)
    sources = own.filter("doc_id % 31 <> 5").select("source.relative_path")
    failures = own.filter("doc_id % 37 = 11").select("directory", F.lit("ValueError: torn").alias("error"))
    reports, _ = run_validation(own.drop("doc_id"), sources, parsed, pairs.select("directory", "page_number", F.col("primary_text").alias("text")), reference.drop("doc_id"), failures=failures)
    r = F.col("report")
    return reports.select("directory", "status", "error_message", r["document_type"].alias("document_type"), F.size(r["pages"]).alias("pages"), r["summary"]["pass_pages"].alias("pass_pages"), r["summary"]["docling_total_tables"].alias("total_tables"))


@query
def src_check_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was ingested, with an error where its PDF or its parse has gone."""
    k = F.col("doc_id")
    path = F.concat(F.lit("raw/"), k.cast("string"), F.lit(".pdf"))
    log = table(spark, sf_dir, "documents").select(F.concat(F.lit("raw/"), k.cast("string")).alias("directory"), F.struct(path.alias("relative_path")).alias("source"), "doc_id", F.when(k % 3 == 0, F.array(F.lit("metadata"), F.lit("error"))).otherwise(F.array(F.lit("metadata"))).alias("kinds"))
    log = log.select("directory", "source", "doc_id", F.explode("kinds").alias("kind"))
    own = files.processed_documents(log, strict=True)
    out = files.check_sources(own, log.filter("doc_id % 5 <> 1").select("source.relative_path").distinct(), log.filter("doc_id % 7 <> 2").select("directory").distinct())
    return out.select("directory", "early_status", "error_message")


@query
def src_new_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprinted texts whose content no successful run has seen."""
    own = files.fingerprints(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("relative_path"), F.length("text").alias("length"), F.col("text").cast("binary").alias("content")))
    log = own.filter("cast(relative_path as long) % 2 = 0").select(F.lit("metadata").alias("kind"), F.struct("sha256").alias("source"))
    return files.new_files(own, log).select("relative_path", "length", "sha256")


@query
def snk_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and fingerprints of what ingestion stores of each document: three outputs and metadata, or an error."""
    k = F.col("doc_id")
    name = F.concat(k.cast("string"), F.lit(".pdf"))
    bad = k % 6 == 1
    own = table(spark, sf_dir, "documents").select(
        k.cast("string").alias("directory"), F.struct(name.alias("file_name"), name.alias("relative_path"), F.length("text").cast("long").alias("file_size_bytes"), F.sha2("text", 256).alias("sha256")).alias("source"),
        F.struct(F.lit(2).alias("page_count"), F.lit(1).alias("table_count")).alias("document"), F.struct(F.lit("docling").alias("name"), F.lit("success").alias("conversion_status"), F.when(bad, "failed").alias("status"), F.lit(1.5).alias("processing_time_seconds")).alias("parser"),
        F.struct(F.lit("document.json").alias("json"), F.lit("document.md").alias("markdown"), F.lit("document.txt").alias("text")).alias("outputs"), F.when(bad, F.struct(F.lit("ValueError").alias("type"), F.lit("torn").alias("message"))).alias("error"),
        F.lit("{}").alias("json"), F.concat(F.lit("# "), "text").alias("markdown"), "text",
    )
    out = ingest.artifacts(own)
    j = lambda p: F.get_json_object("content", p)
    kept = F.when(F.col("file_name").endswith(".json"), F.concat_ws("|", j("$.source.file_name"), j("$.source.sha256"), j("$.parser.name"), j("$.parser.status"), j("$.document.page_count"), j("$.error.type"), j("$.error.message"))).otherwise(F.sha2("content", 256))
    return out.select("directory", "file_name", kept.alias("kept"))


@query
def set_dedupe_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as glyphs of a page: equal ones within a step of one another are one, the first."""
    q, d = F.col("l_quantity").cast("double"), F.col("l_discount").cast("double")
    own = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("page"), F.col("l_returnflag").alias("text"), F.col("l_linestatus").alias("fontname"), F.lit(9.0).alias("size"), F.floor(q * 3 + d * 10).cast("double").alias("x0"), (F.col("l_linenumber") * 2).cast("double").alias("top"))
    return extract.dedupe_chars(own, ["page"], 1.0).groupBy("page").agg(F.count("*").alias("glyphs"), F.sum("x0").alias("x0"))


@query
def ord_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("x0"), (F.col("l_linenumber") % 3).cast("double").alias("top"))
    own = own.withColumn("x0", F.col("x0") + F.col("l_linenumber") / 100)
    return extract.reading_order(own, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "order")


@query
def lim_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty words of each document, as a look at a page shows them."""
    words = F.split(F.trim(text.collapse(F.col("text"))), " ")
    return extract.item_previews(table(spark, sf_dir, "documents"), ["doc_id"], words, 20, "word_index", "word")


@query
def str_nfkc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composed forms, which no text of the tables has."""
    rows = [(1, "\ufb01le \u2460"), (2, "\uff21\uff22\u3000c"), (3, "e\u0301"), (4, "\u00bd \u2126"), (5, "plain"), (6, None), (7, "\u1e9b\u0323 \u212b")]
    return spark.createDataFrame(rows, "k int, t string").select("k", text.normalize_text(F.col("t")).alias("normalized"))


def map_text(m: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def corners() -> list[Column]:
    return [F.get("bbox", F.lit(i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))]


@query
def adp_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = every_parser(spark, sf_dir).results
    return own.select("parser_name", "source_file", "success", F.length("text").alias("text_length"), F.length("markdown").alias("markdown_length"), map_text(F.col("metadata")).alias("metadata"), "error")


@query
def adp_pages_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = every_parser(spark, sf_dir).pages
    return own.select("parser_name", "source_file", "page_number", "text", "markdown", F.coalesce(map_text(F.col("metadata")), F.lit("")).alias("metadata"))


@query
def adp_elements_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = every_parser(spark, sf_dir).elements
    return own.select("parser_name", "source_file", "element_index", "type", "text", "page_number", *corners(), F.coalesce(map_text(F.col("metadata")), F.lit("")).alias("metadata"))


@query
def adp_tables_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = every_parser(spark, sf_dir).tables
    return own.select("parser_name", "source_file", "table_index", rows_text(F.col("rows")).alias("rows"), "page_number", *corners(), "markdown", "html")


@query
def adp_results_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as JSON, read again."""
    schema = "success boolean, error string, pages array<struct<page_number:int,text:string>>, elements array<struct<type:string>>, tables array<struct<rows:array<array<string>>>>"
    own = parse_results_json(every_parser(spark, sf_dir)).select("parser_name", "source_file", F.from_json("json", schema).alias("r"))
    total = F.aggregate("r.pages", F.lit(0), lambda a, p: a + F.length(p["text"]))
    return own.select("parser_name", "source_file", "r.success", "r.error", F.size("r.pages").alias("pages"), F.size("r.elements").alias("elements"), F.size("r.tables").alias("tables"), F.get("r.pages", F.lit(0))["text"].alias("first"), total.alias("characters"))
