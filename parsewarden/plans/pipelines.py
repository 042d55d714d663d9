"""The two jobs: ingestion of a folder of PDFs, and validation of what was stored."""

from __future__ import annotations

import sys
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parsewarden.config import ValidationConfig
from parsewarden.functions.text import output_path
from parsewarden.operators import rollup
from parsewarden.operators.extract import stored_documents, table_provenance
from parsewarden.operators.profile import profile_pages
from parsewarden.operators.rules import validate_pages
from parsewarden.sources import files, sinks
from parsewarden.sources.adapters import parse_results_json
from parsewarden.sources.extractors import adapted, docling_parser, extract, reference_pages, stored_pages
from parsewarden.sources.ingest import Parser, artifacts, ingest


def run_ingestion(spark: SparkSession, raw: str, processed: str, name: str, factory: Callable[[], Parser], export: bool = False) -> DataFrame:
    """Parse every PDF below raw; the table of parses goes to processed/parses. Returns its counts (one row).

    export also writes the files of each document below processed, a local folder that executors share.
    """
    sinks.write_table(ingest(files.discover_pdfs(spark, raw, content=True), name, factory), f"{processed}/parses")
    parsed = spark.read.parquet(f"{processed}/parses")
    if export:
        sinks.export_files(artifacts(parsed), processed.removeprefix("file://"))
    return rollup.ingestion_counts(parsed.select(F.col("parser.status").alias("parser_status")))


def compared_pages(primary: DataFrame, reference: DataFrame, tables: DataFrame, counts: DataFrame) -> DataFrame:
    """Pages that both parsers have, up to the smaller page count, with the number of the primary parser's tables.

    Rows of either parser and of tables are dealt out by directory once; a page comes of its rows by aggregation, and what
    follows by directory stays where it is. Texts are shuffled once. Of several rows of a page the largest values count.
    """
    parts = [
        primary.select("directory", "page_number", F.lit(1).alias("p"), F.coalesce("text", F.lit("")).alias("primary_text")),
        reference.select("directory", "page_number", F.lit(1).alias("r"), F.col("text").alias("reference_text"), "char_objects", "width", "height", "images", F.col("tables").alias("reference_tables")),
        tables.filter("page_no is not null").select("directory", F.col("page_no").alias("page_number"), F.lit(1).cast("long").alias("primary_tables")),
    ]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).repartition("directory")
    values = ("primary_text", "reference_text", "char_objects", "width", "height", "images", "reference_tables")
    pages = rows.groupBy("directory", "page_number").agg(*[F.max(c).alias(c) for c in (*values, "p", "r")], F.coalesce(F.sum("primary_tables"), F.lit(0).cast("long")).alias("primary_tables"))
    both = pages.filter("p = 1 and r = 1").drop("p", "r").join(counts, "directory")
    return both.filter(F.col("page_number") <= F.least("primary_pages", "reference_pages")).drop("primary_pages", "reference_pages")


def run_validation(documents: DataFrame, sources: DataFrame, parsed: DataFrame, primary: DataFrame, reference: DataFrame, config: ValidationConfig = ValidationConfig(), failures: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Reports of documents and the corpus summary.

    documents: directory and source, as files.ingestion_log has them; sources: relative_path of PDFs; parsed: directory and
    json; primary: directory, page_number, text; reference: directory, page_number, text, char_objects, width, height,
    images, tables; failures: directory and error of documents that could not be read, which FAIL. Returns directory,
    status, error_message and report (null for documents whose files are missing or failed), and one row of counts.
    Nothing is collected. Store the reports and summarise what was stored: the summary of this plan runs it again.
    """
    checked = files.check_sources(documents, sources, parsed)
    if failures is not None:
        wrong = failures.groupBy("directory").agg(F.min("error").alias("__error"))
        checked = checked.join(wrong, "directory", "left").withColumns({"error_message": F.coalesce("error_message", "__error"), "early_status": F.coalesce("early_status", F.when(F.col("__error").isNotNull(), "FAIL"))}).drop("__error")
    stored = stored_documents(parsed)
    seen = reference.groupBy("directory").agg(F.count("*").cast("int").alias("reference_pages"))
    good = checked.filter("early_status is null").select("directory")
    counts = good.join(stored, "directory").join(seen, "directory", "left").select("directory", "primary_pages", F.coalesce("reference_pages", F.lit(0)).alias("reference_pages"))
    tables = table_provenance(stored.join(good, "directory", "left_semi"))
    pages = compared_pages(primary, reference, tables, counts)
    done = rollup.roll_up(validate_pages(profile_pages(pages, config), config), counts, "directory", config, tables, pages=True)
    reports = rollup.document_report(done, config, "directory")
    out = checked.select("directory", "early_status", "error_message").join(reports, "directory", "left")
    out = out.select("directory", F.coalesce("early_status", "report.status").alias("status"), "error_message", "report")
    return out, rollup.corpus_summary(out)


def validate_stored(spark: SparkSession, processed: str, raw: str, out: str, config: ValidationConfig = ValidationConfig(), export: bool = False) -> DataFrame:
    """Validate what ingestion has stored below processed against the PDFs below raw; reports and summary go below out.

    Stored parses are not parsed again; each PDF is read once more by the reference parser. A document that either can't
    read FAILS with its error. Returns the summary, one row.
    """
    parses = spark.read.parquet(f"{processed}/parses").filter("error is null")
    documents, parsed = parses.select("directory", "source"), parses.select("directory", "json")
    sinks.write_table(extract(files.discover_pdfs(spark, raw, content=True), "pdfplumber"), f"{out}/reference")
    sinks.write_table(stored_pages(parsed), f"{out}/primary")
    seen, stored = spark.read.parquet(f"{out}/reference"), spark.read.parquet(f"{out}/primary")
    primary = stored.select("directory", F.explode("pages").alias("x")).select("directory", "x.*")
    reference = reference_pages(seen).withColumn("directory", output_path(F.col("relative_path")))
    failures = stored.filter("error is not null").select("directory", "error").union(seen.filter("not success").select(output_path(F.col("source_file")).alias("directory"), "error"))
    reports, _ = run_validation(documents, seen.select(F.col("source_file").alias("relative_path")), parsed, primary, reference, config, failures)
    sinks.write_table(reports, f"{out}/reports")
    written = spark.read.parquet(f"{out}/reports")
    if export:
        sinks.export_files(sinks.report_files(written.filter("report is not null"), "directory"), out.removeprefix("file://"))
    summary = rollup.corpus_summary(written)
    sinks.write_corpus_summary(summary, f"{out}/validation_summary.json")
    return summary


def parse_to(spark: SparkSession, parser: str, where: str, out: str) -> DataFrame:
    """Every PDF of a folder, or one file, by one parser: rows to out/extracted, results as lines of JSON to out/results."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(where)
    found = read.select(F.col("path").alias("relative_path"), "content").filter(F.lower("relative_path").endswith(".pdf"))
    sinks.write_table(extract(found, parser), f"{out}/extracted")
    results = parse_results_json(adapted(parser, spark.read.parquet(f"{out}/extracted")))
    results.select("json").write.mode("overwrite").text(f"{out}/results")
    return spark.read.parquet(f"{out}/extracted").groupBy("success").count()


COMMANDS = {
    "ingest RAW PROCESSED": lambda spark, raw, processed: run_ingestion(spark, raw, processed, "docling", docling_parser),
    "validate PROCESSED RAW OUT": validate_stored,
    "parse PARSER WHERE OUT": parse_to,
    "validate-tables SF_DIR": lambda spark, sf_dir: _queries()["agg_corpus_summary"](spark, sf_dir),
}


def _queries() -> dict:
    from parsewarden.plans.queries import QUERIES

    return QUERIES


def main(arguments: list[str]) -> int:
    """Run a command and print its counts, one line of JSON for each row."""
    for usage, command in COMMANDS.items():
        name, *wanted = usage.split()
        if arguments[:1] == [name] and len(arguments) == len(wanted) + 1:
            for row in command(SparkSession.builder.getOrCreate(), *arguments[1:]).toJSON().collect():
                print(row)
            return 0
    print("commands:", *COMMANDS, sep="\n  ", file=sys.stderr)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
