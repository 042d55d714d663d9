"""From raw documents to token ids: the operators of parsewarden.llm as one pipeline.

Each stage takes (spark, docs, sf_dir), with docs what the stage before has kept, and returns a DataFrame; all but the
last return the columns of documents. Stages are written as Parquet and read again, so a lost executor costs a stage's
tasks and not the pipeline.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parsewarden.llm.chunk_dedup import chunk_dedup
from parsewarden.llm.common import delete_path, fresh_path, table, written
from parsewarden.llm.latent_decontamination import decontaminate
from parsewarden.llm.ngram_join import link
from parsewarden.llm.quality_rules import quality_rules
from parsewarden.llm.sentencepiece_codec import encode_and_decode


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base tests and the rules learned from labels."""
    judged, _ = quality_rules(docs, table(spark, sf_dir, "labels"))
    return judged.filter("kept").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that shingle links connect, the one of smallest id. Rows without id stay.

    Rows of one id are one document: the smallest of them stays, by text and then by the other columns in their order.
    """
    linked = link(docs.select("doc_id", "text"))
    first = linked.filter("doc_id = component_id").select("doc_id").distinct()
    order = ["text", *[c for c in docs.columns if c not in ("doc_id", "text")]]
    kept = docs.join(first, "doc_id").groupBy("doc_id").agg(F.min(F.struct(*order)).alias("__row"))
    return kept.select("doc_id", "__row.*").select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the chunks that a document of smaller id has."""
    return chunk_dedup(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item has leaked."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_crc32 and whether decoding gives the text again."""
    out = encode_and_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=("doc_id", "text"))
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_tokens", "ids", "ids_crc32", same.alias("round_trip"))


STAGES = [
    ("quality rules", keep_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", drop_leaks),
    ("SentencePiece encoding and decoding", encode),
]

#: Learned rules, components and latent retrieval have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage. The folder of each stage is deleted once the next is written; the result reads the last."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = fresh_path(spark, f"stage{k}")
            docs = written(docs, path)
            if before:
                delete_path(spark, before)
            before = path
    return docs
