"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from parsewarden.llm import chunk_dedup, latent_decontamination, ngram_join, oracles, quality_rules, sentencepiece_codec, suffix_dedup, token_counts, token_files, url_filters, warc_revisits

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_warc_revisits": warc_revisits.op2_warc_revisits,
    "op3_chunk_dedup": chunk_dedup.op3_chunk_dedup,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_url_filters": url_filters.op5_url_filters,
    "op6_ngram_join": ngram_join.op6_ngram_join,
    "op7_latent_decontamination": latent_decontamination.op7_latent_decontamination,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_sentencepiece": sentencepiece_codec.op9_sentencepiece,
    "op10_token_files": token_files.op10_token_files,
}
ORACLES = {
    "op2_warc_revisits": warc_revisits.ORACLE,
    "op5_url_filters": url_filters.ORACLE,
    "op6_ngram_join": oracles.NGRAM_JOIN,
    "op8_suffix_dedup": oracles.SUFFIX_DEDUP,
}
