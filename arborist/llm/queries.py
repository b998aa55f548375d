"""Queries and DuckDB SQL of the training-data operators."""

from __future__ import annotations

from . import ann, bpe, chat_format, decontaminate, license_scan, line_dedup, ngram_join, quality, toxicity, url_filter
from .common import table

QUERIES = {
    "op1_decontaminate": lambda spark, d: decontaminate.op1(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op2_chat_format": lambda spark, d: chat_format.op2(table(spark, d, "conversations")),
    "op3_ngram_join": lambda spark, d: ngram_join.op3(table(spark, d, "documents")),
    "op4_quality_classifier": lambda spark, d: quality.op4(table(spark, d, "documents"), table(spark, d, "labels")),
    "op5_line_dedup": lambda spark, d: line_dedup.op5(table(spark, d, "documents")),
    "op6_url_filter": lambda spark, d: url_filter.op6(table(spark, d, "pages"), table(spark, d, "labels")),
    "op7_byte_bpe": lambda spark, d: bpe.op7(table(spark, d, "documents")),
    "op8_license_scan": lambda spark, d: license_scan.op8(table(spark, d, "documents")),
    "op9_toxicity": lambda spark, d: toxicity.op9(table(spark, d, "documents"), table(spark, d, "labels")),
    "op10_ann": lambda spark, d: ann.op10(table(spark, d, "embeddings")),
}

ORACLE_SQL = {
    "op1_decontaminate": decontaminate.OP1_SQL,
    "op3_ngram_join": ngram_join.OP3_SQL,
    "op10_ann": ann.OP10_SQL,
    "op2_chat_format": chat_format.OP2_SQL,
    "op5_line_dedup": line_dedup.OP5_SQL,
    "op6_url_filter": url_filter.OP6_SQL,
}
