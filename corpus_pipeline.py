"""The corpus pipeline: five stages over ``documents``, each written and read again.

Stages return the columns of documents, the last one those of its digest. Each
works on all rows that its predecessor kept. Executors give back the heap that
the stage before took, as Python workers need its place.

Defined cases: null and empty texts pass every stage (nothing speaks against
them) and end as no tokens; null, repeated and clashing ids are rows like any
other until near duplicates go, of which one row of each group stays, equal
rows being one group; a null language is one of its own; extra columns of
documents are left behind; without labels nothing is rejected, without a
benchmark nothing overlaps; no documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborist.llm import bpe, decontaminate, line_dedup, ngram_join, quality
from arborist.llm.common import give_back, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality.kept(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more keep their first occurrence only; ``n_chars`` follows."""
    give_back(spark)
    out = line_dedup.deduplicated(docs.select(*COLUMNS), min_docs=10, min_chars=1, keep_first=True)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (five words, 0.8): the one with the least id."""
    give_back(spark)
    return ngram_join.representatives(docs.select(*COLUMNS), k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap the benchmark go."""
    give_back(spark)
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left."""
    give_back(spark)
    return bpe.op7(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: SQL can't state the model's perplexities, nor the stages after it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
