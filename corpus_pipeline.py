"""Corpus pipeline: toxicity, quality rules, near-duplicate removal and packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but
the last return the columns of ``documents``. Between stages the result is written as Parquet in
the shared folder and read again, which cuts lineage. The last stage's rows are token pieces,
which SQL cannot make, so there is no oracle; tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import host_quality, packing, simhash_similar, toxicity
from weftline.llm.common import materialise, table, vocabulary


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of a toxic grade is below one half."""
    return toxicity.toxicity_filter(docs, table(spark, sf_dir, "labels"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules, from hosts whose shrunk failure rate is acceptable."""
    return host_quality.quality_filter(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each near-duplicate class: five-word shingles, SimHash
    fingerprints within two bits (pigeonhole blocks), then all pairs of similarity 0.8 or more."""
    return simhash_similar.keep_first_similar(docs, similarity=0.8, shingle_words=5, max_distance=2)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents, packed into sequences of at most 2048 tokens."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality_rules", quality_stage),
    ("simhash_dedup", simhash_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
