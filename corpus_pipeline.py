"""A corpus pipeline of five stages over documents.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept; run() writes each stage's rows as Parquet in the shared folder and
reads them again as the next one's docs. All but the last return the columns
of documents. A table without rows goes through as one. Null and empty texts,
null and repeated ids, ties and other columns are as each stage's operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clade.llm import jaccard, mixing, pieces, quality, substring
from clade.llm.common import stored


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier rejects go."""
    return quality.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 80 % of their five-word shingles the smallest id stays."""
    return jaccard.deduplicated(docs, ngram=5, pct=80)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more stay in their first document only."""
    return substring.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.resampled(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, and the digests of ids and of the decoded text."""
    return pieces.encoded(docs)


STAGES = [
    ("quality_crf", reject_low_quality),
    ("ngram_jaccard", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Training, chaining and tokenising can't be said in SQL; tests hold the
#: stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
