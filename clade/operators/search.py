"""Neighbourhoods: which sequences are near given ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clade.functions.sequences import normalised


def similar(sequences: DataFrame, targets: DataFrame, k: int = 12, min_identity: float = 0.9, max_hits: int = 1000) -> DataFrame:
    """target_seq, seq, identity, rank of distinct sequences (column seq) that
    share at least min_identity of the smaller's k-letter grams with a distinct
    target sequence, best first, max_hits a target. Grams are joined, so no
    pair without a common gram is made."""
    one = sequences.select(normalised(F.col("seq")).alias("seq")).distinct()
    two = targets.select(normalised(F.col("seq")).alias("target_seq")).distinct()

    def grams(c):
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - k + 1, F.lit(1))), lambda p: F.substr(c, p, F.lit(k))))

    a = one.withColumn("g", grams(F.col("seq"))).select("seq", F.size("g").alias("n"), F.explode("g").alias("g"))
    b = two.withColumn("g", grams(F.col("target_seq"))).select("target_seq", F.size("g").alias("m"), F.explode("g").alias("g"))
    hits = b.join(a, "g").groupBy("target_seq", "seq", "n", "m").agg((F.count("*") / F.least("n", "m")).alias("identity")).where(F.col("identity") >= min_identity)
    best = W.partitionBy("target_seq").orderBy(F.desc("identity"), "seq")
    return hits.select("target_seq", "seq", "identity", F.row_number().over(best).alias("rank")).where(F.col("rank") <= max_hits)


def neighbourhood(sequences: DataFrame, target_ids: DataFrame, k: int = 12, min_identity: float = 0.9, max_hits: int = 1000) -> DataFrame:
    """seq_id of all sequences (seq_id, seq) that are targets (seq_id), equal
    one, or are similar to one; unknown targets give nothing."""
    targets = sequences.join(target_ids.select("seq_id").distinct(), "seq_id", "left_semi")
    near = similar(sequences, targets, k, min_identity, max_hits).select(F.col("seq").alias("k")).unionByName(targets.select(normalised(F.col("seq")).alias("k"))).distinct()
    return sequences.withColumn("k", normalised(F.col("seq"))).join(near, "k", "left_semi").select("seq_id").distinct()
