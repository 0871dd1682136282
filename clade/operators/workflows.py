"""End-to-end workflows over sequence files: cluster, grow a target, analyse, refine."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clade.functions import kernels
from clade.functions import sequences as seqs

from . import cluster, distance, metrics, query_analysis, refine


def one_scope(sequences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """items and pairs of all sequences (idx, seq) as one scope."""
    items = sequences.select(F.lit(0).alias("scope_id"), "idx", "seq")
    return items, distance.scoped_pairs(items)


def full_clustering(sequences: DataFrame, pairs: DataFrame | None = None, **options) -> DataFrame:
    """sequences with cluster_num (null: singleton). pairs: (i, j, d), else by alignment."""
    problems = seqs.validate(sequences) if pairs is None else []
    if problems:
        raise ValueError("; ".join(problems))
    items, own = one_scope(sequences) if pairs is None else (sequences.select(F.lit(0).alias("scope_id"), "idx"), pairs.select(F.lit(0).alias("scope_id"), "i", "j", "d"))
    return sequences.join(cluster.gap_clusters(items.select("scope_id", "idx"), own, **options).drop("scope_id"), "idx")


def target_clustering(sequences: DataFrame, targets: DataFrame, min_split: float = 0.005, max_lump: float = 0.02, percentile: int = 95) -> DataFrame:
    """sequences with member: the cluster grown from those that equal a target (target_id, seq)."""
    found = seqs.first_match(targets, sequences).where("idx is not null").select("idx").distinct()
    if not found.take(1):
        raise ValueError("no target sequence is among the input")
    items, pairs = one_scope(sequences)
    seeded = items.select("scope_id", "idx").join(found.withColumn("is_seed", F.lit(True)), "idx", "left").withColumn("is_seed", F.coalesce("is_seed", F.lit(False)))
    return sequences.join(cluster.target_clusters(seeded, pairs, min_split, max_lump, percentile).drop("scope_id"), "idx")


def cluster_pairs(sequences: DataFrame, assign: DataFrame) -> DataFrame:
    """Labelled pairs as analysis wants them: inside a cluster from the
    cluster's own alignment and median length, across clusters from one
    alignment of all."""
    members = assign.join(sequences, "seq_id")
    idx = members.select("seq_id").distinct().select("seq_id", F.xxhash64("seq_id").alias("idx"))
    rows = members.join(idx, "seq_id").select("cluster_id", "idx", "seq")
    inside = distance.scoped_pairs(rows.select(F.col("cluster_id").alias("scope_id"), "idx", "seq")).select("i", "j", "d", F.col("scope_id").alias("ci"), F.col("scope_id").alias("cj"))
    every = distance.scoped_pairs(rows.select(F.lit(0).alias("scope_id"), "idx", "seq")).select("i", "j", "d")
    across = distance.labelled(every, rows.select("idx", "cluster_id")).where("ci <> cj").select("i", "j", "d", "ci", "cj")
    return inside.unionByName(across)


def analysis(sequences: DataFrame, assign: DataFrame, percentiles=(90, 95)) -> dict[str, DataFrame]:
    """summary (per cluster), percentiles (by side), gaps, and the labelled pairs."""
    pairs = cluster_pairs(sequences, assign).cache()
    return {"pairs": pairs, "summary": metrics.cluster_summary(pairs, assign), "percentiles": metrics.percentile_vector(pairs), "gaps": metrics.gap_metrics(pairs, percentiles)}


def query_hits(sequences: DataFrame, min_split: float = 0.005, max_lump: float = 0.02) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes, summary, pairs) of sequences (scope_id, idx, seq), one query a scope, the first record."""
    pairs = distance.scoped_pairs(sequences).cache()
    classes = query_analysis.classified(sequences.select("scope_id", "idx"), pairs, min_split, max_lump).cache()
    return classes, query_analysis.summary(classes), pairs


def refinement(sequences: DataFrame, assign: DataFrame, conf: refine.Config | None = None, **checkpoints) -> dict:
    """Refined assignment, its verification against the input, and the mapping."""
    result = refine.refine(sequences, assign, conf, **checkpoints)
    return {"result": result, "verification": metrics.verification(result.assign, assign), "mapping": metrics.mapping(assign, result.assign)}


def distances_frame(spark: SparkSession, texts: list[str]) -> DataFrame:
    """Pairs of a short list of sequences, on the driver."""
    d = kernels.sequence_distances(texts)
    rows = [(i, j, None if d[i, j] != d[i, j] else float(d[i, j])) for i in range(len(d)) for j in range(i + 1, len(d))]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["i", "j", "d"]) if rows else [], "i long, j long, d double")
