"""Which hits of a query belong with it: many queries at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clade.functions import kernels

from . import cluster, metrics
from .distance import directed, known


def check_thresholds(min_split: float, max_lump: float) -> None:
    if min_split < 0 or max_lump < 0 or min_split >= max_lump:
        raise ValueError("thresholds must satisfy 0 <= min_split < max_lump")


def classified(items: DataFrame, pairs: DataFrame, min_split: float = 0.005, max_lump: float = 0.02, percentile: int = 100) -> DataFrame:
    """items (scope_id = query, idx; the smallest idx is the query), pairs
    (scope_id, i, j, d) -> scope_id, idx, is_query, member, identity (to the
    query), is_medoid, nearest (best identity to a non-member, of members).
    A query without other items is its own only member."""
    check_thresholds(min_split, max_lump)
    first = F.min("idx").over(W.partitionBy("scope_id"))
    seeded = items.withColumn("is_seed", F.col("idx") == first)
    grown = cluster.target_clusters(seeded, pairs, min_split, max_lump, percentile).join(seeded.select("scope_id", "idx", F.col("is_seed").alias("is_query")), ["scope_id", "idx"])

    both = pairs.select("scope_id", "i", "j", "d").unionByName(pairs.select("scope_id", F.col("j").alias("i"), F.col("i").alias("j"), "d"))
    query = grown.where("is_query").select("scope_id", F.col("idx").alias("j"))
    to_query = both.join(query, ["scope_id", "j"]).select("scope_id", F.col("i").alias("idx"), metrics.identity(F.col("d")).alias("identity"))
    side = grown.select("scope_id", F.col("idx").alias("j"), F.col("member").alias("mj"))
    mine = both.where(known()).join(grown.where("member").select("scope_id", F.col("idx").alias("i")), ["scope_id", "i"]).join(side, ["scope_id", "j"])
    sums = mine.groupBy("scope_id", F.col("i").alias("idx")).agg(F.coalesce(F.sum(F.when(F.col("mj"), F.col("d"))), F.lit(0.0)).alias("total"), F.min(F.when(~F.col("mj"), F.col("d"))).alias("out"))
    return _classes(grown.join(to_query, ["scope_id", "idx"], "left").join(sums, ["scope_id", "idx"], "left"))


def classified_vectors(items: DataFrame, min_split: float = 0.005, max_lump: float = 0.02, percentile: int = 100) -> DataFrame:
    """classified of vectors (scope_id, idx, v): a task has the vectors of a
    scope and makes the distances of the members only."""
    check_thresholds(min_split, max_lump)

    def kernel(idx, d, _) -> pd.DataFrame:
        members, others, _, _ = kernels.grow_target(d, [0], min_split, max_lump, percentile)
        member = np.zeros(len(idx), bool)
        member[members] = True
        total, out = np.zeros(len(idx)), np.full(len(idx), np.nan)
        for k in members:
            row = d.rows([k])[0]
            row[k] = np.nan
            total[k] = np.sort(row[members])[: np.count_nonzero(~np.isnan(row[members]))].sum()  # equal distances, equal sums
            if others:
                out[k] = np.fmin.reduce(row[others])
        return pd.DataFrame({"idx": idx, "is_query": np.arange(len(idx)) == 0, "member": member, "d": d.rows([0])[0], "total": total, "out": out})

    rows = cluster.by_scope(items, kernel, "idx long, is_query boolean, member boolean, d double, total double, out double")
    return _classes(rows.withColumn("identity", metrics.identity(F.col("d"))))


def _classes(out: DataFrame) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("scope_id").orderBy(F.col("member").desc(), F.coalesce("total", F.lit(0.0)), "idx"))
    return out.select("scope_id", "idx", "is_query", "member", F.when(F.col("is_query"), 100.0).otherwise(F.col("identity")).alias("identity"), (F.col("member") & (rank == 1)).alias("is_medoid"), metrics.identity(F.col("out")).alias("nearest"))


def summary(classes: DataFrame) -> DataFrame:
    """A row a query: members, non-members, spread of the members' identities
    to the query, best non-member, gap. Without members the spread is 100."""
    v, m = F.col("identity"), F.col("member") & ~F.col("is_query")
    out = ~F.col("member")
    row = classes.groupBy("scope_id").agg(
        F.sum(F.col("member").cast("long")).alias("members"), F.sum(out.cast("long")).alias("non_members"), F.min(F.when(m, v)).alias("lo"), F.percentile(F.when(m, v), 0.05).alias("intra_p5"), F.percentile(F.when(m, v), 0.5).alias("intra_median"),
        F.percentile(F.when(m, v), 0.95).alias("intra_p95"), F.max(F.when(m, v)).alias("intra_max"), F.max("nearest").alias("nearest_non_member"),
    )
    row = row.withColumn("intra_min", F.coalesce("lo", F.lit(100.0))).drop("lo")
    gap = F.col("intra_min") - F.col("nearest_non_member")
    return row.withColumn("gap_size", gap).withColumn("gap_exists", F.coalesce(gap > 0, F.lit(False)))


def identities(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """scope_id, side, identity of the pairs within the query's cluster (intra)
    and of its members with non-members (inter); unknown distances are left out."""
    side = classes.select("scope_id", "idx", "member")
    both = pairs.where(known()).join(side.select("scope_id", F.col("idx").alias("i"), F.col("member").alias("mi")), ["scope_id", "i"]).join(side.select("scope_id", F.col("idx").alias("j"), F.col("member").alias("mj")), ["scope_id", "j"])
    return both.where("mi or mj").select("scope_id", F.when(F.col("mi") & F.col("mj"), "intra").otherwise("inter").alias("side"), metrics.identity(F.col("d")).alias("identity"))


def warnings(classes: DataFrame) -> DataFrame:
    """scope_id, warning: what makes a query's result weak."""
    row = classes.groupBy("scope_id").agg(F.count("*").alias("n"), F.sum(F.col("member").cast("int")).alias("members"), F.sum((~F.col("is_query") & F.col("identity").isNull()).cast("int")).alias("gone"))
    texts = F.array_compact(F.array(
        F.when(F.col("n") < 2, F.lit("insufficient data: no other sequence")), F.when((F.col("n") > 1) & (F.col("members") == 1), F.lit("the query is alone in its cluster")),
        F.when((F.col("n") > 1) & (F.col("members") == F.col("n")), F.lit("no sequence is outside the query's cluster")), F.when(F.col("gone") > 0, F.format_string("%d sequences have no distance to the query", "gone")),
    ))
    return row.select("scope_id", F.explode(texts).alias("warning"))


__all__ = ["check_thresholds", "classified", "directed", "identities", "summary", "warnings"]
