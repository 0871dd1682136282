"""Proximity graph of clusters, and the scopes that refinement works on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fan_out(edges: DataFrame, medoids: DataFrame, most: int | None = None) -> DataFrame:
    """Edges between distinct medoid sequences (src_seq, dst_seq, distance) to
    edges between all clusters that have them (medoids: cluster_id, seq);
    clusters with one medoid sequence are at distance 0. most: of the clusters
    with one medoid sequence lead only to the first ones by id, which is all
    that a reader takes who wants less than `most` neighbours of a cluster by
    distance, then id; the edges then grow with the clusters, not their pairs."""
    a, b = medoids.select(F.col("cluster_id").alias("src"), F.col("seq").alias("src_seq")), medoids.select(F.col("cluster_id").alias("dst"), F.col("seq").alias("dst_seq"))
    if most is not None:
        b = b.withColumn("r", F.row_number().over(W.partitionBy("dst_seq").orderBy("dst"))).where(F.col("r") <= most).drop("r")
    apart = edges.where("src_seq <> dst_seq").join(a, "src_seq").join(b, "dst_seq").select("src", "dst", "distance")
    equal = a.join(b, F.col("src_seq") == F.col("dst_seq")).where("src <> dst").select("src", "dst", F.lit(0.0).alias("distance"))
    return apart.unionByName(equal)


def joined_through(edges: DataFrame, medoids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same graph without a row for each pair of clusters: each distinct
    medoid sequence is stood for by its smallest cluster_id. Returns (members:
    cluster_id, representative, at distance 0; edges between representatives:
    src, dst, distance)."""
    first = medoids.groupBy("seq").agg(F.min("cluster_id").alias("representative"))
    members = medoids.join(first, "seq").select("cluster_id", "representative")
    a, b = first.select(F.col("representative").alias("src"), F.col("seq").alias("src_seq")), first.select(F.col("representative").alias("dst"), F.col("seq").alias("dst_seq"))
    return members, edges.where("src_seq <> dst_seq").join(a, "src_seq").join(b, "dst_seq").select("src", "dst", "distance")


def knn(edges: DataFrame, k: int, close: float | None = None) -> DataFrame:
    """The nearest neighbours of each src, ranked: k of them, or all within
    `close` where those are at least k."""
    by = W.partitionBy("src")
    ranked = edges.withColumn("rnk", F.row_number().over(by.orderBy("distance", "dst")))
    if close is None:
        return ranked.where(F.col("rnk") <= k)
    near = F.sum((F.col("distance") <= close).cast("int")).over(by)
    return ranked.withColumn("near", near).where(F.when(F.col("near") >= k, F.col("distance") <= close).otherwise(F.col("rnk") <= k)).drop("near")


def within(edges: DataFrame, most: float) -> DataFrame:
    return edges.where(F.col("distance") <= most)


def close_pairs(edges: DataFrame, most: float) -> DataFrame:
    """Unordered pairs within `most`, each once, with the smaller distance of its directions."""
    return within(edges, most).groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min("distance").alias("distance"))


def scopes(edges: DataFrame, sizes: DataFrame, core: float, context: float, most: int) -> DataFrame:
    """Of each src, the clusters that its refinement takes in: neighbours
    within `core` closest first while the sum of sizes stays within `most`,
    then those within `context` under what is left. The seed is always in.
    sizes: cluster_id, size. Returns src, cluster_id, zone."""
    seed = sizes.select(F.col("cluster_id").alias("src"), F.col("size").alias("seed_size"))
    near = edges.where(F.col("distance") <= context).join(sizes.select(F.col("cluster_id").alias("dst"), "size"), "dst").join(seed, "src")
    running = W.partitionBy("src").orderBy("distance", "dst").rowsBetween(W.unboundedPreceding, 0)
    inner = near.where(F.col("distance") <= core).withColumn("sum", F.col("seed_size") + F.sum("size").over(running)).where(F.col("sum") <= most)
    used = inner.groupBy("src").agg(F.max("sum").alias("used"))
    outer = near.where(F.col("distance") > core).join(used, "src", "left").withColumn("sum", F.coalesce("used", "seed_size") + F.sum("size").over(running)).where(F.col("sum") <= most)
    out = inner.select("src", F.col("dst").alias("cluster_id"), F.lit("core").alias("zone")).unionByName(outer.select("src", F.col("dst").alias("cluster_id"), F.lit("context").alias("zone")))
    return out.unionByName(sizes.select(F.col("cluster_id").alias("src"), "cluster_id", F.lit("seed").alias("zone")))
