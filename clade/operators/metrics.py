"""Metrics over the two relations that everything reduces to: labelled pairs
(i, j, d, ci, cj) and assignments (idx, cluster_id)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .allpairs import Pairs
from .distance import known

def same() -> Column:
    return F.col("ci") == F.col("cj")


def nearest_rank(d: Column, p: Column | float) -> Column:
    """Value at rank int(n * p / 100) of a sorted list; 0 of nothing."""
    p = p if isinstance(p, Column) else F.lit(p)
    xs = F.sort_array(F.collect_list(d))
    at = F.least(F.floor(F.size(xs) * p / 100).cast("int"), F.size(xs) - 1)
    return F.when(F.size(xs) == 0, 0.0).otherwise(F.get(xs, at))


def percentile_vector(pairs: DataFrame | Pairs, ps=(5, 10, 25, 50, 75, 90, 95, 99, 100)) -> DataFrame:
    """side (intra, inter), percentile, value: one row a side and percentile;
    NaN for a side without distances."""
    if isinstance(pairs, Pairs):
        both = pairs.sides(ps, ps)
        both = both.select(F.array(*[f"u{k}" for k in range(len(ps))]).alias("intra"), F.array(*[f"l{k}" for k in range(len(ps))]).alias("inter"))
        return both.select(F.inline(_side_rows(ps)))
    every = F.array(*[F.lit(p / 100) for p in ps])
    both = pairs.where(known()).agg(F.percentile(F.when(same(), F.col("d")), every).alias("intra"), F.percentile(F.when(~same(), F.col("d")), every).alias("inter"))
    return both.select(F.inline(_side_rows(ps)))


def _side_rows(ps) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("side"), F.lit(p).alias("percentile"), F.coalesce(F.get(n, F.lit(k)), F.lit(float("nan"))).alias("value")) for n in ("intra", "inter") for k, p in enumerate(ps)])


def gap_metrics(pairs: DataFrame | Pairs, ps=(90, 95)) -> DataFrame:
    """percentile, intra_upper, inter_lower, gap_size, gap_exists. A side
    without distances gives null bounds and no gap."""
    if isinstance(pairs, Pairs):
        row = pairs.sides(ps, [100 - p for p in ps]).toDF(*[f"u{p}" for p in ps], *[f"l{p}" for p in ps])
        return _gap_rows(row, ps)
    k = pairs.where(known())
    cols = []
    for p in ps:
        cols += [F.percentile(F.when(same(), F.col("d")), p / 100).alias(f"u{p}"), F.percentile(F.when(~same(), F.col("d")), (100 - p) / 100).alias(f"l{p}")]
    return _gap_rows(k.agg(*cols), ps)


def _gap_rows(row: DataFrame, ps) -> DataFrame:
    each = F.array(*[F.struct(F.lit(p).alias("percentile"), F.col(f"u{p}").alias("intra_upper"), F.col(f"l{p}").alias("inter_lower")) for p in ps])
    out = row.select(F.inline(each))
    gap = F.col("inter_lower") - F.col("intra_upper")
    return out.withColumn("gap_size", gap).withColumn("gap_exists", F.coalesce(gap > 0, F.lit(False)))


def cluster_summary(pairs: DataFrame | Pairs, assign: DataFrame) -> DataFrame:
    """Per cluster: n_sequences, n_distances, P5 P25 P50 P75 P95, mean, std (population)."""
    ps = (5, 25, 50, 75, 95)
    if isinstance(pairs, Pairs):
        inside = pairs.inside([(f"p{p}", p, None, "linear") for p in ps]).withColumnsRenamed({"c": "cluster_id", "n": "n_distances"})
    else:
        inside = pairs.where(known() & same()).groupBy(F.col("ci").alias("cluster_id")).agg(F.count("*").alias("n_distances"), *[F.percentile("d", p / 100).alias(f"p{p}") for p in ps], F.avg("d").alias("mean"), F.stddev_pop("d").alias("std"))
    sizes = assign.groupBy("cluster_id").agg(F.count("*").alias("n_sequences"))
    return sizes.join(inside, "cluster_id", "left").withColumn("n_distances", F.coalesce("n_distances", F.lit(0)))


def cluster_pairs(pairs: DataFrame) -> DataFrame:
    """Distances between clusters under c1 < c2, those within one under c1 = c2."""
    return pairs.where(known()).withColumns({"c1": F.least("ci", "cj"), "c2": F.greatest("ci", "cj")})


def linkage(pairs: DataFrame | Pairs, p: float) -> DataFrame:
    """Interpolated percentile of the distances between each two clusters."""
    if isinstance(pairs, Pairs):
        return pairs.groups([("linkage", p, F.col("t1") < F.col("t2"), "linear")]).select("c1", "c2", "linkage", "n")
    return cluster_pairs(pairs).where("c1 < c2").groupBy("c1", "c2").agg(F.percentile("d", p / 100).alias("linkage"), F.count("*").alias("n"))


def merged_spread(pairs: DataFrame | Pairs, p: float) -> DataFrame:
    """Nearest-rank percentile of all distances within the union of each two clusters."""
    if isinstance(pairs, Pairs):
        return pairs.unions([("spread", p, None, "nearest")]).select("c1", "c2", "spread", "n")
    by = cluster_pairs(pairs)
    across = by.where("c1 < c2").select("c1", "c2", "d")
    both = across.select("c1", "c2").distinct()
    own = by.where("c1 = c2").select(F.col("c1").alias("c"), "d")
    first = both.join(own.withColumnRenamed("c", "c1"), "c1").select("c1", "c2", "d")
    inner = first.unionByName(both.join(own.withColumnRenamed("c", "c2"), "c2").select("c1", "c2", "d"))
    return across.unionByName(inner).groupBy("c1", "c2").agg(nearest_rank(F.col("d"), p).alias("spread"), F.count("*").alias("n"))


def gap_after_merge(pairs: DataFrame | Pairs, p: int) -> DataFrame:
    """Global gap if each two clusters were one, for all pairs of clusters in
    one pass: their distances change sides, the rest stay."""
    if isinstance(pairs, Pairs):
        out = pairs.moved(p, 100 - p)
        return out.select("c1", "c2", F.coalesce(F.col("inter_lower") - F.col("intra_upper"), F.lit(0.0)).alias("gap_size"))
    k = cluster_pairs(pairs)
    two = k.where("c1 < c2").select(F.col("c1").alias("m1"), F.col("c2").alias("m2")).distinct()
    # per pair of clusters the distances are few; the relabelled relation is clusters^2 times the pairs
    hyp = k.select("c1", "c2", "d").crossJoin(two)
    inner = (F.col("c1") == F.col("c2")) | ((F.col("c1") == F.col("m1")) & (F.col("c2") == F.col("m2")))
    out = hyp.groupBy("m1", "m2").agg(F.percentile(F.when(inner, F.col("d")), p / 100).alias("intra_upper"), F.percentile(F.when(~inner, F.col("d")), (100 - p) / 100).alias("inter_lower"))
    return out.select(F.col("m1").alias("c1"), F.col("m2").alias("c2"), F.coalesce(F.col("inter_lower") - F.col("intra_upper"), F.lit(0.0)).alias("gap_size"))


LOCAL = (90, 95, 100)


def local_gaps(pairs: DataFrame | Pairs, assign: DataFrame, max_lump: float) -> DataFrame:
    """Per cluster: sum over the percentiles of the nearest other cluster's
    lower distance less the own upper one; a single item spreads 0, no other
    cluster counts max_lump."""
    if isinstance(pairs, Pairs):
        inside, across = F.col("t1") == F.col("t2"), F.col("t1") < F.col("t2")
        g = pairs.groups([(f"l{p}", 100 - p, across, "linear") for p in LOCAL] + [(f"u{p}", p, inside, "linear") for p in LOCAL])
        # within: one row of its upper ones; between two: a row for each with the lower ones
        each = g.withColumn("cluster_id", F.explode(F.array_distinct(F.array("c1", "c2")))).groupBy("cluster_id").agg(*[F.min(f"l{p}").alias(f"n{p}") for p in LOCAL], *[F.max(f"u{p}").alias(f"u{p}") for p in LOCAL])
        near, own = each, None
    else:
        by = cluster_pairs(pairs)
        low = by.where("c1 < c2").groupBy("c1", "c2").agg(*[F.percentile("d", (100 - p) / 100).alias(f"l{p}") for p in LOCAL])
        both = low.unionByName(low.select(F.col("c2").alias("c1"), F.col("c1").alias("c2"), *[f"l{p}" for p in LOCAL]))
        near = both.groupBy(F.col("c1").alias("cluster_id")).agg(*[F.min(f"l{p}").alias(f"n{p}") for p in LOCAL])
        own = by.where("c1 = c2").groupBy(F.col("c1").alias("cluster_id")).agg(*[F.percentile("d", p / 100).alias(f"u{p}") for p in LOCAL])
    all_ = assign.select("cluster_id").distinct().join(near, "cluster_id", "left")
    all_ = all_ if own is None else all_.join(own, "cluster_id", "left")
    gap = sum((F.coalesce(F.col(f"n{p}") - F.coalesce(f"u{p}", F.lit(0.0)), F.lit(max_lump)) for p in LOCAL), F.lit(0.0))
    return all_.select("cluster_id", gap.alias("local_gap"))


def local_score(gaps: DataFrame, alpha: float = 0.0) -> DataFrame:
    n = F.count("*")
    return gaps.agg(n.alias("num_clusters"), F.when(n <= 1, 0.0).otherwise(F.sum("local_gap") / F.pow(n, F.lit(alpha))).alias("score"))


def medoids(pairs: DataFrame, assign: DataFrame, skip_missing: bool = False) -> DataFrame:
    """Per cluster the member with the smallest sum of distances to the others,
    the first on ties. A missing distance rules a candidate out, or counts as 0
    (skip_missing). Where all are ruled out, the first member it is, without a
    total; a cluster of one is its own."""
    inside = pairs.where(same())
    d = F.when(known(), F.col("d"))
    sides = inside.select(F.col("ci").alias("cluster_id"), F.col("i").alias("idx"), d.alias("d")).unionByName(inside.select(F.col("ci").alias("cluster_id"), F.col("j").alias("idx"), d.alias("d")))
    total = sides.groupBy("cluster_id", "idx").agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("total"), F.sum(F.col("d").isNull().cast("int")).alias("gone"))
    if not skip_missing:
        total = total.where("gone = 0")
    members = assign.groupBy("cluster_id").agg(F.min("idx").alias("first"), F.count("*").alias("size"))
    best = total.groupBy("cluster_id").agg(F.min(F.struct("total", "idx")).alias("b"))
    return members.join(best, "cluster_id", "left").select("cluster_id", F.coalesce("b.idx", "first").alias("medoid"), F.coalesce("b.total", F.when(F.col("size") == 1, 0.0)).alias("total"), "size")


def nearest_outside(pairs: DataFrame | Pairs) -> DataFrame:
    """Per item the smallest distance to an item of another cluster."""
    if isinstance(pairs, Pairs):
        return pairs.outside().groupBy("idx").agg(F.min("d").alias("nearest"))
    out = pairs.where(known() & ~same())
    return out.select(F.col("i").alias("idx"), "d").unionByName(out.select(F.col("j").alias("idx"), "d")).groupBy("idx").agg(F.min("d").alias("nearest"))


def identity(d: Column) -> Column:
    return F.when(d.isNotNull() & ~F.isnan(d), (1 - d) * 100)


def query_gap(to_query: DataFrame) -> DataFrame:
    """(member boolean, identity) of hits against a query: spread of the
    members' identities, the best non-member, and the gap between."""
    v, m = F.col("identity"), F.col("member")
    inside = F.when(m, v)
    row = to_query.where(v.isNotNull()).agg(
        F.min(inside).alias("intra_min"), F.percentile(inside, 0.05).alias("intra_p5"), F.percentile(inside, 0.5).alias("intra_median"), F.percentile(inside, 0.95).alias("intra_p95"), F.max(inside).alias("intra_max"), F.max(F.when(~m, v)).alias("nearest_non_member")
    )
    gap = F.coalesce("intra_min", F.lit(100.0)) - F.col("nearest_non_member")
    return row.withColumn("gap_size", gap).withColumn("gap_exists", F.coalesce(gap > 0, F.lit(False)))


def histogram(values: DataFrame, col: str, width: float = 0.5) -> DataFrame:
    """Left-closed bins of a fixed width from multiples of it; empty bins are left out."""
    n = F.count("*")
    out = values.where(known(col)).groupBy((F.floor(F.col(col) / width) * width).alias("bin_start")).agg(n.alias("count"))
    return out.withColumn("frequency", F.col("count") / F.sum("count").over(W.partitionBy()))


def equal_bins(values: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Equal bins from least to most, the last one closed; all bins are there."""
    k = values.where(known(col)).select(F.col(col).alias("v"))
    edges = k.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(bins // 2)
    counts = k.crossJoin(F.broadcast(edges)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("count"))
    return edges.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", "hi").join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("bin_start"), F.coalesce("count", F.lit(0)).alias("count"))


def neighbourhood_metrics(pairs: DataFrame | Pairs, assign: DataFrame, p: int, max_lump: float, k: int = 3) -> DataFrame:
    """Per cluster: gap against its k nearest clusters (by smallest distance),
    whose distances are pooled. Columns gap, intra_upper, inter_lower,
    cluster_size, num_neighbors."""
    if isinstance(pairs, Pairs):
        pooled, own = pairs.nearest(p, 100 - p, k).withColumnRenamed("c", "cluster_id"), None
    else:
        by = cluster_pairs(pairs).select("c1", "c2", "d")
        out = by.where("c1 < c2")
        out = out.unionByName(out.select(F.col("c2").alias("c1"), F.col("c1").alias("c2"), "d"))
        near = out.groupBy("c1", "c2").agg(F.min("d").alias("m")).withColumn("r", F.row_number().over(W.partitionBy("c1").orderBy("m", "c2"))).where(F.col("r") <= k)
        pooled = out.join(near, ["c1", "c2"]).groupBy(F.col("c1").alias("cluster_id")).agg(F.percentile("d", (100 - p) / 100).alias("inter_lower"), F.countDistinct("c2").alias("num_neighbors"))
        own = by.where("c1 = c2").groupBy(F.col("c1").alias("cluster_id")).agg(F.percentile("d", p / 100).alias("intra_upper"))
    sizes = assign.groupBy("cluster_id").agg(F.count("*").alias("cluster_size"))
    all_ = sizes.join(pooled, "cluster_id", "left")
    all_ = all_ if own is None else all_.join(own, "cluster_id", "left")
    upper = F.coalesce("intra_upper", F.lit(0.0))
    return all_.select("cluster_id", F.coalesce(F.col("inter_lower") - upper, F.lit(max_lump)).alias("gap"), upper.alias("intra_upper"), F.coalesce("inter_lower", F.lit(max_lump)).alias("inter_lower"), "cluster_size", F.coalesce("num_neighbors", F.lit(0)).alias("num_neighbors"))


def aggregate_metrics(per_cluster: DataFrame) -> DataFrame:
    """Mean gap, size-weighted mean, shares of clusters and of items with a
    positive gap, number of clusters; zeros for nothing."""
    n, pos = F.col("cluster_size"), F.col("gap") > 0
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return per_cluster.agg(
        z(F.avg("gap")).alias("mean_gap"), z(F.sum(F.col("gap") * n) / F.sum(n)).alias("weighted_gap"), z(F.avg(pos.cast("double"))).alias("gap_coverage"), z(F.sum(F.when(pos, n)) / F.sum(n)).alias("gap_coverage_sequences"), F.count("*").alias("num_clusters")
    )


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 9, less the log of the eight factors too many."""
    z = n.cast("double") + 9
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7) + 1 / (1188 * z**9) - 691 / (360360 * z**11)
    over = F.lit(1.0)
    for k in range(1, 9):
        over = over * (n + k)
    return series - F.log(over)


def adjusted_mutual_information(labels: DataFrame) -> DataFrame:
    """ami of two labellings (a, b) of the same rows: mutual information less
    its expectation under random labels, over the mean entropy less it. Under
    two rows, or where both agree on one class, it is 1. The expectation is
    summed per pair of sizes of classes over possible overlaps."""
    rows = labels.where("a is not null and b is not null")
    cont = rows.groupBy("a", "b").agg(F.count("*").alias("n"))
    ra, rb = cont.groupBy("a").agg(F.sum("n").alias("x")), cont.groupBy("b").agg(F.sum("n").alias("y"))
    total = cont.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    with_n = cont.join(ra, "a").join(rb, "b").crossJoin(F.broadcast(total))
    mi = with_n.agg(F.sum(F.col("n") / F.col("total") * F.log(F.col("total") * F.col("n") / (F.col("x") * F.col("y")))).alias("mi"))
    ent = lambda t, c: t.crossJoin(F.broadcast(total)).agg(F.sum(-(F.col(c) / F.col("total")) * F.log(F.col(c) / F.col("total"))))
    ha, hb = ent(ra, "x").toDF("ha"), ent(rb, "y").toDF("hb")
    sizes = ra.groupBy("x").agg(F.count("*").alias("mx")).crossJoin(F.broadcast(rb.groupBy("y").agg(F.count("*").alias("my")))).crossJoin(F.broadcast(total))
    lo, hi = F.greatest(F.lit(1), F.col("x") + F.col("y") - F.col("total")), F.least("x", "y")
    over = sizes.where(lo <= hi).withColumn("k", F.explode(F.sequence(lo, hi)))
    x, y, k, n = (F.col(c) for c in ("x", "y", "k", "total"))
    logp = sum((log_factorial(c) for c in (x, y, n - x, n - y)), F.lit(0.0)) - sum((log_factorial(c) for c in (n, k, x - k, y - k, n - x - y + k)), F.lit(0.0))
    term = F.col("mx") * F.col("my") * F.col("k") / F.col("total") * F.log(F.col("total") * F.col("k") / (F.col("x") * F.col("y"))) * F.exp(logp)
    emi = over.agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("emi"))
    all_ = total.crossJoin(mi).crossJoin(ha).crossJoin(hb).crossJoin(emi)
    below = (F.col("ha") + F.col("hb")) / 2 - F.col("emi")
    ami = (F.col("mi") - F.col("emi")) / F.when(F.abs(below) < 1e-15, 1e-15).otherwise(below)
    return all_.select(F.when((F.col("total") < 2) | ((F.col("ha") == 0) & (F.col("hb") == 0)), 1.0).otherwise(ami).alias("ami"))


def size_distribution(sizes: DataFrame, col: str = "size") -> DataFrame:
    """Buckets 1-10, 11-50, 51-100, >100 with counts and per cent."""
    s = F.col(col)
    bounds = [("1-10", 1, 10), ("11-50", 11, 50), ("51-100", 51, 100), (">100", 101, 2**31 - 1)]
    row = sizes.agg(*[F.sum(s.between(lo, hi).cast("long")).alias(f"b{k}") for k, (_, lo, hi) in enumerate(bounds)], F.count("*").alias("n"))
    each = F.array(*[F.struct(F.lit(name).alias("bucket"), F.coalesce(f"b{k}", F.lit(0)).alias("count"), F.when(F.col("n") > 0, 100.0 * F.col(f"b{k}") / F.col("n")).otherwise(0.0).alias("pct")) for k, (name, _, _) in enumerate(bounds)])
    return row.select(F.inline(each))


def size_summary(sizes: DataFrame, col: str = "size") -> DataFrame:
    """Largest, smallest, upper median (value at n // 2 in order), mean. The
    median comes from how often each size occurs, so what is put in order is
    the distinct sizes."""
    each = sizes.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("v")).agg(F.count("*").alias("n"))
    row = each.agg(F.max("v").alias("largest"), F.min("v").alias("smallest"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"), F.sum("n").alias("total"))
    upto = each.withColumn("upto", F.sum("n").over(W.orderBy("v").rowsBetween(W.unboundedPreceding, 0)))
    median = upto.crossJoin(row.select("total")).where(F.col("upto") > F.floor(F.col("total") / 2)).agg(F.min("v").alias("median"))
    return row.crossJoin(median).select("largest", "smallest", "median", "mean")


def conflicts(assign: DataFrame) -> DataFrame:
    """Sequences in more than one cluster, with the clusters in order."""
    return assign.groupBy("seq_id").agg(F.sort_array(F.collect_set("cluster_id")).alias("cluster_ids")).where(F.size("cluster_ids") > 1)


def verification(now: DataFrame, before: DataFrame) -> DataFrame:
    """Counts of an assignment, and its conflicts against those of before
    (both: seq_id, cluster_id): new, unresolved, resolved."""
    c1, c0 = conflicts(now).select("seq_id"), conflicts(before).select("seq_id")
    counts = now.agg(F.countDistinct("seq_id").alias("unique_sequences"), F.count("*").alias("assignments"))
    one = lambda df, name: df.agg(F.count("*").alias(name))
    out = counts.crossJoin(one(c1, "conflicts")).crossJoin(one(c1.join(c0, "seq_id", "left_anti"), "new_conflicts"))
    return out.crossJoin(one(c1.join(c0, "seq_id", "left_semi"), "unresolved_conflicts")).crossJoin(one(c0.join(c1, "seq_id", "left_anti"), "resolved_conflicts"))


def mapping(before: DataFrame, after: DataFrame) -> DataFrame:
    """What became of each cluster (both: seq_id, cluster_id): a row for each
    part, largest first, with its share of the old cluster, and the kind:
    removed, renamed (one part of 99 % and more), partial (one part), split."""
    b = before.select("seq_id", F.col("cluster_id").alias("old_id")).distinct()
    a = after.select("seq_id", F.col("cluster_id").alias("new_id")).distinct()
    size = b.groupBy("old_id").agg(F.count("*").alias("old_size"))
    over = b.join(a, "seq_id").groupBy("old_id", "new_id").agg(F.count("*").alias("overlap"))
    out = size.join(over, "old_id", "left").withColumn("parts", F.count("new_id").over(W.partitionBy("old_id")))
    share = 100.0 * F.col("overlap") / F.col("old_size")
    kind = F.when(F.col("parts") == 0, "removed").when(F.col("parts") > 1, "split").when(share >= 99, "renamed").otherwise("partial")
    return out.select("old_id", "new_id", "old_size", "overlap", share.alias("pct"), kind.alias("kind"), F.row_number().over(W.partitionBy("old_id").orderBy(F.desc("overlap"), "new_id")).alias("rank"))


def renumbered(sizes: DataFrame) -> DataFrame:
    """(cluster_id, size) -> new ids cluster_00001, ... by size, ties by id."""
    n = F.row_number().over(W.orderBy(F.desc("size"), "cluster_id"))
    return sizes.select("cluster_id", "size", F.format_string("cluster_%05d", n).alias("new_id"))


def cluster_marks(assign: DataFrame) -> DataFrame:
    """cluster_id, p, q, n: a cluster is known by two sums of its members' 64-bit
    hashes and by its size. Order and repeated rows don't matter."""
    member = lambda salt: F.sum(F.xxhash64(F.lit(salt), F.col("seq_id").cast("string")).cast("decimal(38,0)"))
    return assign.select("cluster_id", "seq_id").distinct().groupBy("cluster_id").agg(member(1).alias("p"), member(2).alias("q"), F.count("*").alias("n"))


def marks_signature() -> Column:
    """The digest of a set of cluster_marks (an aggregate)."""
    total = lambda salt: F.sum(F.xxhash64(F.lit(salt), "p", "q", "n").cast("decimal(38,0)")).cast("string")
    return F.sha2(F.concat_ws("|", F.coalesce(total(1), F.lit("")), F.coalesce(total(2), F.lit("")), F.count("*").cast("string")), 256)


def signature(assign: DataFrame) -> DataFrame:
    """A digest of a partition (seq_id, cluster_id) that names of clusters,
    order and repeated rows don't change. No cluster's members, and no list of
    clusters, come together in one row."""
    return cluster_marks(assign).agg(marks_signature().alias("signature"), F.count("*").alias("clusters"))


def priority(assign: DataFrame, counts: DataFrame) -> DataFrame:
    """Order of seeds: clusters by the least number of times a member was
    reclustered, then largest first, then by id."""
    c = assign.join(counts, "seq_id", "left").groupBy("cluster_id").agg(F.min(F.coalesce("times", F.lit(0))).alias("least_times"), F.count("*").alias("size"))
    return c.withColumn("rank", F.row_number().over(W.orderBy("least_times", F.desc("size"), "cluster_id")))
