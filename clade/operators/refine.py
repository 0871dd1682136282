"""Iterative refinement of given clusters over their neighbourhood graph.

Each iteration: medoids, nearest clusters, disjoint scopes by priority, one
grouped map that realigns and reclusters all chosen scopes at once, and a
written state that cuts the lineage. The driver sees counts only. It ends when
the partition no longer changes."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clade.functions import kernels
from clade.functions import sequences as seqs
from clade.sources import readers, writers

from . import graph, metrics

#: Columns of the state: a row a member, with how often it was reclustered and
#: its cluster's gap.
STATE = ("cluster_id", "seq_id", "times", "gap")


@dataclass
class Config:
    min_split: float = 0.005
    max_lump: float = 0.02
    percentile: int = 95
    method: str = "global"
    alpha: float = 0.0
    close_threshold: float = 0.04
    max_scope_size: int = 300
    neighbours: int = 20
    max_iterations: int = 10
    kmer: int = 8
    min_identity: float = 0.5


@dataclass
class Result:
    assign: DataFrame
    iterations: int
    converged: bool
    history: list = field(default_factory=list)


def _folder(spark) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (root.rstrip("/") if root else "file://" + tempfile.mkdtemp(prefix="clade-")) + f"/refine-{uuid.uuid4().hex}"


def _medoid_rows(sequences: DataFrame, assign: DataFrame) -> DataFrame:
    """cluster_id, medoid (seq_id), seq, size: from each cluster's own alignment."""

    def kernel(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq_id")
        total = kernels.sequence_distances(pdf.seq.tolist()).sum(axis=1) if len(pdf) > 2 else [0.0] * len(pdf)
        at = min(range(len(pdf)), key=lambda k: (total[k] if total[k] == total[k] else float("inf"), k))
        return pd.DataFrame({"cluster_id": [key[0]], "medoid": [pdf.seq_id.iloc[at]], "seq": [pdf.seq.iloc[at]], "size": [len(pdf)]})

    return assign.join(sequences, "seq_id").select("cluster_id", "seq_id", "seq").groupBy("cluster_id").applyInPandas(kernel, "cluster_id string, medoid string, seq string, size long")


def cluster_edges(medoids: DataFrame, conf: Config) -> DataFrame:
    """Directed edges between clusters: shared k-mers propose pairs of distinct
    medoid sequences, alignment measures them, equal ones are at 0."""
    distinct = medoids.select("seq").distinct()
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("seq") - conf.kmer + 1, F.lit(1))), lambda p: F.substr("seq", p, F.lit(conf.kmer))))
    each = distinct.select("seq", F.size(grams).alias("n"), F.explode(grams).alias("g"))
    other = each.select(F.col("seq").alias("seq2"), F.col("n").alias("n2"), "g")
    near = each.join(other, "g").where("seq < seq2").groupBy("seq", "seq2", "n", "n2").agg(F.count("*").alias("shared")).where(F.col("shared") >= conf.min_identity * F.least("n", "n2"))

    def measure(batches):
        for pdf in batches:
            pdf["distance"] = [float(kernels.sequence_distances([a, b])[0, 1]) for a, b in zip(pdf.seq, pdf.seq2, strict=True)]
            yield pdf[["seq", "seq2", "distance"]]

    measured = near.select("seq", "seq2").mapInPandas(measure, "seq string, seq2 string, distance double").where("not isnan(distance)")
    both = measured.select(F.col("seq").alias("src_seq"), F.col("seq2").alias("dst_seq"), "distance").unionByName(measured.select(F.col("seq2").alias("src_seq"), F.col("seq").alias("dst_seq"), "distance"))
    return graph.fan_out(both, medoids, max(conf.max_scope_size, conf.neighbours) + 1)


def _write(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _remove(spark, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def chosen_scopes(scopes: DataFrame, order: DataFrame, root: str) -> DataFrame:
    """Of scopes (src, cluster_id) those that a walk over the seeds in order
    takes when it passes over each one that meets a scope taken before.
    order: cluster_id, key (a struct that sorts as the walk goes).

    No walk is made: in each round a seed wins if it comes first among the
    undecided seeds of every cluster in its scope, and those that meet a winner
    are out. The first seed of all always wins, so the rounds end."""
    left = scopes.select("src", "cluster_id").distinct().join(order.select(F.col("cluster_id").alias("src"), "key"), "src")
    taken, n = None, 0
    while True:
        first = left.groupBy("cluster_id").agg(F.min("key").alias("first"))
        won = left.join(first, "cluster_id").groupBy("src").agg(F.min((F.col("key") == F.col("first")).cast("int")).alias("won"))
        marked = left.join(won, "src")
        met = marked.where("won = 1").select("cluster_id").distinct()
        out = left.join(met, "cluster_id").select("src").distinct().withColumn("out", F.lit(1))
        n += 1
        rows = _write(marked.join(out, "src", "left").where("won = 1 or out is null"), f"{root}/round{n:03d}")
        now = rows.where("won = 1").select("src", "cluster_id", "key")
        taken = now if taken is None else taken.unionByName(now)
        left = rows.where("won = 0").select("src", "cluster_id", "key")
        if not left.take(1):
            return taken


def numbered_scopes(counts: DataFrame, start: int) -> DataFrame:
    """(scope_id, n) -> scope_id, base: each scope's n numbers follow those of
    the scopes before it, from `start`. Sums are run within 1,024 buckets of
    scopes and over the buckets' totals, so no task sees all scopes."""
    dealt = counts.withColumn("bucket", F.pmod(F.xxhash64("scope_id"), F.lit(1024)))
    totals = dealt.groupBy("bucket").agg(F.sum("n").alias("t"))
    before = totals.select("bucket", (F.sum("t").over(W.orderBy("bucket")) - F.col("t")).alias("before"))
    inside = F.sum("n").over(W.partitionBy("bucket").orderBy("scope_id")) - F.col("n")
    return dealt.withColumn("inside", inside).join(F.broadcast(before), "bucket").select("scope_id", (F.lit(start) + F.col("before") + F.col("inside")).alias("base"))


def refine(sequences: DataFrame, assign: DataFrame, conf: Config | None = None, every: int = 0, checkpoints: str | None = None, resume: str | None = None) -> Result:
    """sequences (seq_id, seq) and assign (cluster_id, seq_id; strings) to a
    refined assignment.

    Seeds go by the least number of times that a member was reclustered, then
    largest first, then by id. A scope whose partition reclustering gives back
    keeps its clusters' ids; the others' new clusters are numbered on from the
    highest number that is there. A partition that reclustering gave is not
    tried again. It ends when an iteration changes nothing (its adjusted mutual
    information is 1) or at conf.max_iterations.

    A sequence in several clusters goes to the first scope that takes one of
    them in, and leaves the others. Members without a sequence (none given, null
    or empty) stay where they are; repeated rows count once; of a seq_id's
    several sequences the smallest is taken; a null cluster_id or seq_id is left out.

    every, checkpoints: write state to checkpoints/iter=NNN after each
    every-th iteration; resume: such a folder to go on from (`assign` is then
    what the mapping and verification start from, and is not read)."""
    conf = conf or Config()
    spark = sequences.sparkSession
    root = _folder(spark)
    texts = sequences.where("seq_id is not null and length(seq) > 0").groupBy("seq_id").agg(F.min(F.upper("seq")).alias("seq"))
    sequences = _write(texts, f"{root}/sequences")
    start = 0
    if resume:
        saved = readers.checkpoint(spark, resume)
        if saved is None:
            raise FileNotFoundError(resume)
        start, given = saved[0]["iteration"], saved[1]
    else:
        given = assign.where("cluster_id is not null and seq_id is not null").select("cluster_id", "seq_id").distinct()
    for name, kind in (("times", "long"), ("gap", "double")):
        if name not in given.columns:
            given = given.withColumn(name, F.lit(0 if name == "times" else None).cast(kind))
    given = _write(given.select(*STATE), f"{root}/given")
    state = _write(given.join(sequences.select("seq_id"), "seq_id", "left_semi").select(*STATE), f"{root}/state{start}")
    absent = given.join(sequences.select("seq_id"), "seq_id", "left_anti").select(*STATE)
    torn = _write(metrics.conflicts(state).select("seq_id"), f"{root}/torn")
    any_torn = bool(torn.take(1))
    number = seqs.next_number(given).first().next_number
    settled: DataFrame | None = None
    history, it, done = [], start, False
    while it < conf.max_iterations and not done:
        it += 1
        at = f"{root}/work{it}"
        medoids = _write(_medoid_rows(sequences, state), f"{at}/medoids")
        edges = _write(graph.knn(cluster_edges(medoids, conf), conf.neighbours, conf.close_threshold), f"{at}/edges")
        zones = graph.scopes(edges, medoids.select("cluster_id", "size"), conf.max_lump, conf.close_threshold, conf.max_scope_size).select("src", "cluster_id").distinct()
        zones = _write(zones, f"{at}/zones")
        if settled is not None:
            known = zones.join(metrics.cluster_marks(state), "cluster_id").groupBy("src").agg(metrics.marks_signature().alias("signature")).join(settled, "signature", "left_semi")
            zones = zones.join(known, "src", "left_anti")
        order = state.groupBy("cluster_id").agg(F.min("times").alias("t"), F.count("*").alias("n")).select("cluster_id", F.struct(F.col("t"), -F.col("n"), "cluster_id").alias("key"))
        taken = chosen_scopes(zones, order, at)
        rows = taken.join(state, "cluster_id").groupBy("seq_id").agg(F.min(F.struct("key", "src")).alias("first"), F.array_sort(F.collect_set("cluster_id")).alias("olds"), F.max("times").alias("times"))
        members = rows.select(F.col("first.src").alias("scope_id"), "seq_id", "olds", "times").join(sequences, "seq_id")
        fresh = _write(members.groupBy("scope_id").applyInPandas(_recluster(conf), "scope_id string, num long, seq_id string, old_id string, times long, gap double"), f"{at}/fresh")
        counts = fresh.where("old_id is null").groupBy("scope_id").agg(F.max("num").alias("n"))
        bases = numbered_scopes(counts, number - 1)
        named = fresh.join(bases, "scope_id", "left").withColumn("cluster_id", F.coalesce("old_id", F.format_string("cluster_%05dR%d", F.col("base") + F.col("num"), F.lit(it))))
        kept = state.join(taken.select("cluster_id").distinct(), "cluster_id", "left_anti")
        if any_torn:
            kept = kept.join(torn.join(fresh.select("seq_id"), "seq_id", "left_semi"), "seq_id", "left_anti")
        before = state
        state = _write(kept.select(*STATE).unionByName(named.select(*STATE)), f"{root}/state{it}")
        outcome = metrics.cluster_marks(fresh.select("scope_id", F.struct("scope_id", "num").alias("cluster_id"), "seq_id"))
        reached = outcome.groupBy(F.col("cluster_id.scope_id").alias("scope_id")).agg(metrics.marks_signature().alias("signature")).select("signature")
        reached = _write(reached, f"{root}/settled/iter={it}")
        settled = reached if settled is None else settled.unionByName(reached)
        stats = fresh.agg(F.countDistinct("scope_id").alias("scopes"), F.countDistinct(F.when(F.col("old_id").isNull(), F.col("scope_id"))).alias("changed"), F.count("*").alias("sequences")).first()
        number += counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
        moved = any_torn and bool(before.join(torn, "seq_id").select("seq_id").exceptAll(state.join(torn, "seq_id").select("seq_id")).take(1))
        done = not stats.changed and not moved
        label = lambda df, name: df.groupBy("seq_id").agg(F.min("cluster_id").alias(name))
        ami = 1.0 if done else metrics.adjusted_mutual_information(label(before, "a").join(label(state, "b"), "seq_id")).first().ami
        per_cluster = state.groupBy("cluster_id").agg(F.min("gap").alias("gap"), F.count("*").alias("cluster_size"))
        sizes = per_cluster.agg(F.count("*").alias("n")).first()
        converge = metrics.aggregate_metrics(per_cluster.where("gap is not null")).first().asDict()
        entry = {"iteration": it, "scopes": stats.scopes, "changed": stats.changed, "sequences": stats.sequences, "clusters": sizes.n, "ami": ami, **{k: v for k, v in converge.items() if k != "num_clusters"}, "clusters_with_metrics": converge["num_clusters"]}
        history.append(entry)
        if every and checkpoints and it % every == 0:
            writers.checkpoint(state.unionByName(absent), checkpoints, it, entry)
        _remove(spark, at)
        _remove(spark, f"{root}/state{it - 1}")
    result = _write(state.unionByName(absent).select("cluster_id", "seq_id"), f"{root}/final")
    for name in ("sequences", "given", f"state{it}", "torn", "settled"):
        _remove(spark, f"{root}/{name}")
    return Result(result, it, done, history)


def _recluster(conf: Config):
    """One scope: its members' new clusters, numbered from 1, with each one's
    gap to its nearest clusters. old_id is set where the partition came back
    as it was. A scope that can't be aligned stays as it is."""

    def kernel(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq_id").reset_index(drop=True)
        ids, olds = pdf.seq_id.tolist(), [list(o) for o in pdf.olds]
        was: dict[str, list] = {}
        for k, o in enumerate(olds):
            was.setdefault(o[0], []).append(k)
        whole = all(len(o) == 1 for o in olds)
        try:
            d = kernels.sequence_distances(pdf.seq.tolist())
            clusters, single, _ = kernels.gap_cluster(d, conf.min_split, conf.max_lump, conf.percentile, conf.method, conf.alpha)
            groups = [sorted(int(m) for m in c) for c in clusters] + [[int(s)] for s in single]
            gaps = kernels.scope_gaps(d, groups, conf.percentile, conf.max_lump)
        except ValueError:
            groups = list(was.values())
            gaps = [math.nan] * len(groups)
        stays = whole and sorted(groups) == sorted(was.values())
        rows = [(key[0], n, ids[m], olds[m][0] if stays else None, int(pdf.times[m]) + 1, None if g != g else g) for n, (c, g) in enumerate(zip(groups, gaps, strict=True), 1) for m in c]
        return pd.DataFrame(rows, columns=["scope_id", "num", "seq_id", "old_id", "times", "gap"])

    return kernel
