"""Pair generators. Each returns (i, j, d) with i < j, d null where unknown,
plus scope_id where the items come in scopes."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clade.functions import kernels

#: Items in a block of the all-pairs kernel: a call's result has its square in
#: rows (some 300 MB in the task), and a row goes to a task for each block of its scope.
BLOCK = 2048


def _usable(items: DataFrame, vector: str):
    """Vectors without nulls; others take part in no pair."""
    # floats go as they are, half as many bytes; kernels make doubles of them
    v = F.col(vector) if dict(items.dtypes)[vector] == "array<float>" else F.col(vector).cast("array<double>")
    return items.withColumn(vector, v).where(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()))


def vector_pairs(items: DataFrame, idx: str = "idx", vector: str = "v", block: int = BLOCK) -> DataFrame:
    """Euclidean distances of all pairs of items (idx long, v array<double>).
    All pairs are the result, so their number is what bounds it: beyond some
    100,000 items use scoped_vector_pairs."""
    one = items.select(F.lit(0).alias("scope_id"), F.col(idx).alias("idx"), F.col(vector).alias("v"))
    return scoped_vector_pairs(one, block).select("i", "j", "d")


def scoped_vector_pairs(items: DataFrame, block: int = BLOCK) -> DataFrame:
    """(scope_id, idx long, v array<double>) -> (scope_id, i, j, d): Euclidean
    distances of the pairs within each scope; no other pair is made.

    Items of a scope are dealt into blocks of about `block`; a row goes once to
    every pair of blocks that it takes part in, and each pair of blocks is one
    vectorised kernel call. A null vector, one with a null component, a null
    idx or scope takes part in no pair; vectors of unequal length are not
    compared; rows with one idx are at no distance of each other."""
    kept = _usable(items, "v").where("idx is not null and scope_id is not null")
    blocks = F.greatest(F.lit(1), F.ceil(F.count("*") / block)).cast("int")
    dealt = kept.join(kept.groupBy("scope_id").agg(blocks.alias("blocks")), "scope_id").withColumn("b", F.pmod(F.xxhash64("idx"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("scope_id", F.col("idx").cast("long").alias("idx"), "v", "b", F.least("b", "o").alias("b1"), F.greatest("b", "o").alias("b2"))

    def kernel(key, pdf: pd.DataFrame) -> pd.DataFrame:
        scope, b1, b2 = key
        parts = []
        for size in pdf.v.map(len).unique():
            same = pdf[pdf.v.map(len) == size]
            one, two = same[same.b == b1], same[same.b == b2]
            if not len(one) or not len(two):
                continue
            x, y = np.stack(one.v.to_numpy()).astype(float), np.stack(two.v.to_numpy()).astype(float)
            out = np.empty((len(x), len(y)))
            for at in range(len(x)):
                out[at] = np.sqrt(((x[at] - y) ** 2).sum(axis=1))
            a, c = np.meshgrid(one.idx.to_numpy(), two.idx.to_numpy(), indexing="ij")
            keep = a < c if b1 == b2 else a != c
            parts.append(pd.DataFrame({"scope_id": scope, "i": np.minimum(a, c)[keep], "j": np.maximum(a, c)[keep], "d": out[keep]}))
        return pd.concat(parts) if parts else pd.DataFrame({"scope_id": [], "i": [], "j": [], "d": []})

    kind = dict(items.dtypes)["scope_id"]
    return dealt.groupBy("scope_id", "b1", "b2").applyInPandas(kernel, f"scope_id {kind}, i long, j long, d double")


def scoped_pairs(sequences: DataFrame) -> DataFrame:
    """(scope_id, idx, seq) -> (scope_id, i, j, d): one multiple alignment a
    scope, terminal gaps masked, columns trimmed by coverage, distances over
    the median length. A scope must fit one task; refinement bounds it."""

    def kernel(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        d = kernels.sequence_distances(pdf.seq.tolist())
        i, j = np.triu_indices(len(d), 1)
        idx = pdf.idx.to_numpy()
        return pd.DataFrame({"scope_id": key[0], "i": idx[i], "j": idx[j], "d": pd.array(np.where(np.isnan(d[i, j]), None, d[i, j]), dtype="Float64")})

    kind = dict(sequences.dtypes)["scope_id"]
    return sequences.select("scope_id", F.col("idx").cast("long").alias("idx"), "seq").groupBy("scope_id").applyInPandas(kernel, f"scope_id {kind}, i long, j long, d double")


def labelled(pairs: DataFrame, assign: DataFrame) -> DataFrame:
    """pairs with the clusters of both sides: ci, cj. assign: (idx, cluster_id)."""
    a = assign.select(F.col("idx").alias("i"), F.col("cluster_id").alias("ci"))
    b = assign.select(F.col("idx").alias("j"), F.col("cluster_id").alias("cj"))
    return pairs.join(a, "i").join(b, "j")


def known(d: str | Column = "d") -> Column:
    """Distances that are there; a NaN in a group would make its percentiles NaN."""
    d = F.col(d) if isinstance(d, str) else d
    return d.isNotNull() & ~F.isnan(d)


def directed(pairs: DataFrame) -> DataFrame:
    """Both directions of each pair."""
    return pairs.unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))


def from_item(pairs: DataFrame, item: int) -> DataFrame:
    """idx, d: the distances of one item to the others."""
    return pairs.where((F.col("i") == item) | (F.col("j") == item)).select(F.when(F.col("i") == item, F.col("j")).otherwise(F.col("i")).alias("idx"), "d")


def shingle_jaccard(texts: DataFrame, k: int, least: float) -> DataFrame:
    """Candidate generation (inverted index): pairs of (idx, text) that share
    at least `least` of the smaller's distinct k-character grams, with that
    share as identity. Grams are joined, counted and filtered; no pair without
    a common gram is made."""
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - k + 1, F.lit(1))), lambda p: F.substr("text", p, F.lit(k))))
    sets = texts.select("idx", grams.alias("g")).withColumn("n", F.size("g"))
    each = sets.select("idx", "n", F.explode("g").alias("g"))
    other = each.select(F.col("idx").alias("j"), F.col("n").alias("m"), "g")
    return (
        each.join(other, "g").where("idx < j").groupBy(F.col("idx").alias("i"), "j", "n", "m").agg(F.count("*").alias("shared"))
        .withColumn("identity", F.col("shared") / F.least("n", "m")).where(F.col("identity") >= least).select("i", "j", "shared", "identity")
    )
