"""Embedding near-dedup by lattice hashing.

Unit vectors are projected by Gaussian matrices to blocks of eight dimensions,
and each block is decoded to its nearest point of the E8 lattice; the points of
a table's blocks are a vector's cell in that table. A vector is kept under its
own cell and looked for under that cell and the nearest neighbouring cells
(lattice steps by minimal vectors, cheapest first). Pairs that meet in any
table are verified by their cosine in double precision.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, stored

#: Tables, E8 blocks a table, neighbouring cells probed, width of a lattice
#: step against the projected unit sphere, seed of the projections. A pair at cosine
#: 0.93 meets with probability 0.97, at 0.95 with 0.995; unrelated pairs with 1e-4.
TABLES, BLOCKS, PROBES, SCALE, SEED = 8, 2, 8, 1.6, 8128


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or eight of +-1/2
    with an even number of minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = [0.0] * 8
            v[i], v[j] = a, b
            out.append(v)
    out += [list(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """Nearest point of D8 (integers of even sum): round, and where the sum is
    odd round the worst entry the other way."""
    p = np.rint(x)
    gap = x - p
    odd = (p.sum(axis=-1).astype(np.int64) & 1).astype(bool)
    worst = np.abs(gap).argmax(axis=-1)[..., None]
    step = np.where(np.take_along_axis(gap, worst, -1) >= 0, 1.0, -1.0)
    np.put_along_axis(p, worst, np.take_along_axis(p, worst, -1) + step * odd[..., None], -1)
    return p


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row of eight: the better of D8 and D8 + 1/2."""
    a = _nearest_even(x)
    b = _nearest_even(x - 0.5) + 0.5
    near = ((x - a) ** 2).sum(-1) <= ((x - b) ** 2).sum(-1)
    return np.where(near[..., None], a, b)


class Cells:
    """Cells of unit vectors of one dimension."""

    def __init__(self, dim: int, tables: int, blocks: int, probes: int, scale: float, seed: int):
        rng = np.random.default_rng([seed, dim])
        self.project = rng.standard_normal((dim, tables * blocks * 8)) * (1 / scale)
        self.shift = rng.random(tables * blocks * 8) * 4
        self.factors = rng.integers(1, 2**62, (tables, blocks * 8), dtype=np.int64) | 1
        self.salt = rng.integers(1, 2**62, tables, dtype=np.int64)
        self.shape, self.probes, self.steps = (tables, blocks, 8), probes, minimal_vectors()

    def __call__(self, units: np.ndarray) -> np.ndarray:
        """(vectors, tables, 1 + probes) keys, the vector's own cell first."""
        n, (tables, blocks, _) = len(units), self.shape
        x = (units @ self.project + self.shift).reshape(n, tables, blocks, 8)
        p = decode_e8(x)
        twice = np.rint(p * 2).astype(np.int64).reshape(n, tables, blocks * 8)
        own = (twice * self.factors).sum(-1) + self.salt
        if not self.probes:
            return own[..., None]
        gain = (x - p) @ self.steps.T  # a step v costs |v|^2 - 2 gain, and |v|^2 is 2 for all
        gain = gain.reshape(n, tables, blocks * 240)
        best = np.argpartition(-gain, self.probes - 1, axis=-1)[..., : self.probes]
        step2 = np.rint(self.steps * 2).astype(np.int64)
        moved = np.einsum("tbi,vi->tbv", self.factors.reshape(tables, blocks, 8), step2).reshape(tables, blocks * 240)
        near = own[..., None] + np.take_along_axis(np.broadcast_to(moved, gain.shape), best, -1)
        return np.concatenate([own[..., None], near], -1)


def _vectors(column) -> list:
    out = []
    for v in column.to_pylist():
        a = np.array(v, np.float64) if v is not None and None not in v else None
        out.append(a if a is not None and len(a) and np.isfinite(a).all() and a.any() else None)
    return out


def _keys(conf):
    def run(batches):
        made: dict[int, Cells] = {}
        for b in batches:
            vecs = _vectors(b.column(1))
            rows, table, own, key = [], [], [], []
            for dim in sorted({len(v) for v in vecs if v is not None}):
                at = [i for i, v in enumerate(vecs) if v is not None and len(v) == dim]
                cells = made.setdefault(dim, Cells(dim, *conf))
                for lo in range(0, len(at), 256):
                    part = at[lo : lo + 256]
                    m = np.stack([vecs[i] for i in part])
                    m /= np.abs(m).max(axis=1, keepdims=True)
                    k = cells(m / np.linalg.norm(m, axis=1, keepdims=True))
                    n, t, p = k.shape
                    rows.append(np.repeat(part, t * p))
                    table.append(np.tile(np.repeat(np.arange(t), p), n))
                    own.append(np.tile(np.arange(p) == 0, n * t))
                    key.append(k.reshape(-1))
            if rows:
                rows = np.concatenate(rows)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(rows)), pa.array(np.concatenate(table).astype(np.int32)), pa.array(np.concatenate(key)), pa.array(np.concatenate(own))], ["rep", "tab", "cell", "own"]
                )

    return run


def _verify(least: float):
    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 8192):
                part = b.slice(lo, 8192)
                x, y = part.column(2), part.column(3)
                nx, ny = np.diff(x.offsets.to_numpy()), np.diff(y.offsets.to_numpy())
                vx, vy = x.flatten().to_numpy().astype(np.float64), y.flatten().to_numpy().astype(np.float64)
                ok = np.zeros(part.num_rows, bool)
                if (nx == nx[0]).all() and (ny == nx[0]).all():
                    ok = cosine(vx.reshape(-1, nx[0]), vy.reshape(-1, nx[0])) >= least
                else:
                    ox, oy = x.offsets.to_numpy() - x.offsets[0].as_py(), y.offsets.to_numpy() - y.offsets[0].as_py()
                    for i in np.flatnonzero(nx == ny):
                        ok[i] = cosine(vx[None, ox[i] : ox[i + 1]], vy[None, oy[i] : oy[i + 1]])[0] >= least
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(ok))

    return run


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of rows, scaled by powers of two first, so that no square over- or underflows."""
    x, y = (np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1]) for v in (x, y))
    return np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))


def linked(
    embeddings: DataFrame, least: float = 0.93, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, scale: float = SCALE, seed: int = SEED
) -> DataFrame:
    """Near-duplicate classes of vectors with equal, non-null labels.

    embeddings: vec_id (long), embedding (array of numbers), label (any type);
    other columns are ignored. Returns vec_id, n_links (other rows linked
    directly), component_id (smallest vec_id reachable), kept. Null, empty and
    zero vectors, vectors with null or non-finite components, and rows with a
    null label or vec_id link with nothing; vectors of unequal length never
    link. Equal vectors of a label are one class, compared once. No pair below
    the threshold is linked; a pair at it is found if it meets in a table.
    Repeated rows are rows of their own and link with each other.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("string").alias("label"))
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = stored(rows.select("vec_id", F.when(F.coalesce(ok, F.lit(False)), F.sha2(F.concat_ws("|", F.hex("label"), F.concat_ws(",", F.transform("v", lambda x: (x + F.lit(0.0)).cast("string")))), 256)).alias("sig"), "label", "v"), "vectors")
    reps = stored(rows.where("sig is not null").groupBy("sig").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v")), "classes")
    reps = reps.withColumn("node", F.xxhash64("sig"))

    conf = (tables, blocks, probes, scale, seed)
    keys = reps.select("node", "v").mapInArrow(_keys(conf), "rep long, tab int, cell long, own boolean").join(reps.select(F.col("node").alias("rep"), F.xxhash64("label").alias("lab")), "rep")
    keys = stored(keys, "cells")
    home = keys.where("own").select("tab", "cell", "lab", F.col("rep").alias("x"))
    near = keys.select("tab", "cell", "lab", F.col("rep").alias("y"))
    pairs = home.join(near, ["tab", "cell", "lab"]).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    side = reps.select("node", "v")
    both = pairs.join(side.toDF("a", "va"), "a").join(side.toDF("b", "vb"), "b").select("a", "b", "va", "vb")
    links = stored(both.mapInArrow(_verify(least), "a long, b long"), "links")

    weight = reps.select("node", "rep", "copies")
    each = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    n_links = each.join(weight.select(F.col("node").alias("b"), "copies"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("copies").alias("others"))
    w1, w2 = weight.select(F.col("node").alias("a"), F.col("rep").alias("ra")), weight.select(F.col("node").alias("b"), F.col("rep").alias("rb"))
    comp = components(links.join(w1, "a").join(w2, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    classes = (
        reps.select("sig", "node", "rep", "copies")
        .join(n_links, "node", "left")
        .join(comp.toDF("rep", "component"), "rep", "left")
        .select("sig", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("c"))
    )
    out = rows.select("vec_id", "sig").join(classes, "sig", "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
