"""Shared pieces of the training-data operators: scratch tables, fixed-size
bitmaps, connected components, and word hashing."""

from __future__ import annotations

import ctypes
import hashlib
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_ROOT = None
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where that setting is absent,
    a temporary one on a session of one machine, an error on any other."""
    global _OWN_ROOT
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _OWN_ROOT is None:
        _OWN_ROOT = "file://" + tempfile.mkdtemp(prefix="clade-")
    return _OWN_ROOT


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: the lineage
    ends there, and a lost executor costs a re-read, not a recomputation."""
    spark = df.sparkSession
    spark.sparkContext._jvm.System.gc()  # shuffle files of plans that are gone are deleted when the driver's JVM collects them
    path = f"{scratch_root(spark)}/clade-{uuid.uuid4().hex}/{name}"
    before = spark.conf.get(BATCH, None)
    spark.conf.set(BATCH, "8m")  # rows that hold whole texts or words: fewer of them go to Python at a time
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(BATCH) if before is None else spark.conf.set(BATCH, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._clade_path = path
    return out


def relieve(spark: SparkSession) -> None:
    """Have the executors' JVMs give back the heap that earlier joins and sorts
    grew into: they keep it until they collect all of it, and the memory of
    Python workers comes on top. A task a core, outside of Spark SQL's log."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')"))._jdf.queryExecution().toRdd().count()


def release(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._clade_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_names(df: DataFrame, n: int) -> list[str]:
    """n column names that df doesn't have, whatever the case of its names."""
    used = {c.lower() for c in df.columns}
    return [name for name in (f"_c{k}" for k in range(len(used) + n)) if name not in used][:n]


# ---- bitmaps: a set of longs as 2^25 bits (4 MB), whatever the data's size ----

BITMAP_BITS = 25


def bitmap(ids: DataFrame, col: str) -> np.ndarray:
    """A superset of ids[col] as a fixed-size bit array, pre-aggregated on the
    executors: at most 2^19 words reach the driver."""
    p = F.pmod(F.col(col), F.lit(1 << BITMAP_BITS).cast("long"))
    words = (
        ids.where(F.col(col).isNotNull())
        .select(F.shiftright(p, 6).cast("int").alias("w"), p.alias("p"))
        .select("w", F.expr("shiftleft(1L, cast(p % 64 as int))").alias("b"))
        .groupBy("w")
        .agg(F.bit_or("b").alias("b"))
        .toArrow()
    )
    out = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    out[words["w"].to_numpy()] = words["b"].to_numpy()
    return out


def in_bitmap(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    p = x.astype(np.int64) & ((1 << BITMAP_BITS) - 1)
    return ((bits[p >> 6] >> (p & 63)) & 1).astype(bool)


def only(batch: pa.RecordBatch, bits: np.ndarray) -> pa.RecordBatch:
    """The rows whose first column is in the bitmap."""
    ids = batch.column(0)
    hit = in_bitmap(bits, ids.fill_null(0).to_numpy(zero_copy_only=False)) & ids.is_valid().to_numpy(zero_copy_only=False)
    return batch.filter(pa.array(hit))


# ---- memory of Python workers ---------------------------------------------------


def tidy(run):
    """A mapInArrow function that gives freed memory back when a task ends:
    workers are used again, and the next operator's tables come on top."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # another C library
                pass

    return wrapped


# ---- connected components -----------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(a, b) longs -> (node, component): component is the smallest reachable
    node. Alternates large-star and small-star; every step is a min aggregate
    (combined before its shuffle) and a join that adaptive execution can split,
    so no node's neighbours are gathered in one place."""
    cur = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc")
    mark = None
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low2, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low2.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        nxt = stored(small, "cc")
        row = nxt.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        release(cur)
        cur = nxt
        if (row.n, row.h) == mark or row.n == 0:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = (row.n, row.h)


# ---- words ------------------------------------------------------------------------

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0xB5297A4D68E31DA3


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inv = pow(_BASE, -1, 2**64)
    one = np.ones(n, np.uint64)
    one[1:] = np.uint64(_BASE)
    two = np.ones(n, np.uint64)
    two[1:] = np.uint64(inv)
    return np.cumprod(one), np.cumprod(two)


class WordHashes:
    """64-bit hashes of the words of a column of texts, without making the
    words: words are runs of `[^\x20\x09-\x0D]`, A-Z count as a-z. A word's
    hash is a polynomial in random values of its bytes, taken from prefix sums
    over a whole run of texts."""

    STEP = 1 << 20

    def __init__(self, between: np.ndarray = _SPACE):
        self.between = between
        self.power, self.inverse = _powers(self.STEP)

    def __call__(self, column: pa.Array, step: int = STEP):
        """Yields (row, hashes, counts): the words of rows row, row + 1, ...,
        counts of them each, about step bytes at a time and whole texts always."""
        for lo, data, bounds in byte_runs(column, step):
            start, _, h = self.spans(data, bounds)
            yield lo, h, np.diff(np.searchsorted(start, bounds))

    def spans(self, b: np.ndarray, bounds: np.ndarray):
        """(start, end, hash) of every word of the bytes b; bounds part the texts."""
        if len(b) == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        if len(b) > len(self.power):
            self.power, self.inverse = _powers(len(b))
        word = ~self.between[b]
        cut = np.zeros(len(b) + 1, bool)
        cut[bounds] = True
        before = np.concatenate([[False], word[:-1]])
        after = np.concatenate([word[1:], [False]])
        start = np.flatnonzero(word & (~before | cut[:-1]))
        end = np.flatnonzero(word & (~after | cut[1:])) + 1
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTE[b] * self.power[: len(b)], out=sums[1:])
        return start, end, mixed((sums[end] - sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def byte_runs(column: pa.Array, step: int = WordHashes.STEP):
    """(row, bytes, bounds) of about step bytes of a text column at a time,
    whole texts always: row row + i is bytes[bounds[i]:bounds[i + 1]]."""
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + step, "right")) - 1)
        yield lo, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def by_row(hashes: np.ndarray, counts: np.ndarray, grams: int):
    """The k-gram hashes of each row: those of its whole sequence if it is shorter."""
    all_grams = kgrams(hashes, grams) if len(hashes) >= grams else hashes[:0]
    at = 0
    for c in counts.tolist():
        yield all_grams[at : at + c - grams + 1] if c >= grams else kgrams(hashes[at : at + c], grams)
        at += c


def lists(arrays: list[np.ndarray], kind) -> pa.Array:
    """An Arrow list column of numpy arrays."""
    off = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(arrays) if arrays else np.zeros(0), kind))


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_S1, _S2 = np.uint64(32), np.uint64(29)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S1)) * _M2
    x = (x ^ (x >> _S2)) * _M1
    return x ^ (x >> _S1)


def kgrams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; of the whole sequence if it is shorter."""
    n = len(h)
    if n == 0:
        return h
    m = min(k, n)
    acc = h[: n - m + 1] + np.uint64(m)
    for j in range(1, m):
        acc = mixed(acc) + h[j : n - m + 1 + j]
    return mixed(acc)


def digest16(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()
