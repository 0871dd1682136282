"""Mixing sources to target weights by entropy balancing, in DataFrame
operations only.

Targets come from weights by water-filling. The rates are the solution of

    minimise  sum of size_d * (r_d log r_d - r_d + 1)
    with      sum over a source of r_d * size_d = target,  0 <= r_d <= most

whose dual has one multiplier a source: r_d = min(most, exp(lambda_source)).
(The entropy is taken over words, so that a rate does not favour short or long
documents of a source.) The dual is convex and parts by source: its Newton
steps are arithmetic on a source's row. Rates are then rounded into whole copies
by a hash of the document, and what rounding leaves of a source's target is
worked off, an aggregate over the documents a round, over documents whose size
fits into the rest.

All that a document's copies depend on is its size, its hash and one row of its
source: the multiplier, and of each round of correction the rest and the last
hash cell. So copies are worked out beside each row, and no document is joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import release, stored

#: Copies of a document at most; Newton steps at most, and the relative error
#: at which they end; rounds of correction, and their hash cells.
MOST, NEWTON, CLOSE, ROUNDS, CELLS = 3, 25, 1e-9, 6, 256
#: A table of sources of up to so many rows is broadcast; beyond, it is joined
#: by source and SALT, so that no source's documents meet in one task.
SMALL, SALT = 20_000, 64


def word_count(text):
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))), F.lit(0)).cast("long")


def targets(sizes: DataFrame, cycle: int = 3, most: int = MOST) -> DataFrame:
    """source, source_size -> source, source_size, target (double).

    Sources in code point order, null last, weigh 1, 2, .., cycle, repeating,
    and share the total by weight; none gets over most times its size, and
    what that leaves goes to the others by weight. Sorted by size over weight
    the capped sources come first, so running sums settle all of them at once.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    weighed = sizes.withColumn("w", (F.pmod(F.row_number().over(order) - 1, F.lit(cycle)) + 1).cast("double")).withColumn("cap", most * F.col("source_size").cast("double"))
    full = W.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    every = W.partitionBy()
    left = F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("cap").over(full.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    w_left = F.sum("w").over(full.rowsBetween(0, W.unboundedFollowing))
    capped = weighed.withColumn("level", left / w_left).withColumn("over", F.col("cap") <= F.col("level") * F.col("w"))
    free = F.sum("source_size").over(every).cast("double") - F.sum(F.when(F.col("over"), F.col("cap")).otherwise(0.0)).over(every)
    share = free * F.col("w") / F.sum(F.when(F.col("over"), F.lit(0.0)).otherwise(F.col("w"))).over(every)
    return capped.select("source", "source_size", F.when(F.col("over"), F.col("cap")).otherwise(share).alias("target"))


def mixed(docs: DataFrame, cycle: int = 3, most: int = MOST) -> DataFrame:
    """What a mix takes of every document.

    docs: any columns; doc_id, text and source are read. Returns doc_id, size
    (words; 0 for null and empty texts), source_size, target, copies (0 to
    most), taken (copies * size). A source without words has target 0 and takes
    none; documents without words have no copies to give but count one each, so
    that they are neither lost nor multiplied. Rows with a null id or source
    take part (null is a source); repeated rows share their hash and are drawn
    alike. Nothing depends on partitioning or order: reruns agree.
    """
    rows = stored(_weighed(docs), "sizes")
    state = _balanced(rows, cycle, most)
    out = _taken(rows, state, most)
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _weighed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), _hash().alias("h"))


def _hash():
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string"))


def _balanced(rows: DataFrame, cycle: int, most: int) -> DataFrame:
    """(source, size, h) -> a row a source: source, source_size, target, lam,
    and rounds, an array of salt, rest and last cell."""
    sums = stored(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sums")
    small = _small(sums)
    names = ["source", "source_size", "target", "lam", "rounds"]
    none = F.from_json(F.lit("[]"), "array<struct<salt:int,rest:bigint,last:int>>")
    state = stored(targets(sums, cycle, most).withColumn("lam", _multiplier(most)).withColumn("rounds", none).select(*names), "targets")
    release(sums)
    got = _taken(rows, state, most, small).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("got"))
    new = stored(_with(state, got, small).select(*names, "got"), "rounds")
    release(state)
    state = new
    for salt in range(1, ROUNDS + 1):
        now = state.withColumn("rest", F.round(F.col("target") - F.col("got")).cast("long"))
        at = _taken(rows, now, most, small)
        cell = F.when(_fits(F.col("size"), F.col("copies"), F.col("rest"), most), _cell(F.col("h"), F.lit(salt)))
        cells = at.withColumn("cell", cell).where("cell is not null").groupBy("source", "cell").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
        # as many whole cells as the rest has room for
        so_far = F.sum("words").over(W.partitionBy("source").orderBy("cell").rowsBetween(W.unboundedPreceding, 0))
        last = cells.withColumn("so_far", so_far).where("so_far <= abs(rest)").groupBy(F.col("source").alias("__s")).agg(F.max("cell").alias("last"), F.max("so_far").alias("moved"))
        side = now.join(F.broadcast(last) if small else last, F.col("source").eqNullSafe(F.col("__s")), "left")
        step = F.array(F.struct(F.lit(salt).alias("salt"), "rest", F.coalesce("last", F.lit(-1)).alias("last")))
        # what those cells give or take is what the next round finds taken: no documents are read to sum it
        moved = F.coalesce("moved", F.lit(0)) * F.signum("rest").cast("long")
        new = stored(side.select("source", "source_size", "target", "lam", F.concat("rounds", step).alias("rounds"), (F.col("got") + moved).alias("got")), "rounds")
        release(state)
        state = new
    return state.select(*names)


def _multiplier(most: int):
    """lambda of a source from source_size and target, by Newton steps on the
    dual: f(lam) = source_size * min(most, exp(lam)) - target. The documents of
    a source have one rate, so the dual parts by source and a step needs no
    other row. A source that is close enough keeps its lambda."""

    def step(lam, _):
        rate = F.least(F.exp(lam), F.lit(float(most)))
        slope = F.col("source_size") * F.when(F.exp(lam) <= most, F.exp(lam)).otherwise(0.0)
        off = F.col("source_size") * rate - F.col("target")
        far = F.when(F.col("target") > 0, F.abs(off) / F.col("target")).otherwise(0.0)
        return F.when(far <= CLOSE, lam).when(slope > 0, lam - F.greatest(F.lit(-2.0), F.least(F.lit(2.0), off / slope))).otherwise(F.log(F.lit(float(most))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON)), F.lit(0.0), step)


def _cell(h, salt):
    return F.pmod(F.xxhash64(h, salt), F.lit(CELLS)).cast("int")


def _fits(size, copies, rest, most: int):
    """Whether a copy more (or less) of a document fits into what its source
    still lacks (or has too much)."""
    return (size > 0) & (size <= F.abs(rest)) & F.when(rest > 0, copies < most).otherwise(copies > 0)


def _taken(rows: DataFrame, state: DataFrame, most: int, small: bool | None = None) -> DataFrame:
    """rows (source, size, h) with the columns of their source's state, and copies."""
    size, h = F.col("size"), F.col("h")
    rate = F.when(F.col("source_size") == 0, 1.0).otherwise(F.least(F.exp("lam"), F.lit(float(most))))
    near = F.round(rate, 9)
    u = (F.pmod(F.xxhash64(h, F.lit(0)), F.lit(1 << 52)) / float(1 << 52)).cast("double")
    drawn = F.least(F.lit(most), F.floor(near).cast("int") + (u < near - F.floor(near)).cast("int")).cast("int")

    def corrected(copies, r):
        within = _fits(size, copies, r["rest"], most) & (_cell(h, r["salt"]) <= r["last"])
        return (copies + F.when(within, F.when(r["rest"] > 0, 1).otherwise(-1)).otherwise(0)).cast("int")

    copies = F.when(size == 0, F.lit(1)).otherwise(F.aggregate("rounds", drawn, corrected))
    return _with(rows, state, _small(state) if small is None else small).withColumn("copies", copies.cast("int"))


def _small(by_source: DataFrame) -> bool:
    return by_source.limit(SMALL + 1).count() <= SMALL


def _with(rows: DataFrame, by_source: DataFrame, small: bool) -> DataFrame:
    """Null-safe join of rows with a table that has a row a source: broadcast
    where it was counted to be small, else by source and a salt of the row."""
    side = by_source.withColumnRenamed("source", "__source")
    if small:
        return rows.join(F.broadcast(side), rows["source"].eqNullSafe(side["__source"])).drop("__source")
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALT)).cast("int"))
    side = side.withColumn("__salt2", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return salted.join(side, salted["source"].eqNullSafe(side["__source"]) & (F.col("__salt") == F.col("__salt2"))).drop("__source", "__salt", "__salt2")


def resampled(docs: DataFrame, cycle: int = 3, most: int = MOST) -> DataFrame:
    """docs with every row as often as the mix takes it; all columns stay.

    Every row has its own copies, whatever ids it shares with others; equal
    rows (doc_id, text, source) are drawn alike. Null and empty texts have no
    words and come once; null ids and sources take part. Other columns may have
    any name. An empty table comes back empty.
    """
    names = docs.columns
    sizes = stored(_weighed(docs).select("source", "size", "h"), "sizes")
    state = _balanced(sizes, cycle, most)
    release(sizes)
    # a struct, so that no column of docs meets one of the mix
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), _hash().alias("h"))
    out = _taken(rows, state, most).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("n")).select(*[F.col(f"row.`{c}`") for c in names])
