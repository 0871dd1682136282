"""N-gram Jaccard join by a token-group matrix.

Documents become sets of word shingles (64-bit hashes). Equal sets collapse
into one class. The classes are partitioned into groups of similar sets (equal
min-hash, taken over a set's frequent tokens where it has some; split where a
min-hash is common, so that a group stays bounded). The matrix has two forms: a
relation of tokens against the groups whose members' prefixes hold them (the
prefix of a set is so many of its rarest tokens that any pair at the threshold
shares one), and, for each group, the union of its members' tokens as a bitmap.

A set queries the groups that it shares a prefix token with. Its overlap with
a group is bounded by the group's union, then by the members' own bitmaps; a
group is opened, that is tokens are read, only for the pairs within the bound,
and those are intersected exactly until all that can be linked is connected.

Nothing is approximate: the partition, the order of tokens, the bitmaps and the
sketch of frequent tokens change the work, never the links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, bitmap, by_row, components, digest16, free_names, in_bitmap, lists, mixed, only, release, stored, tidy

#: A group's expected members and tokens at most; groups beyond are split by a hash.
GROUP_MEMBERS, GROUP_TOKENS = 256, 131_072
#: A token held by so many prefixes goes behind all others in the global order.
FREQUENT = 16


def shingle_sets(column: pa.Array, k: int, words: WordHashes):
    """The sorted distinct shingles of each text, a run of rows at a time."""
    for lo, h, counts in words(column):
        yield lo, [_distinct(g) for g in by_row(h, counts, k)]


def _distinct(x: np.ndarray) -> np.ndarray:
    return _distinct_sorted(np.sort(x))


def need(n, pct: int):
    """Tokens that a set of n must share with a partner at the threshold."""
    return (pct * n + 99) // 100


def set_bits(tokens: np.ndarray) -> bytes:
    """Tokens as a bitmap of a power of two of bits, 4 to 8 a token."""
    size = max(64, 1 << (4 * max(len(tokens), 1) - 1).bit_length())
    out = np.zeros(size, np.uint8)
    out[(tokens & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def at_size(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) at another power of two: folded, or
    repeated, so that a token's bit is set in either."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return np.tile(bits, (1, words // bits.shape[1]))


def _profile(k: int, pct: int):
    def run(batches):
        words = WordHashes()
        for b in batches:
            for lo, sets in shingle_sets(b.column(1), k, words):
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0)[lo : lo + len(sets)],
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([digest16(s.tobytes()) for s in sets], pa.binary()),
                        lists([s[: len(s) - need(len(s), pct) + 1 if len(s) else 0].view(np.int64) for s in sets], pa.int64()),
                    ],
                    ["doc_id", "n", "sig", "prefix"],
                )

    return run


def _prefixes(k: int, pct: int, frequent):
    def run(batches):
        words, bits = WordHashes(), frequent.value
        for b in batches:
            for lo, sets in shingle_sets(b.column(1), k, words):
                low, prefix, bits_ = [], [], [set_bits(s) for s in sets]
                for s in sets:
                    x = s.view(np.int64)
                    common = in_bitmap(bits, x)
                    # copies of one text agree on its common tokens more than on those of their edits
                    low.append(int(mixed(s[common] if common.any() else s).min().view(np.int64)) if len(s) else 0)
                    prefix.append(np.concatenate([x[~common], x[common]])[: len(s) - need(len(s), pct) + 1] if len(s) else x)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[lo : lo + len(sets)], pa.array([digest16(s.tobytes()) for s in sets], pa.binary()), pa.array(low, pa.int64()), lists(prefix, pa.int64()), pa.array(bits_, pa.binary())],
                    ["doc_id", "sig", "low", "prefix", "bits"],
                )

    return run


def _tokens(k: int, marked):
    def run(batches):
        words, bits = WordHashes(), marked.value
        for b in batches:
            b = only(b, bits)
            for lo, sets in shingle_sets(b.column(1), k, words):
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[lo : lo + len(sets)], pa.array([digest16(s.tobytes()) for s in sets], pa.binary()), lists([np.sort(s.view(np.int64)) for s in sets], pa.int64())], ["doc_id", "sig", "tokens"]
                )

    return run


def _distinct_sorted(x: np.ndarray) -> np.ndarray:
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) > 1 else x


def _unpacked(members):
    """Ids, set sizes and bitmaps of an Arrow list of (doc_id, n, bits)."""
    rows = members.values
    return rows.field(0).to_numpy(), rows.field(1).to_numpy(), [np.frombuffer(x, np.uint64) for x in rows.field(2).to_pylist()]


def within_bound(q, x, pct: int):
    """Index pairs (query, member) that may be at the threshold. A bit that the
    query has and the other side lacks is at least one token that it lacks; so
    the overlap is at most the set's size less the number of those bits."""
    (_, qn, qb), (_, xn, xb) = q, x
    none = np.zeros(0, np.int64)
    out_q, out_x = [none], [none]
    sizes = np.array([len(b) for b in xb])
    for words in sorted({len(b) for b in qb}):
        mine = np.array([i for i, b in enumerate(qb) if len(b) == words])
        lo, hi = qn[mine].min(), qn[mine].max()
        near = np.flatnonzero((pct * lo <= 100 * xn) & (pct * xn <= 100 * hi))
        if len(near) == 0:
            continue
        theirs = np.empty((len(near), words), np.uint64)
        for w in np.unique(sizes[near]):
            at = np.flatnonzero(sizes[near] == w)
            theirs[at] = at_size(np.stack([xb[near[i]] for i in at]), words)
        union = ~np.bitwise_or.reduce(theirs, axis=0)
        for i in mine:
            if qn[i] - int(np.bitwise_count(qb[i] & union).sum()) < need(qn[i], pct):
                continue  # the whole group is out of reach
            most = np.minimum(qn[i] - np.bitwise_count(qb[i] & ~theirs).sum(axis=1, dtype=np.int64), xn[near] - np.bitwise_count(theirs & ~qb[i]).sum(axis=1, dtype=np.int64) if words <= sizes[near].min() else xn[near])
            hit = near[(100 + pct) * most >= pct * (qn[i] + xn[near])]
            out_q.append(np.full(len(hit), i))
            out_x.append(hit)
    return np.concatenate(out_q), np.concatenate(out_x)


def _bound(pct: int):
    def run(batches):
        last, two = None, None  # rows arrive sorted by g
        for b in batches:
            for i, (g, part) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if g != last:
                    last, two = g, _unpacked(b.column(3)[i])
                one = _unpacked(b.column(2)[i])
                q, x = within_bound(one, two, pct)
                q, x = one[0][q], two[0][x]
                q, x = q[q != x], x[q != x]
                if len(q):
                    yield pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), pa.array([part], pa.int64()), lists([q], pa.int64()), lists([x], pa.int64())], ["g", "part", "q", "x"])

    return run


def _open(pct: int):
    """Intersects the pairs within the bound, but none that are already
    connected through others: what comes out is a spanning forest."""

    def run(batches):
        for b in batches:
            for qs, xs, members in zip(b.column(0), b.column(1), b.column(2), strict=True):
                rows = members.values
                sets: dict[int, list] = {}
                for d, t in zip(rows.field(0).to_pylist(), rows.field(1), strict=True):
                    sets.setdefault(d, []).append(t.values.to_numpy())
                root = {d: d for d in sets}

                def find(v):
                    while root[v] != v:
                        root[v] = root[root[v]]
                        v = root[v]
                    return v

                out = []
                for q, x in zip(qs.values.to_pylist(), xs.values.to_pylist(), strict=True):
                    u, v = find(q), find(x)
                    if u != v and any(similar(s, t, pct) for s in sets[q] for t in sets[x]):
                        root[max(u, v)] = min(u, v)
                        out.append((q, x))
                if out:
                    yield pa.RecordBatch.from_pydict({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64())})

    return run


def similar(s: np.ndarray, t: np.ndarray, pct: int) -> bool:
    """Whether two sets (sorted, distinct) are at the threshold."""
    if len(s) > len(t):
        s, t = t, s
    if pct * len(t) > 100 * len(s):
        return False
    at = np.searchsorted(t, s)
    common = int((t[np.minimum(at, len(t) - 1)] == s).sum())
    return 100 * common >= pct * (len(s) + len(t) - common)


def _parts():
    """Into how many parts rows with a set size n go."""
    return F.greatest(F.lit(1), F.ceil(F.count("*") / GROUP_MEMBERS), F.ceil(F.sum("n") / GROUP_TOKENS)).cast("long")


def near_duplicates(docs: DataFrame, ngram: int = 5, pct: int = 80) -> DataFrame:
    """Components of documents whose shingle sets have 100 * |A and B| >= pct * |A or B|.

    docs: any columns; doc_id (long) and text are read. Returns doc_id,
    n_shingles, component_id for every row. Null and empty texts, and texts of
    white space only, have no shingles and link with nothing; a text shorter
    than ngram words is one shingle. Rows with a null doc_id come back with a
    null component and link with nothing. Repeated rows come back repeated.
    Lengths are unlimited. Hash collisions within one pair (2^-64 each) are
    the only departure from exact string comparison.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    prof = stored(texts.mapInArrow(tidy(_profile(ngram, pct)), "doc_id long, n long, sig binary, prefix array<long>"), "profile")
    frequent = prof.select(F.explode("prefix").alias("t")).groupBy("t").count().where(F.col("count") >= FREQUENT)
    bits = spark.sparkContext.broadcast(bitmap(frequent, "t"))

    reps = prof.where("n > 0 and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    reps = stored(reps, "classes")
    pre = texts.mapInArrow(tidy(_prefixes(ngram, pct, bits)), "doc_id long, sig binary, low long, prefix array<long>, bits binary")
    pre = stored(pre.join(reps, ["doc_id", "sig"]).dropDuplicates(["doc_id", "sig"]), "prefixes")
    parts = pre.groupBy("low").agg(_parts().alias("parts"))
    groups = stored(pre.join(parts, "low").withColumn("g", F.xxhash64("low", F.pmod(F.xxhash64("sig"), F.col("parts")))).select("doc_id", "n", "g", "prefix", "bits"), "groups")

    index = groups.select(F.explode("prefix").alias("t"), "doc_id", "n", "g")
    index = index.join(index.groupBy("t").count().where("count > 1").select("t"), "t")
    matrix = index.groupBy("t", "g").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("held"))
    query = index.withColumnRenamed("g", "own")
    asked = query.join(matrix, "t").where(f"(own < g or (own = g and held > 1)) and {pct} * least <= 100 * n and {pct} * n <= 100 * most")
    asked = stored(asked.select("doc_id", "n", "g").distinct(), "asked")

    member = F.struct("doc_id", "n", "bits")
    bitmaps = groups.join(asked.select("g").distinct(), "g", "left_semi").groupBy("g").agg(F.collect_list(member).alias("members"))
    blocks = asked.join(asked.groupBy("g").agg(_parts().alias("parts")), "g").select("doc_id", "g", F.pmod(F.xxhash64("doc_id"), F.col("parts")).alias("part"))
    blocks = blocks.join(groups.select("doc_id", "n", "bits"), "doc_id").groupBy("g", "part").agg(F.collect_list(member).alias("queries"))
    near = blocks.join(bitmaps, "g").select("g", "part", "queries", "members").mapInArrow(tidy(_bound(pct)), "g long, part long, q array<long>, x array<long>")
    near = stored(near.withColumn("id", F.monotonically_increasing_id()), "near")

    wanted = near.select("id", F.explode(F.array_distinct(F.concat("q", "x"))).alias("doc_id"))
    marked = spark.sparkContext.broadcast(bitmap(wanted, "doc_id"))
    tokens = texts.mapInArrow(tidy(_tokens(ngram, marked)), "doc_id long, sig binary, tokens array<long>").join(reps.select("doc_id", "sig"), ["doc_id", "sig"], "left_semi").dropDuplicates(["doc_id", "sig"])
    packs = wanted.join(tokens, "doc_id").groupBy("id").agg(F.collect_list(F.struct("doc_id", "tokens")).alias("members"))
    opened = near.join(packs, "id").select("q", "x", "members")
    links = components(opened.mapInArrow(tidy(_open(pct)), "a long, b long"))
    release(pre, groups, asked, near)

    home = reps.select("sig", F.col("doc_id").alias("rep")).join(links, F.col("rep") == F.col("node"), "left").select("sig", F.coalesce("component", "rep").alias("home"))
    out = prof.select("doc_id", "n", F.when(F.expr("n > 0 and doc_id is not null"), F.col("sig")).alias("sig")).join(home, "sig", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("home", "doc_id").alias("component_id"))
    return out


def deduplicated(docs: DataFrame, ngram: int = 5, pct: int = 80) -> DataFrame:
    """docs without near duplicates: of each component the row of the smallest
    doc_id stays; all columns are kept, whatever their names.

    What is compared are the distinct (doc_id, text): rows that share a doc_id
    but not the text are documents of their own, equal rows are one document
    and stay or go together. Ties between texts of one doc_id go to the smaller
    hash. Rows with a null doc_id stay, as do null and empty texts and those
    without words, which link with nothing. An empty table comes back empty.
    Distinct documents are told apart by a 64-bit hash.
    """
    (key,) = free_names(docs, 1)
    own = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = docs.where(F.col("doc_id").isNotNull()).select(own.alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("id"))
    near = near_duplicates(rows, ngram, pct).select(F.col("doc_id").alias("key"), "component_id").distinct()
    ids = rows.select(F.col("doc_id").alias("key"), "id").distinct()
    stays = near.join(ids, "key").groupBy("component_id").agg(F.min(F.struct("id", "key")).alias("first")).select(F.col("first.key").alias(key))
    out = docs.withColumn(key, own).join(stays, key, "left_semi")
    return out.where(F.col("doc_id").isNotNull()).select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))
