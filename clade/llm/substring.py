"""Substring dedup by collinear chaining.

Texts become blocks of word hashes, about half a megabyte of text, or one long
document. Seeds are pairs of four-word grams a few words apart (near pairs
find passages with many changed words; far pairs tell passages from lines that
many documents share). A block sends each distinct seed once, dealt by hash;
where they meet, the first holder of each seed (smallest doc_id) is found and
sent back to the blocks that hold it. So a seed in a third of all documents is
one entry a block: no task gathers its holders, and no pairs of holders are made.

A document's matches with one holder are chained in order on both sides, with
gap costs, through a Fenwick tree; each chain is then aligned word by word to
find where its passages begin and end and how much of each agrees.

The first holder of a seed may have it in another passage. What that leaves is
settled exactly for equal text: windows of min_words words whose seeds all have
earlier holders, but no such run with one of them, go the same way as seeds.
The first holder of such a window has all of its words.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WordHashes, free_names, kgrams, mixed, release, relieve, stored, tidy

#: Words of a gram; of a seed's two grams, how far the second starts behind the
#: first, and the window of which the smallest first gram is a seed.
GRAM, NEAR, FAR = 4, (5, 8, 5), (20, 31, 15)
#: Bytes of text in a block, entries that meet in one task.
BLOCK_BYTES, BUCKET = 1 << 19, 1 << 19
#: Bits of a word's hash; bits of a key beyond those that count the words there are.
WORD_BITS, SPARE_BITS = 24, 21
#: A document with fewer matches than SURE is first compared by the words up to
#: MARGIN beyond its outer ones; where a passage goes on there, it is compared whole.
SURE, MARGIN = 4, 100
#: Score of a seed, cost of a word of gap on either side.
SEED_SCORE, GAP_COST = 8.0, 0.125
#: Alignment: score of equal words, of unequal ones; an end stops growing when it fell so far.
EQUAL, UNEQUAL, DROP = 1, -2, 12
ONE, NONE = 1 << 32, -(1 << 60)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- arrays in one binary value ----------------------------------------------------


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, byte by byte of their numbers, compressed."""
    return pa.compress(b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int, *kinds) -> list[np.ndarray]:
    sizes = [np.dtype(k).itemsize for k in kinds]
    raw = np.frombuffer(pa.decompress(data, decompressed_size=n * sum(sizes), codec="zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for k, s in zip(kinds, sizes, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * s].reshape(s, n).T).view(k).reshape(n))
        at += n * s
    return out


def packed_words(words: np.ndarray) -> bytes:
    """Many words as a list of terms, frequent ones first, and their numbers."""
    terms, number, counts = np.unique(words, return_inverse=True, return_counts=True)
    order = np.lexsort((terms, -counts))
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order))
    steps = packed(np.diff(terms[order], prepend=np.uint32(0)))
    return struct.pack("<qq", len(terms), len(steps)) + steps + packed(rank[number])


def unpacked_words(data: bytes, n: int) -> np.ndarray:
    m, size = struct.unpack_from("<qq", data)
    steps = unpacked(data[16 : 16 + size], m, np.uint32)[0]
    return np.cumsum(steps, dtype=np.uint32)[unpacked(data[16 + size :], n, np.uint32)[0]]


# ---- blocks and seeds --------------------------------------------------------------

BLOCK = "ids array<long>, texts array<binary>, counts array<int>, n long, words binary"


def _blocks(size: int):
    def run(batches):
        hashes = WordHashes()
        for b in batches:
            for lo, h, counts in hashes(b.column(2), size):
                ids = b.column(0)[lo : lo + len(counts)].to_numpy()
                full = np.flatnonzero(counts)
                order = full[np.argsort(ids[full], kind="stable")]  # in a block, place is by doc_id
                start = np.cumsum(counts) - counts
                n = counts[order]
                at = np.repeat(start[order] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                if len(order):
                    keys = b.column(1)[lo : lo + len(counts)].take(pa.array(order))
                    yield pa.RecordBatch.from_pydict(
                        {"ids": pa.array([ids[order]], pa.list_(pa.int64())), "texts": pa.array([keys.to_pylist()], pa.list_(pa.binary())), "counts": pa.array([n], pa.list_(pa.int32())), "n": [len(at)], "words": [packed_words((h[at] >> np.uint64(64 - WORD_BITS)).astype(np.uint32))]}
                    )

    return run


def _sliding(f, x: np.ndarray, w: int) -> np.ndarray:
    """f (np.minimum or np.maximum) over all windows of w, by doubling."""
    have = 1
    while have < w:
        step = min(have, w - have)
        x = f(x[:-step], x[step:])
        have += step
    return x


def minimizers(x: np.ndarray, window: int) -> np.ndarray:
    """Positions of the hashes x that are smallest in some window: those that
    equal the largest minimum of the windows round them."""
    if len(x) == 0:
        return np.zeros(0, np.int64)
    w = min(window, len(x))
    low = _sliding(np.minimum, x, w)
    edge = np.zeros(w - 1, np.uint64)
    return np.flatnonzero(_sliding(np.maximum, np.concatenate([edge, low, edge]), w) == x)


def linked_grams(words: np.ndarray, doc: np.ndarray, lo: int, hi: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and keys of the seeds of words (of document doc, in order): a
    gram that is smallest in some window, and of the grams that start lo to hi
    words behind it the one whose hash with it is smallest."""
    x = kgrams(words, GRAM) if len(words) >= GRAM else words[:0]
    n = len(x) - hi
    if n <= 0:
        return np.zeros(0, np.int64), words[:0]
    best = mixed(x[lo : lo + n] ^ x[:n])
    for o in range(lo + 1, hi + 1):
        best = np.minimum(best, mixed(x[o : o + n] ^ x[:n]))
    at = minimizers(x, window)
    at = at[at < n]
    at = at[doc[at] == doc[at + hi + GRAM - 1]]
    return at, mixed(mixed(x[at]) + best[at] + np.uint64(lo))


def window_keys(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of size words, by doubling."""
    out, have = mixed(words + np.uint64(size)), 1
    while have < size:
        step = min(have, size - have)
        out = mixed(out[:-step] + np.uint64(0x9E3779B97F4A7C15)) + out[step:]
        have += step
    return mixed(out)


class Block:
    """A stored block: ids, text keys and word counts by place, all words."""

    def __init__(self, ids, texts, counts, n, words):
        self.ids, self.texts, self.counts = ids.values.to_numpy(), texts.values, counts.values.to_numpy()
        self.words = unpacked_words(words.as_py(), n.as_py())
        self.start = np.cumsum(self.counts) - self.counts
        self.doc = np.repeat(np.arange(len(self.ids)), self.counts)

    def seeds(self, bits: int):
        """Positions and keys of near and far seeds."""
        wide = mixed(self.words.astype(np.uint64))
        drop = np.uint64(64 - bits)
        return [(at, keys >> drop << drop) for at, keys in (linked_grams(wide, self.doc, *NEAR), linked_grams(wide, self.doc, *FAR))]

    def windows(self, size: int):
        """Position (by index) and key of every run of size words in one document."""
        keys = window_keys(self.words.astype(np.uint64), size) if len(self.words) >= size else np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[: len(keys)] == self.doc[size - 1 :][: len(keys)])
        return at, keys[at]

    def of(self, place: int) -> np.ndarray:
        return self.words[self.start[place] : self.start[place] + self.counts[place]]


ENTRY = (np.uint64, np.int64, np.uint32, np.uint32, np.uint8)  # key, doc_id, place, word, whether several documents of the block have it
ANSWER = (np.uint64, np.int64, np.int64, np.uint32, np.uint32)  # key, and the first holder's doc_id, block, place, word


def entries(block: Block, number: int, at: np.ndarray, keys: np.ndarray, buckets: int):
    """The distinct keys of a block with their first holder in it, by bucket."""
    order = np.argsort(keys, kind="stable")
    at, keys = at[order], keys[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(keys)]]) - 1
    many = (block.ids[block.doc[at[first]]] != block.ids[block.doc[at[last]]]).astype(np.uint8)
    at, keys = at[first], keys[first]
    doc = block.doc[at]
    cut = np.searchsorted(keys, (np.arange(1, buckets) * ((1 << 64) // buckets)).astype(np.uint64)) if buckets > 1 else np.zeros(0, np.int64)
    out = {"bucket": [], "block": [], "n": [], "data": []}
    for k, (a, z) in enumerate(zip([0, *cut.tolist()], [*cut.tolist(), len(keys)], strict=True)):
        if a < z:
            out["bucket"].append(k)
            out["block"].append(number)
            out["n"].append(z - a)
            s = slice(a, z)
            out["data"].append(packed(keys[s], block.ids[doc[s]], doc[s].astype(np.uint32), (at[s] - block.start[doc[s]]).astype(np.uint32), many[s]))
    return out


ENTRIES = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])


def _seed_entries(buckets: int, bits: int):
    def run(batches):
        for b in batches:
            for number, *row in zip(*(b.column(i) for i in range(6)), strict=True):
                block = Block(*row)
                (p, k), (q, j) = block.seeds(bits)
                both = np.concatenate([p, q])
                order = np.argsort(both, kind="stable")
                if len(both):
                    yield pa.RecordBatch.from_pydict(entries(block, number.as_py(), both[order], np.concatenate([k, j])[order], buckets), ENTRIES)

    return run


def runs(batches):
    """Tables of the rows with one value of the first column; rows arrive in its
    order, so that no list of them is made before they get here."""
    held, last = [], None
    for b in batches:
        key = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
        for a, z in zip(cuts, cuts[1:], strict=False):
            if a < z:
                if held and key[a] != last:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(b.slice(a, z - a))
                last = key[a]
    if held:
        yield pa.Table.from_batches(held)


def _first_holders(batches):
    """Of the entries that meet in a bucket: for each block, the first holder of
    its keys that another document has; and the holders' places (n < 0). A
    bucket's entries are held once, and places among them as 32-bit numbers."""
    for rows in runs(batches):
        blocks, ns = rows.column(1).to_numpy(), rows.column(2).to_numpy()
        key, doc, place, word, many = (np.empty(int(ns.sum()), kind) for kind in ENTRY)
        owner = np.repeat(np.arange(len(blocks), dtype=np.int32), ns)
        at = 0
        for d, n in zip(rows.column(3), ns.tolist(), strict=True):
            for whole, part in zip((key, doc, place, word, many), unpacked(d.as_buffer(), n, *ENTRY), strict=True):
                whole[at : at + n] = part
            at += n
        del rows
        order = _sorted(key, doc, blocks[owner])
        new = np.ones(len(order), bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        f = order[np.flatnonzero(new)][np.cumsum(new, dtype=np.int32) - 1]
        hit = (doc[f] != doc[order]) | (many[order] > 0)
        o, f = order[hit], f[hit]
        del order, new, hit
        by = np.argsort(owner[o], kind="stable")
        o, f = o[by], f[by]
        del by
        out = {"block": [], "n": [], "data": []}
        for a, z in _stretches(owner[o]):
            mine, first = o[a:z], f[a:z]
            out["block"].append(int(blocks[owner[mine[0]]]))
            out["n"].append(z - a)
            out["data"].append(packed(key[mine], doc[first], blocks[owner[first]], place[first], word[first]))
        del o, key, doc, word, many
        held = owner[f].astype(np.int64) << 32 | place[f]
        del f, owner, place
        held.sort()
        held = held[np.concatenate([[True], held[1:] != held[:-1]])] if len(held) else held
        for a, z in _stretches(held >> 32):
            out["block"].append(int(blocks[held[a] >> 32]))
            out["n"].append(a - z)
            out["data"].append(packed(held[a:z].astype(np.uint32)))
        del held
        yield pa.RecordBatch.from_pydict(out, pa.schema([("block", pa.int64()), ("n", pa.int64()), ("data", pa.binary())]))


def _sorted(*by: np.ndarray) -> np.ndarray:
    """The order of rows by columns, the first one foremost, in 32 bits."""
    return np.lexsort(by[::-1]).astype(np.int32)


def _stretches(x: np.ndarray) -> list[tuple[int, int]]:
    """From and to of each run of equal values."""
    cuts = [0, *(np.flatnonzero(x[1:] != x[:-1]) + 1).tolist(), len(x)]
    return list(zip(cuts[:-1], cuts[1:], strict=True)) if len(x) else []


def unsettled(p: np.ndarray, y: np.ndarray, holder: np.ndarray, n: int, size: int) -> np.ndarray:
    """Starts of the windows of size words of a document of n words that may be
    equal to an earlier one which the first holders of its seeds don't show.
    p: positions of its near seeds; y, holder: where the first holder has each,
    holder -1 where the document itself is it or no other has it. Equal windows
    have equal seeds and so equal first holders: both sides choose alike."""
    reach = NEAR[1] + GRAM
    if n < size or not len(p):
        return np.zeros(0, np.int64)
    good = holder >= 0
    s = np.arange(n - size + 1)
    a, b = np.searchsorted(p, s + NEAR[2] - 1), np.searchsorted(p, s + size - reach, "right") - 1  # whether these are seeds is up to the window's words alone
    bad = np.concatenate([[0], np.cumsum(~good)])
    ok = (a <= b) & (bad[np.minimum(b, len(p) - 1) + 1] == bad[np.minimum(a, len(p))])
    if not ok.any():
        return s[:0]
    run = np.cumsum(np.concatenate([[0], ~(good[1:] & good[:-1] & (holder[1:] == holder[:-1]) & (np.diff(y) == np.diff(p)))]))
    first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    last = np.concatenate([first[1:], [len(p)]]) - 1
    begin, end = p[first], p[last] + NEAR[0] + GRAM  # at least so far
    for r in np.flatnonzero((end - begin >= size) & good[first]):  # one holder shows min_words and nearly all of these
        ok[max(0, begin[r] - reach) : max(0, end[r] - size + reach) + 1] = False
    return s[ok]


WORK = pa.schema(
    [("bucket", pa.int64()), ("block", pa.int64()), ("place", pa.int64()), ("own_block", pa.int64()), ("own_place", pa.int64()), ("doc_id", pa.int64()), ("text", pa.binary()), ("lo", pa.int64()), ("left", pa.int64()), ("n", pa.int64()), ("data", pa.binary()), ("first_id", pa.int64()), ("m", pa.int64()), ("matches", pa.binary())]
)


def asking(block: Block, number: int, d: int, to_block: int, to_place: int, first_id: int, x: np.ndarray, y: np.ndarray, margin: int | None) -> dict:
    """A document's matches with one holder, and the words round them: lo words
    are left out before those, left words after them."""
    n = int(block.counts[d])
    lo, hi = (0, n) if margin is None else (max(0, int(x.min()) - margin), min(n, int(x.max()) + margin))
    return {
        "block": to_block, "place": to_place, "own_block": number, "own_place": d, "doc_id": int(block.ids[d]), "text": block.texts[d].as_py(), "lo": lo, "left": n - hi, "n": hi - lo,
        "data": packed(block.of(d)[lo:hi]), "first_id": first_id, "m": len(x), "matches": packed(x.astype(np.uint32), y.astype(np.uint32)),
    }


def _whole(batches):
    """Documents that were compared in part, as asked again with all their words."""
    for b in batches:
        out = []
        for number, *row, asked in zip(*(b.column(i) for i in range(7)), strict=True):
            block = Block(*row)
            for a in asked.as_py():
                x, y = unpacked(a["matches"], a["m"], np.uint32, np.uint32)
                out.append(asking(block, number.as_py(), a["own_place"], a["block"], a["place"], a["first_id"], x, y, None))
        yield pa.RecordBatch.from_pylist([{"bucket": None, **r} for r in out], WORK)


def _matched(buckets: int, bits: int, size: int, margin: int, again: bool):
    """Looks up the seeds of each block (again: its windows) in the answers. Out
    come, as rows of one kind: a document with its matches with one holder
    (block and place are the holder's), a holder (m is null), and entries of
    windows that are not settled (bucket isn't null)."""

    def run(batches):
        for rows in runs(batches):
            if rows.num_rows > 1 and rows.column(1)[0].as_py() == 0:  # the block comes first, then its answers
                number = rows.column(0)[0].as_py()
                block, rows = Block(*(rows.column(i)[0] for i in range(2, 7))), rows.slice(1)
                ns, data = rows.column(5).to_numpy(), rows.column(6).to_pylist()
                held = [unpacked(d, -int(n), np.uint32)[0] for d, n in zip(data, ns, strict=True) if n < 0]
                got = [unpacked(d, int(n), *ANSWER) for d, n in zip(data, ns, strict=True) if n > 0]
                out = {c: [] for c in WORK.names}

                def add(**row):
                    for c in WORK.names:
                        out[c].append(row.get(c))

                for place in np.unique(np.concatenate(held)).tolist() if held else []:
                    w = block.of(place)
                    add(block=number, place=place, n=len(w), data=packed(w))
                if got:
                    key, doc, at_block, place, word = (np.concatenate(c) for c in zip(*got, strict=True))
                    order = np.argsort(key)
                    key, doc, at_block, place, word = (c[order] for c in (key, doc, at_block, place, word))
                    seeds = [block.windows(size)] if again else block.seeds(bits)
                    cols: tuple = ([], [], [])  # place here, word here, answer
                    for which, (at, k) in enumerate(seeds):
                        i = np.minimum(np.searchsorted(key, k), len(key) - 1)
                        mine = block.doc[at]
                        hit = (key[i] == k) & (doc[i] != block.ids[mine])
                        if which == 0 and not again:
                            near = at, np.where(hit, i, -1)
                        at, mine, i = at[hit], mine[hit], i[hit]
                        # a key that comes back at once (words said over and over) has the same match: the first one stands
                        order = np.lexsort((at, i, mine))
                        back = (np.diff(mine[order]) == 0) & (np.diff(i[order]) == 0) & (np.diff(at[order]) < size)
                        stands = order[np.concatenate([[True], ~back])] if len(order) else order
                        for c, v in zip(cols, (mine[stands], (at - block.start[mine])[stands], i[stands]), strict=False):
                            c.append(v)
                    mine, x, i = (np.concatenate(c) for c in cols)
                    order = np.lexsort((x, place[i], at_block[i], mine))
                    mine, x, i = mine[order], x[order], i[order]
                    y = word[i].astype(np.int64)
                    step = (np.diff(mine) != 0) | (np.diff(at_block[i]) != 0) | (np.diff(place[i].astype(np.int64)) != 0)
                    for part in np.split(np.arange(len(i)), np.flatnonzero(step) + 1) if len(i) else []:
                        d, j = int(mine[part[0]]), int(i[part[0]])
                        px, py = x[part], y[part]
                        # of matches one after another on a diagonal some are enough
                        keep = np.ones(len(px), bool)
                        if again:
                            keep[1:] = (np.diff(px) != 1) | (np.diff(py) != 1) | (px[1:] % (size // 2) == 0)
                            keep[:-1] |= (np.diff(px) != 1) | (np.diff(py) != 1)
                            keep[-1] = True
                        else:
                            keep[1:] = (np.diff(px) != 0) | (np.diff(py) != 0)
                        px, py = px[keep], py[keep]
                        add(**asking(block, number, d, int(at_block[j]), int(place[j]), int(doc[j]), px, py, None if len(px) >= SURE else margin + (size if again else GRAM)))
                    if not again:
                        at, i = near
                        left, ends = [], np.searchsorted(at, np.concatenate([block.start, [len(block.words)]]))
                        name = np.unique(np.stack([at_block, place.astype(np.int64)]), axis=1, return_inverse=True)[1].reshape(-1)
                        for d in np.unique(mine).tolist():
                            s = slice(ends[d], ends[d + 1])
                            h = np.where(i[s] >= 0, name[i[s]], -1)
                            left.append(block.start[d] + unsettled(at[s] - block.start[d], word[i[s]].astype(np.int64), h, int(block.counts[d]), size))
                        left = np.concatenate(left) if left else np.zeros(0, np.int64)
                        if len(left):
                            keys = window_keys(block.words.astype(np.uint64), size)[left]
                            for e in zip(*(v for v in entries(block, number, left, keys, buckets).values()), strict=True):
                                add(bucket=e[0], block=e[1], n=e[2], data=e[3])
                yield pa.RecordBatch.from_pydict(out, WORK)

    return run


# ---- chains and their alignment -----------------------------------------------------


def chains(x: np.ndarray, y: np.ndarray) -> list[list[int]]:
    """Collinear chains of the matches (x, y): disjoint, both sides increasing,
    best first. A chain scores SEED_SCORE a seed less GAP_COST a word of gap on
    either side; the best predecessor of a match is the largest prefix maximum
    of score + cost * (x + y) over smaller y, kept in a Fenwick tree."""
    order = np.lexsort((-y, x))
    xs, ys = x[order], y[order]
    if len(xs) > 1 and (np.diff(xs) > 0).all() and (np.diff(ys) > 0).all() and (np.diff(xs) + np.diff(ys)).max() * GAP_COST < SEED_SCORE:
        return [order.tolist()]  # every match follows the one before at a gain: the tree would choose the same
    rank = np.searchsorted(np.unique(ys), ys) + 1
    size = int(rank.max())
    best, who = [0.0] * (size + 1), [-1] * (size + 1)
    score, back = [0.0] * len(xs), [-1] * len(xs)
    for i, (a, c, r) in enumerate(zip(xs.tolist(), ys.tolist(), rank.tolist(), strict=True)):
        top, j, q = 0.0, -1, r - 1
        while q > 0:
            if who[q] >= 0 and (j < 0 or best[q] > top):
                top, j = best[q], who[q]
            q -= q & -q
        gain = top - GAP_COST * (a + c) if j >= 0 else 0.0
        score[i] = SEED_SCORE + max(0.0, gain)
        back[i] = j if j >= 0 and gain > 0 else -1
        key, q = score[i] + GAP_COST * (a + c), r
        while q <= size:
            if who[q] < 0 or key > best[q]:
                best[q], who[q] = key, i
            q += q & -q
    out, used = [], [False] * len(xs)
    for i in sorted(range(len(xs)), key=lambda i: -score[i]):
        path = []
        while i >= 0 and not used[i]:
            used[i] = True
            path.append(int(order[i]))
            i = back[i]
        if path:
            out.append(path[::-1])
    return out


def grown(a: np.ndarray, c: np.ndarray) -> tuple[int, int, int]:
    """How far a run goes on, on either side, and how many words agree: the
    best end of an alignment with gaps, row by row, over the columns that have
    not fallen by more than DROP. A cell holds score * ONE + agreeing words."""
    most = min(len(a), len(c))
    n = 64
    while n < most and (a[:n] == c[:n]).all():  # equal words need no table
        n *= 4
    unlike = np.flatnonzero(a[: min(n, most)] != c[: min(n, most)])
    n = int(unlike[0]) if len(unlike) else most
    reach = n + DROP // -UNEQUAL + 1
    if set(a[n:reach].tolist()).isdisjoint(c[n:reach].tolist()):  # every way on falls by DROP
        return n, n, n
    # plain numbers: a row has some DROP cells, too few for arrays to pay
    a, c = a.tolist(), c.tolist()
    step, wide = UNEQUAL * ONE, DROP // -UNEQUAL
    best, end = n * (ONE * EQUAL + 1), (n, n, n)
    lo, row = n, [best + step * j for j in range(min(wide, len(c) - n) + 1)]
    for i in range(n, len(a)):
        w, least, new, left, before = a[i], best - DROP * ONE, [], NONE, NONE
        for j, here in enumerate(row, lo):  # column j is behind word j - 1 of c
            v = here + step
            if before > NONE and before + (ONE * EQUAL + 1 if c[j - 1] == w else step) > v:
                v = before + (ONE * EQUAL + 1 if c[j - 1] == w else step)
            before = here
            if left + step > v:
                v = left + step
            new.append(v)
            left = v
        j = lo + len(row)
        if j <= len(c):
            v = max(before + (ONE * EQUAL + 1 if c[j - 1] == w else step), left + step)
            new.append(v)
            while v + step >= least and lo + len(new) <= len(c):
                v += step
                new.append(v)
        top = max(new)
        if top > best:
            j = new.index(top)
            best, end = top, (i + 1, lo + j, top % ONE)
            least = best - DROP * ONE
        while new and new[-1] < least:
            new.pop()
        k = 0
        while k < len(new) and new[k] < least:
            k += 1
        if k == len(new):
            break
        lo, row = lo + k, new[k:]
    return end


def common_words(a: np.ndarray, c: np.ndarray) -> int:
    """Longest common subsequence of two gaps: a row of the table is the bits
    of one number, a word of c one addition."""
    where: dict = {}
    for i, w in enumerate(a.tolist()):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in c.tolist():
        if w in where:
            u = row & where[w]
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def lengthened(wx, wy, s: int, e: int, fs: int, fe: int, agree: int, min_words: int, min_identity: float):
    """A passage that is too short, gone on along the diagonals to agreeing
    words further out, if it then has min_words and min_identity; else None.
    The ends of growth are the best ones, not the furthest that are allowed."""
    most = max(0, int(agree / min_identity) - (e - s)) + min_words  # more words than that are never allowed
    n, m = min(s, fs, most), min(len(wx) - e, len(wy) - fe, most)
    p = np.concatenate([[0], np.flatnonzero(wx[s - n : s][::-1] == wy[fs - n : fs][::-1]) + 1])
    q = np.concatenate([[0], np.flatnonzero(wx[e : e + m] == wy[fe : fe + m]) + 1])
    size = p[:, None] + q
    got = agree + np.arange(len(p))[:, None] + np.arange(len(q))
    fit = (e - s + size >= min_words) & (got >= min_identity * (max(e - s, fe - fs) + size))
    if not fit.any():
        return None
    i, j = np.unravel_index(np.where(fit, size, -1).argmax(), size.shape)
    return s - int(p[i]), e + int(q[j]), fs - int(p[i]), fe + int(q[j]), int(got[i, j])


def aligned(wx, wy, xs, ys, k: int, min_words: int, min_identity: float) -> list[tuple[int, int, int, int, int]]:
    """(start, end, start, end, agreeing words) of the passages of a chain; xs
    and ys index wx and wy. The chain is a row of equal runs and the gaps
    between them. A passage goes from one run to another, on into the words
    beyond as far as they agree, and has min_words and min_identity by itself:
    runs with unlike text between them are passages of their own. Passages
    within others are left out."""
    first = np.flatnonzero(np.concatenate([[True], (np.diff(xs) != np.diff(ys)) | (np.diff(xs) > k)]))
    last = np.concatenate([first[1:], [len(xs)]]) - 1
    runs, ex, ey = [], 0, 0
    for a, c, e in zip(xs[first].tolist(), ys[first].tolist(), (xs[last] + k).tolist(), strict=True):
        n, cut = e - a, max(0, ex - a, ey - c) if runs else 0
        if cut < n:
            runs.append((a + cut, c + cut, n - cut))
            ex, ey = a + n, c + n
    a, c, n = np.array(runs).T
    gaps = list(zip([0, *(a + n)], [*a, len(wx)], [0, *(c + n)], [*c, len(wy)], strict=True))  # before, between and after
    agree = np.cumsum(n + np.array([0] + [common_words(wx[p:q], wy[u:v]) for p, q, u, v in gaps[1:-1]]))
    left, right = grown(wx[: a[0]][::-1], wy[: c[0]][::-1]), grown(wx[ex:], wy[ey:])
    s, e, fs, fe, got = int(a[0]) - left[0], ex + right[0], int(c[0]) - left[1], ey + right[1], int(agree[-1]) + left[2] + right[2]
    if e - s < min_words:
        more = lengthened(wx, wy, s, e, fs, fe, got, min_words, min_identity)
        return [more] if more else []
    if got >= min_identity * max(e - s, fe - fs):
        return [(s, e, fs, fe, got)]
    before = np.array([left] + [grown(wx[p:q][::-1], wy[u:v][::-1]) for p, q, u, v in gaps[1:-1]])
    after = np.array([grown(wx[p:q], wy[u:v]) for p, q, u, v in gaps[1:-1]] + [right])
    out, seen = [], -1
    for i in range(len(a)):
        if i and seen == len(a) - 1:
            break
        pick = None
        for left in (before[i], np.zeros(3, int)):
            for right in (after[i:], np.zeros((len(a) - i, 3), int)):
                s, fs = a[i] - left[0], c[i] - left[1]
                e, fe = (a + n)[i:] + right[:, 0], (c + n)[i:] + right[:, 1]
                got = agree[i:] - agree[i] + n[i] + left[2] + right[:, 2]
                fit = np.flatnonzero((e - s >= min_words) & (got >= min_identity * np.maximum(e - s, fe - fs)))
                if len(fit) and (pick is None or fit[-1] + i > pick[0]):
                    j = int(fit[-1])
                    pick = (j + i, (int(s), int(e[j]), int(fs), int(fe[j]), int(got[j])))
        if pick and pick[0] > seen:
            seen = pick[0]
            out.append(pick[1])
    return out


FOUND = pa.schema([(c, pa.binary() if c == "text" else pa.int64()) for c in ("doc_id", "text", "s", "e", "first_id", "fs", "fe", "agree")] + [(c, pa.int64()) for c in ("block", "place", "own_block", "own_place", "m")] + [("matches", pa.binary())])


def _passages(k: int, min_words: int, min_identity: float):
    """Chains of each document with each holder, and their passages. Where one
    comes close to the end of the words that were sent, though the document
    goes on, the row is returned (m isn't null, s and e are those ends) to be
    asked again."""

    def run(batches):
        for b in batches:
            out = {c: [] for c in FOUND.names}
            for row in (row for at in range(0, b.num_rows, 64) for row in b.slice(at, 64).to_pylist()):
                lo, n = row["lo"], row["n"]
                wx, wy = unpacked(row["data"], n, np.uint32)[0], unpacked(row["hdata"], row["hn"], np.uint32)[0]
                x, y = (v.astype(np.int64) for v in unpacked(row["matches"], row["m"], np.uint32, np.uint32))
                x -= lo
                known: list = []
                for path in chains(x, y):
                    if any(p[0] <= x[path[0]] and x[path[-1]] + k <= p[1] for p in known):
                        continue  # a better chain's passage has all of it
                    known += aligned(wx, wy, x[path], y[path], k, min_words, min_identity)
                close = min_words // 2
                if any((lo and s < close) or (row["left"] and e > n - close) for s, e, *_ in known):
                    known = []
                    for c, v in {c: row.get(c) for c in FOUND.names}.items():
                        out[c].append(lo if c == "s" else lo + n if c == "e" else v)
                for s, e, fs, fe, agree in known:
                    for c, v in zip(FOUND.names, (row["doc_id"], row["text"], int(s) + lo, int(e) + lo, row["first_id"], int(fs), int(fe), int(agree), *[None] * 6), strict=True):
                        out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, FOUND)

    return run


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'binary' if pa.types.is_binary(f.type) else 'long'}" for f in schema)


def repeated_passages(docs: DataFrame, min_words: int = 50, min_identity: float = 0.8) -> DataFrame:
    """Passages of at least min_words words that an earlier document (smaller
    doc_id) also has, with at least min_identity of the words agreeing.

    docs: any columns; doc_id (long) and text are read, whole. A row a passage:
    doc_id, text_md5 (of the row's text, as rows may share a doc_id), start_word,
    end_word (exclusive), n_words, identity (agreeing words over the longer
    side, weighted by length), first_ids (sorted array of the earlier documents
    it was found in). Words are compared with A-Z lower-cased. Null, empty and
    short texts and null doc_ids have no passages; an empty table gives none.
    Rows that share a doc_id count as one document and do not repeat each
    other; each has its own passages, equal rows the same ones once. Of several
    equal holders the one with the smallest doc_id counts, then the first block.

    Equal passages are always found, but for up to NEAR[1] + GRAM words at either
    end where another holder has the rest. One that differs is found if one of
    its seeds, as it stands, was first held by a document that has the passage.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(F.col("text").cast("string"))).alias("key"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    relieve(docs.sparkSession)
    blocks = stored(texts.mapInArrow(tidy(_blocks(BLOCK_BYTES)), BLOCK).withColumn("block", F.monotonically_increasing_id()).select("block", "ids", "texts", "counts", "n", "words"), "blocks")
    words = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(1, words // (2 * BUCKET))

    bits = min(64, SPARE_BITS + max(1, words).bit_length())
    block_columns = ["block", "ids", "texts", "counts", "n", "words"]

    def looked_up(found: DataFrame, again: bool) -> DataFrame:
        by_bucket = found.select("bucket", "block", "n", "data").repartition("bucket").sortWithinPartitions("bucket")
        answers = by_bucket.mapInArrow(tidy(_first_holders), "block long, n long, data binary")
        rest = {"ids": "array<long>", "texts": "array<binary>", "counts": "array<int>"}
        answers = answers.select("block", F.lit(1).alias("part"), *[F.lit(None).cast(t).alias(c) for c, t in rest.items()], "n", F.col("data").alias("words"))
        at = blocks.select("block", F.lit(0).alias("part"), *block_columns[1:]).unionByName(answers).repartition("block").sortWithinPartitions("block", "part")
        relieve(docs.sparkSession)
        return stored(at.mapInArrow(tidy(_matched(buckets, bits, min_words, MARGIN, again)), _ddl(WORK)), "work")

    def compared(asked: DataFrame, held: DataFrame, k: int) -> DataFrame:
        holders = held.where("m is null and bucket is null").select("block", "place", F.col("n").alias("hn"), F.col("data").alias("hdata"))
        # a merge join puts a shuffle between two Python steps, so that a task has one worker
        both = asked.where("m is not null").drop("bucket").join(holders.hint("merge"), ["block", "place"])
        relieve(docs.sparkSession)
        return stored(both.mapInArrow(tidy(_passages(k, min_words, min_identity)), _ddl(FOUND)), "passages")

    def passages(work: DataFrame, k: int) -> list[DataFrame]:
        found = [compared(work, work, k)]
        # what a passage with a holder that was compared covers needs no other holder
        clear = found[0].where("m is null").select("doc_id", "text", F.col("s").alias("from"), F.col("e").alias("to")).distinct()
        part = found[0].where("m is not null").alias("p").join(clear.alias("c"), F.expr("p.doc_id = c.doc_id and p.text = c.text and c.from <= p.s and p.e <= c.to"), "left_anti")
        part = part.select("own_block", F.struct("own_place", "block", "place", "first_id", "m", "matches").alias("asked"))
        if part.take(1):
            asked = part.groupBy(F.col("own_block").alias("block")).agg(F.collect_list("asked").alias("asked"))
            found.append(compared(blocks.join(asked.hint("merge"), "block").select(*block_columns, "asked").mapInArrow(tidy(_whole), _ddl(WORK)), work, k))
        return [df.where("m is null").select("doc_id", "text", "s", "e", "first_id", "fs", "fe", "agree") for df in found]

    seeds = blocks.select(*block_columns).mapInArrow(tidy(_seed_entries(buckets, bits)), _ddl(ENTRIES))
    work = looked_up(seeds, False)
    found = passages(work, GRAM)
    more = looked_up(work.where("bucket is not null").select("bucket", "block", "n", "data"), True)
    release(work)
    found += passages(more, min_words)
    release(more, blocks)
    every = found[0]
    for df in found[1:]:
        every = every.unionByName(df)

    by = W.partitionBy("doc_id", "text").orderBy("s", "e", "first_id")
    seen = F.max("e").over(by.rowsBetween(W.unboundedPreceding, -1))
    isle = every.withColumn("new", F.when(F.col("s") <= seen, 0).otherwise(1)).withColumn("isle", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    longer = F.greatest(F.col("e") - F.col("s"), F.col("fe") - F.col("fs"))
    out = isle.groupBy("doc_id", "text", "isle").agg(
        F.min("s").alias("start_word"), F.max("e").alias("end_word"), (F.sum("agree") / F.sum(longer)).alias("identity"), F.array_sort(F.collect_set("first_id")).alias("first_ids")
    )
    return out.select("doc_id", F.lower(F.hex("text")).alias("text_md5"), "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "identity", "first_ids")


def without(text: str | None, spans) -> str | None:
    """text without its words start..end (exclusive) of each span, and without
    the white space that follows them."""
    if not text or not spans:
        return text
    at = [m.start() for m in WORD.finditer(text)] + [len(text)]
    out, here = [], 0
    for s, e in sorted(spans):
        if s < e and s < len(at) - 1:
            a, z = at[s], at[min(e, len(at) - 1)]
            out.append(text[here : max(here, a)])
            here = max(here, z)
    return "".join(out) + text[here:]


def _cut(name: str):
    def run(batches):
        for b in batches:
            i, j = b.schema.names.index("text"), b.schema.names.index(name)
            texts = [without(t, [(x["s"], x["e"]) for x in s] if s else None) for t, s in zip(b.column(i).to_pylist(), b.column(j).to_pylist(), strict=True)]
            cols = [pa.array(texts, pa.string()) if n == "text" else b.column(n) for n in b.schema.names if n != name]
            yield pa.RecordBatch.from_arrays(cols, [n for n in b.schema.names if n != name])

    return run


def deduplicated(docs: DataFrame, min_words: int = 50, min_identity: float = 0.8) -> DataFrame:
    """docs with the repeated passages cut out of all but their first document;
    every row and column stays, n_chars (if there) follows the text.

    Spans belong to a doc_id and a text, so rows that share a doc_id lose only
    what their own text repeats, and equal rows lose the same. Rows with a null
    doc_id, null and empty texts stay as they are; other columns may have any
    name. An empty table comes back empty.
    """
    who, what, cut = free_names(docs, 3)
    # merge joins, here and above, at every size: spans grow with the documents
    spans = repeated_passages(docs, min_words, min_identity).groupBy(F.col("doc_id").alias(who), F.col("text_md5").alias(what))
    spans = spans.agg(F.collect_list(F.struct(F.col("start_word").alias("s"), F.col("end_word").alias("e"))).alias(cut))
    out = docs.withColumns({who: F.col("doc_id").cast("long"), what: F.md5(F.col("text").cast("string"))}).join(spans.hint("merge"), [who, what], "left").select(*docs.columns, cut).mapInArrow(tidy(_cut(cut)), docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
