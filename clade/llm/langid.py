"""Language identification as inference in a mixture of languages.

Training counts hashed byte n-grams by language. A document is a bag of
n-grams, each drawn from one of an unknown set of languages in unknown
proportions. Expectation-maximisation estimates the proportions; the set is
chosen by penalised likelihood among the nested sets of the languages with the
largest proportions. The prediction is the language of the largest share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, byte_runs, mixed

#: n-gram length in bytes, hash buckets, EM steps, weight of the unseen; the
#: penalty for a language is PENALTY * log(n-grams); bytes that a run of documents holds.
GRAM, BUCKETS, STEPS, SMOOTH, PENALTY, RUN = 4, 1 << 15, 12, 0.5, 3.0, 1 << 18


def buckets(b: np.ndarray, bounds: np.ndarray):
    """(bucket, document) of every n-gram of the texts that b and bounds hold.
    A-Z are folded; n-grams don't cross documents."""
    x = _BYTE[b]
    n = len(x) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = x[:n]
    for i in range(1, GRAM):
        h = h * np.uint64(0x9E3779B97F4A7C15) + x[i : n + i]
    doc = np.searchsorted(bounds, np.arange(n), "right") - 1
    inside = np.arange(n) + GRAM <= bounds[doc + 1]
    return (mixed(h[inside]) & np.uint64(BUCKETS - 1)).astype(np.int64), doc[inside]


def _counted(langs: list):
    place = {v: i for i, v in enumerate(langs)}

    def run(batches):
        total = np.zeros((len(langs), BUCKETS), np.int64)
        for b in batches:
            of = np.array([place[v] for v in b.column(0).to_pylist()], np.int64)
            for lo, data, bounds in byte_runs(b.column(1)):
                k, doc = buckets(data, bounds)
                total += np.bincount(of[lo + doc] * BUCKETS + k, minlength=total.size).reshape(total.shape)
        lang, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[lang, bucket])], ["lang", "bucket", "n"])

    return run


def held_out(doc_id):
    """Rows that no model may learn from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame):
    """(languages, log-probabilities of buckets by language) from the text and
    lang of every document that isn't held out. A task adds up its own counts
    before the shuffle; the table that reaches the driver is languages x
    BUCKETS, for every language there is."""
    rows = docs.where("lang is not null and text is not null").where(~held_out(F.col("doc_id").cast("long"))).select(F.col("lang").cast("string").alias("lang"), "text")
    langs = sorted(r[0] for r in rows.select("lang").distinct().collect())
    if not langs:
        return [], np.zeros((0, BUCKETS), np.float32)
    got = rows.mapInArrow(_counted(langs), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full((len(langs), BUCKETS), SMOOTH)
    counts[got["lang"].to_numpy(), got["bucket"].to_numpy()] += got["n"].to_numpy()
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def mixture(counts: np.ndarray, doc: np.ndarray, n_docs: int, p: np.ndarray, live: np.ndarray):
    """EM over many documents at once. counts, doc: of the distinct n-grams,
    documents in order; p: probabilities, n-grams x languages; live: languages
    that a document's set holds. Returns proportions and log-likelihoods."""
    first = np.searchsorted(doc, np.arange(n_docs))
    share = live / np.maximum(live.sum(axis=1, keepdims=True), 1)
    weight = counts[:, None]
    total = np.maximum(np.bincount(doc, weights=counts, minlength=n_docs), 1)[:, None]
    for _ in range(STEPS):
        r = p * share[doc]
        z = r.sum(axis=1, keepdims=True)
        r *= weight / z
        share = np.add.reduceat(r, first, axis=0) / total
    return share, np.add.reduceat(counts * np.log((p * share[doc]).sum(axis=1)), first)


def infer(k: np.ndarray, doc: np.ndarray, n_docs: int, logp: np.ndarray):
    """Proportions of the chosen languages of each document (rows of zeros
    where it has no n-gram). k, doc: its n-grams' buckets, documents in order."""
    n_langs = len(logp)
    out = np.zeros((n_docs, n_langs))
    if len(k) == 0:
        return out
    key, counts = np.unique(doc * BUCKETS + k, return_counts=True)
    doc, k = key // BUCKETS, key % BUCKETS
    have, doc = np.unique(doc, return_inverse=True)
    counts = counts.astype(np.float64)
    table = logp.T.astype(np.float64)
    lp = table[k]
    first = np.searchsorted(doc, np.arange(len(have)))
    alone = np.add.reduceat(lp * counts[:, None], first, axis=0)
    total = np.add.reduceat(counts, first)
    best, top = alone.max(axis=1), alone.argmax(axis=1)
    share = np.zeros((len(have), n_langs))
    share[np.arange(len(have)), top] = 1
    cost = PENALTY * np.log(total + 1)
    # no mixture can beat each n-gram's best language: documents where even that doesn't pay are settled
    bound = np.add.reduceat(lp.max(axis=1) * counts, first) - best
    open_ = np.flatnonzero(bound > cost) if n_langs > 1 else np.zeros(0, int)
    if len(open_):
        place = np.full(len(have), -1)
        place[open_] = np.arange(len(open_))
        inside = place[doc] >= 0
        d, c = place[doc[inside]], counts[inside]
        p = np.exp(lp[inside])
        full, like = mixture(c, d, len(open_), p, np.ones((len(open_), n_langs)))
        rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1, kind="stable")
        chosen, value = share[open_], best[open_].copy()
        rest = np.flatnonzero(like - cost[open_] > value)
        for size in range(2, n_langs + 1):
            if len(rest) == 0:
                break
            at = np.full(len(open_), -1)
            at[rest] = np.arange(len(rest))
            ok = at[d] >= 0
            got, l = mixture(c[ok], at[d[ok]], len(rest), p[ok], (rank[rest] < size).astype(float))
            worth = l - (size - 1) * cost[open_][rest]
            better = worth > value[rest]
            value[rest[better]] = worth[better]
            chosen[rest[better]] = got[better]
            rest = rest[like[rest] - size * cost[open_][rest] > value[rest]]
        share[open_] = chosen
    out[have] = share
    return out


def _predicted(langs: list[str], logp: np.ndarray):
    def run(batches):
        for b in batches:
            texts = b.column(1)
            for lo, data, bounds in byte_runs(texts, max(1, RUN * 8 // max(8, len(langs)))):  # n-grams x languages stay as many
                n = len(bounds) - 1
                share = infer(*buckets(data, bounds), n, logp) if langs else np.zeros((n, 0))
                pred, score, every = [], [], []
                for i, t in enumerate(texts.slice(lo, n).to_pylist()):
                    s = share[i]
                    if not langs or not t or not any(map(str.isalpha, t)):
                        pred.append("und")
                        score.append(0.0)
                        every.append([])
                        continue
                    if not s.any():  # a letter, but too short for an n-gram: all languages alike
                        s = np.full(len(langs), 1 / len(langs))
                    pred.append(langs[int(s.argmax())])
                    score.append(float(min(1.0, s.max())))
                    every.append([{"lang": langs[j], "share": float(s[j])} for j in np.argsort(-s, kind="stable") if s[j] > 0])
                kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
                yield pa.RecordBatch.from_arrays([b.column(0)[lo : lo + n], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(every, kind)], ["doc_id", "lang_pred", "score", "languages"])

    return run


def identified(docs: DataFrame, training: DataFrame | None = None) -> DataFrame:
    """Language of every document: doc_id, held_out, lang_pred, score (share of
    that language), languages (array of lang and share, largest first).

    docs: any columns; doc_id and text are read, whole; training (docs by
    default): doc_id, text, lang. A null text, an empty one, and one without a
    letter is `und` with score 0; so is everything when nothing could be
    learned. Texts too short for an n-gram count as all languages alike.
    Repeated rows come back repeated.
    """
    langs, logp = train(docs if training is None else training)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = texts.mapInArrow(_predicted(langs, logp), "doc_id long, lang_pred string, score double, languages array<struct<lang:string,share:double>>")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "languages")
