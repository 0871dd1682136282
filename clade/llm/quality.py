"""Document quality by a linear-chain conditional random field over lines.

Every non-blank line is good or bad. A line is scored from its own features and
those of the lines before and after it, and labels of successive lines depend
on each other. Forward-backward gives each line's probability of being bad;
their mean, weighted by line length, is the document's badness, which a
one-variable logistic regression turns into a score.

Labels are per document, so training is by self-labelling: first every line of
a bad document counts as bad; then the lines that the fitted field finds good
are relabelled (the worst line of a bad document stays bad), and it is refitted.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _SPACE, WordHashes, byte_runs, lists, tidy

#: The training sample: documents and bytes of text at most (of the smallest
#: hashed ids those that fit, whole), rounds of relabelling, gradient steps, rate, penalty.
SAMPLE, SAMPLE_BYTES, ROUNDS, STEPS, RATE, PENALTY = 3000, 24_000_000, 2, 120, 0.1, 1e-3

_KINDS = np.zeros((6, 256), np.float32)  # letters, capitals, digits, other printables, bytes of non-ASCII letters, white space
_KINDS[0, 97:123] = _KINDS[1, 65:91] = _KINDS[2, 48:58] = _KINDS[4, 128:] = 1
_KINDS[5, _SPACE] = 1
_KINDS[3] = (_KINDS.sum(axis=0) == 0)
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True
N_FEATURES = 12


class LineFeatures:
    """Features of the non-blank lines of a run of texts."""

    def __init__(self):
        self.words, self.lines = WordHashes(), WordHashes(_NEWLINE)

    def __call__(self, b: np.ndarray, bounds: np.ndarray):
        """(features, length, lines of each text)."""
        ls, le, lh = self.lines.spans(b, bounds)
        ws, we, wh = self.words.spans(b, bounds)
        of = np.searchsorted(ls, ws, "right") - 1  # the line of each word
        n_words = np.bincount(of, minlength=len(ls)).astype(np.float64)
        full = n_words > 0
        number = np.cumsum(full) - 1
        ls, le, lh, n_words, of = ls[full], le[full], lh[full], n_words[full], number[of]
        n = len(ls)
        counts = np.diff(np.searchsorted(ls, bounds))
        if n == 0:
            return np.zeros((0, N_FEATURES)), np.zeros(0), counts
        size = (le - ls).astype(np.float64)
        share = np.empty((5, n))
        for i in range(5):
            sums = np.concatenate([[0], np.cumsum(_KINDS[i][b], dtype=np.float64)])
            share[i] = (sums[le] - sums[ls]) / size
        # runs of one byte, such as *** or ....
        same = np.concatenate([[0], np.cumsum(np.concatenate([[False], (b[1:] == b[:-1]) & (_KINDS[3][b[1:]] > 0)]), dtype=np.float64)])
        runs = (same[le] - same[ls]) / n_words
        nxt = np.bincount(of[1:], weights=(wh[1:] == wh[:-1]) & (of[1:] == of[:-1]), minlength=n)
        distinct = np.unique(wh ^ (of.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), return_index=True)[1]
        kinds = np.bincount(of[distinct], minlength=n) / n_words
        doc = np.repeat(np.arange(len(counts)), counts)
        key = lh ^ (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        _, inverse, many = np.unique(key, return_inverse=True, return_counts=True)
        odd_end = np.bincount(of, weights=_KINDS[3][b[we - 1]] > 0, minlength=n) / n_words
        mean = np.bincount(of, weights=we - ws, minlength=n) / n_words
        x = np.stack(
            [np.log1p(size) / 4, np.log1p(mean), *share, runs, nxt / n_words, (1 - kinds) * np.minimum(1, n_words / 200 + 0.2), (many[inverse] > 1).astype(float), odd_end], axis=1
        )
        return x, size, counts


def with_neighbours(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each line's features, those of the lines before and after it in its
    document (zeros at the ends), and one."""
    n, f = x.shape
    ends = np.cumsum(counts)
    first = (ends - counts)[counts > 0]
    last = ends[counts > 0] - 1
    before, after = np.zeros((n, f)), np.zeros((n, f))
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first] = after[last] = 0
    return np.concatenate([x, before, after, np.ones((n, 1))], axis=1)


@dataclass
class Model:
    weights: np.ndarray  # of a line's features, for the label bad
    moves: np.ndarray  # scores of successive labels, 2 x 2
    mean: np.ndarray
    scale: np.ndarray
    slope: float
    offset: float
    prior: float  # score where there is no line

    def badness(self, x, size, counts) -> np.ndarray:
        """Length-weighted mean of the lines' probability of being bad; NaN without lines."""
        out = np.full(len(counts), np.nan)
        if len(x):
            p = marginals(with_neighbours((x - self.mean) / self.scale, counts) @ self.weights, self.moves, counts)[0]
            doc = np.repeat(np.arange(len(counts)), counts)
            have = counts > 0
            out[have] = (np.bincount(doc, weights=p * size, minlength=len(counts)) / np.maximum(np.bincount(doc, weights=size, minlength=len(counts)), 1))[have]
        return out

    def score(self, x, size, counts) -> np.ndarray:
        bad = self.badness(x, size, counts)
        return np.where(np.isnan(bad), self.prior, _sigmoid(self.slope * _logit(np.nan_to_num(bad)) + self.offset))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def marginals(scores: np.ndarray, moves: np.ndarray, counts: np.ndarray):
    """Forward-backward over all documents at once: each line's probability of
    being bad, and the expected number of each succession of labels."""
    docs = np.flatnonzero(counts)
    docs = docs[np.argsort(-counts[docs], kind="stable")]
    first, n = (np.cumsum(counts) - counts)[docs], counts[docs]
    emit = np.stack([np.ones(len(scores)), np.exp(np.clip(scores, -30, 30))], axis=1)
    step = np.exp(moves)
    ahead, back = np.empty_like(emit), np.ones_like(emit)
    deep = int(n[0]) if len(n) else 0
    live = [int(np.searchsorted(-n, -t, "left")) for t in range(deep + 1)]  # documents with more than t lines
    for t in range(deep):
        at = first[: live[t]] + t
        a = emit[at] if t == 0 else emit[at] * (ahead[at - 1] @ step)
        ahead[at] = a / a.sum(axis=1, keepdims=True)
    moved = np.zeros((2, 2))
    for t in range(deep - 2, -1, -1):
        at = first[: live[t + 1]] + t
        after = emit[at + 1] * back[at + 1]
        both = ahead[at][:, :, None] * step * after[:, None, :]
        moved += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        z = after @ step.T
        back[at] = z / z.sum(axis=1, keepdims=True)
    p = ahead * back
    return p[:, 1] / p.sum(axis=1), moved


def fit(x: np.ndarray, size: np.ndarray, counts: np.ndarray, good: np.ndarray) -> Model:
    """The field and the score from documents' lines and labels (1: good)."""
    prior = (good.sum() + 1) / (len(good) + 2) if len(good) else 0.5
    f = x.shape[1]
    if len(x) == 0 or good.min() == good.max():
        return Model(np.zeros(3 * f + 1), np.zeros((2, 2)), np.zeros(f), np.ones(f), 0.0, float(_logit(prior)), float(prior))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = with_neighbours((x - mean) / scale, counts)
    doc = np.repeat(np.arange(len(counts)), counts)
    in_bad = good[doc] == 0
    y = in_bad.astype(np.int64)
    inner = doc[1:] == doc[:-1]
    for _ in range(ROUNDS):
        weights, moves = np.zeros(z.shape[1]), np.zeros((2, 2))
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:-1][inner], y[1:][inner]), 1)
        m1, m2, v1, v2 = np.zeros_like(weights), np.zeros((2, 2)), np.zeros_like(weights), np.zeros((2, 2))
        for i in range(1, STEPS + 1):
            p, moved = marginals(z @ weights, moves, counts)
            g1, g2 = z.T @ (p - y) / len(y) + PENALTY * weights, (moved - seen) / len(y) + PENALTY * moves
            m1, v1 = 0.9 * m1 + 0.1 * g1, 0.99 * v1 + 0.01 * g1**2
            m2, v2 = 0.9 * m2 + 0.1 * g2, 0.99 * v2 + 0.01 * g2**2
            for a, m, v in ((weights, m1, v1), (moves, m2, v2)):
                a -= RATE * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
        p = marginals(z @ weights, moves, counts)[0]
        worst = np.zeros(len(counts))
        np.maximum.at(worst, doc, p)
        y = (in_bad & ((p >= 0.5) | (p >= worst[doc]))).astype(np.int64)
    model = Model(weights, moves, mean, scale, -1.0, 0.0, float(prior))
    bad = model.badness(x, size, counts)
    have = ~np.isnan(bad)
    u, t = _logit(bad[have]), good[have].astype(float)
    a = np.array([-1.0, 0.0])
    design = np.stack([u, np.ones(len(u))], axis=1)
    for _ in range(30):  # Newton steps of the logistic regression
        p = _sigmoid(design @ a)
        h = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, design.T @ (p - t) + 1e-3 * (a - [-1.0, 0.0]))
        a -= step / max(1.0, np.abs(step).max() / 2)  # classes that are apart have no finite optimum to jump to
    model.slope, model.offset = float(min(a[0], 0.0)), float(a[1])
    return model


def _line_rows(batches):
    features = LineFeatures()
    for b in batches:
        for lo, data, bounds in byte_runs(b.column(2)):
            x, size, counts = features(data, bounds)
            ends = np.cumsum(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0)[lo : lo + len(counts)],
                    b.column(1)[lo : lo + len(counts)],
                    lists([x[e - c : e].reshape(-1) for e, c in zip(ends, counts, strict=True)], pa.float64()),
                    lists([size[e - c : e] for e, c in zip(ends, counts, strict=True)], pa.float64()),
                ],
                ["doc_id", "good", "x", "size"],
            )


def held_out(doc_id) -> F.col:
    """Rows that no model may learn from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on a bounded sample of labelled documents that are not held out: the
    sample smallest hashed ids, without those that no longer fit into
    SAMPLE_BYTES. Each is learned from whole."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("good"))
    picked = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    room, fits = SAMPLE_BYTES, []
    for r in texts.join(picked, "doc_id").groupBy("doc_id", "good").agg(F.sum(F.octet_length("text")).alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():  # sample rows at most
        if (r.n or 0) <= room:
            room -= r.n or 0
            fits.append((r.doc_id, r.good))
    chosen = docs.sparkSession.createDataFrame(fits, "doc_id long, good int")
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "good", "text").mapInArrow(_line_rows, "doc_id long, good int, x array<double>, size array<double>")
    got = rows.toArrow().sort_by([("doc_id", "ascending")])
    sizes, xs = got["size"].combine_chunks(), got["x"].combine_chunks()
    if len(got) == 0:
        return fit(np.zeros((0, N_FEATURES)), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
    counts = sizes.value_lengths().to_numpy().astype(np.int64)
    return fit(xs.flatten().to_numpy().reshape(-1, N_FEATURES), sizes.flatten().to_numpy(), counts, got["good"].to_numpy())


def _scored(model: Model):
    def run(batches):
        features = LineFeatures()
        for b in batches:
            for lo, data, bounds in byte_runs(b.column(1)):
                s = model.score(*features(data, bounds))
                yield pa.RecordBatch.from_arrays([b.column(0)[lo : lo + len(s)], pa.array(s)], ["doc_id", "score"])

    return run


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Quality of every document: doc_id, held_out, score (0 to 1, higher is
    better), predicted (1 if score >= 0.5).

    docs: any columns; doc_id and text are read, whole. labels: doc_id and
    quality (0 or 1; other values and null ids are ignored; of labels that
    disagree the lower counts). A text without a non-blank line, null or empty,
    scores the share of good documents in training; without labels of both
    kinds every document does. Repeated rows come back repeated.
    """
    model = train(docs, labels, sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = texts.mapInArrow(tidy(_scored(model)), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs without those that the classifier rejects; all columns stay. The
    score is computed beside each row, so rows with null or repeated ids keep
    their own decision."""
    model = train(docs, labels, sample)

    def run(batches):
        features = LineFeatures()
        for b in batches:
            for lo, data, bounds in byte_runs(b.column(b.schema.names.index("text"))):
                s = model.score(*features(data, bounds))
                yield b.slice(lo, len(s)).filter(pa.array(s >= 0.5))

    return docs.mapInArrow(tidy(run), docs.schema)
