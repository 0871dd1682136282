"""Repeated ids, null ids, clashing names, damaged values, and plain versions."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from clade.llm import common, jaccard, jpeg, langid, mixing, quality, registry, urls

CLASH = "doc_id long, text string, source string, __keep int, __copies int, __doc int, __n int, _c0 int, size int, h int, row int, copies int, lam int, rounds int"


def clashing(spark, rows):
    return spark.createDataFrame([(*r, *range(11)) for r in rows], CLASH)


def test_free_names(spark):
    df = spark.createDataFrame([(1, 2)], "_C0 int, _c2 int")
    assert common.free_names(df, 2) == ["_c1", "_c3"]


def test_resampling_of_repeated_ids(spark):
    r = random.Random(0)
    rows = [(k // 3, "w " * r.randint(0, 9) + str(k), "abc"[k % 7 % 3]) for k in range(400)] + [(None, f"n{k} x", "a") for k in range(30)] + [(None, None, None), (None, "", "a")]
    df = clashing(spark, rows)
    got = mixing.resampled(df)
    assert got.columns == df.columns
    many: dict = {}
    for x in got.collect():
        many[x.doc_id, x.text, x.source] = many.get((x.doc_id, x.text, x.source), 0) + 1
    rates = mixing._taken(mixing._weighed(df), mixing._balanced(mixing._weighed(df), 3, 3), 3)
    want = {x.h: x.copies for x in rates.collect()}
    keys = df.select("doc_id", "text", "source", mixing._hash().alias("k")).collect()
    assert many == {(k.doc_id, k.text, k.source): want[k.k] for k in keys if want[k.k]}
    assert len({k.k for k in keys}) == len(rows)


def test_mixing_with_many_sources(spark, monkeypatch):
    rows = [(k, "w " * (k % 9), f"s{k % 40}") for k in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(mixing.mixed(df).collect())
    monkeypatch.setattr(mixing, "SMALL", 5)
    assert sorted(mixing.mixed(df).collect()) == want


def test_near_duplicates_of_repeated_ids(spark):
    one, two = "a b c d e f g", "h i j k l m n"
    rows = [(1, one), (5, one.upper()), (5, two), (5, two), (6, two), (7, None), (7, None), (8, ""), (None, one), (None, one)]
    df = clashing(spark, [(i, t, "s") for i, t in rows])
    out = jaccard.deduplicated(df)
    assert out.columns == df.columns
    assert sorted(((x.doc_id or 0), x.text or "") for x in out.collect()) == sorted([(1, one), (5, two), (5, two), (7, ""), (7, ""), (8, ""), (0, one), (0, one)])
    assert jaccard.deduplicated(df.limit(0)).count() == 0


def test_a_long_text_among_sets(spark):
    r = random.Random(3)
    long = [f"w{r.randint(0, 10**6)}" for _ in range(200_000)]
    near = [w if k % 500 else "x" for k, w in enumerate(long)]
    df = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(long[:1000]))], "doc_id long, text string")
    assert {x.doc_id: x.component_id for x in jaccard.near_duplicates(df, 3, 90).collect()} == {1: 1, 2: 1, 3: 3}


def test_damaged_media(spark):
    good = jpeg.encode(np.arange(64, dtype=np.uint8), np.array([64]))[0]
    rows = [(1, 64, good), (2, 3, b"GIF"), (3, 9, good[:-30]), (4, 0, None), (5, 0, b""), (6, 64, good)]
    got = {x.doc_id: x for x in jpeg.media_features(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary").coalesce(1)).collect()}
    assert got[1].payload_bytes == got[6].payload_bytes == 64 and got[1].error is None
    assert got[2].payload_sha256 is None and got[2].error and got[3].feature is None and got[3].error
    assert got[4].payload_bytes == got[5].payload_bytes == 0 and got[4].error is None


def plain_mixture(counts, p, chosen):
    """EM for one document and one set of languages, a number at a time."""
    share = {j: 1 / len(chosen) for j in chosen}
    for _ in range(langid.STEPS):
        new = dict.fromkeys(chosen, 0.0)
        for c, row in zip(counts, p):
            z = sum(row[j] * share[j] for j in chosen)
            for j in chosen:
                new[j] += c * row[j] * share[j] / z
        share = {j: v / sum(counts) for j, v in new.items()}
    return share, sum(c * np.log(sum(row[j] * share[j] for j in chosen)) for c, row in zip(counts, p))


def test_mixture_against_plain_em():
    r = np.random.default_rng(0)
    n_langs = 4
    p = r.dirichlet(np.full(langid.BUCKETS, 0.02), n_langs) + 1e-9
    logp = np.log(p / p.sum(axis=1, keepdims=True))
    for _ in range(6):
        shares = r.dirichlet([0.4] * n_langs)
        k = np.concatenate([r.choice(langid.BUCKETS, int(400 * s) + 1, p=np.exp(logp[j]) / np.exp(logp[j]).sum()) for j, s in enumerate(shares)])
        got = langid.infer(k, np.zeros(len(k), np.int64), 1, logp)[0]
        at, counts = np.unique(k, return_counts=True)
        rows = np.exp(logp[:, at]).T
        full = plain_mixture(counts, rows, range(n_langs))[0]
        order = sorted(range(n_langs), key=lambda j: -full[j])
        best, value = None, -np.inf
        alone = [(plain_mixture(counts, rows, [j])[1], -j) for j in range(n_langs)]
        sets = [[-max(alone)[1]]] + [order[:n] for n in range(2, n_langs + 1)]
        for chosen in sets:
            share, like = plain_mixture(counts, rows, chosen)
            worth = like - (len(chosen) - 1) * langid.PENALTY * np.log(len(k) + 1)
            if worth > value:
                best, value = share, worth
        assert {j for j in range(n_langs) if got[j] > 0} == set(best)
        assert all(got[j] == pytest.approx(v, abs=1e-6) for j, v in best.items())
        # no other set of languages does better by more than the penalty of the nested search
        every = max(plain_mixture(counts, rows, c)[1] - (len(c) - 1) * langid.PENALTY * np.log(len(k) + 1) for n in range(1, n_langs + 1) for c in itertools.combinations(range(n_langs), n))
        assert value >= every - 1e-6


def test_language_ties_go_to_the_first(spark):
    rows = [(k, "same words here", "ab"[k % 2]) for k in range(40)]
    df = spark.createDataFrame([x for x in rows if x[0] % 4 != 9], "doc_id long, text string, lang string")
    assert len({x.lang_pred for x in langid.identified(df).collect()}) == 1


def test_quality_sample_holds_whole_documents(spark, monkeypatch):
    """A bad document whose bad lines come late is learned from whole, or not at all."""
    clean = "\n".join(f"some quiet words in line {k}" for k in range(900))
    rows = [(k, clean + "\n" + "\n".join(["$$$ buy | buy | buy $$$"] * 600) if k % 4 == 0 else clean) for k in range(24)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(24)], "doc_id long, quality int")
    got = {x.doc_id: x.predicted for x in quality.scored(df, lab).collect()}
    assert all(got[k] == int(k % 4 > 0) for k in range(24))
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 10)
    assert {x.score for x in quality.scored(df, lab).collect()} == {0.5}


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def test_verdicts_against_a_plain_version(spark):
    """Rules and the model's sum, a url at a time; n-gram buckets come from the operator."""
    table = urls.labelled_table(spark)
    weights = urls.train(table)
    r = random.Random(2)
    hosts = ["news.example.net", "ads.example.net", "a.com", "com", "xcom", "example.org", "sub.example.org", "Example.ORG", "", "casino.bet", "é.fr"]
    paths = ["", "/", "/de/1", "/fr/x", "/es/2", "/en/1", "/en/12?a=/es/", "/en/2#x", "/login", "/wiki/Tea", "/cart/checkout", "x/de/"]
    rows = [(k, f"http://{r.choice(hosts)}{r.choice(paths)}") for k in range(300)] + [(900, None), (901, "no scheme"), (902, "a://b?c"), (900, None)]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit("x"))
    grams = {(x.host, x.path): x.f for x in urls.judged(df).select("host", "path", urls.buckets(F.col("host"), F.col("path")).alias("f")).collect()}
    want = []
    for i, u in rows:
        host, path = plain_url(u)
        fits = [(h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
        f = grams[host, path]
        z = sum(weights[b] for b in f) / len(f) ** 0.5 + weights[-1]
        want.append((i, host, path, rule, verdict or ("block" if 1 / (1 + np.exp(-z)) >= 0.5 else "allow")))
    got = [tuple(x) for x in urls.judged(df).select("page_id", "host", "path", "rule", "verdict").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_held_out_urls(spark):
    """Trained without a host of either kind, the model judges that host's urls by their paths."""
    table = urls.labelled_table(spark).collect()
    right = 0
    for n in range(4):
        hosts = {y: list(dict.fromkeys(t.host for t in table if t.label == y))[n] for y in (0, 1)}
        seen = spark.createDataFrame([t for t in table if t.host not in hosts.values()])
        w = urls.train(seen)
        left = spark.createDataFrame([t for t in table if t.host in hosts.values()])
        right += sum((x.p >= 0.5) == (x.label == 1) for x in left.select("label", urls.probability(urls.buckets(F.col("host"), F.col("path")), w).alias("p")).collect())
    assert right >= 0.9 * len(table)


def test_queries_say_what_they_do():
    assert all(f.__doc__ for f in registry.queries().values())


def test_mixing_asks_little_of_the_driver(spark):
    """Each job, its plan and its broadcasts stay in the driver's memory for a while: a mix took over 100 of them."""
    df = spark.createDataFrame([(i, "w " * (i % 17), f"s{i % 5}") for i in range(200)], "doc_id long, text string, source string")
    spark.sparkContext.setJobGroup("mix", "")
    try:
        got = mixing.mixed(df).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(got) == 200 and len(spark.sparkContext.statusTracker().getJobIdsForGroup("mix")) <= 60
