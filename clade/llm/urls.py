"""URL filter: rules first, then a logistic regression on hashed character
n-grams of host and path. Everything is DataFrame expressions; the model is
trained by full-batch gradient steps over a small labelled table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hash buckets, n-gram length, gradient steps, step size, L2 penalty.
BUCKETS, GRAM, STEPS, RATE, PENALTY = 1024, 4, 12, 12.0, 1e-3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (host, path of the rule with its slash, verdict)
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

#: The labelled table: (host, path, 1 to block). Kinds of host and path that a
#: crawl keeps (articles, references, notes) and drops (adverts, tracking,
#: log-ins, carts, listings without text).
LABELLED = [
    (host, path, label)
    for label, hosts, paths in (
        (0, ("news.example.net", "www.library.example.com", "blog.writer.example.org", "docs.project.example.net"), ("/en/20145", "/article/history-of-tea", "/es/3071.html", "/wiki/Lattice", "/fr/essay/1999/", "/de/4711")),
        (1, ("ads.example.net", "track.example.com", "m.shop.example.org", "casino.example.net"), ("/click/out", "/login", "/cart/checkout", "/banner/728x90.html", "/tag/free-bonus/", "/pixel.gif")),
    )
    for host in hosts
    for path in paths
]


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.when(url.contains("://"), F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; else empty."""
    return F.when(url.contains("://"), F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules, what: int) -> Column:
    """The longest rule that fits, as its string (what 0) or verdict (what 1); else null."""
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.lit(h + p if what == 0 else verdict)
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("string") if out is None else out.otherwise(F.lit(None).cast("string"))


def buckets(host: Column, path: Column) -> Column:
    """Hash buckets of the n-grams of `^host` and of `path$`, apart, each once."""

    def grams(text, salt):
        places = F.sequence(F.lit(1), F.greatest(F.length(text) - GRAM + 1, F.lit(1)))
        return F.transform(places, lambda i: F.pmod(F.xxhash64(F.lit(salt), F.substr(text, i, F.lit(GRAM))), F.lit(BUCKETS)).cast("int"))

    return F.array_distinct(F.concat(grams(F.concat(F.lit("^"), host), "host"), grams(F.concat(path, F.lit("$")), "path")))


def train(labelled: DataFrame) -> list[float]:
    """Weights of the buckets, and the intercept last, of a logistic regression
    over labelled (host, path, label). Each step is one aggregate over the
    table; what reaches the driver is BUCKETS + 1 numbers at most, whatever
    the table's size. A row's features have unit length. An empty table gives zeros."""
    rows = labelled.where("label is not null").select(
        F.monotonically_increasing_id().alias("row"), F.col("label").cast("double").alias("label"), buckets(F.coalesce("host", F.lit("")), F.coalesce("path", F.lit(""))).alias("f")
    )
    # one partition: the table is small by contract, and a step is then one task without a shuffle
    rows = rows.withColumn("unit", 1 / F.sqrt(F.size("f").cast("double"))).coalesce(1).cache()
    n = max(rows.count(), 1)
    weights = [0.0] * (BUCKETS + 1)
    for _ in range(STEPS):
        gap = probability(F.col("f"), weights) - F.col("label")
        step = rows.select(gap.alias("gap"), "unit", F.explode(F.concat("f", F.array(F.lit(BUCKETS)))).alias("b"))
        slope = F.sum(F.col("gap") * F.when(F.col("b") == BUCKETS, F.lit(1.0)).otherwise(F.col("unit")))
        for b, g in step.groupBy("b").agg(slope).collect():
            weights[b] -= RATE * (g / n + PENALTY * weights[b])
    rows.unpersist()
    return weights


def probability(features: Column, weights: list[float]) -> Column:
    table = F.lit(np.array(weights))  # one literal, not one a number
    unit = 1 / F.sqrt(F.size(features).cast("double"))
    total = F.aggregate(features, F.lit(0.0), lambda acc, b: acc + F.get(table, b)) * unit + F.lit(weights[BUCKETS])
    return 1 / (1 + F.exp(-total))


def labelled_table(spark: SparkSession) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(y).alias("label")) for h, p, y in LABELLED])
    return spark.range(1).select(F.inline(rows))


def judged(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES) -> DataFrame:
    """Every url of pages with its host, path, rule, verdict and the model's
    probability that it should be blocked.

    A null url, and one without `://`, has an empty host and path; no rule fits
    it and the model judges it. Repeated rows come back repeated; other columns
    are ignored; urls of any length count whole. Without labelled rows the
    model says 0.5 and blocks (0.5 and above block).
    """
    weights = train(labelled if labelled is not None else labelled_table(pages.sparkSession))
    parts = pages.select(F.col("page_id"), host_of(F.col("url").cast("string")).alias("host"), path_of(F.col("url").cast("string")).alias("path"))
    parts = parts.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    score = probability(buckets(F.col("host"), F.col("path")), weights)
    out = parts.withColumn("p_block", score).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules, 0))
    by_rule = rule_of(F.col("host"), F.col("path"), rules, 1)
    verdict = F.coalesce(by_rule, F.when(F.col("p_block") >= 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "p_block")
