"""Readers: sequences, cluster directories, distance matrices, search hits, checkpoints."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fasta(spark: SparkSession, *paths: str, upper: bool = True) -> DataFrame:
    """idx, seq_id (first token), description (whole header), seq, file. Files
    in the order given, records in file order. A record is what lies between
    two `>` at line starts, so a `>` inside a header is part of it."""
    parts = []
    for n, path in enumerate(paths):
        text = spark.read.option("lineSep", "\n>").text(path)
        parts.append(text.select(F.lit(n).alias("f"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("m"), F.regexp_replace("value", "^>|\r", "").alias("v")))
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    head = F.trim(F.get(F.split("v", "\n", 2), F.lit(0)))
    body = F.regexp_replace(F.coalesce(F.get(F.split("v", "\n", 2), F.lit(1)), F.lit("")), r"\s", "")
    rows = all_.where(F.length(F.trim("v")) > 0).select("f", "file", "m", head.alias("description"), (F.upper(body) if upper else body).alias("seq"))
    # idx orders all records: one window over a file list, not over a key
    idx = F.row_number().over(W.orderBy("f", "file", "m")) - 1
    return rows.select(idx.cast("long").alias("idx"), F.get(F.split("description", r"\s+", 2), F.lit(0)).alias("seq_id"), "description", "seq", "file")


def text_fasta(text: str) -> list[tuple[int, str, str, str]]:
    """Records of FASTA text (standard input): idx, seq_id, description, seq."""
    out = []
    for block in ("\n" + text.replace("\r", "")).split("\n>")[1:]:
        head, _, body = block.partition("\n")
        out.append((len(out), head.split()[0] if head.split() else "", head.strip(), "".join(body.split()).upper()))
    return out


def cluster_directory(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(sequences, assign) of a folder with one .fasta or .fa a cluster: the
    cluster's id is the file's stem; `unassigned` files give sequences only.
    Empty files are skipped; of a seq_id's records the last one counts; no
    folder or no cluster is an error."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        raise FileNotFoundError(path)
    files = sorted(s.getPath().toString() for s in fs.listStatus(folder) if s.getLen() and s.getPath().getName().endswith((".fasta", ".fa")))
    clusters = [f for f in files if PurePosixPath(f).stem != "unassigned"]
    if not clusters:
        raise ValueError(f"no cluster files in {path}")
    rows = fasta(spark, *files, upper=False)
    stem = F.regexp_extract("file", r"([^/]+)\.(?:fasta|fa)$", 1)
    rows = rows.withColumn("cluster_id", stem)
    last = rows.groupBy("seq_id").agg(F.max(F.struct("idx", "description", "seq")).alias("r")).select("seq_id", "r.description", "r.seq")
    return last, rows.where("cluster_id <> 'unassigned'").select("cluster_id", "seq_id", F.col("idx").alias("ord"))


def aligned_fasta(spark: SparkSession, path: str, order: DataFrame) -> DataFrame:
    """An outside alignment of order (idx, seq_id): idx, seq_id, aln, null where
    the alignment has no such record; of repeated records the last counts.
    Records whose name starts with Consensus are the aligner's own."""
    rows = fasta(spark, path).where(~F.col("seq_id").startswith("Consensus"))
    last = rows.groupBy("seq_id").agg(F.max(F.struct("idx", "seq")).alias("r")).select("seq_id", F.col("r.seq").alias("aln"))
    return order.select("idx", "seq_id").join(last, "seq_id", "left").select("idx", "seq_id", "aln")


def distance_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A headerless n x n CSV as (i, j, d) with i < j; nan is null. Row numbers
    come from the order of lines."""
    lines = spark.read.text(path).where("length(trim(value)) > 0").select((F.row_number().over(W.orderBy(F.monotonically_increasing_id())) - 1).cast("long").alias("i"), "value")
    out = lines.select("i", F.posexplode(F.split("value", ",")).alias("j", "s")).where("i < j").select("i", F.col("j").cast("long").alias("j"), F.expr("try_cast(trim(s) as double)").alias("d"))
    return out.withColumn("d", F.when(~F.isnan("d"), F.col("d")))


HITS = "query string, subject string, coverage double, identity double, aln_len int, e_value double, score double"


def _hits(rows: DataFrame) -> DataFrame:
    """query, subject, coverage, identity, aln_len, e_value, score, rank: by score, best first."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "subject")))


def _fields(spark: SparkSession, path: str, n: int) -> DataFrame:
    return spark.read.text(path).select(F.split("value", "\t").alias("f")).where(F.size("f") == n)


def tabular_hits(spark: SparkSession, path: str) -> DataFrame:
    """Seven tab-separated columns: query, subject, coverage, identity, length,
    e-value, bit score. Lines of other lengths are skipped."""
    f = _fields(spark, path, 7)
    c = lambda k, t: F.expr(f"try_cast(f[{k}] as {t})")
    return _hits(f.select(F.get("f", F.lit(0)).alias("query"), F.get("f", F.lit(1)).alias("subject"), c(2, "double").alias("coverage"), c(3, "double").alias("identity"), c(4, "int").alias("aln_len"), c(5, "double").alias("e_value"), c(6, "double").alias("score")))


def user_hits(spark: SparkSession, path: str) -> DataFrame:
    """Five tab-separated columns: query, target, identity, length, coverage;
    e-value 0, score the identity. `*` stands for no hit and is left out."""
    f = _fields(spark, path, 5)
    c = lambda k, t: F.expr(f"try_cast(f[{k}] as {t})")
    rows = f.select(F.get("f", F.lit(0)).alias("query"), F.get("f", F.lit(1)).alias("subject"), c(4, "double").alias("coverage"), c(2, "double").alias("identity"), c(3, "int").alias("aln_len"), F.lit(0.0).alias("e_value"), c(2, "double").alias("score"))
    return _hits(rows.where("subject <> '*'"))


def top_hits(hits: DataFrame, most: int = 100, min_identity: float = 90.0, max_e: float = 1e-5) -> DataFrame:
    return hits.where((F.col("identity") >= min_identity) & (F.col("e_value") <= max_e) & (F.col("rank") <= most))


def checkpoint(spark: SparkSession, path: str):
    """(state, assign) of a written iteration, or None where there is none."""
    jvm = spark.sparkContext._jvm
    state = jvm.org.apache.hadoop.fs.Path(f"{path}/state")
    if not state.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(state):
        return None
    return spark.read.json(f"{path}/state").first().asDict(), spark.read.parquet(f"{path}/assign")


def latest_checkpoint(spark: SparkSession, path: str) -> str | None:
    """The folder of the last whole iteration under path, or None."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return None
    done = [s.getPath().toString() for s in fs.listStatus(folder) if s.getPath().getName().startswith("iter=") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "state"))]
    return max(done, key=lambda at: int(at.rsplit("=", 1)[1]), default=None)
