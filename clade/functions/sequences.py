"""Column functions on sequences, identifiers and distances."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: letters of a valid sequence (IUPAC nucleotides and the gap).
ALPHABET = "ATCGNRYKMSWBDHV-"


def capitals(seq: Column) -> Column:
    """a-z as A-Z, as nucleotide codes are ASCII; other letters stay as they are."""
    return F.translate(seq, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def normalised(seq: Column) -> Column:
    return capitals(F.trim(seq))


def content_id(seq: Column) -> Column:
    """seq_ and 16 hex digits of the SHA-256 of the normalised sequence."""
    return F.concat(F.lit("seq_"), F.substring(F.sha2(normalised(seq), 256), 1, 16))


def database_key(sequences: DataFrame, seq: str = "seq") -> DataFrame:
    """12 hex digits that name a set of sequences, whatever their order."""
    h = F.substring(F.sha2(capitals(F.col(seq)), 256), 1, 16)
    return sequences.select(h.alias("h")).agg(F.substring(F.sha2(F.concat_ws("", F.sort_array(F.collect_list("h"))), 256), 1, 12).alias("db_key"))


def deduplicated(sequences: DataFrame) -> DataFrame:
    """(idx, seq, description) -> a row a distinct sequence in first-seen
    order: seq_id, seq, descriptions. Ids of different sequences that collide
    get _1, _2, ..."""
    from pyspark.sql import Window as W

    one = sequences.groupBy(normalised(F.col("seq")).alias("seq")).agg(F.min("idx").alias("idx"), F.sort_array(F.collect_list(F.struct("idx", "description"))).alias("d"))
    n = F.row_number().over(W.partitionBy(content_id(F.col("seq"))).orderBy("idx")) - 1
    sid = F.when(n == 0, content_id(F.col("seq"))).otherwise(F.concat(content_id(F.col("seq")), F.lit("_"), n.cast("string")))
    return one.select("idx", sid.alias("seq_id"), "seq", F.col("d.description").alias("descriptions"))


def invalid_letters(seq: Column) -> Column:
    """Sorted distinct letters outside the alphabet."""
    letters = F.array_distinct(F.split(F.upper(seq), ""))
    return F.array_sort(F.array_except(letters, F.array(*[F.lit(c) for c in (*ALPHABET, "")])))


def problem(idx: Column, seq: Column) -> Column:
    """What is wrong with a sequence (numbered from 1), or null."""
    n = (idx + 1).cast("string")
    bad = invalid_letters(seq)
    return F.when(F.coalesce(F.length(seq), F.lit(0)) == 0, F.concat(F.lit("Sequence "), n, F.lit(" is empty"))).when(F.size(bad) > 0, F.concat(F.lit("Sequence "), n, F.lit(" has invalid characters: "), F.array_join(bad, ", ")))


def validate(sequences: DataFrame) -> list[str]:
    """The problems of (idx, seq), in order; nothing at all is one."""
    bad = sequences.select("idx", problem(F.col("idx"), F.col("seq")).alias("p")).where("p is not null").orderBy("idx").collect()
    if bad:
        return [r.p for r in bad]
    return [] if sequences.take(1) else ["No sequences provided"]


def masked_ends(aln: Column) -> Column:
    """Leading and trailing gaps as `.`; a row of gaps only stays."""
    lead = F.length(F.regexp_extract(aln, "^(-*)", 1))
    tail = F.length(F.regexp_extract(aln, "(-*)$", 1))
    core = F.substr(aln, lead + 1, F.length(aln) - lead - tail)
    return F.when(aln.rlike("^-*$"), aln).otherwise(F.concat(F.repeat(F.lit("."), lead), core, F.repeat(F.lit("."), tail)))


def covered_range(aligned: DataFrame, share: float = 0.5) -> DataFrame:
    """(scope_id, idx, aln) -> per scope the first and last column (from 1)
    that int(share * rows) rows cover."""
    need = aligned.groupBy("scope_id").agg(F.floor(share * F.count("*")).alias("need"))
    letters = aligned.select("scope_id", F.posexplode(F.split("aln", "")).alias("pos", "ch")).where("ch <> ''")
    cover = letters.groupBy("scope_id", "pos").agg(F.sum((F.col("ch") != ".").cast("long")).alias("cover"))
    return cover.join(need, "scope_id").where("cover >= need").groupBy("scope_id").agg((F.min("pos") + 1).alias("first_col"), (F.max("pos") + 1).alias("last_col"))


def trimmed(aligned: DataFrame, share: float = 0.5) -> DataFrame:
    """aligned with aln cut to its scope's covered range."""
    at = covered_range(aligned, share)
    return aligned.join(at, "scope_id").withColumn("aln", F.substr("aln", F.col("first_col"), F.col("last_col") - F.col("first_col") + 1)).drop("first_col", "last_col")


def columns_of(a: Column, b: Column) -> Column:
    """Columns of a pair of rows that count: no `.` in either, not both gaps."""
    z = F.zip_with(F.split(a, ""), F.split(b, ""), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    return F.filter(z, lambda c: (c["p"] != ".") & (c["q"] != ".") & (c["p"] != "") & ~((c["p"] == "-") & (c["q"] == "-")))


def overlap(a: Column, b: Column) -> Column:
    """Columns where both rows have a letter."""
    return F.size(F.filter(columns_of(a, b), lambda c: (c["p"] != "-") & (c["q"] != "-")))


def overlap_valid(n: Column, la: Column, lb: Column) -> Column:
    """At least half of the shorter sequence, and something, overlaps."""
    return (la > 0) & (lb > 0) & (n > 0) & (n >= 0.5 * F.least(la, lb))


def normal_length(seq: Column) -> Column:
    """Integer median of lengths (an aggregate)."""
    return F.floor(F.percentile(F.length(seq), 0.5)).cast("int")


def description(header: Column) -> Column:
    """What follows the first blank of a header, or null."""
    return F.get(F.split(header, " ", 2), F.lit(1))


# ---- cluster ids: cluster_00012, with a stage I, C or R and a number -----------------

_STAGES = {"initial": "I", "conflict": "C", "refine": "R"}
ID = re.compile(r"cluster_(\d+)([ICR]\d*)?")


def format_id(n: int, stage: str | None = None, iteration: int | None = None) -> str:
    if stage is None:
        return f"cluster_{n:05d}"
    if stage not in _STAGES:
        raise ValueError(f"unknown stage {stage!r}")
    return f"cluster_{n:05d}{_STAGES[stage]}" + (str(iteration) if stage == "refine" and iteration is not None else "")


def parse_id(cluster_id: str) -> tuple[int, str | None]:
    m = ID.match(cluster_id)
    if not m:
        raise ValueError(f"not a cluster id: {cluster_id!r}")
    return int(m[1]), m[2]


def id_number(cluster_id: Column) -> Column:
    return F.regexp_extract(cluster_id, r"^cluster_(\d+)", 1).try_cast("int")


def id_suffix(cluster_id: Column) -> Column:
    s = F.regexp_extract(cluster_id, r"^cluster_\d+([ICR]\d*)", 1)
    return F.when(s != "", s)


def next_number(ids: DataFrame, col: str = "cluster_id") -> DataFrame:
    return ids.agg((F.coalesce(F.max(id_number(F.col(col))), F.lit(0)) + 1).alias("next_number"))


def first_match(targets: DataFrame, sequences: DataFrame) -> DataFrame:
    """Targets (target_id, seq) matched to sequences (idx, seq) by their text:
    the first occurrence; null where there is none."""
    first = sequences.groupBy(normalised(F.col("seq")).alias("k")).agg(F.min("idx").alias("idx"))
    return targets.select("target_id", normalised(F.col("seq")).alias("k")).join(first, "k", "left").select("target_id", "idx")
