"""Writers: cluster files, assignment tables, reports, checkpoints. What goes
into single named files is written from the driver, a cluster at a time."""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _numbered(result: DataFrame) -> DataFrame:
    """idx, seq_id, description, seq, cluster_num (null: singleton) in order."""
    return result.orderBy(F.col("cluster_num").asc_nulls_last(), "idx")


def cluster_fasta(result: DataFrame, base: str, label: str = "singletons") -> list[str]:
    """base.cluster_001.fasta, ...; singletons in base.<label>.fasta. Rows are
    streamed in cluster order."""
    if "seq" not in result.columns:
        raise ValueError("writing FASTA needs sequences")
    base = base.removesuffix(".fasta").removesuffix(".fa")
    most = result.agg(F.max("cluster_num"), F.sum(F.col("cluster_num").isNull().cast("int"))).first()
    pad = max(3, len(str((most[0] or 0) + (1 if most[1] else 0))))
    out, files = None, []
    at: object = ()
    for r in _numbered(result).toLocalIterator():
        name = f"cluster_{r.cluster_num:0{pad}d}" if r.cluster_num is not None else label
        if r.cluster_num != at:
            if out:
                out.close()
            at = r.cluster_num
            files.append(f"{base}.{name}.fasta")
            out = open(files[-1], "w")
        out.write(f">{r.seq_id} {name}\n{r.seq}\n" if r.cluster_num is not None else f">{r.seq_id}\n{r.seq}\n")
    if out:
        out.close()
    return files


def cluster_fasta_distributed(result: DataFrame, path: str) -> None:
    """The same records as one folder a cluster, written by the executors."""
    name = F.coalesce(F.format_string("cluster_%03d", "cluster_num"), F.lit("singletons"))
    result.select(F.concat(F.lit(">"), "seq_id", F.lit(" "), name, F.lit("\n"), "seq").alias("value"), name.alias("cluster_name")).write.partitionBy("cluster_name").text(path)


def assignment_tsv(result: DataFrame, path: str, label: str = "singleton") -> None:
    with open(path, "w") as f:
        f.write("sequence_id\tcluster_id\n")
        for r in _numbered(result).toLocalIterator():
            f.write(f"{r.seq_id}\t{f'cluster_{r.cluster_num}' if r.cluster_num is not None else label}\n")


def assignment_text(result: DataFrame) -> str:
    groups: dict = {}
    for r in _numbered(result).toLocalIterator():
        groups.setdefault(r.cluster_num, []).append(r.seq_id)
    lines = []
    for n, ids in groups.items():
        lines.append(f"Cluster {n} ({len(ids)} sequences):" if n is not None else f"Singletons ({len(ids)} sequences):")
        lines += [f"  - {i}" for i in ids] + [""]
    return "\n".join(lines)


def to_json(value, path: str) -> None:
    with open(path, "w") as f:
        json.dump(value, f, indent=2, default=lambda o: o.item() if hasattr(o, "item") else str(o))


def summary_tsv(summary: DataFrame, path: str) -> None:
    """Per-cluster table of metrics.cluster_summary; NA where there is no distance."""
    cols = ["p5", "p25", "p50", "p75", "p95", "mean", "std"]
    with open(path, "w") as f:
        f.write("\t".join(["cluster_file", "n_sequences", "n_distances", "P5", "P25", "P50", "P75", "P95", "mean", "std"]) + "\n")
        for r in summary.orderBy("cluster_id").toLocalIterator():
            f.write("\t".join([str(r.cluster_id), str(r.n_sequences), str(r.n_distances), *("NA" if r[c] is None else f"{r[c]:.6f}" for c in cols)]) + "\n")


def analysis_text(summary: DataFrame, percentiles: DataFrame, gaps: DataFrame) -> str:
    lines = ["=" * 80, "DISTANCE ANALYSIS", "=" * 80, ""]
    for r in summary.orderBy("cluster_id").toLocalIterator():
        lines.append(f"{r.cluster_id}: {r.n_sequences} sequences, {r.n_distances} distances" + ("" if r["mean"] is None else f", mean {r['mean']:.6f}, P95 {r.p95:.6f}"))
    for side in ("intra", "inter"):
        lines += ["", f"{side}-cluster"] + [f"  P{r.percentile}: {r.value:.6f}" for r in percentiles.where(F.col("side") == side).orderBy("percentile").collect()]
    lines += ["", "barcode gap"]
    for r in gaps.orderBy("percentile").collect():
        lines.append(f"  P{r.percentile}: " + (f"{r.gap_size:.6f} ({'gap' if r.gap_exists else 'no gap'})" if r.gap_size is not None else "not defined"))
    return "\n".join(lines) + "\n"


def query_tsv(classes: DataFrame, path: str) -> None:
    """Per-sequence rows of a query analysis; null is empty."""
    cols = ["idx", "is_query", "member", "identity", "is_medoid", "nearest"]
    with open(path, "w") as f:
        f.write("\t".join(["scope_id", *cols]) + "\n")
        for r in classes.orderBy("scope_id", "idx").toLocalIterator():
            show = lambda v: "" if v is None else str(v).lower() if isinstance(v, bool) else f"{v:.2f}" if isinstance(v, float) else str(v)
            f.write("\t".join([str(r.scope_id), *(show(r[c]) for c in cols)]) + "\n")


def refined_fasta(assign: DataFrame, sequences: DataFrame, folder: Path) -> None:
    """A file a cluster, its id after each record's description; sequences in
    no cluster in unassigned.fasta, if there are any. Rows are streamed."""
    rows = sequences.join(assign, "seq_id", "left").orderBy("cluster_id", "seq_id")
    at, f = None, None
    for r in rows.toLocalIterator():
        name = r.cluster_id if r.cluster_id is not None else "unassigned"
        if name != at:
            if f:
                f.close()
            at, f = name, open(folder / f"{name}.fasta", "w")
        f.write(f">{r.description} {r.cluster_id}\n{r.seq}\n" if r.cluster_id is not None else f">{r.description}\n{r.seq}\n")
    if f:
        f.close()


def mapping_text(mapping: DataFrame) -> str:
    lines, last = [], None
    for r in mapping.orderBy("old_id", "rank").toLocalIterator():
        if r.kind == "removed":
            lines.append(f"{r.old_id} -> removed")
        elif r.kind == "renamed":
            lines.append(f"{r.old_id} -> {r.new_id}")
        elif r.kind == "partial":
            lines.append(f"{r.old_id} -> {r.new_id} ({r.overlap}/{r.old_size}, {r.pct:.1f}%)")
        else:
            if last != r.old_id:
                lines.append(f"{r.old_id} -> split:")
            lines.append(f"    {r.new_id} ({r.overlap}/{r.old_size}, {r.pct:.1f}%)")
        last = r.old_id
    return "\n".join(lines) + "\n"


def checkpoint(assign: DataFrame, path: str, iteration: int, summary: dict) -> str:
    """An iteration's assignment and state under path/iter=NNN."""
    spark = assign.sparkSession
    at = f"{path.rstrip('/')}/iter={iteration:03d}"
    assign.write.mode("overwrite").parquet(f"{at}/assign")
    spark.createDataFrame([(iteration, json.dumps(summary))], "iteration int, summary string").coalesce(1).write.mode("overwrite").json(f"{at}/state")
    return at


def stamped_folder(root: str, suffix: str = "final") -> Path:
    """root/<time>_<suffix>, and root/latest that points to it."""
    out = Path(root) / f"{time.strftime('%Y%m%d_%H%M%S')}_{suffix}"
    out.mkdir(parents=True)
    link = Path(root) / "latest"
    if link.is_symlink() or link.exists():
        link.unlink()
    os.symlink(out.name, link)
    return out
