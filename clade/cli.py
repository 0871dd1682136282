"""Command line: python -m clade.cli {cluster,refine,analyze,query} ..."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from clade.operators import metrics, query_analysis, refine, workflows
from clade.sources import readers, writers


def session() -> SparkSession:
    spark = SparkSession.builder.appName("clade").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _thresholds(p: argparse.ArgumentParser, percentile: bool = True) -> None:
    p.add_argument("--min-split", type=float, default=0.005)
    p.add_argument("--max-lump", type=float, default=0.02)
    if percentile:
        p.add_argument("--target-percentile", type=int, default=95, choices=range(50, 101), metavar="50..100")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="clade")
    sub = top.add_subparsers(dest="tool", required=True)
    c = sub.add_parser("cluster", help="cluster sequences, or grow one cluster from targets")
    c.add_argument("input", nargs="+")
    c.add_argument("-o", "--output")
    c.add_argument("--format", choices=["fasta", "tsv", "text"], default="fasta")
    _thresholds(c)
    c.add_argument("--gap-method", choices=["local", "global"], default="local")
    c.add_argument("--alpha", type=float, default=0.0)
    c.add_argument("--target")
    c.add_argument("--export-metrics")
    c.add_argument("--distance-matrix")
    r = sub.add_parser("refine", help="refine given clusters")
    r.add_argument("--input-dir", required=True)
    r.add_argument("--output-dir", required=True)
    r.add_argument("--close-threshold", type=float, required=True)
    r.add_argument("--max-iterations", type=int, default=10)
    _thresholds(r)
    r.add_argument("--gap-method", choices=["local", "global"], default="global")
    r.add_argument("--alpha", type=float, default=0.0)
    r.add_argument("--max-scope-size", type=int, default=300)
    r.add_argument("--knn-neighbors", type=int, default=20)
    r.add_argument("--renumber", action="store_true", default=True)
    r.add_argument("--preserve-ids", dest="renumber", action="store_false")
    r.add_argument("--no-timestamp", action="store_true")
    r.add_argument("--checkpoint-frequency", type=int, default=0, help="write the state after each so many iterations")
    r.add_argument("--checkpoint-dir", help="a folder that all executors share (OUTPUT_DIR/checkpoints)")
    r.add_argument("--resume", help="a written iteration, or the folder of several (INPUT_DIR/checkpoints if it is there)")
    r.add_argument("--log-level", default="ERROR", choices=["DEBUG", "INFO", "WARN", "ERROR"])
    a = sub.add_parser("analyze", help="distances within and between given clusters")
    a.add_argument("files", nargs="+")
    a.add_argument("-o", "--output", default="cluster_analysis")
    a.add_argument("--format", choices=["text", "json", "tsv"], default="text")
    a.add_argument("--bins", type=int, default=50)
    a.add_argument("--gap-percentiles", type=int, nargs="+", default=[90, 95])
    q = sub.add_parser("query", help="which sequences belong with the first")
    q.add_argument("input", nargs="?")
    q.add_argument("-o", "--output")
    q.add_argument("-f", "--format", choices=["json", "text", "tsv"], default="json")
    _thresholds(q, False)
    return top


def _files(paths) -> None:
    for p in paths:
        if not Path(p).is_file():
            sys.exit(f"no such file: {p}")


def run_cluster(spark, a) -> None:
    if a.gap_method == "global" and a.alpha:
        sys.exit("--alpha is for the local gap")
    if a.gap_method == "local" and a.target_percentile != 95:
        sys.exit("--target-percentile is for the global gap")
    _files(a.input)
    base = a.output or str(Path(a.input[0]).with_suffix(""))
    label = "singletons"
    if a.distance_matrix:
        pairs = readers.distance_matrix(spark, a.distance_matrix)
        n = spark.read.text(a.distance_matrix).where("length(trim(value)) > 0").count()
        sequences = spark.range(n).select(F.col("id").alias("idx"), F.col("id").cast("string").alias("seq_id"), F.lit("").alias("description"))
    else:
        pairs, sequences = None, readers.fasta(spark, *a.input)
    sequences = sequences.cache()
    try:
        if a.target:
            targets = readers.fasta(spark, a.target).select(F.col("idx").alias("target_id"), "seq")
            result = workflows.target_clustering(sequences, targets, a.min_split, a.max_lump, a.target_percentile)
            result, label = result.withColumn("cluster_num", F.when(F.col("member"), 1)), "unclustereds"
        else:
            result = workflows.full_clustering(sequences, pairs, min_split=a.min_split, max_lump=a.max_lump, percentile=a.target_percentile, method=a.gap_method, alpha=a.alpha)
    except ValueError as e:
        sys.exit(str(e))
    result = result.cache()
    if a.format == "fasta":
        writers.cluster_fasta(result, base, label)
    elif a.format == "tsv":
        writers.assignment_tsv(result, base if base.endswith(".tsv") else f"{base}.tsv", label.removesuffix("s"))
    else:
        Path(base if base.endswith(".txt") else f"{base}.txt").write_text(writers.assignment_text(result))
    if a.export_metrics:
        row = result.agg(F.max("cluster_num").alias("clusters"), F.sum(F.col("cluster_num").isNull().cast("int")).alias("singletons"), F.max("best_gap").alias("best_gap")).first()
        writers.to_json(row.asDict() | {"min_split": a.min_split, "max_lump": a.max_lump, "gap_method": a.gap_method}, a.export_metrics)


def run_refine(spark, a) -> None:
    sequences, assign = readers.cluster_directory(spark, a.input_dir)
    assign = assign.select("cluster_id", "seq_id")
    if assign.select("cluster_id").distinct().count() < 2:
        sys.exit("refinement needs two clusters")
    conf = refine.Config(min_split=a.min_split, max_lump=a.max_lump, percentile=a.target_percentile, method=a.gap_method, alpha=a.alpha, close_threshold=a.close_threshold, max_scope_size=a.max_scope_size, neighbours=a.knn_neighbors, max_iterations=a.max_iterations)
    spark.sparkContext.setLogLevel(a.log_level)
    resume = readers.latest_checkpoint(spark, a.resume or f"{a.input_dir}/checkpoints") or a.resume
    out = workflows.refinement(sequences, assign, conf, every=a.checkpoint_frequency, checkpoints=a.checkpoint_dir or f"{a.output_dir}/checkpoints", resume=resume)
    final = out["result"].assign
    check = out["verification"].first()
    if check.conflicts:
        sys.exit(f"{check.conflicts} sequences are in several clusters")
    Path(a.output_dir).mkdir(parents=True, exist_ok=True)
    folder = Path(a.output_dir) if a.no_timestamp else writers.stamped_folder(a.output_dir)
    sizes = final.groupBy("cluster_id").agg(F.count("*").alias("size"))
    names = metrics.renumbered(sizes) if a.renumber else sizes.withColumn("new_id", F.col("cluster_id"))
    named = final.join(names.select("cluster_id", "new_id"), "cluster_id").select("seq_id", F.col("new_id").alias("cluster_id")).cache()
    writers.refined_fasta(named, sequences, folder)
    (folder / "cluster_mapping.txt").write_text(writers.mapping_text(metrics.mapping(assign, named)))
    s = metrics.size_summary(sizes).first()
    before = metrics.conflicts(assign).count()
    lines = [f"iterations: {out['result'].iterations}", f"converged: {out['result'].converged}", f"clusters: {sizes.count()}", f"sequences: {check.unique_sequences}", f"sizes: largest {s.largest}, smallest {s.smallest}, median {s.median}, mean {s['mean']:.2f}"]
    lines += [f"conflicts: {before} given, {check.resolved_conflicts} resolved, {check.unresolved_conflicts} unresolved, {check.new_conflicts} new", "parameters: " + ", ".join(f"{k} {v}" for k, v in conf.__dict__.items())]
    lines += [f"clusters of {r.bucket}: {r['count']} ({r.pct:.1f}%)" for r in metrics.size_distribution(sizes).collect()]
    (folder / "refine_summary.txt").write_text("\n".join(lines + [str(h) for h in out["result"].history]) + "\n")


def run_analyze(spark, a) -> None:
    _files(a.files)
    rows = readers.fasta(spark, *a.files)
    rows = rows.withColumn("cluster_id", F.regexp_extract("file", r"([^/]+?)(?:\.fasta|\.fa)?$", 1))
    out = workflows.analysis(rows.select("seq_id", "seq").dropDuplicates(["seq_id"]), rows.select("cluster_id", "seq_id"), a.gap_percentiles)
    if a.format == "tsv":
        writers.summary_tsv(out["summary"], f"{a.output}.tsv")
    elif a.format == "json":
        hist = {side: [r.asDict() for r in metrics.equal_bins(out["pairs"].where(c), "d", a.bins).orderBy("bin").collect()] for side, c in (("intra", "ci = cj"), ("inter", "ci <> cj"))}
        writers.to_json({k: [r.asDict() for r in out[k].collect()] for k in ("summary", "percentiles", "gaps")} | {"histograms": hist, "parameters": {"gap_percentiles": a.gap_percentiles, "bins": a.bins}}, f"{a.output}.json")
    else:
        Path(f"{a.output}.txt").write_text(writers.analysis_text(out["summary"], out["percentiles"], out["gaps"]))


def run_query(spark, a) -> None:
    if a.input:
        _files([a.input])
        text = Path(a.input).read_text()
    else:
        text = sys.stdin.read()
    records = readers.text_fasta(text)
    if not records:
        sys.exit("no sequences")
    rows = spark.createDataFrame([(0, i, s) for i, _, _, s in records], "scope_id int, idx long, seq string")
    classes, summary, pairs = workflows.query_hits(rows, a.min_split, a.max_lump)
    if a.format == "tsv":
        writers.query_tsv(classes, a.output or "/dev/stdout")
        return
    names = {i: n for i, n, _, _ in records}
    s = summary.first().asDict()
    if a.format == "json":
        value = {"summary": {k: round(v, 2) if isinstance(v, float) else v for k, v in s.items()}, "sequences": [{"id": names[r.idx]} | {k: round(v, 2) if isinstance(v, float) else v for k, v in r.asDict().items() if k != "scope_id"} for r in classes.orderBy("idx").collect()]}
        sides = query_analysis.identities(classes, pairs)
        for side in ("intra", "inter"):
            h = metrics.histogram(sides.where(F.col("side") == side), "identity")
            value[f"{side}_histogram"] = [r.asDict() | {"frequency": round(r.frequency, 4)} for r in h.orderBy("bin_start").collect()]
        value["warnings"] = [r.warning for r in query_analysis.warnings(classes).collect()]
        value["parameters"] = {"min_split": a.min_split, "max_lump": a.max_lump}
        writers.to_json(value, a.output or "/dev/stdout")
    else:
        lines = [f"{k:20} {v}" for k, v in s.items()] + [f"{names[r.idx]:40} {'member' if r.member else '-':8} {r.identity if r.identity is not None else float('nan'):8.2f}" for r in classes.orderBy("idx").collect()]
        print("\n".join(lines), file=open(a.output, "w") if a.output else sys.stdout)


def main(argv=None) -> None:
    a = parser().parse_args(argv)
    {"cluster": run_cluster, "refine": run_refine, "analyze": run_analyze, "query": run_query}[a.tool](session(), a)


if __name__ == "__main__":
    main()
