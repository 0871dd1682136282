import random

import pytest

from clade import cli
from clade.functions import sequences as seqs
from clade.operators import distance, graph, metrics, query_analysis, refine
from clade.sources import readers, writers


@pytest.fixture(scope="module")
def barcodes():
    """Three species of 300 bases some 10 % apart, members within 0.7 %."""
    r = random.Random(4)
    root = [r.choice("ACGT") for _ in range(300)]
    out = []
    for s in range(3):
        anc = [r.choice("ACGT") if r.random() < 0.07 else c for c in root]
        for k in range(5):
            seq = anc[:]
            for p in r.sample(range(300), k % 3):
                seq[p] = {"A": "C", "C": "G", "G": "T", "T": "A"}[seq[p]]
            out.append((f"s{s}_{k}", "".join(seq)))
    return out


def write(path, rows):
    path.write_text("".join(f">{i} of species > {i[:2]}\n{s[:100]}\n{s[100:]}\n" for i, s in rows))


def test_fasta(spark, tmp_path, barcodes):
    write(tmp_path / "a.fasta", barcodes[:4])
    write(tmp_path / "b.fa", barcodes[4:6])
    got = readers.fasta(spark, str(tmp_path / "a.fasta"), str(tmp_path / "b.fa")).orderBy("idx").collect()
    assert [(r.idx, r.seq_id, r.seq) for r in got] == [(k, i, s) for k, (i, s) in enumerate(barcodes[:6])]
    assert got[0].description == "s0_0 of species > s0"
    assert [(r[1], r[3]) for r in readers.text_fasta((tmp_path / "a.fasta").read_text())] == barcodes[:4]


def test_cluster_directory(spark, tmp_path, barcodes):
    for name, rows in (("A", barcodes[:3]), ("B", barcodes[2:5])):
        write(tmp_path / f"{name}.fasta", rows)
    write(tmp_path / "unassigned.fasta", barcodes[5:6])
    (tmp_path / "empty.fasta").write_text("")
    sequences, assign = readers.cluster_directory(spark, str(tmp_path))
    assert sequences.count() == 6 and assign.count() == 6
    assert [r.seq_id for r in metrics.conflicts(assign).collect()] == [barcodes[2][0]]
    with pytest.raises(FileNotFoundError):
        readers.cluster_directory(spark, str(tmp_path / "none"))
    (tmp_path / "x").mkdir()
    with pytest.raises(ValueError):
        readers.cluster_directory(spark, str(tmp_path / "x"))


def test_matrix_and_hits(spark, tmp_path):
    (tmp_path / "m.csv").write_text("0,0.1,nan\n0.1,0,0.3\nnan,0.3,0\n")
    assert {(r.i, r.j): r.d for r in readers.distance_matrix(spark, str(tmp_path / "m.csv")).collect()} == {(0, 1): 0.1, (0, 2): None, (1, 2): 0.3}
    (tmp_path / "h.tsv").write_text("q\ta\t90\t99.5\t600\t1e-9\t800\nbad line\nq\tb\t90\t95\t600\t1e-9\t900\nq\tc\t90\t80\t600\t1e-9\t999\n")
    hits = readers.tabular_hits(spark, str(tmp_path / "h.tsv"))
    assert [r.subject for r in hits.orderBy("rank").collect()] == ["c", "b", "a"]
    assert {r.subject for r in readers.top_hits(hits).collect()} == {"a", "b"}
    (tmp_path / "u.tsv").write_text("q\ta\t97.5\t600\t90\nq\t*\t0\t0\t0\n")
    assert [(r.subject, r.score) for r in readers.user_hits(spark, str(tmp_path / "u.tsv")).collect()] == [("a", 97.5)]


def test_outside_alignment(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">s2 x\nAC-\nGT\n>Consensus_1\nACCGT\n>s1\nACCGT\n")
    order = spark.createDataFrame([(0, "s1"), (1, "s2"), (2, "s3")], "idx long, seq_id string")
    assert [tuple(r) for r in readers.aligned_fasta(spark, str(tmp_path / "a.fasta"), order).orderBy("idx").collect()] == [(0, "s1", "ACCGT"), (1, "s2", "AC-GT"), (2, "s3", None)]


def test_validation(spark):
    df = spark.createDataFrame([(0, "ACGT"), (1, ""), (2, "ACXZ-n")], "idx long, seq string")
    assert seqs.validate(df) == ["Sequence 2 is empty", "Sequence 3 has invalid characters: X, Z"]
    assert seqs.validate(df.limit(0)) == ["No sequences provided"]
    assert seqs.format_id(7, "refine", 2) == "cluster_00007R2" and seqs.parse_id("cluster_00012C") == (12, "C")
    for bad in (lambda: seqs.format_id(1, "x"), lambda: seqs.parse_id("c1")):
        with pytest.raises(ValueError):
            bad()


def test_graph(spark):
    e = spark.createDataFrame([("1", "2", 0.03), ("1", "3", 0.21), ("2", "1", 0.03), ("2", "4", 0.07), ("3", "1", 0.21), ("4", "2", 0.07)], "src string, dst string, distance double")
    assert {(r.a, r.b, r.distance) for r in graph.close_pairs(e, 0.1).collect()} == {("1", "2", 0.03), ("2", "4", 0.07)}
    assert {(r.src, r.dst) for r in graph.knn(e, 1, 0.1).collect()} == {("1", "2"), ("2", "1"), ("2", "4"), ("3", "1"), ("4", "2")}
    assert {(r.src, r.dst) for r in graph.knn(e, 1).collect()} == {("1", "2"), ("2", "1"), ("3", "1"), ("4", "2")}


def test_histogram(spark):
    df = spark.createDataFrame([(87.6,), (87.9,), (88.0,), (88.4,), (88.4,), (91.5,), (None,), (float("nan"),)], "v double")
    assert {r.bin_start: r["count"] for r in metrics.histogram(df, "v").collect()} == {87.5: 2, 88.0: 3, 91.5: 1}
    assert metrics.histogram(df.limit(0), "v").count() == 0


def test_agreement(spark):
    same = spark.createDataFrame([(k, k % 3, "abc"[k % 3]) for k in range(30)], "i int, a int, b string")
    assert metrics.adjusted_mutual_information(same).first().ami == pytest.approx(1.0)
    assert metrics.adjusted_mutual_information(same.limit(1)).first().ami == 1.0
    r = random.Random(1)
    noise = spark.createDataFrame([(r.randint(0, 4), r.randint(0, 4)) for _ in range(600)], "a int, b int")
    assert abs(metrics.adjusted_mutual_information(noise).first().ami) < 0.03


def test_refinement_repairs_a_split_and_a_lump(spark, barcodes):
    seqs_df = spark.createDataFrame(barcodes, "seq_id string, seq string")
    start = {"x1": barcodes[:2], "x2": barcodes[2:5], "y": barcodes[5:10] + barcodes[10:15]}
    assign = spark.createDataFrame([(c, i) for c, rows in start.items() for i, _ in rows], "cluster_id string, seq_id string")
    out = refine.refine(seqs_df, assign, refine.Config(min_split=0.003, max_lump=0.03, close_threshold=0.1))
    groups = {}
    for r in out.assign.collect():
        groups.setdefault(r.cluster_id, set()).add(r.seq_id)
    assert out.converged and sorted(sum(map(sorted, groups.values()), [])) == sorted(i for i, _ in barcodes)
    species = [{i[:2] for i in g} for g in groups.values()]
    assert all(len(s) == 1 for s in species)  # the lump is split, and nothing across species is joined


def test_query(spark, barcodes):
    rows = spark.createDataFrame([(0, k, s) for k, (_, s) in enumerate(barcodes)] + [(1, 0, barcodes[0][1])], "scope_id int, idx long, seq string")
    from clade.operators import workflows

    classes, summary, pairs = workflows.query_hits(rows, 0.005, 0.03)
    sides = {(r.scope_id, r.side): r["count"] for r in query_analysis.identities(classes, pairs).groupBy("scope_id", "side").count().collect()}
    assert sides == {(0, "intra"): 10, (0, "inter"): 50}
    assert [(r.scope_id, r.warning) for r in query_analysis.warnings(classes).collect()] == [(1, "insufficient data: no other sequence")]
    assert distance.from_item(pairs.where("scope_id = 0"), 3).count() == 14
    assert {r.idx for r in classes.where("member and scope_id = 0").collect()} == set(range(5))
    s = {r.scope_id: r for r in summary.collect()}
    assert s[0].gap_exists and s[0].members == 5 and s[1].members == 1 and s[1].intra_min == 100.0 and not s[1].gap_exists
    with pytest.raises(ValueError):
        query_analysis.check_thresholds(0.02, 0.01)


def test_command_line(spark, tmp_path, barcodes, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    src = tmp_path / "in.fasta"
    write(src, barcodes)
    cli.main(["cluster", str(src), "-o", str(tmp_path / "out"), "--max-lump", "0.03"])
    files = sorted(p.name for p in tmp_path.glob("out.*"))
    assert files == ["out.cluster_001.fasta", "out.cluster_002.fasta", "out.cluster_003.fasta"]
    cli.main(["cluster", str(src), "-o", str(tmp_path / "t.tsv"), "--format", "tsv", "--max-lump", "0.03"])
    lines = (tmp_path / "t.tsv").read_text().splitlines()
    assert lines[0] == "sequence_id\tcluster_id" and len(lines) == 16
    cli.main(["analyze", *(str(tmp_path / f) for f in files), "-o", str(tmp_path / "an"), "--format", "tsv"])
    assert (tmp_path / "an.tsv").read_text().count("\n") == 4
    cli.main(["query", str(src), "-o", str(tmp_path / "q.json"), "--max-lump", "0.03"])
    assert '"members": 5' in (tmp_path / "q.json").read_text()
    folder = tmp_path / "clusters"
    folder.mkdir()
    for f in files:
        (tmp_path / f).rename(folder / f.removeprefix("out."))
    write(folder / "unassigned.fasta", [("loose", barcodes[0][1])])
    cli.main(["refine", "--input-dir", str(folder), "--output-dir", str(tmp_path / "ref"), "--close-threshold", "0.2", "--min-split", "0.02", "--max-lump", "0.03", "--no-timestamp", "--checkpoint-frequency", "1"])
    made = tmp_path / "ref"
    assert sorted(p.name for p in made.glob("*.fasta")) == ["cluster_00001.fasta", "cluster_00002.fasta", "cluster_00003.fasta", "unassigned.fasta"]
    assert "loose" in (made / "unassigned.fasta").read_text() and (made / "checkpoints" / "iter=001").is_dir()
    assert all("cluster_0000" in line.split(" -> ")[1] for line in (made / "cluster_mapping.txt").read_text().splitlines())
    for bad in (["--alpha", "1", "--gap-method", "global"], ["--target-percentile", "90"]):
        with pytest.raises(SystemExit):
            cli.main(["cluster", str(src), *bad])


def test_checkpoint(spark, tmp_path):
    assign = spark.createDataFrame([("c", "s")], "cluster_id string, seq_id string")
    at = writers.checkpoint(assign, str(tmp_path), 3, {"ami": 1.0})
    state, back = readers.checkpoint(spark, at)
    assert state["iteration"] == 3 and back.collect() == assign.collect()
    assert readers.checkpoint(spark, str(tmp_path / "none")) is None
