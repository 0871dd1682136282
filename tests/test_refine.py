import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clade.functions import kernels
from clade.functions import sequences as seqs
from clade.operators import graph, metrics, refine
from clade.sources import readers

CONF = refine.Config(min_split=0.02, max_lump=0.03, close_threshold=0.2)


@pytest.fixture(scope="module")
def species():
    """Four kinds of 240 bases, some 10 % apart; members differ by at most two bases."""
    r = random.Random(11)
    root = [r.choice("ACGT") for _ in range(240)]
    out = {}
    for s in "abcd":
        base = [r.choice("ACGT") if r.random() < 0.07 else c for c in root]
        for k in range(4):
            seq = base[:]
            for p in r.sample(range(240), k % 3):
                seq[p] = "ACGT"["CGTA".index(seq[p])]
            out[f"{s}{k}"] = "".join(seq)
    return out


def frames(spark, species, clusters):
    rows = [(c, i) for c, ids in clusters.items() for i in ids]
    return spark.createDataFrame(list(species.items()), "seq_id string, seq string"), spark.createDataFrame(rows, "cluster_id string, seq_id string")


def groups(assign):
    out = {}
    for r in assign.collect():
        out.setdefault(r.cluster_id, set()).add(r.seq_id)
    return out


def kind(species, s):
    return [i for i in species if i[0] == s]


def test_stable_clusters_keep_their_ids(spark, species):
    start = {f"cluster_0000{n}": kind(species, s) for n, s in enumerate("abcd", 1)}
    out = refine.refine(*frames(spark, species, start), CONF)
    assert out.converged and out.iterations == 1 and out.history[0]["ami"] == 1.0 and out.history[0]["changed"] == 0
    assert groups(out.assign) == {c: set(ids) for c, ids in start.items()}
    assert out.history[0]["gap_coverage"] == 1.0 and out.history[0]["clusters"] == 4


def test_changed_clusters_are_numbered_on(spark, species):
    start = {"cluster_00007": kind(species, "a") + kind(species, "b"), "x": kind(species, "c"), "y": kind(species, "d")}
    out = refine.refine(*frames(spark, species, start), CONF)
    got = groups(out.assign)
    assert sorted(map(sorted, got.values())) == [kind(species, s) for s in "abcd"]
    new = sorted(c for c in got if c not in start)
    assert all(got[c] == set(start[c]) for c in got if c in start)
    assert [seqs.parse_id(c) for c in new] == [(8 + k, "R1") for k in range(len(new))] and len(new) >= 2
    assert out.history[0]["ami"] < 1 and out.history[-1]["ami"] == 1.0 and out.converged


def test_resume_from_a_checkpoint(spark, species, tmp_path):
    start = {"p": kind(species, "a") + kind(species, "b"), "q": kind(species, "c")[:2], "r": kind(species, "c")[2:] + kind(species, "d")}
    sequences, assign = frames(spark, species, start)
    whole = refine.refine(sequences, assign, CONF)
    one = refine.Config(**{**CONF.__dict__, "max_iterations": 1})
    part = refine.refine(sequences, assign, one, every=1, checkpoints=str(tmp_path))
    assert not part.converged and readers.latest_checkpoint(spark, str(tmp_path)).endswith("iter=001")
    state = readers.checkpoint(spark, str(tmp_path / "iter=001"))
    assert state[0]["iteration"] == 1 and state[1].agg(F.max("times")).first()[0] == 1
    rest = refine.refine(sequences, assign, CONF, resume=str(tmp_path / "iter=001"))
    assert groups(rest.assign) == groups(whole.assign) and rest.iterations == whole.iterations and rest.history[0]["iteration"] == 2
    assert readers.latest_checkpoint(spark, str(tmp_path / "none")) is None
    with pytest.raises(FileNotFoundError):
        refine.refine(sequences, assign, CONF, resume=str(tmp_path / "iter=009"))


def test_conflicts_nulls_and_members_without_sequence(spark, species):
    a, b = kind(species, "a"), kind(species, "b")
    sequences, assign = frames(spark, species, {"m": a, "n": b + a[:1], "z": ["ghost", "empty"]})
    sequences = sequences.unionByName(spark.createDataFrame([("empty", ""), (None, "ACGT"), ("a0", "AC")], sequences.schema)).where("seq_id is null or seq_id <> 'a0' or seq <> 'AC'")
    assign = assign.unionByName(spark.createDataFrame([(None, "b1"), ("m", None), ("m", "a1")], assign.schema))
    out = refine.refine(sequences, assign, CONF)
    got = groups(out.assign)
    assert got.pop("z") == {"ghost", "empty"}
    assert sorted(map(sorted, got.values())) == [a, b] and metrics.conflicts(out.assign).count() == 0
    assert out.assign.count() == 10


def test_no_clusters(spark, species):
    sequences, assign = frames(spark, species, {"m": kind(species, "a")})
    out = refine.refine(sequences, assign.limit(0), CONF)
    assert out.converged and out.assign.count() == 0


def test_scopes_are_those_of_a_walk(spark, tmp_path):
    r = random.Random(5)
    names = [f"c{k:02d}" for k in range(40)]
    scopes = {c: {c, *r.sample(names, r.randint(0, 3))} for c in names}
    order = {c: (r.randint(0, 2), -r.randint(1, 4), c) for c in names}
    want, used = set(), set()
    for c in sorted(names, key=order.get):
        if not scopes[c] & used:
            used |= scopes[c]
            want.add(c)
    rows = spark.createDataFrame([(c, d) for c in names for d in scopes[c]], "src string, cluster_id string")
    keys = spark.createDataFrame([(c, *order[c]) for c in names], "cluster_id string, t int, n int, c string").select("cluster_id", F.struct("t", "n", "c").alias("key"))
    got = groups(refine.chosen_scopes(rows, keys, f"file://{tmp_path}").select(F.col("src").alias("cluster_id"), F.col("cluster_id").alias("seq_id")))
    assert got == {c: scopes[c] for c in want}


def test_numbers_do_not_overlap(spark):
    counts = {f"s{k}": k % 4 + 1 for k in range(300)}
    got = {r.scope_id: r.base for r in refine.numbered_scopes(spark.createDataFrame(list(counts.items()), "scope_id string, n long"), 10).collect()}
    assert sorted(got[s] + k for s, n in counts.items() for k in range(1, n + 1)) == list(range(11, 11 + sum(counts.values())))


def test_scope_gaps_are_those_of_the_relation(spark):
    r = np.random.default_rng(3)
    d = r.random((12, 12))
    d = (d + d.T) / 2
    d[0, 5] = d[5, 0] = math.nan
    parts = [[0, 1, 2], [3, 4], [5], [6, 7, 8], [9, 10, 11]]
    label = {k: n for n, c in enumerate(parts) for k in c}
    pairs = spark.createDataFrame([(i, j, float(d[i, j]), label[i], label[j]) for i in range(12) for j in range(i + 1, 12)], "i int, j int, d double, ci int, cj int")
    assign = spark.createDataFrame(list(label.items()), "idx int, cluster_id int")
    want = {x.cluster_id: x.gap for x in metrics.neighbourhood_metrics(pairs, assign, 95, 0.02).collect()}
    assert kernels.scope_gaps(d, parts, 95, 0.02) == pytest.approx([want[k] for k in range(5)])
    assert kernels.scope_gaps(np.zeros((2, 2)), [[0, 1]], 95, 0.02) == [0.02]


def test_log_factorials(spark):
    got = spark.createDataFrame([(n,) for n in (0, 1, 2, 9, 170, 10**6, 10**12)], "n long").select("n", metrics.log_factorial(F.col("n")).alias("v")).collect()
    for x in got:
        assert x.v == pytest.approx(math.lgamma(x.n + 1), rel=1e-13, abs=1e-13)


def test_fan_out_keeps_what_the_nearest_need(spark):
    r = random.Random(2)
    medoids = spark.createDataFrame([(f"c{k:02d}", r.choice("xyz")) for k in range(30)], "cluster_id string, seq string")
    apart = spark.createDataFrame([(p, q, {"xy": 0.1, "xz": 0.2, "yz": 0.1}["".join(sorted(p + q))]) for p in "xyz" for q in "xyz" if p != q], "src_seq string, dst_seq string, distance double")
    rows = lambda e: {(x.src, x.dst, x.distance) for x in graph.knn(e, 3).collect()}
    few = graph.fan_out(apart, medoids, 4)
    assert rows(few) == rows(graph.fan_out(apart, medoids)) and few.count() <= 30 * 12
