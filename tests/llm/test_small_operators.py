import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from clade.llm import jpeg, langid, lattice, mixing, pieces, quality, urls, warc

TEXTS = [(1, "Plain text here."), (2, None), (3, ""), (4, "é́ ﬁ ① 🙂 ▁x  y "), (5, "word " * 5000), (5, "word " * 5000), (None, "a\tb\n c"), (7, "x" * 70000), (8, "\x00 \x00")]


def frame(spark, rows=TEXTS):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("'q' as ids", "text", "doc_id", "0 as media", "'s' as n_bytes")


# ---- 4


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (9, None, "same"), (3, "http://b", None), (4, "x\r\ny", ""), (5, "u", "é🙂"), (5, "u", "é🙂"), (None, "n", "same")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("address", F.lit("z"))
    got = warc.archived(df, str(tmp_path / "a")).collect()
    owner = {}
    for p, _, h in rows:
        if p is not None:
            owner[h or ""] = max(owner.get(h or "", -(2**62)), p)
    want = []
    for p, _, h in rows:
        raw = (h or "").encode()
        rev = p is not None and p != owner[h or ""]
        want.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if rev else "response", owner[h or ""] if rev else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    for r in got:
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        length = int(head.decode().split("Content-Length: ")[1].split("\r\n")[0])
        assert rest[length:] == b"\r\n\r\n" and (r.record_type == "revisit" or rest[:length].endswith(bytes(r.payload)))
    assert spark.read.parquet(str(tmp_path / "a/payloads")).count() == 3


def test_warc_damage_and_small_payloads(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "xy"), (2, "a", "xy")], "page_id long, url string, html string")
    assert {r.record_type for r in warc.archived(df, str(tmp_path / "s"), min_bytes=3).collect()} == {"response"}
    warc.write_archive(df, str(tmp_path / "d"))
    spark.read.parquet(str(tmp_path / "d/payloads")).withColumn("payload", F.lit(b"other")).write.parquet(str(tmp_path / "e/payloads"))
    spark.read.parquet(str(tmp_path / "d/headers")).write.parquet(str(tmp_path / "e/headers"))
    with pytest.raises(Exception, match="damaged"):
        warc.read_archive(spark, str(tmp_path / "e")).collect()
    assert warc.archived(df.limit(0), str(tmp_path / "z")).count() == 0


def test_warc_reading_shuffles_no_payloads(spark, tmp_path):
    rows = [(k, f"http://a/{k}", base64.b64encode(random.Random(k // 2).randbytes(20000)).decode()) for k in range(200)]
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "a"))
    context = spark.sparkContext._jsc.sc()

    def shuffled():
        context.listenerBus().waitUntilEmpty()
        return context.statusStore().executorSummary("driver").totalShuffleWrite()

    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # a large archive's join is never a broadcast
    try:
        before = shuffled()
        got = warc.read_archive(spark, str(tmp_path / "a")).select(columns).collect()
        sent = shuffled() - before
        whole = warc.read_archive(spark, str(tmp_path / "a")).collect()
        headers = spark.read.parquet(str(tmp_path / "a/headers"))
        headers.withColumn("header", F.regexp_replace("header", "sha1:.", "sha1:_")).write.parquet(str(tmp_path / "b/headers"))
        spark.read.parquet(str(tmp_path / "a/payloads")).write.parquet(str(tmp_path / "b/payloads"))
        with pytest.raises(Exception, match="does not match its header"):
            warc.read_archive(spark, str(tmp_path / "b")).select(columns).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    raw = {k: html.encode() for k, _, html in rows}
    want = [(k, len(raw[k]), base64.b32encode(hashlib.sha1(raw[k]).digest()).decode(), "response" if k % 2 else "revisit", None if k % 2 else k + 1) for k in raw]
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    assert all(bytes(r.payload) == raw[r.page_id] for r in whole) and len(whole) == len(raw)
    assert 0 < sent < 300000 < sum(len(x) for x in set(raw.values())) / 8


# ---- 5


def test_e8_decoding_is_nearest():
    r = np.random.default_rng(0)
    x = r.standard_normal((50, 8)) * 2
    p = lattice.decode_e8(x)
    steps = lattice.minimal_vectors()
    assert len(steps) == 240 and np.allclose((steps**2).sum(1), 2)
    near = ((x[:, None] - p[:, None] - steps[None]) ** 2).sum(-1).min(1)
    assert (((x - p) ** 2).sum(1) <= near + 1e-9).all()  # Voronoi cells of E8 are cut by its 240 shortest vectors (and 2160 more touch)
    assert np.allclose(lattice.decode_e8(p), p)


def test_cosine_of_huge_and_tiny_vectors():
    x = np.array([[3.0, 4.0], [3e300, 4e300], [3e-300, 4e-300]])
    assert lattice.cosine(x, x[::-1]) == pytest.approx([1, 1, 1])


def test_links_against_brute_force(spark):
    r = np.random.default_rng(4)
    rows = []
    for k in range(220):
        base = r.standard_normal(64)
        for c in range(1 + k % 3):
            rows.append((len(rows), (base + r.standard_normal(64) * r.choice([0.05, 0.15, 0.25])).tolist(), int(k % 4)))
    rows.append((len(rows), (np.array(rows[0][1]) * 3).tolist(), rows[0][2]))
    rows += [(900, rows[0][1], None), (901, None, 0), (902, [0.0] * 64, 0), (903, [float("nan")] * 64, 0), (904, [None] + [1.0] * 63, 0), (905, [1.0] * 3, 0), (906, [1.0] * 3, 0), (907, rows[0][1], rows[0][2]), (907, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rep", F.lit(1)).withColumn("sig", F.lit("a"))
    got = {r.vec_id: r for r in lattice.linked(df).collect()}
    ok = [(i, np.array(v), c) for i, v, c in rows if c is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)]
    pairs = {(a[0], b[0], n, m) for n, a in enumerate(ok) for m, b in enumerate(ok) if n < m and a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / np.sqrt((a[1] @ a[1]) * (b[1] @ b[1])) >= 0.93}
    links = {}
    for a, b, n, m in pairs:
        links[a, n] = links.get((a, n), 0) + 1
        links[b, m] = links.get((b, m), 0) + 1
    found = sum(min(got[i].n_links, links.get((i, n), 0)) for n, (i, _, _) in enumerate(ok))
    assert all(got[i].n_links <= links.get((i, n), 0) for n, (i, _, _) in enumerate(ok))
    assert found >= 0.95 * sum(links.values())
    assert got[900].n_links == 0 and got[902].kept and got[907].component_id == 0 and not got[907].kept and got[905].n_links == 1
    assert lattice.linked(df.limit(0)).count() == 0


# ---- 6


def test_pieces_are_the_library_s(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    r = random.Random(0)
    odd = [(100 + k, "".join(r.choice(["a", "the", " ", "  ", "▁", "\n", "é", "🙂", "\t", "ing", "."]) for _ in range(r.randint(0, 40)))) for k in range(200)]
    rows = TEXTS + odd
    got = sorted((tuple(x) for x in pieces.encoded(frame(spark, rows), ids=True, decoded=True).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256").collect()), key=str)
    want = []
    for i, t in rows:
        ids = sp.encode(t or "")
        back = sp.decode(ids)
        want.append((i, len(ids), ids, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), back, hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    back = pieces.decoded(pieces.encoded(frame(spark, odd[:20])).select("doc_id", "ids")).collect()
    assert {x.doc_id: x.text for x in back} == {i: sp.decode(sp.encode(t)) for i, t in odd[:20]}


def test_table_that_fills_up(monkeypatch):
    monkeypatch.setattr(pieces, "TABLE", 5)
    with open(pieces.default_model(), "rb") as f:
        t = pieces.ChunkTable(f.read())
    texts = [f"some words {k} and more" for k in range(20)]
    assert [g[0] for g in t.encode(texts)] == t.processor.encode(texts)
    assert [g[0] for g in t.encode(texts[5:9])] == t.processor.encode(texts[5:9])


# ---- 7


def brute_targets(sizes, cycle=3, most=3):
    """Water-filling by rounds: whoever gets too much is capped, the rest share again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: k % cycle + 1 for k, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        weight = sum(w[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and left * w[s] / weight > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in capped else left * w[s] / weight for s in names}
        capped |= over


def test_mix_meets_targets(spark):
    r = random.Random(5)
    rows = [(k, " ".join(["w"] * r.choice([0, 1, 5, 40, 300])), r.choice(["a", "a", "a", "b", "é", "z", "", None])) for k in range(1500)] + [(1, None, "a"), (2, "x y", "tiny"), (None, "a b c", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("s")).withColumn("h", F.lit(0))
    got = mixing.mixed(df).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    by = {}
    src = {(i, len((t or "").split())): s for i, t, s in rows}
    for g in got:
        s = src[g.doc_id, g.size]
        assert g.source_size == sizes[s] and g.target == pytest.approx(want[s]) and 0 <= g.taken <= 3 * g.size
        by[s] = by.get(s, 0) + g.taken
    for s, t in want.items():
        assert abs(by[s] - t) <= max(2, 0.01 * t)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed(df.repartition(7)).collect()))
    assert mixing.mixed(df.limit(0)).count() == 0


def test_resampled_rows(spark):
    rows = [(k, "w " * (k % 9), "ab"[k % 5 == 0], k) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int")
    copies = {g.doc_id: g.copies for g in mixing.mixed(df).collect()}
    out = mixing.resampled(df)
    assert out.columns == df.columns
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == {k: v for k, v in copies.items() if v}


# ---- 9


def test_media_round_trip(spark):
    got = sorted((tuple(r) for r in jpeg.media_features(jpeg.stored_media(frame(spark))).collect()), key=str)
    media = sorted(((r.doc_id, r.n_bytes, bytes(r.media)) for r in jpeg.stored_media(frame(spark)).collect()), key=str)
    want = []
    for i, t in TEXTS:
        raw = (t or "").encode()
        pay = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        want.append((i, len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:])))
    assert sorted((g[:5] for g in got), key=str) == sorted(want, key=str)
    assert sorted((g[5], g[6]) for g in got) == sorted((len(m), hashlib.sha256(m).hexdigest()) for _, _, m in media)
    assert jpeg.media_features(jpeg.stored_media(frame(spark).limit(0))).count() == 0


def test_all_bytes_and_several_images():
    x = np.random.default_rng(0).integers(0, 256, 64 * 9000, dtype=np.uint8)
    data = jpeg.encode(x, np.array([len(x)]))[0]
    thumbs = jpeg.thumbnails([data, b""])
    assert len(thumbs[0]) == 2 and thumbs[1] == [] and np.array_equal(np.concatenate([t.reshape(-1) for t in thumbs[0]]), x)
    small = jpeg.encode(x[:640], np.array([64, 640]))
    assert [np.array_equal(jpeg._plain(jpeg.Image(m)) + 128, jpeg.thumbnails([m])[0][0]) for m in small] == [True, True]
    with pytest.raises(ValueError):
        jpeg.Image(b"GIF89a")


# ---- 8, 1, 10


def test_languages(spark):
    r = random.Random(0)
    vocab = {"en": "the of and to in that was for with his they".split(), "de": "der die und das nicht ein ist von mit sich auch".split(), "fr": "le la les des est que dans pour une qui sur".split()}
    say = lambda v, n: " ".join(r.choice(vocab[v]) + r.choice(["", "s", "en"]) for _ in range(n))
    rows = [(k, say(v, 40), v) for k in range(240) for v in [list(vocab)[k % 3]]]
    rows += [(1000, say("en", 60) + " " + say("de", 30), None), (1001, None, "en"), (1002, "", "de"), (1003, "12 34 !", None), (1004, "é", None), (1005, say("fr", 30) * 200, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(0))
    got = {x.doc_id: x for x in langid.identified(df).collect()}
    assert all((got[k].held_out) == (zlib.crc32(str(k).encode()) % 4 == 2) for k, _, _ in rows)
    assert np.mean([got[k].lang_pred == v for k, _, v in rows[:240]]) > 0.98
    both = {x.lang: x.share for x in got[1000].languages}
    assert got[1000].lang_pred == "en" and set(both) == {"en", "de"} and 0.5 < both["en"] < 0.8
    assert [got[k].lang_pred for k in (1001, 1002, 1003)] == ["und"] * 3 and got[1004].lang_pred in vocab and got[1005].lang_pred == "fr"
    assert {x.lang_pred for x in langid.identified(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identified(df.limit(0)).count() == 0


def test_forward_backward_against_all_labellings():
    r = np.random.default_rng(0)
    counts = np.array([3, 0, 1, 5])
    scores, moves = r.standard_normal(9), r.standard_normal((2, 2))
    p, moved = quality.marginals(scores, moves, counts)
    at, want, want_moved = 0, [], np.zeros((2, 2))
    for n in counts:
        z, m, mv = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in np.ndindex(*(2,) * n) if n else ():
            w = np.exp(sum(scores[at + i] * y[i] for i in range(n)) + sum(moves[a, b] for a, b in zip(y, y[1:])))
            z, m = z + w, m + w * np.array(y)
            for a, b in zip(y, y[1:]):
                mv[a, b] += w
        if n:
            want += list(m / z)
            want_moved += mv / z
        at += n
    assert p == pytest.approx(want) and moved == pytest.approx(want_moved)


def test_quality_learns_junk(spark):
    r = random.Random(1)
    vocab = [f"word{k}" for k in range(80)]
    line = lambda: " ".join(r.choice(vocab) for _ in range(12)).capitalize() + "."
    junk = lambda: " ".join(r.choice(vocab) + "$$$" for _ in range(12)) + " |"
    rows, labels = [], []
    for k in range(400):
        bad = k % 4 == 0
        rows.append((k, "\n".join([line()] + [junk() if bad else line() for _ in range(r.randint(2, 6))])))
        labels.append((k, 0 if bad else 1, 0))
    rows += [(900, None), (901, ""), (902, "\n \n"), (903, (line() + "\n") * 3000), (None, line())]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("good", F.lit(0))
    lab = spark.createDataFrame(labels + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality.scored(df, lab).collect()}
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert all(got[k].held_out for k in held) and np.mean([got[k].predicted == (k % 4 != 0) for k in held]) > 0.97
    assert got[900].score == got[901].score == got[902].score and 0 <= got[900].score <= 1 and got[None].held_out is False
    assert quality.scored(df.limit(0), lab).count() == 0
    assert {x.predicted for x in quality.scored(df.limit(5), lab.limit(0)).collect()} == {1}
    kept = quality.kept(df, lab)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == {k for k, x in got.items() if x.predicted}


def test_urls(spark):
    rows = [(1, "HTTP://Sub.Example.ORG/es/x?q#f"), (2, "https://example.org/en/1/a"), (3, "http://notexample.org/es/"), (4, "http://x.com/de/1"), (5, "http://com/fr/"), (6, None), (7, "no scheme/x"), (8, "http://a.b?x=/y"), (9, "http://org"), (10, "a://b://c/d#e"), (10, "a://b://c/d#e"), (11, "http://É.com/" + "x" * 5000)]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("h"))
    got = {r.page_id: (r.host, r.path, r.rule) for r in urls.judged(df).collect()}
    assert got[1] == ("sub.example.org", "/es/x", "example.org/es/") and got[2][2] == "example.org/en/1" and got[3] == ("notexample.org", "/es/", "org/")
    assert got[4][2] == "com/de/" and got[5] == ("com", "/fr/", "com/fr/") and got[6] == ("", "", None) and got[7] == ("", "", None)
    assert got[8] == ("a.b", "", None) and got[9] == ("org", "", None) and got[10] == ("b:", "//c/d", None) and got[11][0] == "É.com"
    assert urls.judged(df.limit(0)).count() == 0


def test_url_model_separates_its_table(spark):
    table = urls.labelled_table(spark)
    w = urls.train(table)
    p = table.select("label", urls.probability(urls.buckets(F.col("host"), F.col("path")), w).alias("p")).collect()
    assert all((r.p >= 0.5) == (r.label == 1) for r in p)
    assert urls.train(table.limit(0)) == [0.0] * (urls.BUCKETS + 1)


def test_every_language_is_trained(spark):
    rows = [(d, f"l{d % 300:03}", f"text of language number {d % 300}") for d in range(3000)]
    langs, logp = langid.train(spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(2))
    assert len(langs) == len(logp) == 300
