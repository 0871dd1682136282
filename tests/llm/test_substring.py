import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from clade.llm import substring
from clade.llm.common import relieve


def words(r, n):
    return [f"{r.choice('abcdefgh')}{r.randint(0, 9999)}" for _ in range(n)]


@pytest.fixture(scope="module")
def planted():
    r = random.Random(1)
    passage = words(r, 70)
    fuzzy = [w if k % 18 else "x" for k, w in enumerate(passage)]
    short = words(r, 30)
    docs = {
        1: words(r, 40) + passage + words(r, 30),
        2: words(r, 25) + passage + words(r, 10),
        3: fuzzy + words(r, 30),
        4: words(r, 120),
        5: words(r, 50) + short,
        6: short + words(r, 50),
        9: words(r, 15) + [w.upper() for w in passage],
    }
    return docs, passage


def brute_spans(docs, least):
    """Longest exact runs that an earlier document has."""
    out = {}
    for d, w in docs.items():
        w = [x.lower() for x in w]
        for e, v in docs.items():
            if e < d:
                v = [x.lower() for x in v]
                for a in range(len(w)):
                    for b in range(len(v)):
                        n = 0
                        while a + n < len(w) and b + n < len(v) and w[a + n] == v[b + n]:
                            n += 1
                        if n >= least:
                            out.setdefault(d, set()).update(range(a, a + n))
    return out


def test_planted_passages(spark, planted):
    docs, _ = planted
    rows = [(d, " ".join(w)) for d, w in docs.items()] + [(None, " ".join(docs[1])), (20, None), (21, ""), (22, "one"), (4, " ".join(docs[4]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as block", "2 as key", "3 as words")
    got = {r.doc_id: r for r in substring.repeated_passages(df).collect()}
    assert set(got) == {2, 3, 9}
    exact = brute_spans({d: docs[d] for d in (1, 2, 9)}, 50)
    for d in (2, 9):
        assert set(range(got[d].start_word, got[d].end_word)) == exact[d] and got[d].identity > 0.97 and 1 in got[d].first_ids
    assert got[3].n_words >= 68 and 0.9 < got[3].identity < 1


def test_cut(spark, planted):
    docs, passage = planted
    df = spark.createDataFrame([(d, " ".join(w), "en", "s", 5) for d, w in docs.items()], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r for r in substring.deduplicated(df).collect()}
    assert set(out) == set(docs)
    assert out[2].text.split() == docs[2][:25] + docs[2][95:] and out[2].n_chars == len(out[2].text)
    assert out[1].text == " ".join(docs[1]) and out[4].text == " ".join(docs[4])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substring.repeated_passages(df).count() == 0 and substring.deduplicated(df).count() == 0


def test_without():
    assert substring.without("a  b\nc d", [(1, 3)]) == "a  d"
    assert substring.without("a b", [(0, 2)]) == "" and substring.without(None, [(0, 1)]) is None
    assert substring.without("a b c d e", [(1, 3), (2, 4)]) == "a e"


def brute_chain(x, y):
    """Best chain score by trying every predecessor."""
    order = np.lexsort((-y, x))
    x, y = x[order], y[order]
    best = []
    for i in range(len(x)):
        s = 0.0
        for j in range(i):
            if y[j] < y[i]:
                s = max(s, best[j] - substring.GAP_COST * (x[i] - x[j] + y[i] - y[j]))
        best.append(s + substring.SEED_SCORE)
    return max(best)


def test_chaining_against_all_predecessors():
    r = np.random.default_rng(2)
    for _ in range(60):
        n = int(r.integers(1, 25))
        x, y = r.integers(0, 200, n), r.integers(0, 200, n)
        top = substring.chains(x, y)[0]
        assert all(y[a] < y[b] for a, b in zip(top, top[1:]))
        cost = sum(substring.GAP_COST * (x[b] - x[a] + y[b] - y[a]) for a, b in zip(top, top[1:]))
        assert len(top) * substring.SEED_SCORE - cost == pytest.approx(brute_chain(x, y))
        assert sorted(sum(substring.chains(x, y), [])) == list(range(n))


def test_minimizers_keep_a_seed_in_every_window():
    r = np.random.default_rng(3)
    x = r.integers(0, 50, 400).astype(np.uint64)
    want = {s + int(k) for s in range(len(x) - 11) for k in np.flatnonzero(x[s : s + 12] == x[s : s + 12].min())}
    assert set(substring.minimizers(x, 12).tolist()) == want


def test_equal_runs_share_a_seed_at_the_same_place():
    r = np.random.default_rng(9)
    for lo, hi, window in (substring.NEAR, substring.FAR):
        run = window - 1 + hi + substring.GRAM
        for _ in range(50):
            shared = r.integers(1, 1 << 60, run).astype(np.uint64)
            found = []
            for before in (int(r.integers(0, 30)), int(r.integers(0, 30))):
                words = np.concatenate([r.integers(1, 1 << 60, before).astype(np.uint64), shared, r.integers(1, 1 << 60, 40).astype(np.uint64)])
                at, keys = substring.linked_grams(words, np.zeros(len(words), np.int64), lo, hi, window)
                found.append(set(zip((at - before).tolist(), keys.tolist(), strict=True)))
            assert found[0] & found[1]


def test_packing():
    r = np.random.default_rng(8)
    a, b = r.integers(0, 1 << 60, 1000).astype(np.uint64), r.integers(0, 9, 1000).astype(np.uint8)
    x, y = substring.unpacked(substring.packed(a, b), 1000, np.uint64, np.uint8)
    assert (x == a).all() and (y == b).all()


def brute_common(a, c):
    row = [0] * (len(c) + 1)
    for w in a:
        new = [0]
        for j, v in enumerate(c):
            new.append(row[j] + 1 if w == v else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_first_holders_of_a_bucket_in_little_memory():
    r = np.random.default_rng(3)
    rows, held = [], {}
    for block in range(200):
        keys = np.unique(r.integers(0, 120_000, 600, dtype=np.uint64) << np.uint64(20))
        place = r.integers(0, 20, len(keys)).astype(np.uint32)
        doc, word = (place.astype(np.int64) * 7919 + block * 31) % 1009 - 5, r.integers(0, 4000, len(keys)).astype(np.uint32)
        many = (r.random(len(keys)) < 0.1).astype(np.uint8)
        rows.append((0, block, len(keys), substring.packed(keys, doc, place, word, many)))
        for k, d, p, w, m in zip(keys.tolist(), doc.tolist(), place.tolist(), word.tolist(), many.tolist(), strict=True):
            held.setdefault(k, []).append((d, block, p, w, m))
    batches = pa.table([list(c) for c in zip(*rows, strict=True)], schema=substring.ENTRIES).to_batches(max_chunksize=64)
    tracemalloc.start()
    try:
        out = list(substring._first_holders(iter(batches)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 90 * sum(n for *_, n, _ in rows)  # it was 150 bytes an entry

    answers, places = set(), set()
    for key, entries in held.items():
        first = min(entries)
        for d, block, _, _, m in entries:
            if d != first[0] or m:
                answers.add((block, key, *first[:4]))
                places.add((first[1], first[2]))
    got, seen = [], []
    for b in out:
        for block, n, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if n > 0:
                got += [(block, *row) for row in zip(*(a.tolist() for a in substring.unpacked(data, n, *substring.ANSWER)), strict=True)]
            else:
                seen += [(block, p) for p in substring.unpacked(data, -n, np.uint32)[0].tolist()]
    assert len(got) == len(answers) and set(got) == answers
    assert len(seen) == len(places) and set(seen) == places


def test_executors_collect_their_heap(spark):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans

    def collections():
        return sum(b.getCollectionCount() for b in beans() if "Young" not in b.getName())

    before = collections()
    relieve(spark)
    assert collections() > before


def test_common_words():
    r = np.random.default_rng(10)
    for _ in range(60):
        a, c = r.integers(0, 8, int(r.integers(0, 40))), r.integers(0, 8, int(r.integers(0, 40)))
        assert substring.common_words(a, c) == brute_common(a.tolist(), c.tolist())
    a = np.arange(600)
    assert substring.common_words(a, np.concatenate([[9999], a[:-1]])) == 599


def test_two_passages_with_unlike_text_between(spark):
    r = random.Random(4)
    one, two = words(r, 60), words(r, 60)
    df = spark.createDataFrame([(d, " ".join(one + words(r, 80) + two)) for d in (1, 2)], "doc_id long, text string")
    got = sorted((x.start_word, x.end_word, x.identity) for x in substring.repeated_passages(df).collect())
    assert got == [(0, 60, 1.0), (140, 200, 1.0)]


def brute_grown(a, c):
    """Best score of an alignment of a prefix of each."""
    row = [substring.UNEQUAL * j for j in range(len(c) + 1)]
    best = 0
    for i, w in enumerate(a):
        new = [row[0] + substring.UNEQUAL]
        for j, v in enumerate(c):
            new.append(max(row[j] + (substring.EQUAL if w == v else substring.UNEQUAL), row[j + 1] + substring.UNEQUAL, new[j] + substring.UNEQUAL))
        row, best = new, max(best, *new)
    return best


def test_growth_with_gaps():
    r = np.random.default_rng(5)
    for _ in range(100):
        a = r.integers(0, 1000, 40)
        c = np.insert(np.delete(a, r.integers(0, 40, 2)), int(r.integers(5, 30)), 5000)
        c[r.integers(0, len(c), 2)] = 6000
        i, j, agree = substring.grown(a, c)
        assert max(brute_grown(a[:i], c[:j]), 0) == brute_grown(a, c) and agree <= min(i, j)
    assert substring.grown(a, a) == (40, 40, 40) and substring.grown(a[:0], a) == (0, 0, 0)


def test_later_holders_are_tried(spark):
    r = random.Random(6)
    docs, want = {}, set()
    for t in range(0, 60, 3):
        one, two = words(r, 30), words(r, 30)
        docs[t] = one + words(r, 100) + two
        docs[t + 1] = words(r, 20) + one + two + words(r, 20)
        docs[t + 2] = words(r, 5) + one + two + words(r, 40)
        want.add((t + 2, 5, 65))
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    got = substring.repeated_passages(df).collect()
    assert {(x.doc_id, x.start_word, x.end_word) for x in got} == want and all(x.doc_id - 1 in x.first_ids for x in got)


def test_lines_of_several_holders_are_no_passage(spark):
    r = random.Random(7)
    lines = [words(r, 25) for _ in range(5)]
    docs = [words(r, 30) + line + words(r, 30) for line in lines] + [sum(lines, [])]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(docs)], "doc_id long, text string")
    assert substring.repeated_passages(df).count() == 0


def table(spark, docs):
    return spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string")


def spans(df):
    return {(x.doc_id, x.start_word, x.end_word) for x in substring.repeated_passages(df).collect()}


def test_a_long_end_with_changed_words(spark):
    r = random.Random(11)
    passage = words(r, 400)
    changed = passage[:60] + [w if k % 8 else "x" for k, w in enumerate(passage[60:])]
    got = substring.repeated_passages(table(spark, [(1, words(r, 20) + passage), (2, words(r, 9) + changed + words(r, 9))])).collect()
    assert len(got) == 1 and got[0].start_word <= 10 and got[0].end_word >= 405 and 0.88 < got[0].identity < 0.92


def test_a_word_put_into_a_long_gap(spark):
    r = random.Random(12)
    passage = words(r, 1200)
    changed = passage[:100] + ["put"] + passage[100:]
    got = substring.repeated_passages(table(spark, [(1, passage), (2, changed)])).collect()
    assert [(x.start_word, x.end_word) for x in got] == [(0, 1201)]


def test_equal_windows_are_found_whatever_the_first_holders_have(spark):
    r = random.Random(13)
    docs, want = [], set()
    for t in range(0, 90, 3):
        n = r.randint(1, 49)
        run = words(r, 51)
        docs.append((t, run[:n] + words(r, 70) + run[n:]))
        docs.append((t + 1, words(r, 20) + run + words(r, 20)))
        docs.append((t + 2, words(r, 5) + run + words(r, 40)))
        want.add((t + 2, 5, 56))
    got, ends = spans(table(spark, docs)), substring.NEAR[1] + substring.GRAM
    assert all(any(d == g[0] and g[1] <= s + ends and e - ends <= g[2] for g in got) for d, s, e in want)


def test_rows_that_share_an_id_keep_their_own_passages(spark):
    r = random.Random(14)
    passage, own, other = words(r, 60), words(r, 100), words(r, 30)
    rows = [(1, passage), (7, own), (7, other + passage), (7, other + passage), (None, passage)]
    df = spark.createDataFrame([(d, " ".join(w), 1, 2, 3) for d, w in rows], "doc_id long, text string, _c0 int, _C1 int, __spans int")
    out = sorted(((x.doc_id or 0), x.text) for x in substring.deduplicated(df).collect())
    left = " ".join(other) + " "
    assert out == sorted([(1, " ".join(passage)), (7, " ".join(own)), (7, left), (7, left), (0, " ".join(passage))])


def test_a_line_in_every_document_is_no_passage_and_makes_no_pairs(spark):
    r = random.Random(15)
    line = words(r, 30)
    df = table(spark, [(d, words(r, 20) + line + words(r, 20)) for d in range(300)])
    assert substring.repeated_passages(df).count() == 0


def test_a_very_long_text(spark):
    r = random.Random(16)
    passage = words(r, 60)
    long = words(r, 300_000) + passage
    assert spans(table(spark, [(1, passage), (2, long)])) == {(2, 300_000, 300_060)}


def changed(r, passage, share):
    out = []
    for w in passage:
        u = r.random()
        if u >= share:
            out.append(w)
        elif u < share / 3:
            out += [w, f"new{r.randint(0, 10**9)}"]
        elif u < 2 * share / 3:
            out.append(f"new{r.randint(0, 10**9)}")
    return out


def local_alignment(a, c):
    """Brute force: the best local alignment with the operator's scores, over
    every cell of the table. Returns (words of a, words of c, equal words)."""
    best, end = 0, (0, 0, 0)
    row = [(0, 0, 0, 0)] * (len(c) + 1)
    for i, w in enumerate(a):
        new = [(0, 0, 0, 0)]
        for j, v in enumerate(c):
            s, x, y, n = row[j]
            up, left = row[j + 1], new[j]
            cell = max((s + (substring.EQUAL if w == v else substring.UNEQUAL), x + 1, y + 1, n + (w == v)), (up[0] + substring.UNEQUAL, up[1] + 1, up[2], up[3]), (left[0] + substring.UNEQUAL, left[1], left[2] + 1, left[3]))
            new.append(cell if cell[0] > 0 else (0, 0, 0, 0))
            if new[-1][0] > best:
                best, end = new[-1][0], new[-1][1:]
        row = new
    return end


def test_recall_against_local_alignment(spark):
    """Of the passages that a table of all cells finds in pairs of documents,
    with shares of words changed up to 18 %, nine in ten are found."""
    r = random.Random(17)
    docs, want = [], []
    for t in range(0, 480, 2):
        passage = words(r, r.randint(60, 90))
        a = words(r, r.randint(5, 30)) + passage + words(r, r.randint(5, 30))
        c = words(r, r.randint(5, 30)) + changed(r, passage, (t // 2 % 10) * 0.02) + words(r, r.randint(5, 30))
        docs += [(t, a), (t + 1, c)]
        x, y, n = local_alignment(a, c)
        if y >= 50 and n >= 0.8 * max(x, y):
            want.append(t + 1)
    got = {x[0] for x in spans(table(spark, docs))}
    assert len(want) > 180 and len(got & set(want)) >= 0.9 * len(want) and all(d % 2 for d in got)
