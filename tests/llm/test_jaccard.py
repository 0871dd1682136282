import re
import random

from clade.llm import jaccard

ODD = [(None, "a b c d"), (1, None), (2, ""), (3, " \n\t "), (4, "One"), (5, "one"), (6, "one two"), (7, "ONE  two")]


def brute(rows, k, pct):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))
    root = {i: i for i, _ in rows if i is not None}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= pct * len(s | t):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted(((i, len(s), find(i) if i is not None else None) for i, s in sets), key=str)


def corpus(n=160, seed=3):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    hot = [r.choice(words) for _ in range(80)]
    rows = []
    for i in range(10, n):
        kind = r.random()
        if kind < 0.4:  # near copies of one text
            t = [w if r.random() > 0.02 else r.choice(words) for w in hot]
        elif kind < 0.5:
            t = hot[:]
        elif kind < 0.7:  # a shared passage among words of its own
            t = [r.choice(words) for _ in range(40)] + hot[:30]
        else:
            t = [r.choice(words) for _ in range(r.randint(1, 60))]
        rows.append((i, " ".join(t)))
    return rows


def got(spark, rows, k, pct):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("text", "doc_id", "'x' as sig", "1 as n", "2 as component_id")
    return sorted((tuple(r) for r in jaccard.near_duplicates(df, k, pct).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def test_against_brute_force(spark):
    rows = corpus() + ODD + corpus()[:3]  # and repeated rows
    for k, pct in ((3, 90), (5, 80)):
        assert got(spark, rows, k, pct) == brute(rows, k, pct)


def test_small_groups_and_every_token_frequent(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP_MEMBERS", 4)
    monkeypatch.setattr(jaccard, "FREQUENT", 2)
    rows = corpus(90, 5)
    assert got(spark, rows, 3, 90) == brute(rows, 3, 90)


def test_empty_table(spark):
    assert got(spark, [], 3, 90) == []


def test_one_of_each_group_stays(spark):
    rows = [(1, "a b c d e f"), (2, "A b c d e f"), (3, "other words"), (None, "a b c d e f"), (5, None)]
    df = spark.createDataFrame([(i, t, "de", "s", 3) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = jaccard.deduplicated(df)
    assert out.columns == df.columns and sorted((r.doc_id or 0) for r in out.collect()) == [0, 1, 3, 5]
