import random

import pytest

from loomgraph.llm import jaccard


def sets(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    s = {i: sets(t) for i, t in rows}
    low = {i: i for i in s}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    ids = sorted(s)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                a, b = sorted((root(i), root(j)))
                low[b] = a
    return {i: (len(s[i]), root(i)) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde") for _ in range(3))
    passage = [word() for _ in range(60)]
    rows = []
    for g in range(25):
        text = [word() for _ in range(rng.choice([3, 8, 30, 80, 200]))]
        if g % 3 == 0:
            text = passage + text[:20]
        for _ in range(rng.randrange(1, 12)):
            t = list(text)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                t[rng.randrange(len(t))] = word()
            rows.append(" ".join(t).upper() if rng.random() < 0.2 else "  ".join(t))
    rows += ["", None, "one", "One", "one two", " \n ", "é " * 10]
    rng.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("seed", "block"), [(1, 2_000), (2, 5)])
def test_like_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "HOT", 5)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, _id string").repartition(3)
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.components(df).collect()}
    want = brute(rows)
    assert got == want
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (n, c) in want.items() if i == c)


def test_prefixes_share_enough():
    import numpy as np

    rng = np.random.default_rng(0)
    s = jaccard.Settings()
    heavy = np.sort(rng.integers(0, 2000, 300).astype(np.uint64))
    heavy = np.unique(heavy)
    df = rng.integers(2, 5000, len(heavy)).astype(float)
    for _ in range(400):
        x = np.unique(rng.integers(0, 2000, rng.integers(1, 120)).astype(np.uint64))
        y = np.unique(np.append(np.delete(x, rng.integers(0, len(x), len(x) // 12)), rng.integers(0, 2000, len(x) // 12).astype(np.uint64)))
        both = len(np.intersect1d(x, y))
        if 100 * both >= 80 * (len(x) + len(y) - both):
            (lx, px), (ly, py) = jaccard.prefix(x, heavy, df, s), jaccard.prefix(y, heavy, df, s)
            assert len(np.intersect1d(px, py)) >= min(lx, ly)
            assert len(np.intersect1d(np.concatenate(jaccard.meeting(x, heavy, df, s)), np.concatenate(jaccard.meeting(y, heavy, df, s))))
            assert jaccard.possible(jaccard.bitmap(x), len(x), jaccard.bitmap(y), len(y), 80)


def test_edges(spark):
    text = " ".join(f"w{i}" for i in range(20_000))
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "x y z"), (None, "a b c d e f"), (9, text), (10, text + " end"), (11, None), (11, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["id"] or 0, r["n_shingles"], r["component_id"]) for r in jaccard.components(df).collect())
    assert got == [(0, 2, None), (1, 1, 1), (1, 2, 1), (1, 2, 1), (9, 19_996, 9), (10, 19_997, 9), (11, 0, 11), (11, 0, 11)]
    assert jaccard.components(df.limit(0)).count() == 0
    kept = sorted((r["doc_id"] or 0, (r["text"] or "")[:11]) for r in jaccard.keep_one(df).collect())
    assert [k for k, _ in kept] == [0, 1, 9, 11, 11]


@pytest.mark.parametrize("block", [2_000, 5])
def test_no_link_is_lost(spark, monkeypatch, block):
    """All links of all sets, also those inside a component that other links hold together."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = corpus(3)
    every = {frozenset(sets(t)) for _, t in rows if sets(t)}
    near = {x: sum(x != y and 100 * len(x & y) >= 80 * len(x | y) for y in every) for x in every}
    df = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string").repartition(3)
    got = {r["id"]: r["n_links"] for r in jaccard.linked(df).collect()}
    assert got.pop(None) is None and max(near.values()) > 3
    assert got == {i: near.get(frozenset(sets(t)), 0) for i, t in rows}
