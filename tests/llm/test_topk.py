import numpy as np
import pytest

from loomgraph.llm import topk


def brute(rows, queries, k):
    ok = [(i, np.floor(64 * np.array(v, float))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for i, v in ok:
        if i in queries:
            scored = sorted((-int(sum(a * b for a, b in zip(v, w, strict=False))), j) for j, w in ok if j != i)
            out[i] = [(r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return out


@pytest.mark.parametrize(("n", "k", "spread"), [(400, 20, 1.0), (400, 5, 0.05), (12, 20, 1.0), (300, 20, 0.0)])
def test_like_brute_force(spark, n, k, spread):
    rng = np.random.default_rng(n + k)
    base = rng.normal(size=(5, 16))
    rows = [(i, [float(np.float32(x)) for x in base[i % 5] + spread * rng.normal(size=16)]) for i in range(n)]
    rows += [(9001, None), (9002, [1.0, None]), (9003, [float("nan")] * 16), (9004, [float("inf")]), (None, rows[0][1]), (9005, [0.5, -0.5]), (9006, []), (9007, [0.0] * 16)]
    df = spark.createDataFrame([(i, v, "k") for i, v in rows], "vec_id long, embedding array<float>, score string").repartition(3)
    asked = {i for i, _ in rows if i is not None and i % 20 == 0} | {9005, 9006}
    got = {}
    for r in topk.top_k(df, df.filter(df.vec_id.isin(list(asked))), k).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert {q: sorted(v) for q, v in got.items()} == brute(rows, asked, k)


def test_stops_on_proof():
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(2000, 32)) * 3)
    x[:40] = np.round(rng.normal(size=32) * 30)
    r, d = np.nonzero(x)
    v = x[r, d].astype(np.int32)
    o = np.argsort(-np.abs(v), kind="stable")
    ends = sorted({int((np.abs(v) >= max(1, lv * np.abs(v).max())).sum()) for lv in topk.LEVELS} | {len(v)})
    block = {"ids": np.arange(2000).astype("<i8").tobytes(), "width": 32, "dim": d[o].astype("<i4").tobytes(), "place": r[o].astype("<u2").tobytes(), "value": v[o].tobytes(), "ends": ends}
    best = topk.Best(1, 20)
    assert topk.search_block(block, np.array([0]), x[:1], best) <= 80  # the 40 equal vectors tie
    assert best.id[0].tolist() == list(range(1, 21))


def test_empty_and_large(spark):
    rows = [(1, [1e6, 3.0]), (2, [1.0, -7e5]), (3, [2e4, 2e4]), (4, [1e6, 3.0 + 2**-6]), (5, [-1e6, 0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(df, df, 3).collect()}
    want = brute(rows, {1, 2, 3, 4, 5}, 3)
    assert got == {(q, r): (j, s) for q, x in want.items() for r, j, s in x}
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0
    far = spark.createDataFrame([(1, [1e20]), (2, [1e20])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond the range"):
        topk.top_k(far, far).collect()


def test_repeated_ids(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [3.0, 1.0]), (1, [3.0, 1.0]), (2, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, df.filter("vec_id = 20")).orderBy("rank").collect()]
    one = 64 * 64
    assert got == [(1, 1, 3 * one), (2, 1, 3 * one), (3, 2, 2 * one), (4, 1, one), (5, 1, one), (6, 2, 0)]
