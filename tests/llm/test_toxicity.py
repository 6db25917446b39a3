import random
import zlib

import numpy as np

from loomgraph.llm import toxicity as T


def test_fit_finds_the_word_that_hidden_positives_share():
    rng, i = np.random.default_rng(0), np.arange(3000)
    known, hidden = i < 450, (i >= 450) & (i % 10 == 0)
    sets = [np.unique(np.append(rng.integers(100, 400, 30), [7 if known[k] or hidden[k] else 8])).astype(np.uint32) for k in i]
    m = T.fit(sets, np.where(known, T.POSITIVE, T.UNLABELLED) | np.where((i >= 450) & (i < 900) & ~hidden, T.NEGATIVE, 0), 0.1)
    g = np.array([m.bias + sum(m.weights.get(int(f), 0.0) for f in x) for x in sets])
    assert m.weights[7] == max(m.weights.values()) and m.weights[8] == min(m.weights.values())
    assert (g[hidden][:, None] > g[~known & ~hidden][None, :]).mean() > 0.9


def test_like_a_plain_nnpu():
    """The sparse fit against dense matrices, the gradient of the risk by finite differences."""
    rng = np.random.default_rng(3)
    p, u, s, prior = rng.random((20, 6)) < 0.4, rng.random((50, 6)) < 0.3, T.Settings(epochs=25), 0.3
    csr = lambda x: T.Csr(*(a.astype(np.int32) for a in np.nonzero(x)), len(x))
    w, bias = T.nnpu(csr(p), csr(u), 6, prior, s)
    softplus = lambda z: np.log1p(np.exp(z))

    def parts(t):
        gp, gu = p @ t[:-1] + t[-1], u @ t[:-1] + t[-1]
        return prior * softplus(-gp).mean(), softplus(gu).mean() - prior * softplus(gp).mean()

    t, m, v = np.append(np.zeros(6), np.log(prior / (1 - prior))), np.zeros(7), np.zeros(7)
    least = s.sparsity * prior * np.sqrt((p.sum(0) + u.sum(0) + 1) / 71 / 20)
    for k in range(1, s.epochs + 1):
        goal = (lambda x: sum(parts(x))) if parts(t)[1] >= 0 else (lambda x: -parts(x)[1])
        g = np.array([(goal(t + e) - goal(t - e)) / 2e-6 for e in np.eye(7) * 1e-6])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = s.rate / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        t = t - step * m / (1 - 0.9**k)
        t[:-1] = np.sign(t[:-1]) * np.maximum(abs(t[:-1]) - step[:-1] * least, 0)
    assert np.allclose(np.append(w, bias), t, atol=1e-3)


def test_risk_is_cut_at_zero():
    """Where positives and unlabelled texts are easily told apart, an uncut risk would go far below zero."""
    sets = [np.array([1 if i < 40 else 2], np.uint32) for i in range(200)]
    part = np.where(np.arange(200) < 40, T.POSITIVE, T.UNLABELLED)
    m = T.fit(sets, part, 0.4, T.Settings(epochs=400, sparsity=0))
    gu = np.full(160, m.bias + m.weights.get(2, 0.0))
    gp = np.full(40, m.bias + m.weights.get(1, 0.0))
    assert T.risk(gp, gu, 0.4)[1] > -0.2
    assert T.fit([], np.empty(0, int), 0.3).weights == {}


def test_held_out_accuracy_and_edges(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 5)))
    rows, labels = [], []
    for i in range(900):
        bad = i % 6 == 0
        w = [word() for _ in range(40)] + ["Vile" + word() for _ in range(5 * bad)]
        rng.shuffle(w)
        rows.append((i, " ".join(w), "k"))
        if i % 2 == 0:
            labels.append((i, 1, int(bad)))
    rows += [(2000, None, "k"), (2001, "", "k"), (None, "vile vileab", None), (3, rows[3][1], "k"), (2002, "ab " * 50_000, "k")]
    labels += [(None, 0, 1), (4, None, None), (6, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = T.train(docs, lab)
    got = T.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    p = {r["doc_id"]: r["score"] for r in got}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum((p[i] >= 0.7) == (i % 6 == 0) for i in held)
    assert right >= 0.95 * len(held)
    assert p[2000] == p[2001] < 0.7
    kept = T.keep(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, v in p.items() if v < 0.7}
    assert T.score(docs.limit(0), model).count() == 0
    none = T.train(docs, lab.limit(0))
    assert {r["score"] < 0.01 for r in T.score(docs, none).collect()} == {True}
