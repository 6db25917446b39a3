import hashlib
import random

import pytest

from loomgraph.llm import decontam


def brute(docs, items, window=10):
    out = {}
    pats = {i: decontam.patterns(t, window) for i, t in items}
    for d, text in docs:
        w = decontam.words(text)
        hit, who = set(), set()
        for i, ps in pats.items():
            for p in ps:
                p = p.split(b" ")
                for k in range(len(w) - len(p) + 1):
                    if w[k : k + len(p)] == p:
                        hit.update(range(k, k + len(p)))
                        who.add(i)
        out[d] = (len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(map(str, who))).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("chars", [10**6, 60])
def test_like_brute_force(spark, monkeypatch, chars):
    monkeypatch.setattr(decontam, "AUTOMATON_CHARS", chars)
    rng = random.Random(3)
    word = lambda: rng.choice(["A", "b", "Cé", "d9", "e"])
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 3, 5, 7])))) for i in range(12)] + [(50, None), (51, "A, b!"), (52, "a-b")]
    docs = [(i, rng.choice([" ", "\n", ", "]).join(word() for _ in range(rng.randrange(0, 25)))) for i in range(60)] + [(100, None), (101, "?!"), (102, "x " * 3000 + "A b")]
    got = decontam.digest(decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 5))
    assert {r["doc_id"]: tuple(r)[1:] for r in got.collect()} == brute(docs, items, 5)


def test_spans_and_clean(spark):
    docs = spark.createDataFrame([(1, "Éa — One, TWO three; four", "k"), (2, "one two", "k"), (2, "one two", "k"), (None, None, None)], "doc_id long, text string, items string")
    bench = spark.createDataFrame([(7, "one two three"), (None, "one two")], "item_id long, text string")
    r = decontam.contamination(docs, bench).filter("doc_id = 1").first()
    assert [("Éa — One, TWO three; four")[s["start"] : s["end"]] for s in r["spans"]] == ["One, TWO three"]
    assert r["items"] == [7] and [tuple(h) for h in r["hits"]] == [(2, 5)]  # the dash is a word, too
    assert sorted((x["doc_id"] or 0) for x in decontam.clean(docs, bench).collect()) == [0, 2, 2]
    assert decontam.clean(docs, bench.limit(0)).count() == 4
    assert decontam.contamination(docs.limit(0), bench).count() == 0
