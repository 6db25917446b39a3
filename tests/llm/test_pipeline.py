import random

import public_tokenizers
import pytest

from loomgraph.llm import bpe, decontam, toxicity
from tests.llm.test_jaccard import brute as near_brute

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 6)))
    passage = " ".join(word() for _ in range(40))
    rows, labels = [], []
    for i in range(500):
        w = [word() for _ in range(rng.randrange(30, 90))]
        if i % 8 == 0:
            w += ["Horrid" + word() for _ in range(6)]
        if i % 50 == 1:
            w += passage.split()
        if i % 20 == 2:
            w += [f"mail.{i}@host{i % 3}.example.org"]
        labels.append((i, 1, int(i % 8 == 0)))
        rows.append((i, " ".join(w)))
    for i in (5, 7, 9):
        for k in range(3):
            rows.append((1000 + i * 10 + k, rows[i][1] + " tail" * (k > 0)))
    rows += [(2000, None), (2001, ""), (2002, "short")]
    d = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame([(i, t, "en", "s0", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([l for l in labels if l[0] % 2 == 0], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, passage), (1, "never there at all in any of these texts whatsoever today")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, dict(rows)


def test_like_a_plain_version(spark, folder):
    d, texts = folder
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, d).collect()}
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    score = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    left = {i: t for i, t in texts.items() if score[i] < 0.7}
    assert sum(i % 8 == 0 for i in left if i < 500) <= 3 and sum(i % 8 != 0 for i in left if i < 500) >= 430
    near = near_brute(sorted(left.items()))
    left = {i: t for i, t in left.items() if near[i][1] == i}
    a = decontam.build([(0, spark.read.parquet(f"{d}/benchmark.parquet").filter("item_id = 0").first()["text"])])
    left = {i: t for i, t in left.items() if not decontam.scan(a, t).items}
    assert set(got) == set(left)
    c = bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for i, r in got.items():
        if "@" not in (left[i] or ""):
            assert r["text"] == (left[i] or "")
        else:
            assert "@" not in r["text"] and "[EMAIL]" in r["text"]
        assert r["ids"] == c.encode(r["text"]) and r["n_tokens"] == len(r["ids"])


def test_stages_keep_columns(spark, folder):
    d, _ = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(20), d).columns == docs.columns, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "decontamination", "personal_data", "tokens"]
