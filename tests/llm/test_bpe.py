import hashlib
import random

import public_tokenizers
import pytest

from loomgraph.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize(("chunk", "overlap"), [(7, 2), (16, 4), (64, 8)])
def test_chunks_stitch_to_the_whole(chunk, overlap):
    small, whole = bpe.Codec(PATH, public_tokenizers.PATTERN, chunk, overlap), bpe.Codec(PATH, public_tokenizers.PATTERN)
    rng = random.Random(chunk)
    alphabet = ["a", "b", "the ", " ", "  ", "\n", "\n\n", "'", "'s", "'re", "!!", "12", "é", "日本", "\u00a0", "\t", "🙂", "word", "x" * 30, "、", "字", "。", "ヶ", "Я", "！"]
    for n in range(300):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 120)))
        ids = small.encode(text)
        assert ids == whole.core.encode_ordinary(text), repr(text)
        assert small.decode(ids) == text.encode()


def test_texts_without_a_boundary():
    small = bpe.Codec(PATH, public_tokenizers.PATTERN, 16, 4)
    for text in ("x" * 500, " " * 500, "日" * 300, "a" * 200 + " " + "b" * 200):
        assert small.encode(text) == small.core.encode_ordinary(text)


def test_texts_without_ascii_are_cut_too():
    small = bpe.Codec(PATH, public_tokenizers.PATTERN, 16, 4)
    text = "日本語の文です。次、三！" * 40
    assert len(small.cuts(text)) > 10 and small.encode(text) == small.core.encode_ordinary(text)


def test_frames(spark):
    rows = [(1, "It's 12  o'clock.\n\nÉtude", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x"), (None, "a " * 30_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    coded = bpe.encode(docs, PATH, public_tokenizers.PATTERN)
    back = bpe.decode(coded, PATH, public_tokenizers.PATTERN)
    got = {r["doc_id"]: (r["decoded"] or b"").decode() for r in back.collect()}
    assert got == {i: t or "" for i, t, _ in rows}
    assert bpe.encode(docs, PATH, public_tokenizers.PATTERN).columns == ["doc_id", "ids"]  # the result replaces a column of its name
    both = bpe.encode(docs.withColumn("decoded", bpe.F.lit(1)), PATH, public_tokenizers.PATTERN, decoded_col="decoded")
    assert {r["doc_id"]: r["decoded"].decode() for r in both.collect()} == got
    d = {r["doc_id"]: r for r in bpe.digest(docs, PATH, public_tokenizers.PATTERN).collect()}
    assert d[2]["n_tokens"] == 0 and d[2]["ids_sha256"] == d[2]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    assert d[None]["decoded_sha256"] == hashlib.sha256(b"a " * 30_000).hexdigest()
    assert bpe.digest(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
