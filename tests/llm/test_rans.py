import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from loomgraph.llm import rans
from loomgraph.llm.common import small_batches

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n", [0, 1, 5, rans.LANES, rans.LANES + 1, 70_000, rans.BLOCK + 3])
def test_segment_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), 999).astype(np.uint32)
    t = rans.table_of(rans.frequencies(np.bincount(ids, minlength=1000)))
    data = rans.encode_segment([1, rans.NULL_ID], [n, 0], ids, t)
    s = rans.Segment(data)
    assert (s.ids(t) == ids).all() and s.lengths.tolist() == [n, 0]
    if n > 70_000:
        assert (s.part(0, 2, t) == ids[2 * rans.STEPS * rans.LANES : 3 * rans.STEPS * rans.LANES]).all()
        p = np.bincount(ids, minlength=1000) / n
        bits = -(p[p > 0] * np.log2(p[p > 0])).sum() * n
        assert 8 * len(data) < 1.2 * bits
        broken = bytearray(data)
        broken[-9] ^= 1
        with pytest.raises(ValueError):
            rans.Segment(bytes(broken))


def test_frequencies():
    for c in ([0] * 5, [1, 0, 0], [10**12, 1, 3], list(range(50_000))):
        f = rans.frequencies(np.array(c))
        assert f.sum() == 1 << rans.SCALE and f.min() >= 1


def test_words_like_whole_texts():
    enc, lib = rans.Encoder(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(2)
    pieces = ["a", " b", " 's", "'re", "\n", "  ", " ", "Éta", "ñ9", "12", "!?", "日本", "\t", " ", "<|endoftext|>", "…", "x\ny", "Été,", "no.", "ab***", "²", "a²,"]
    for _ in range(500):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(30)))
        assert np.frombuffer(enc(text), "<u2").tolist() == lib.encode(text, add_special_tokens=False).ids, repr(text)


def test_special_strings_as_the_library_gives_them():
    assert np.frombuffer(rans.Encoder(PATH)("a <|endoftext|> b"), "<u2").tolist() == Tokenizer.from_file(PATH).encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]


def test_files(spark, monkeypatch):
    monkeypatch.setattr(rans, "SEGMENT", 300)
    rows = [(i * 7 % 101, f"Word {i} and\nmore é{i}", "x") for i in range(101)] + [(None, "null id", "x"), (5000, None, "x"), (5001, "", "x"), (7, "again 7", "x"), (7, "again 7", "x"), (9000, "long " * 5000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(5)
    path = rans.encode(docs, PATH)
    got = rans.read(spark, path, with_ids=True).collect()
    assert len(got) == len(rows)
    lib, start = Tokenizer.from_file(PATH), 0
    want = sorted(((-1 if d is None else d), [*lib.encode(t or "", add_special_tokens=False).ids, 0]) for d, t, _ in rows)
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == start and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        start += r["n_tokens"]
    assert sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["ids"]) for r in got) == want
    order = [(-1 if r["doc_id"] is None else r["doc_id"]) for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order)
    assert rans.read(spark, rans.encode(docs.limit(0), PATH)).count() == 0


def test_counts_come_with_the_ids(spark):
    docs = spark.createDataFrame([(i, f"Word {i % 9}, and é{i}" if i else None) for i in range(50)], "doc_id long, text string").repartition(4)
    lib = Tokenizer.from_file(PATH)
    tokens = rans.tokenise(docs, PATH)
    assert tokens.filter("n IS NOT NULL").count() == 50 and tokens.filter("n IS NULL AND ids IS NULL").count() == 4
    want = np.zeros(lib.get_vocab_size(), np.int64)
    for r in docs.collect():
        np.add.at(want, [*lib.encode(r["text"] or "", add_special_tokens=False).ids, 0], 1)
    assert (rans.count(tokens, len(want)) == want).all()


def test_words_with_punctuation_are_kept_once_their_letters_are_known():
    enc, lib = rans.Encoder(PATH), Tokenizer.from_file(PATH)
    for k, text in enumerate(["x ciónmita. y", "y ciónmita. ciónmita", "ciónmita. ciónmita."]):
        assert np.frombuffer(enc(text), "<u2").tolist() == lib.encode(text, add_special_tokens=False).ids
        assert "ciónmita" in enc.later and ("ciónmita." in enc.later) == (k > 0)


def test_small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(2500)], "doc_id long, text string").coalesce(1)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    before = spark.conf.get(name)
    with small_batches(spark):
        assert sorted(r["n"] for r in docs.mapInArrow(sizes, "n long").collect()) == [500, 1000, 1000]
    with pytest.raises(KeyError), small_batches(spark, 10):
        raise KeyError
    assert spark.conf.get(name) == before


def test_ids_leave_a_task_in_small_batches(spark):
    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    texts = [f"word {i}" for i in range(250)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(250), pa.int64()), pa.array(texts)], ["id", "t"])
    assert [b.num_rows for b in rans.tokenise(Docs(), PATH)(iter([batch]))] == [100, 100, 50, 1]


def test_files_start_no_workers_but_those_of_the_operator(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"Word {i}") for i in range(20)], "doc_id long, text string")
    got, held = [], []
    count = rans.count
    monkeypatch.setattr(rans, "count", lambda *a: held.append(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) or count(*a))
    monkeypatch.setattr(spark.sparkContext, "parallelize", lambda *_: got.append("an RDD of Python rows"))
    assert rans.read(spark, rans.encode(docs, PATH)).count() == 20
    assert not got and held == ["1000"]


def test_each_word_of_a_batch_is_looked_up_once(monkeypatch):
    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    class Column:
        def cast(self, _):
            return self

        def alias(self, _):
            return self

    asked = []

    class Counted(rans._Known):
        def __getitem__(self, word):
            asked.append(word)
            return super().__getitem__(word)

    enc, lib = rans.Encoder(PATH), Tokenizer.from_file(PATH)
    enc.later = Counted(enc, " ")
    monkeypatch.setattr(rans, "_encoders", {PATH: enc})
    monkeypatch.setattr(rans.F, "col", lambda _: Column())
    texts = ["one two three two", None, "one two\nthree two three", "", "two  three", "three two"] * 30
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["id", "t"])
    *got, counts = rans.tokenise(Docs(), PATH)(iter([batch]))
    ids = [np.frombuffer(i, "<u2").tolist() for b in got for i in b.column("ids").to_pylist()]
    assert ids == [[*lib.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    assert sorted(asked) == ["three", "two"]


def test_batches_like_whole_texts():
    enc, lib = rans.Encoder(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(3)
    pieces = ["a", " b", " 's", "'re", "\n", "  ", " ", "Éta", "ñ9", "12", "!?", "日本", "\t", "\r", " ", "<|endoftext|>", "…", "x\ny", "no.", "\x00", "word word", " word"]
    for size in (0, 1, 7, 200):
        texts = [rng.choice([None, "", "".join(rng.choice(pieces[rng.randrange(2) * 20 :]) for _ in range(rng.randrange(12)))]) for _ in range(size)]
        got = [np.frombuffer(i, "<u2").tolist() for i in enc.batch(texts)]
        assert got == [lib.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_runs_are_bounded(monkeypatch):
    monkeypatch.setattr(rans, "RUN", 10)
    texts = ["x" * n if n is not None else None for n in (3, 0, 7, 1, 30, None, 10, 9, 1, 2)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["t"])
    assert [b.column("t").to_pylist() for b in rans.runs(iter([batch, batch.slice(4, 0), batch.slice(4)]))] == [texts[a:b] for a, b in [(0, 3), (3, 4), (4, 5), (5, 7), (7, 9), (9, 10), (4, 5), (5, 7), (7, 9), (9, 10)]]
