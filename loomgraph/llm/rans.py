r"""Token ids in files of static range asymmetric numeral system (rANS) blocks.

All blocks share one frequency table: counts over the whole corpus, scaled to 2**SCALE with at least one slot for every id
of the vocabulary. A segment holds whole documents; its ids are cut into blocks of BLOCK ids. A block is coded by LANES
states that take turns (lane i has the ids i, i + LANES, ...), shares one stream of 32-bit words and starts anew, so blocks
are independent. The block table holds each block's place and the crc32 of its ids; inside a block a checkpoint every
STEPS turns holds all states and the place in the stream. Blocks and checkpointed parts are thus decoded in parallel and
checked one by one.

Segment, little-endian: magic `LGR1`, u32 crc32 of the rest, u32 documents, u64 ids, u32 vocabulary, then i64 doc ids, u64
lengths; u32 blocks, then for each u64 offset, u32 ids, u32 words, u32 crc32, u32 checkpoints; then each block's checkpoints
(u32 word place, LANES u64 states) and words.

Edge cases: a null text is empty (its end id alone remains); a null doc_id sorts first and is kept by a flag (the smallest
i64 is reserved for it); repeated doc_ids are kept, ordered by their ids; an empty table gives no segment.
"""

from __future__ import annotations

import codecs
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import accumulate, islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomgraph.llm.common import slices, small_batches, tidy
from loomgraph.storage import materialise, new_path, release

MAGIC = b"LGR1"
SCALE, LANES, BLOCK, STEPS = 20, 1024, 1 << 18, 64
#: Ids of a segment at least, unless a partition ends; a longer document is not cut.
SEGMENT = 1 << 21
#: Bytes of the texts whose words are looked up together, one text at least.
RUN = 1 << 21
NULL_ID = -(1 << 63)
LAYOUT = "part int, segment int, inside long, n_ids long, first_doc long, data binary"


class Table(NamedTuple):
    """Shared frequencies: f sums to 2**SCALE, c their running sum before each id, symbol the id of each slot."""

    f: np.ndarray
    c: np.ndarray
    symbol: np.ndarray


def frequencies(counts: np.ndarray) -> np.ndarray:
    """counts scaled to 2**SCALE, at least 1 each, largest remainders first."""
    n, total = len(counts), 1 << SCALE
    if n > total:
        raise ValueError(f"{n} ids do not fit 2**{SCALE} slots")
    share = counts.astype(np.float64) * (total - n) / max(1, int(counts.sum()))
    f = np.floor(share).astype(np.int64) + 1
    left = total - int(f.sum())
    if left:
        order = np.argsort(-(share - np.floor(share)), kind="stable") if counts.sum() else np.arange(n)
        f += np.bincount(order[np.arange(left) % n], minlength=n)
    return f.astype(np.uint32)


def table_of(f: np.ndarray) -> Table:
    f = f.astype(np.uint64)
    return Table(f, np.cumsum(f) - f, np.repeat(np.arange(len(f), dtype=np.uint32), f.astype(np.int64)))


_LOW, _32, _M = np.uint64(1 << 31), np.uint64(32), np.uint64(SCALE)
_ROOM, _WORD, _SLOT = np.uint64(63 - SCALE), np.uint64(0xFFFFFFFF), np.uint64((1 << SCALE) - 1)


def encode_block(ids: np.ndarray, t: Table) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
    """Checkpoints (words read before, states) from the first turn on, and the words in reading order."""
    n = len(ids)
    turns = -(-n // LANES)
    x = np.full(LANES, _LOW)
    out, marks, written = [], [], 0
    for turn in range(turns - 1, -1, -1):
        s = ids[turn * LANES : (turn + 1) * LANES].astype(np.intp)
        f, v = t.f.take(s), x[: len(s)]
        over = v >= f << _ROOM
        if over.any():
            w = v[over]
            out.append((w & _WORD).astype("<u4"))
            written += len(w)
            v[over] = w >> _32
        q = v // f
        x[: len(s)] = (q << _M) + (v - q * f) + t.c.take(s)
        if turn % STEPS == 0:
            marks.append((written, x.copy()))
    words = np.concatenate(out[::-1]) if out else np.empty(0, "<u4")
    return [(written - w, states) for w, states in reversed(marks)], words


def decode_part(n: int, states: np.ndarray, words: np.ndarray, t: Table) -> np.ndarray:
    """n ids from a checkpoint's states and the words that follow it."""
    x, at, out = states.copy(), 0, np.empty(n, np.uint32)
    for begin in range(0, n, LANES):
        m = min(LANES, n - begin)
        v = x[:m]
        slot = v & _SLOT
        s = t.symbol.take(slot.view(np.int64)).astype(np.intp)
        out[begin : begin + m] = s
        v = t.f.take(s) * (v >> _M) + slot - t.c.take(s)
        low = v < _LOW
        k = int(low.sum())
        if k:
            v[low] = (v[low] << _32) | words[at : at + k]
            at += k
        x[:m] = v
    return out


def encode_segment(doc_ids: list[int], lengths: list[int], ids: np.ndarray, t: Table) -> bytes:
    blocks, body, offset = [], [], 0
    for b in range(0, len(ids), BLOCK):
        part = ids[b : b + BLOCK]
        marks, words = encode_block(part, t)
        raw = b"".join(struct.pack("<I", w) + s.astype("<u8").tobytes() for w, s in marks) + words.tobytes()
        blocks.append(struct.pack("<QIIII", offset, len(part), len(words), zlib.crc32(part.astype("<u4").tobytes()), len(marks)))
        body.append(raw)
        offset += len(raw)
    rest = struct.pack("<IQI", len(doc_ids), len(ids), len(t.f)) + np.array(doc_ids, "<i8").tobytes() + np.array(lengths, "<u8").tobytes() + struct.pack("<I", len(blocks)) + b"".join(blocks) + b"".join(body)
    return MAGIC + struct.pack("<I", zlib.crc32(rest)) + rest


class Segment:
    """Reads a segment; any block, and any checkpointed part of it, can be decoded alone."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC or zlib.crc32(data[8:]) != struct.unpack_from("<I", data, 4)[0]:
            raise ValueError("not a whole segment")
        docs, self.n, self.vocabulary = struct.unpack_from("<IQI", data, 8)
        at = 24
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.lengths = np.frombuffer(data, "<u8", docs, at + 8 * docs).astype(np.int64)
        at += 16 * docs
        count = struct.unpack_from("<I", data, at)[0]
        self.blocks = [struct.unpack_from("<QIIII", data, at + 4 + 24 * i) for i in range(count)]
        self.data, self.body = data, at + 4 + 24 * count

    def part(self, block: int, mark: int, t: Table) -> np.ndarray:
        """The ids between a block's checkpoint and the next."""
        offset, n, words, _, marks = self.blocks[block]
        at, size = self.body + offset, 4 + 8 * LANES
        begin = struct.unpack_from("<I", self.data, at + mark * size)[0]
        states = np.frombuffer(self.data, "<u8", LANES, at + mark * size + 4)
        stream = np.frombuffer(self.data, "<u4", words - begin, at + marks * size + 4 * begin)
        return decode_part(min(STEPS * LANES, n - mark * STEPS * LANES), states, stream, t)

    def block(self, i: int, t: Table) -> np.ndarray:
        ids = np.concatenate([self.part(i, m, t) for m in range(self.blocks[i][4])])
        if zlib.crc32(ids.astype("<u4").tobytes()) != self.blocks[i][3]:
            raise ValueError(f"block {i} is damaged")
        return ids

    def ids(self, t: Table) -> np.ndarray:
        return np.concatenate([self.block(i, t) for i in range(len(self.blocks))]) if self.blocks else np.empty(0, np.uint32)


#: The printable stand-ins that byte-level vocabularies use for the 256 bytes (printable Latin-1 for itself, then U+0100 on).
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_STAND_INS = {b: chr(b) for b in _SHOWN} | {b: chr(0x100 + i) for i, b in enumerate(sorted({*range(256)} - {*_SHOWN}))}
_SHOWN_AS = "".join(_STAND_INS[b] for b in range(256))


class Encoder:
    """Ids of whole texts by the tokenizers library, as little-endian u16 bytes (u32 where the vocabulary needs them).

    A boundary lies before each space or line end between two other characters, and between a word's letters and the
    punctuation behind them, so words with the space before them are encoded once and kept. Texts with other white space or
    with letters beyond the Latin blocks, on whose classes two regex engines might differ, go to the library whole.
    """

    plain = re.compile(r"[^!-~ \n¡-ɏ‐-‧]")

    def __init__(self, path: str, most: int = 450_000):
        self.core = Tokenizer.from_file(path)
        self.added = [t.content for t in self.core.get_added_tokens_decoder().values()]  # the library cuts texts at their strings
        self.code = "H" if self.core.get_vocab_size() <= 1 << 16 else "I"
        self.model, self.shown_before = self.core.model, {"": "", " ": _STAND_INS[0x20]}
        self.most, self.first, self.later = most, _Known(self, ""), _Known(self, " ")
        self.line_end = self.whole("\n")

    def whole(self, text: str) -> bytes:
        return array(self.code, self.core.encode(text, add_special_tokens=False).ids).tobytes()

    def letters(self, before: str, word: str) -> bytes:
        """Of one pre-token, letters behind `before`: the library's merges without its other steps. ASCII letters stand for themselves."""
        shown = self.shown_before[before] + (word if word.isascii() else codecs.charmap_decode(word.encode(), "strict", _SHOWN_AS)[0])
        return array(self.code, [t.id for t in self.model.tokenize(shown)]).tobytes()

    def __call__(self, text: str | None) -> bytes:
        return self.batch([text])[0]

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """Each word of the texts is looked up once. A text's first word bears the mark \\r, which no such text holds, and a line's first one its \\n."""
        out = [b""] * len(texts)
        plain, whole = [], []
        for i, text in enumerate(texts):
            if text:
                (whole if self.plain.search(text) or any(t in text for t in self.added) else plain).append(i)
        words = pc.split_pattern(pa.array(["\r" + texts[i].replace("\n", " \n") for i in plain], pa.large_string()), " ")
        known = words.values.dictionary_encode()
        later = self.later.__getitem__
        ids = pa.array([later(w) if w >= " " else self.begin(w) for w in known.dictionary.to_numpy(zero_copy_only=False).tolist()], pa.large_binary()).take(known.indices)
        at = words.offsets.to_numpy()
        if ids.null_count:
            odd = np.add.reduceat(ids.is_null().to_numpy(zero_copy_only=False), at[:-1], dtype=np.int64)  # a text has one word at least
            whole += [i for i, n in zip(plain, odd.tolist(), strict=True) if n]
        _, offsets, data = ids.buffers()
        if data is not None:
            bounds = np.frombuffer(offsets, np.int64)[at].tolist()
            for i, a, b in zip(plain, bounds, bounds[1:], strict=False):
                out[i] = data[a:b].to_pybytes()
        for i in whole:
            out[i] = self.whole(texts[i])
        return out

    def begin(self, word: str) -> bytes | None:
        """Ids of a marked word; None where there is nothing between two boundaries: white space next to white space or at an end."""
        return (self.line_end if word[0] == "\n" else b"") + self.first[word[1:]] if word[1:] else None


class _Known(dict):
    """word -> ids; two generations, so that frequent words stay when the younger one is full."""

    def __init__(self, encoder: Encoder, before: str):
        super().__init__()
        self.encoder, self.before, self.older = encoder, before, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            if word.isalpha():
                ids = self.encoder.letters(self.before, word)
            elif (base := word.rstrip(".,;:!?*&$%#|")).isalpha():
                new = base not in self
                ids = self[base] + self.encoder.first[word[len(base) :]]
                if new:  # most such words do not come again
                    return ids
            else:
                ids = self.encoder.whole(self.before + word)
        if len(word) <= 40:
            if len(self) >= self.encoder.most:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most RUN bytes of text `t`, one row at least."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column("t")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + RUN, "right")))
            yield b.slice(at, to - at)
            at = to


def tokenise(docs: DataFrame, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, ids (binary, u16 where the vocabulary allows it, else u32; end_id last); and from each task a row without n: how often each id occurs there (counts, binary, i64)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = array(enc.code, [end_id]).tobytes()
        names, vocabulary = ["doc_id", "n", "ids", "counts"], enc.core.get_vocab_size()
        total = np.zeros(vocabulary, np.int64)
        for some in runs(batches):
            out = iter(enc.batch(some.column("t").to_pylist()))
            for b in slices(iter([some])):
                ids = [i + end for i in islice(out, b.num_rows)]
                total += np.bincount(np.frombuffer(b"".join(ids), _kind(vocabulary)), minlength=vocabulary)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([len(i) // len(end) for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.binary())], names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.astype("<i8").tobytes()], pa.binary())], names)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(tidy(run), "doc_id long, n long, ids binary, counts binary")


def _kind(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def count(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs in the whole table: the rows of `tokenise` without n, summed; one row for each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for b in batches:
            for c in b.column("counts"):
                total += np.frombuffer(c.as_buffer(), "<i8")
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "k"])

    out = np.zeros(vocabulary, np.int64)
    for r in tokens.filter("n IS NULL").select("counts").mapInArrow(tidy(run), "id long, k long").groupBy("id").agg(F.sum("k").alias("k")).toArrow().to_batches():
        out[r.column("id").to_numpy()] = r.column("k").to_numpy()
    return out


def write(tokens: DataFrame, f: np.ndarray, path: str) -> None:
    """Segments in ascending doc_id order as rows (part, segment, inside: ids of the part before it, n_ids, first_doc, data) of the Parquet folder path, the table beside."""
    spark = tokens.sparkSession
    shared = spark.sparkContext.broadcast(f)  # one entry an id
    vocabulary = len(f)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table_of(shared.value)
        docs, parts, size, k, inside = [], [], 0, 0, 0

        def segment() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), _kind(vocabulary)).astype(np.uint32)
            data = encode_segment([NULL_ID if d is None else d for d, _ in docs], [n for _, n in docs], ids, t)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([k], pa.int32()), pa.array([inside], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([docs[0][0]], pa.int64()), pa.array([data], pa.binary())], ["part", "segment", "inside", "n_ids", "first_doc", "data"])

        for b in batches:
            for d, n, ids, part in zip(b.column("doc_id").to_pylist(), b.column("n").to_pylist(), b.column("ids"), b.column("part").to_pylist(), strict=True):
                docs.append((d, n))
                parts.append(ids.as_py())
                size += n
                if size >= SEGMENT:
                    yield segment()
                    docs, parts, size, k, inside = [], [], 0, k + 1, inside + size
        if docs:
            yield segment()

    ordered = tokens.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids").withColumn("part", F.spark_partition_id())
    ordered.mapInArrow(tidy(run), LAYOUT).write.parquet(f"{path}/segments")
    spark.createDataFrame(pa.table({"scale": pa.array([SCALE], pa.int32()), "frequencies": pa.array([f.astype("<u4").tobytes()], pa.binary())})).write.parquet(f"{path}/table")


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as u32), and the ids when asked for, from the files alone."""
    head = spark.read.parquet(f"{path}/table").first()
    if head["scale"] != SCALE:
        raise ValueError("another scale")
    shared = spark.sparkContext.broadcast(np.frombuffer(head["frequencies"], "<u4"))
    segments = spark.read.schema(LAYOUT).parquet(f"{path}/segments")
    sizes = segments.groupBy("part").agg(F.sum("n_ids").alias("n"), F.min("first_doc").alias("d"), F.max(F.col("first_doc").isNull()).alias("null")).collect()  # a row for each written part
    sizes.sort(key=lambda r: (not r["null"], r["d"] or 0))
    base = [0, *accumulate(r["n"] for r in sizes)][: len(sizes)]
    # Arrow tables stay in the JVM; lists would start Python workers for RDDs on the executors, which then stay
    starts = spark.createDataFrame(pa.table({"part": pa.array([r["part"] for r in sizes], pa.int32()), "base": pa.array(base, pa.int64())}))
    placed = segments.join(F.broadcast(starts), "part").select((F.col("base") + F.col("inside")).alias("start"), "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table_of(shared.value)
        for b in batches:
            for start, data in zip(b.column("start").to_pylist(), b.column("data"), strict=True):
                s = Segment(data.as_py())
                raw = s.ids(t).astype("<u4")
                ends = np.cumsum(s.lengths)
                cut = [raw[e - n : e].tobytes() for e, n in zip(ends, s.lengths, strict=True)]
                cols = [pa.array([None if d == NULL_ID else int(d) for d in s.doc_ids], pa.int64()), pa.array(start + ends - s.lengths, pa.int64()), pa.array(s.lengths, pa.int64()), pa.array([zlib.crc32(x) for x in cut], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in cut], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return placed.mapInArrow(tidy(run), schema)


def encode(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Tokenise docs and write the files; gives their path, by default a new one in the shared folder."""
    spark = docs.sparkSession
    path = path or new_path(spark, "rans")
    vocabulary = Tokenizer.from_file(tokenizer).get_vocab_size()
    with small_batches(spark):
        tokens = materialise(tokenise(docs, tokenizer, end_id, id_col, text_col), "ids")
        write(tokens.filter("n IS NOT NULL").drop("counts"), frequencies(count(tokens, vocabulary)), path)
    release(spark, *{f.rsplit("/", 1)[0] for f in tokens.inputFiles()})
    return path
