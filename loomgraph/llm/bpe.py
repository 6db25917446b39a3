r"""Byte-level BPE by overlapping chunks.

A text is cut into chunks of `chunk` characters that overlap. Each chunk is pre-tokenised on its own, from its first
character on, as if a pre-token began there; long texts' chunks go to a thread pool. The chunk's first boundaries may be
wrong, yet two scans that share one boundary agree on all later ones. So neighbours are stitched at the first boundary in
the overlap that both have; where an overlap has none, it is doubled. Each stitched piece starts and ends at pre-token
boundaries of the whole text and is encoded by itself. Decoding concatenates the ids' raw bytes.

Edge cases: a null text is empty and has no ids; a text without any boundary to stitch at is one piece; repeated rows are
encoded each; an empty table gives an empty result; further columns are left alone, but for one named like a result's, which
the result replaces.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import slices, tidy

#: Characters of a chunk and of an overlap. Shorter texts are one chunk.
CHUNK, OVERLAP = 16_384, 256
#: Chunks whose scans run side by side in one task.
THREADS = 2


class Codec:
    """Encodes and decodes by a rank file; pattern cuts pre-tokens."""

    def __init__(self, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.core = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            self.bytes_of[i] = piece
        self.name_of = [str(i) for i in range(len(self.bytes_of))]
        self.pattern = regex.compile(pattern)
        self.chunk, self.overlap = chunk, overlap

    def scan(self, text: str, start: int, end: int) -> set[int]:
        """Pre-token boundaries of a scan that starts at start, up to end; the last token of all that reach beyond is left out."""
        out = {start}
        for m in self.pattern.finditer(text, start, concurrent=True):
            if m.end() > end:
                break
            out.add(m.end())
        return out

    def cuts(self, text: str) -> list[int]:
        """Where the text's pieces begin, 0 first."""
        n, c = len(text), self.chunk
        if n <= c + self.overlap:
            return [0]
        starts = range(0, n, c)
        ends = [min(n, s + c + self.overlap) for s in starts]
        with ThreadPoolExecutor(THREADS) as pool:
            scans = list(pool.map(lambda x: self.scan(text, *x), zip(starts, ends, strict=True)))
        out, own, origin = [0], scans[0], 0
        for s, e, other in zip(starts[1:], ends[1:], scans[1:], strict=True):
            at = self.meet(text, own, other, s, s + self.overlap)
            reach = 2 * self.overlap
            while at is None and s + reach // 2 < n:  # scan on from the last sure boundary
                own = self.scan(text, origin, min(n, s + reach))
                other = self.scan(text, s, max(e, min(n, s + reach)))
                at = self.meet(text, own, other, s, min(n, s + reach))
                reach *= 2
            if at is None:
                break  # no boundary is left: the rest is one piece
            if at < n and at > out[-1]:
                out.append(at)
            own, origin = {b for b in other if b >= at}, at
        return out

    # ASCII, and blocks without gaps whose characters have had the same classes since Unicode 3: on these all regex engines agree.
    agreed = regex.compile(r"[\x00-\x7F\u00A1-\u024F\u0410-\u044F\u3001-\u3003\u3008-\u3011\u3041-\u3094\u30A1-\u30FA\u4E00-\u9FA5\uAC00-\uD7A3\uFF01-\uFF5E]")

    @classmethod
    def meet(cls, text: str, a: set[int], b: set[int], lo: int, hi: int) -> int | None:
        """The first boundary that both scans have between characters on whose classes regex engines agree. White space before a
        piece's end would be cut otherwise without the text that follows it."""
        sure = cls.agreed.match
        fit = lambda x: x == len(text) or (sure(text[x]) and sure(text[x - 1]) and not text[x - 1].isspace())
        return min((x for x in a & b if lo < x <= hi and fit(x)), default=None)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        cuts = self.cuts(text)
        if len(cuts) == 1:
            return self.core.encode_ordinary(text)
        out: list[int] = []
        for s, e in zip(cuts, [*cuts[1:], len(text)], strict=True):
            out += self.core.encode_ordinary(text[s:e])
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_codecs: dict[tuple, Codec] = {}


def codec(path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Codec:
    key = (path, pattern, chunk, overlap)
    if key not in _codecs:
        _codecs[key] = Codec(*key)
    return _codecs[key]


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """docs, with text_col replaced by its ids (array<int>) under out_col and, if asked for, the bytes decoded from them under decoded_col."""
    keep = [c for c in docs.columns if c.lower() not in {text_col.lower(), out_col.lower(), (decoded_col or out_col).lower()}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for part in slices(batches):
            found = [c.encode(t.as_py()) for t in part.column("text")]
            cols, names = [part.column(i) for i in range(len(keep))], [*keep, out_col]
            cols.append(pa.array([np.array(x, np.int32) for x in found], pa.list_(pa.int32())))
            if decoded_col:
                cols.append(pa.array(map(c.decode, found), pa.binary()))
                names.append(decoded_col)
            yield pa.RecordBatch.from_arrays(cols, names)

    kept = [docs[f"`{c}`"] for c in keep]
    schema = docs.select(*kept).schema.add(out_col, T.ArrayType(T.IntegerType()))
    if decoded_col:
        schema = schema.add(decoded_col, T.BinaryType())
    return docs.select(*kept, F.col(text_col).alias("text")).mapInArrow(tidy(run), schema)


def decode(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """encoded, with ids_col replaced by the raw bytes (binary) under out_col; null ids give null."""
    keep = [c for c in encoded.columns if c.lower() not in (ids_col.lower(), out_col.lower())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for part in slices(batches):
            raw = pa.array([c.decode(i.values.to_pylist()) if i.is_valid else None for i in part.column(ids_col)], pa.binary())
            yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keep], raw], [*keep, out_col])

    schema = encoded.select(*keep).schema.add(out_col, T.BinaryType())
    return encoded.select(*keep, ids_col).mapInArrow(tidy(run), schema)


def digest(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each text, encoded and decoded in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            n, a, d = [], [], []
            for text in b.column("t"):
                ids = c.encode(text.as_py())
                n.append(len(ids))
                a.append(hashlib.sha256(" ".join(map(c.name_of.__getitem__, ids)).encode()).hexdigest())
                d.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(tidy(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
