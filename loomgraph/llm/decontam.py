r"""Benchmark decontamination with one Aho-Corasick automaton.

Items are normalised to words (A-Z lower-cased, maximal runs of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]`); each run of
`window` consecutive words is a pattern, a shorter item is one pattern as a whole. All patterns go into one automaton over
space-joined words, and each text, normalised alike, is scanned once. Matches are mapped back to words and from there to
code points of the original text.

Edge cases: a null or wordless text has no words and no hits; an item without words has no pattern; equal patterns of
several items count for each; repeated rows are judged each; an empty benchmark hits nothing; further columns are left
alone.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import tidy
from loomgraph.storage import materialise

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_KEPT = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
#: Characters of benchmark text in one automaton at most (about 100 bytes of memory each). A larger benchmark is scanned for in several passes.
AUTOMATON_CHARS = 4_000_000


def words(text: str | None) -> list[bytes]:
    return text.encode().lower().translate(_KEPT).split() if text else []


def patterns(text: str | None, window: int = 10) -> set[bytes]:
    w = words(text)
    return {b" ".join(w[i : i + window]) for i in range(max(1, len(w) - window + 1))} if w else set()


def build(items: list[tuple[int, str | None]], window: int = 10) -> ahocorasick.Automaton:
    """Values are (number of words, ids of the items that have the pattern)."""
    by: dict[bytes, list[int]] = {}
    for item, text in items:
        for p in patterns(text, window):
            by.setdefault(p, []).append(item)
    a = ahocorasick.Automaton()
    for p, ids in by.items():
        a.add_word(f" {p.decode()} ", (p.count(b" ") + 1, tuple(ids)))
    a.make_automaton()
    return a


class Found(NamedTuple):
    n_words: int
    hit: np.ndarray  # of the words: inside a match
    items: set[int]


def scan(a: ahocorasick.Automaton, text: str | None) -> Found:
    w = words(text)
    if not w or a.kind != ahocorasick.AHOCORASICK:
        return Found(len(w), np.zeros(len(w), bool), set())
    line = f" {b' '.join(w).decode()} "
    ends, counts, items = [], [], set()
    for end, (n, ids) in a.iter(line):
        ends.append(end)
        counts.append(n)
        items.update(ids)
    hit = np.zeros(len(w) + 1, int)
    if ends:
        gaps = np.frombuffer(line.encode("utf-32-le"), "<u4") == 0x20
        last = np.cumsum(gaps)[ends] - 1  # spaces up to a match's closing one, less the first
        np.add.at(hit, last - counts, 1)
        np.add.at(hit, last, -1)
    return Found(len(w), np.cumsum(hit)[: len(w)] > 0, items)


def spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Start and end, in code points of the original text, of each run of hit words."""
    out: list[tuple[int, int]] = []
    before = False
    low = text.encode().lower().decode()  # lower-cases A-Z only, so offsets stay
    for m, h in zip(WORD.finditer(low), hit, strict=True):
        if h and before:
            out[-1] = (out[-1][0], m.end())
        elif h:
            out.append(m.span())
        before = bool(h)
    return out


_cache: dict[bytes, ahocorasick.Automaton] = {}


def _automaton(key: bytes, items: list[tuple[int, str | None]], window: int) -> ahocorasick.Automaton:
    if key not in _cache:
        if len(_cache) > 1:
            _cache.clear()
        _cache[key] = build(items, window)
    return _cache[key]


SCHEMA = "doc_id {kind}, n_words long, hits array<struct<first:long,last:long>>, spans array<struct<start:int,end:int>>, items array<long>"


def _pass(docs: DataFrame, items: list[tuple[int, str | None]], window: int, id_col: str, text_col: str, kind: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)
    key = hashlib.sha256(repr((items, window)).encode()).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _automaton(key, shared.value, window)
        for b in batches:
            n, hits, where, which = [], [], [], []
            for text in b.column("t").to_pylist():
                f = scan(a, text)
                n.append(f.n_words)
                edges = np.flatnonzero(np.diff(np.concatenate(([0], f.hit.view(np.int8), [0]))))
                hits.append([{"first": int(x), "last": int(y)} for x, y in zip(edges[::2], edges[1::2], strict=True)])
                where.append([{"start": s, "end": e} for s, e in spans(text, f.hit)] if len(edges) else [])
                which.append(sorted(f.items))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(n, pa.int64()), pa.array(hits, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), pa.array(where, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(which, pa.list_(pa.int64()))],
                ["doc_id", "n_words", "hits", "spans", "items"],
            )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(tidy(run), SCHEMA.format(kind=kind))


def blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, str | None]]]:
    """The benchmark's items in blocks of at most AUTOMATON_CHARS; one block is held at a time."""
    block, size = [], 0
    for r in benchmark.select(item_col, text_col).orderBy(item_col, text_col).toLocalIterator():
        n = len(r[1] or "")
        if block and size + n > AUTOMATON_CHARS:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += n
    yield block


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, hits (runs of hit words: first, past the last), spans (of the original text), items (with occurring patterns)."""
    parts = blocks(benchmark.filter(F.col(item_col).isNotNull()), item_col, item_text)
    first, second = next(parts), next(parts, None)
    if second is None:
        return _pass(docs, first, window, id_col, text_col, dict(docs.dtypes)[id_col])
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), F.sha2(text_col, 256).alias("h")).alias("key"), F.col(text_col).alias("t"))
    out = _pass(keyed, first, window, "key", "t", dict(keyed.dtypes)["key"])
    for block in itertools.chain([second], parts):
        out = materialise(_merge(out, _pass(keyed, block, window, "key", "t", dict(keyed.dtypes)["key"])), "contamination")
    return out.withColumn("doc_id", F.col("doc_id.id"))


def _merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """The results of two passes over the same rows, matched by (doc_id, text): runs and items united."""
    j = a.alias("a").join(b.dropDuplicates(["doc_id"]).alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")))
    both = lambda c: F.array_sort(F.array_distinct(F.concat(f"a.{c}", f"b.{c}")))

    def united(c: str, lo: str, hi: str):
        last = lambda acc: F.element_at(acc, -1)
        grown = lambda acc, x: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)[lo].alias(lo), F.greatest(last(acc)[hi], x[hi]).alias(hi))))
        step = lambda acc, x: F.when((F.size(acc) > 0) & (x[lo] <= last(acc)[hi]), grown(acc, x)).otherwise(F.concat(acc, F.array(x)))
        return F.aggregate(both(c), F.slice(both(c), 1, 0), step)

    return j.select("a.doc_id", "a.n_words", united("hits", "first", "last").alias("hits"), united("spans", "start", "end").alias("spans"), both("items").alias("items"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["last"] - h["first"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of docs without any hit, with their columns: a filter for each block of the benchmark, no shuffle."""
    for block in blocks(benchmark.filter(F.col("item_id").isNotNull()), "item_id", "text"):
        docs = docs.mapInArrow(tidy(_filter(docs.sparkSession.sparkContext.broadcast(block), hashlib.sha256(repr((block, window)).encode()).digest(), window)), docs.schema)
    return docs


def _filter(shared, key: bytes, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _automaton(key, shared.value, window)
        for b in batches:
            yield b.filter(pa.array([not scan(a, t).items for t in b.column("text").to_pylist()], pa.bool_()))

    return run
