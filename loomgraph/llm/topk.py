r"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Vectors are quantised to integers, floor(scale * x). The index holds blocks of vectors; a block's postings are grouped
in segments by impact, the absolute quantised value, highest first. Queries, many at a time, process the segments in that
order: after a segment, a vector's accumulator lacks only lower impacts, so by Cauchy-Schwarz its score differs from the
accumulator by at most |q| times the norm of what is left of the vector. A query's k-th best lower bound, over this block
and those before it in the task, is its threshold. Processing stops when the vectors that can still reach the threshold
(ties count) are few enough, or no segment is left; these possible members, and only these, are rescored exactly.

Sums of integers that stay below 2**53 are exact in doubles; where larger ones may occur, bounds are widened by the rounding
error and rescoring uses whole numbers of any size. Vectors that cannot reach any query's threshold leave the block's later
segments. Queries are a stated set and go in rounds of at most
`round_size`, sent to all tasks; each task keeps the best k of each query.

Edge cases: vectors that are null or hold a null, NaN or infinite component take no part, as query or candidate; shorter
vectors count as padded with zeros; with fewer candidates than k all are given; ties go to the smaller id; a repeated id
is a further candidate, but none for a query of the same id; rows that repeat a query's id are one query of several vectors,
whose scores stand in one ranking (a candidate once for each); null ids take no part; an empty table gives an empty result.
A score that no long can hold raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import tidy
from loomgraph.storage import materialise

#: Vectors of an index block; queries that are processed together; queries sent to the tasks at once.
BLOCK, GROUP, ROUND = 4096, 256, 50_000
#: Impact levels (lower ends, as shares of a block's highest) that end the segments.
LEVELS = (0.5, 0.3, 0.2, 0.12, 0.06)
#: Sums below this are exact in doubles; no long holds more than the other.
EXACT, LONG = 2.0**53, (1 << 63) - 1


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, v: ids that are not null, with finite components only, as doubles."""
    v = F.transform(vec_col, lambda x: x.cast("double"))
    bad = F.exists(vec_col, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & ~bad).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def quantise(batch: pa.RecordBatch, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids and a matrix of integers (as doubles), rows padded with zeros."""
    rows = batch.column("v")
    lengths = np.diff(rows.offsets.to_numpy())
    width = int(lengths.max()) if len(lengths) else 0
    q = np.zeros((len(lengths), width))
    q[np.arange(width) < lengths[:, None]] = np.floor(scale * rows.flatten().to_numpy(zero_copy_only=False))
    if not np.isfinite(q).all():
        raise OverflowError("a scaled component is beyond the range of doubles")
    return batch.column("id").to_numpy(), q


def build(vectors: DataFrame, scale: float, id_col: str, vec_col: str) -> DataFrame:
    """The index: a row for each block with ids, width and values in impact order (dimension, place in the block, value; segment ends)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                ids, q = quantise(b.slice(at, BLOCK), scale)
                row, dim = np.nonzero(q)
                value = q[row, dim]
                order = np.lexsort((row, dim, -np.abs(value)))
                top = float(np.abs(value).max()) if len(value) else 0.0
                kind = "<i4" if top < 1 << 31 else "<f8"
                ends = [int((np.abs(value) >= max(1, level * top)).sum()) for level in LEVELS] + [len(value)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x], t) for x, t in ((ids.astype("<i8").tobytes(), pa.binary()), (q.shape[1], pa.int32()), (dim[order].astype("<i4").tobytes(), pa.binary()), (row[order].astype("<u2").tobytes(), pa.binary()), (value[order].astype(kind).tobytes(), pa.binary()), (sorted(set(ends)), pa.list_(pa.int64())))],
                    ["ids", "width", "dim", "place", "value", "ends"],
                )

    return usable(vectors, id_col, vec_col).mapInArrow(tidy(run), "ids binary, width int, dim binary, place binary, value binary, ends array<long>")


class Best:
    """The k best (score, then smaller id) of each query so far."""

    def __init__(self, n: int, k: int):
        self.score, self.id, self.k = np.full((n, k), -LONG), np.full((n, k), LONG), k

    def add(self, at: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.append(self.score[at], scores), np.append(self.id[at], ids)
        o = np.lexsort((i, -s))[: self.k]
        self.score[at], self.id[at] = s[o], i[o]

    def threshold(self, rows: slice) -> np.ndarray:
        last = self.score[rows, -1].astype(float)
        return np.where(self.id[rows, -1] == LONG, -np.inf, np.where(np.abs(last) < EXACT, last, np.nextafter(last, -np.inf)))


def _scores(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of the rows of a and b as int64."""
    if exact:
        parts = max(1, len(a) * a.shape[1] // 10_000_000)
        return np.concatenate([np.einsum("ij,ij->i", x, y) for x, y in zip(np.array_split(a, parts), np.array_split(b, parts), strict=True)]).astype(np.int64)
    sums = [sum(int(x) * int(y) for x, y in zip(r, t, strict=True)) for r, t in zip(a.tolist(), b.tolist(), strict=True)]
    if any(abs(x) >= LONG for x in sums):
        raise OverflowError("a score is beyond the range of longs")
    return np.array(sums, np.int64)


def search_block(block: dict, q_ids: np.ndarray, q: np.ndarray, best: Best) -> int:
    """Processes one block for all queries; gives how many pairs were rescored."""
    ids = np.frombuffer(block["ids"], "<i8")
    dim, place = np.frombuffer(block["dim"], "<i4"), np.frombuffer(block["place"], "<u2")
    value = np.frombuffer(block["value"], "<i4" if len(block["value"]) == 4 * len(dim) else "<f8").astype(float)
    n, width = len(ids), max(q.shape[1], block["width"])
    if n == 0:
        return 0
    q = np.pad(q, ((0, 0), (0, width - q.shape[1])))
    exact = width * (np.abs(q).max(initial=0) + 1) * (np.abs(value).max(initial=0) + 1) < EXACT
    square = value**2
    segments, whole, begin = [], np.bincount(place, square, n), 0
    left, rounding = whole.copy(), 0.0 if exact else 4 * width * 2.0**-53
    full = np.zeros((n, width))
    full[place, dim] = value
    for end in block["ends"]:
        part = np.zeros((n, width))
        part[place[begin:end], dim[begin:end]] = value[begin:end]
        left = left - np.bincount(place[begin:end], square[begin:end], n)
        segments.append((part, np.sqrt(np.maximum(left, 0) + rounding * whole) * (1 + 1e-9) + rounding * np.sqrt(whole)))
        begin = end
    rescored = 0
    for at in range(0, len(q), GROUP):
        rows = slice(at, at + GROUP)
        g, names = q[rows], q_ids[rows]
        norm = np.sqrt((g * g).sum(1)) * (1 + 1e-9)
        on, score = np.arange(n), np.zeros((len(g), n))  # vectors that some query may still want
        own = names[:, None] == ids[None, :]
        for part, rest in segments:
            score += g @ (part if len(on) == n else part[on]).T
            bound = norm[:, None] * rest[None, on]
            low = np.where(own, -np.inf, score - bound)
            floor = np.maximum(best.threshold(rows), np.partition(low, len(on) - best.k, 1)[:, len(on) - best.k] if len(on) >= best.k else -np.inf)
            able = ~own & (score + bound >= floor[:, None])
            if able.sum() <= 4 * best.k * len(g):
                break  # proved: no other vector can be among the best
            some = able.any(0)
            if some.mean() < 0.7:
                on, score, own, able = on[some], score[:, some], own[:, some], able[:, some]
        r, c = np.nonzero(able)
        found = _scores(g[r], full[on[c]], exact) if len(r) else np.empty(0, np.int64)
        rescored += len(r)
        cut = np.searchsorted(r, np.arange(len(g) + 1))
        for i in range(len(g)):
            if cut[i] < cut[i + 1]:
                best.add(at + i, found[cut[i] : cut[i + 1]], ids[on[c[cut[i] : cut[i + 1]]]])
    return rescored


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query its k best vectors of another id."""
    spark = vectors.sparkSession
    index = materialise(build(vectors, scale, id_col, vec_col), "impacts")
    asked = usable(queries, id_col, vec_col)
    rounds = 1 + asked.count() // ROUND
    out = None
    for i in range(rounds):
        table = asked.filter(F.pmod(F.xxhash64("id"), F.lit(rounds)) == i).toArrow().combine_chunks()
        batches = table.to_batches()
        if not batches:
            continue
        q_ids, q = quantise(batches[0], scale)
        one = index.mapInArrow(tidy(_searcher(spark.sparkContext.broadcast((q_ids, q)), k)), "query_id long, vec_id long, score long")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searcher(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q = shared.value
        best = Best(len(q_ids), k)
        for b in batches:
            for i in range(b.num_rows):
                search_block({c: b.column(c)[i].as_py() for c in b.schema.names}, q_ids, q, best)
        r, c = np.nonzero(best.id < LONG)
        yield pa.RecordBatch.from_arrays([pa.array(q_ids[r], pa.int64()), pa.array(best.id[r, c], pa.int64()), pa.array(best.score[r, c], pa.int64())], ["query_id", "vec_id", "score"])

    return run
