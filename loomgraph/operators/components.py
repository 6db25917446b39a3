"""Connected components of an undirected edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.storage import dropped, materialise

#: Edges that a task holds before it contracts them; so many go to one task.
CHUNK = 2_000_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids, sorted, of edges u - v, and the smallest id that each reaches over them."""
    ids, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b, up = at[: len(u)], at[len(u) :], np.arange(len(ids))
    while True:
        x, y = up[a], up[b]
        on = x != y
        if not on.any():
            return ids, ids[up]
        a, b = a[on], b[on]
        np.minimum.at(up, np.maximum(x, y)[on], np.minimum(x, y)[on])
        while (up != up[up]).any():
            up = up[up]


def _forest(u: pa.Array, v: pa.Array) -> tuple[pa.Array, pa.Array]:
    """As `forest`, of Arrow arrays: the ids are numbered in their order, so strings stay in Arrow's memory."""
    both = pa.concat_arrays((u, v)).dictionary_encode()
    order = pc.sort_indices(both.dictionary)
    place = np.empty(len(order), np.int32)
    place[order.to_numpy()] = np.arange(len(order), dtype=np.int32)
    at = place[both.indices.to_numpy()]
    ids, least = forest(at[: len(u)], at[len(u) :])
    names = both.dictionary.take(order)
    return names.take(pa.array(ids)), names.take(pa.array(least))


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's edges, a row (id, smallest id reached) for each id."""
    parts, size = [], 0
    joined = lambda: (pa.concat_arrays([p[c] for p in parts]) for c in (0, 1))
    for b in batches:
        parts.append((b.column(0), b.column(1)))
        size += b.num_rows
        if size >= CHUNK and len(parts) > 1:
            parts = [_forest(*joined())]
            size = len(parts[0][0]) // 2  # what is left may be as large as the task's ids
    if parts:
        ids, least = _forest(*joined())
        for at in range(0, len(ids), 100_000):
            yield pa.RecordBatch.from_arrays([ids[at : at + 100_000], least[at : at + 100_000]], ["u", "v"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """id, component (the smallest id reachable) for every vertex that has an edge.

    Each task first contracts its own edges to stars, so an id has one row a task at most and no hub travels with its
    edges. Each round then brings the stars of an id together, contracts again, and replaces every root by its own root;
    it ends when each id has one root that is a root itself. Rounds are written to the shared folder, older ones deleted.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u is not null and v is not null")
    kind = e.dtypes[0][1]
    schema = f"u {kind}, v {kind}"
    stars = materialise(e.mapInArrow(_contract, schema), "stars")
    while True:
        width = max(int(e.sparkSession.conf.get("spark.sql.shuffle.partitions")), stars.count() // CHUNK)
        met = materialise(stars.repartition(width, "u").mapInArrow(_contract, schema), "stars")
        roots = materialise(met.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("x")), "roots")
        up = roots.select(F.col("u").alias("m"), F.col("m").alias("top"))
        open_ = roots.join(up, "m").filter("m <> x or top <> m").limit(1).count()
        if not open_:
            dropped(stars, met)
            return roots.select(F.col("u").alias("id"), F.col("m").alias("component"))
        higher = met.join(up.withColumnRenamed("m", "v"), "v").select("u", F.col("top").alias("v"))
        new = materialise(higher.unionByName(roots.select("u", F.col("m").alias("v"))).distinct(), "stars")
        dropped(stars, met, roots)
        stars = new
