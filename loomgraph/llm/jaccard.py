r"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A document's set holds the hashes (64 bits) of its distinct `n`-word shingles. Under one order of all shingles, frequent
ones last, two sets with Jaccard similarity of at least t share at least l members of their l-prefixes, the first
|x| - ceil(t |x|) + l shingles. Each document chooses its own l: from estimated document frequencies of the prefix's
members it weighs the postings to be read against the candidates that remain when l shared members are asked for. A pair
is verified only if its prefixes share min(l_x, l_y) members or more, and then on the whole sets.

Equal sets are one node. Similar nodes meet in the postings of some member of their 1-prefixes, its rarest shingles. There a
task looks at pairs by size and by bitmap (a set bit that the other lacks is a shingle that it lacks, which bounds the
intersection from above, so nothing similar is lost) and gives out a spanning forest of what passes: fewer rows than nodes,
never the pairs. Components of these forests hold every link. Their texts are brought together, in blocks where a component
is large, and there the prefixes' shared members are counted and pairs with enough of them verified. Again a spanning
forest of the links is given out, and each node's number of links. So no step makes a row for each pair, and no pair of
different texts that is linked is left out.

The frequency estimates only order the shingles and choose l: they come from all texts, each task's chunks report shingles
that occur in LOCAL or more texts of a chunk, and the HEAVY most frequent are kept. The result does not depend on them.

Edge cases: null, empty and wordless texts have an empty set and are linked with nothing; a text of fewer than n words is
one shingle; rows with a null id take no part and get a null component; rows that repeat an id are nodes by their texts;
an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import WordHashes, lower_words, slices, tidy
from loomgraph.operators.components import connected_components
from loomgraph.storage import dropped, materialise

LOCAL, HEAVY = 2, 400_000
#: Shingles estimated to be in this many texts or more have their postings dealt out in blocks from the start.
HOT = 5_000
#: The largest l.
MOST_MATCHES = 8
#: Shingles in which a task counts repeats at once.
CHUNK = 4_000_000
#: Sets of a block of a shingle's postings or of a component.
BLOCK = 2_000
#: Shingles of a block of a component's sets (8 bytes each; a task holds two blocks).
BLOCK_SHINGLES = 1_500_000
#: Bits of a bitmap at most. Larger sets' bitmaps tell less, which costs time and changes no result.
MOST_BITS = 8_192
#: Tables of ids up to this number of rows (16 bytes each) are broadcast, larger ones are joined by shuffling.
BROADCAST_ROWS = 500_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Settings(NamedTuple):
    words: int = 5
    percent: int = 80

    def least(self, n: int) -> int:
        """The smallest intersection that a set of n can have with a similar one."""
        return -(-self.percent * n // 100)


def shingles(text: str | None, known: WordHashes, n: int) -> np.ndarray:
    """Sorted distinct hashes."""
    w = lower_words(text)
    if not w:
        return np.empty(0, np.uint64)
    h = known.array(w)
    k = min(n, len(w))
    out = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        out ^= out >> np.uint64(29)
        out *= _MIX
        out += h[j : len(h) - k + 1 + j]
    out ^= out >> np.uint64(31)
    out *= _MIX
    return np.unique(out ^ (out >> np.uint64(29)))


def set_id(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def ranked(s: np.ndarray, heavy: np.ndarray, df: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated frequencies of a set's members, and their places in the order of all shingles."""
    d = np.zeros(len(s))
    if len(heavy):
        at = np.searchsorted(heavy, s)
        at[at == len(heavy)] = 0
        d = np.where(heavy[at] == s, df[at], 0)
    return d, np.argsort(d, kind="stable")  # s is sorted, so ties go by hash


def prefix(s: np.ndarray, heavy: np.ndarray, df: np.ndarray, settings: Settings) -> tuple[int, np.ndarray]:
    """l and the l-prefix of a set. heavy: sorted shingles with their estimated frequencies df."""
    n = len(s)
    d, order = ranked(s, heavy, df)
    base = n - settings.least(n)
    if not d[order[: base + 1]].any():
        return 1, s[order[: base + 1]]
    most = min(MOST_MATCHES, n - base)
    read = np.cumsum(d[order[: base + most]])[base:]
    l = np.arange(1, most + 1)
    best = int(np.argmin(0.1 * read + read / l + 0.5 * l))
    return best + 1, s[order[: base + best + 1]]


def meeting(s: np.ndarray, heavy: np.ndarray, df: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The 1-prefix of a set, its members below and from HOT on."""
    d, order = ranked(s, heavy, df)
    first = order[: len(s) - settings.least(len(s)) + 1]
    hot = d[first] >= HOT
    return s[first[~hot]], s[first[hot]]


def bitmap(s: np.ndarray) -> np.ndarray:
    """One bit for each hash, in a power of two of at least a bit a shingle and at most MOST_BITS; halves can be laid over each other."""
    size = min(1 << max(8, (len(s) - 1).bit_length()), MOST_BITS)
    bits = np.zeros(size, bool)
    bits[((s >> np.uint64(20)) & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little")


def possible(x: np.ndarray, nx: int, y: np.ndarray, ny: int, percent: int) -> bool:
    """Whether sets of these sizes and bitmaps can be similar."""
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    both = min(nx - int(np.bitwise_count(x & ~y).sum()), ny - int(np.bitwise_count(y & ~x).sum()))
    return 100 * both >= percent * (nx + ny - both)


def _counted(sets: list[np.ndarray]) -> pa.RecordBatch:
    """Shingles of LOCAL sets or more; the list is emptied."""
    all_ = np.concatenate([np.empty(0, np.uint64), *sets])
    sets.clear()
    all_.sort()
    edge = np.flatnonzero(np.append(True, all_[1:] != all_[:-1])) if len(all_) else np.empty(0, np.int64)
    k = np.diff(np.append(edge, len(all_)))
    h, k = all_[edge[k >= LOCAL]], k[k >= LOCAL]
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64), pa.int64()), pa.array(k.astype(np.int64), pa.int64())], ["h", "k"])


def heavy_shingles(docs: DataFrame, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles, sorted, with lower estimates of their document frequencies: HEAVY at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen, sets, size = WordHashes(), set(), [], 0
        for b in batches:
            for th, t in zip(b.column("th").to_pylist(), b.column("t"), strict=True):
                if th not in seen:
                    seen.add(th)
                    sets.append(shingles(t.as_py(), known, settings.words))
                    size += len(sets[-1])
            if size >= CHUNK:
                yield _counted(sets)
                seen, sets, size = set(), [], 0
        yield _counted(sets)

    sums = docs.select("th", "t").mapInArrow(tidy(run), "h long, k long").groupBy("h").agg(F.sum("k").alias("k"))
    top = sums.orderBy(F.desc("k"), "h").limit(HEAVY).toArrow()
    h, k = top.column("h").to_numpy().view(np.uint64), top.column("k").to_numpy().astype(float)
    o = np.argsort(h)
    return h[o], k[o]


def sets_of(docs: DataFrame, settings: Settings, shared) -> DataFrame:
    """id, th (the text's hash), s (the set's id), n, tokens and hot (where the set meets others), bits; the last three of a set that repeats in a task are given once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (heavy, df), seen = WordHashes(), shared.value, set()
        for b in slices(batches):
            ids, n, tokens, hot, bits = [], [], [], [], []
            for t in b.column("t"):
                x = shingles(t.as_py(), known, settings.words)
                i = set_id(x) if len(x) else None
                first = len(x) > 0 and i not in seen
                seen.add(i)
                p, q = meeting(x, heavy, df, settings) if first else (None, None)
                ids.append(i)
                n.append(len(x))
                tokens.append(None if p is None else p.view(np.int64))
                hot.append(None if q is None or not len(q) else q.view(np.int64))
                bits.append(bitmap(x).tobytes() if first else None)
            long = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("th"), pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(tokens, long), pa.array(hot, long), pa.array(bits, pa.binary())], ["id", "th", "s", "n", "tokens", "hot", "bits"])

    return docs.mapInArrow(tidy(run), "id long, th long, s long, n long, tokens array<long>, hot array<long>, bits binary")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of shingles that two sets or more have; all postings of a shingle are in one partition."""
    parts = [(b.column("token").to_numpy(), b.column("s").to_numpy()) for b in batches]
    if not parts:
        return
    token, s = (np.concatenate(x) for x in zip(*parts, strict=True))
    o = np.lexsort((s, token))
    token, s = token[o], s[o]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (s[1:] != s[:-1])
    token, s = token[new], s[new]
    same = token[1:] == token[:-1]
    on = np.zeros(len(token), bool)
    on[1:] |= same
    on[:-1] |= same
    token, s = token[on], s[on]
    for at in range(0, len(token), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(token[at : at + 50_000]), pa.array(s[at : at + 50_000])], ["token", "s"])


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is known to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _in_blocks(rows: DataFrame, key: str, cuts: DataFrame) -> DataFrame:
    """rows, once for each pair (i, j) of blocks of their group that holds their block (own). cuts: the groups of several blocks."""
    q = rows.join(_small(cuts), key, "left").withColumn("cuts", F.coalesce("cuts", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("s"), F.col("cuts")).cast("int"))
    r = q.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    return r.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other", "cuts")


def _by_group(columns: tuple[str, ...], start):
    """f(table) on whole groups of rows that follow each other with equal columns; start() gives f for a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, rest, last = start(), [], None
        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in columns])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1), b.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(keys[:, lo]) if hi > lo else last
                if rest and key != last:
                    yield from f(pa.Table.from_batches(rest))
                    rest = []
                if hi > lo:
                    rest.append(b.slice(lo, hi - lo))
                    last = key
        if rest:
            yield from f(pa.Table.from_batches(rest))

    return run


class Union(dict):
    """Sets that are known to hang together in this task."""

    def root(self, x: int) -> int:
        while (up := self.get(x, x)) != x:
            self[x] = x = self.get(up, up)
        return x

    def roots(self, s: np.ndarray) -> np.ndarray:
        return np.array([self.root(x) for x in s.tolist()], np.int64)


def _forest(settings: Settings):
    """Of each group of postings, links a, b that hold together what sizes and bitmaps allow; none that the task has already given in effect."""

    def start():
        known = Union()

        def f(t: pa.Table) -> Iterator[pa.RecordBatch]:
            if t.num_rows < 2:
                return
            s, n, own = t.column("s").to_numpy(), t.column("n").to_numpy().astype(np.int64), t.column("own").to_numpy()
            c = known.roots(s)
            if (c == c[0]).all():
                return
            bits = [np.frombuffer(v.as_buffer(), np.uint64) for v in t.column("bits")]
            across = t.column("i")[0].as_py() != t.column("j")[0].as_py()
            width = np.array([len(v) for v in bits])
            folded: dict[int, np.ndarray] = {}
            ends = np.searchsorted(n, n * 100 // settings.percent, "right")
            a, b = [], []
            for x in range(len(n) - 1):
                y = np.arange(x + 1, ends[x])
                y = y[c[y] != c[x]]
                if across:
                    y = y[own[y] != own[x]]
                if not len(y):
                    continue
                w = int(width[x])
                if w not in folded:  # sizes of similar sets differ by a quarter, so widths by one halving at most
                    m = folded[w] = np.zeros((len(n), w), np.uint64)
                    for k in np.flatnonzero((width == w) | (width == 2 * w)):
                        m[k] = bits[k] if width[k] == w else bits[k][:w] | bits[k][w:]
                p, q = folded[w][x], folded[w][y]
                both = np.minimum(n[x] - np.bitwise_count(p & ~q).sum(1, dtype=np.int64), n[y] - np.bitwise_count(q & ~p).sum(1, dtype=np.int64))
                y = y[100 * both >= settings.percent * (n[x] + n[y] - both)]
                if not len(y):
                    continue
                met, first = np.unique(c[y], return_index=True)
                a += [int(s[x])] * len(met)
                b += s[y[first]].tolist()
                for r in met.tolist():
                    known[r] = int(c[x])
                c[np.isin(c, met)] = c[x]
                if (c == c[0]).all():
                    break
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        return f

    return _by_group(("token", "i", "j"), start)


def candidates(sets: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """s, n, id, th of the sets that meet others; and id, component: what may be linked with it. The table sets is deleted."""
    spark = sets.sparkSession
    part = sets.filter("tokens is not null and id is not null and s is not null")
    size = part.agg(F.sum(F.size("tokens"))).first()[0] or 0
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // 2_000_000)
    cold = part.select("s", F.explode("tokens").alias("token")).repartition(width, "token").mapInArrow(tidy(_shared), "token long, s long")
    hot = part.filter("hot is not null").select(F.explode("hot").alias("token"), "s").distinct()
    posts = materialise(cold.unionByName(hot), "postings")
    some = part.join(posts.select("s").distinct(), "s", "left_semi").groupBy("s").agg(F.min(F.struct("id", "th")).alias("r"), F.max("n").alias("n"), F.first("bits").alias("bits"))
    some = materialise(some.select("s", "n", F.col("r.id").alias("id"), F.col("r.th").alias("th"), "bits"), "nodes")
    dropped(sets)
    cuts = materialise(posts.groupBy("token").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("cuts")).filter("cuts > 1"), "cuts")
    rows = _in_blocks(posts, "token", cuts).join(some.select("s", "n", "bits"), "s")
    rows = rows.repartition(max(width // 4, int(spark.conf.get("spark.sql.shuffle.partitions"))), "token", "i", "j").sortWithinPartitions("token", "i", "j", "n", "s")
    edges = materialise(rows.select("token", "i", "j", "own", "s", "n", "bits").mapInArrow(tidy(_forest(settings)), "a long, b long"), "forests")
    met = connected_components(edges, "a", "b")
    dropped(posts, cuts, edges)
    return some.drop("bits"), met


def _verify(settings: Settings, shared, count: bool):
    """Of each group of texts: links a, b (k null) that hold together what is linked, and, if asked, a set's number of links k in this group."""

    def start():
        known, words, (heavy, df) = Union(), WordHashes(), shared.value

        def f(t: pa.Table) -> Iterator[pa.RecordBatch]:
            if t.num_rows < 2:
                return
            s, own = t.column("s").to_numpy(), t.column("own").to_numpy()
            sets = [shingles(x.as_py(), words, settings.words) for x in t.column("t")]
            l, pre = zip(*[prefix(x, heavy, df, settings) for x in sets], strict=True)
            l, n, m = np.array(l), np.array([len(x) for x in sets]), np.array([len(x) for x in pre])
            begin, pbegin = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(m))
            token, ids = np.unique(np.concatenate(sets), return_inverse=True)
            pids = np.searchsorted(token, np.concatenate(pre))
            del sets, pre
            has = np.zeros(len(token), np.uint8)
            across = t.column("i")[0].as_py() != t.column("j")[0].as_py()
            ends = np.searchsorted(n, n * 100 // settings.percent, "right")
            c, k = known.roots(s), np.zeros(len(s), np.int64)
            a, b = [], []
            for x in range(len(n) - 1):
                e = ends[x]
                if e <= x + 1 or (not count and (c == c[x]).all()):
                    continue
                mine = pids[pbegin[x] : pbegin[x + 1]]
                has[mine] = 1
                shared_ = np.add.reduceat(has[pids[pbegin[x + 1] : pbegin[e]]], pbegin[x + 1 : e] - pbegin[x + 1], dtype=np.int64)
                has[mine] = 0
                on = shared_ >= np.minimum(l[x], l[x + 1 : e])
                if across:
                    on &= own[x + 1 : e] != own[x]
                if not count:
                    on &= c[x + 1 : e] != c[x]
                y = np.flatnonzero(on) + x + 1
                if not len(y):
                    continue
                mine = ids[begin[x] : begin[x + 1]]
                has[mine] = 1
                if len(y) == y[-1] - y[0] + 1:
                    both = np.add.reduceat(has[ids[begin[y[0]] : begin[y[-1] + 1]]], begin[y] - begin[y[0]], dtype=np.int64)
                else:
                    both = np.array([has[ids[begin[z] : begin[z + 1]]].sum(dtype=np.int64) for z in y])
                has[mine] = 0
                y = y[100 * both >= settings.percent * (n[x] + n[y] - both)]
                k[x] += len(y)
                k[y] += 1
                new = y[c[y] != c[x]]
                if len(new):
                    met, first = np.unique(c[new], return_index=True)
                    a += [int(s[x])] * len(met)
                    b += s[new[first]].tolist()
                    for r in met.tolist():
                        known[r] = int(c[x])
                    c[np.isin(c, met)] = c[x]
            some = np.flatnonzero(k) if count else np.empty(0, np.int64)
            cols = [pa.array(np.append(np.array(a, np.int64), s[some])), pa.array(np.append(np.array(b, np.int64), s[some])), pa.array([None] * len(a) + k[some].tolist(), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["a", "b", "k"])

        return f

    return _by_group(("component", "i", "j"), start)


def components(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, th (xxhash64 of the text), n_shingles, component_id for every row."""
    return _run(docs, settings, id_col, text_col, False)


def linked(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As components, with n_links: the number of other sets, each once, that the row's set is similar to (null without an id)."""
    return _run(docs, settings, id_col, text_col, True)


def _run(docs: DataFrame, settings: Settings, id_col: str, text_col: str, count: bool) -> DataFrame:
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("t"))
    shared = spark.sparkContext.broadcast(heavy_shingles(base, settings))
    whole = materialise(sets_of(base, settings, shared), "sets")
    sets = materialise(whole.select("id", "th", "s", "n"), "rows")
    some, met = candidates(whole, settings)
    nodes = materialise(some.join(met.withColumnRenamed("id", "s"), "s"), "met")
    cuts = nodes.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("cuts")).filter("cuts > 1")
    cuts = materialise(cuts, "cuts")
    texts = base.join(_small(nodes), ["id", "th"])
    if sets.groupBy("id", "th").agg(F.count("*").alias("k")).filter("k > 1").limit(1).count():  # rows that repeat id and text
        texts = texts.dropDuplicates(["s"])
    rows = _in_blocks(texts.select("component", "s", "n", "t"), "component", cuts)
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (nodes.agg(F.sum("n")).first()[0] or 0) // 2_000_000)
    rows = rows.repartition(width, "component", "i", "j").sortWithinPartitions("component", "i", "j", "n", "s")
    found = rows.select("component", "i", "j", "own", "s", "t").mapInArrow(tidy(_verify(settings, shared, count)), "a long, b long, k long")
    found = materialise(found, "links")
    known = connected_components(found.filter("k is null"), "a", "b")
    out = _labelled(sets, known)
    if count:
        n = found.filter("k is not null").groupBy(F.col("a").alias("s")).agg(F.sum("k").alias("n_links"))
        out = out.join(n, "s", "left").withColumn("n_links", F.when(F.col("id").isNotNull(), F.coalesce("n_links", F.lit(0))))
    dropped(some, met, nodes, cuts)
    return out.drop("s")


def _labelled(sets: DataFrame, known: DataFrame) -> DataFrame:
    own = sets.filter("id is not null and s is not null").groupBy("s").agg(F.min("id").alias("least"), F.count("*").alias("k"))
    # a node's component as (representative node, smallest id); nodes alone with one row need no entry
    lab = own.join(known.withColumnRenamed("id", "s"), "s", "left").select("s", "k", "least", F.coalesce("component", "s").alias("c"), F.col("component").isNotNull().alias("linked"))
    least = lab.filter("linked").groupBy("c").agg(F.min("least").alias("m"))
    names = lab.filter("linked or k > 1").join(least, "c", "left").select("s", F.coalesce("m", "least").alias("m"))
    return sets.join(names, "s", "left").select("s", "id", "th", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.when(F.col("s").isNull(), F.col("id")).otherwise(F.coalesce("m", "id"))).alias("component_id"))


def keep_one(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """docs, its columns, with one row of each component: the smallest doc_id's. Rows without words or id stay."""
    found = materialise(components(docs, settings), "components")
    drop = _small(found.filter("component_id is not null and component_id <> id").select("id", "th").distinct())
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("th"))
    out = rows.join(drop, ["id", "th"], "left_anti")
    again = found.filter("n_shingles > 0 and id is not null").groupBy("id", "component_id").agg(F.count("*").alias("k")).filter("k > 1 and id = component_id")
    if again.limit(1).count():  # a kept id has several rows: one stays
        twice = again.select("id")
        out = out.join(twice, "id", "left_anti").unionByName(out.join(twice, "id", "left_semi").dropDuplicates(["id"]))
    return out.select("row.*")
