r"""URL rules as a sort-merge range join.

A rule is (host, path): it fits its host and all subdomains when the url's path starts with the rule's path. Hosts become
reversed label lists, so a rule's host is an interval of the sorted keys and the intervals of all rules are nested or
disjoint. Urls and rules are sorted by that key and merged in one sweep; a stack holds the rules whose intervals are
open. The longest fitting rule wins (characters of host and path, then of the host).

Edge cases: a null url or one without `://` has an empty host and path, which no rule fits; repeated rows are judged each;
an empty table gives an empty result; of equal rules the first given counts; other columns are left alone.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import tidy

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: As many rules are merged in one sweep at most, sent to each task; more rules are cut into key ranges of that size.
RULES_PER_RANGE = 50_000
#: As many urls of a key range go to one task at most when there are several ranges.
URLS_PER_TASK = 200_000


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def key(self) -> tuple[str, ...]:
        return tuple(reversed(self.host.split(".")))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def sorted_rules(rules: list[Rule]) -> list[Rule]:
    """By key, then path; the first of equal (host, path) stays."""
    seen: dict[tuple[str, str], Rule] = {}
    for r in rules:
        r = Rule(r.host.translate(str.maketrans(UPPER, LOWER)), r.path, r.verdict)
        seen.setdefault((r.host, r.path), r)
    return sorted(seen.values(), key=lambda r: (r.key, r.path))


class Sweep:
    """Merges urls, in key order, with sorted rules. `of` may also be called out of order: it then starts again."""

    def __init__(self, rules: list[Rule]):
        self.nodes: list[tuple[tuple[str, ...], list[Rule]]] = []
        for r in rules:
            if not self.nodes or self.nodes[-1][0] != r.key:
                self.nodes.append((r.key, []))
            self.nodes[-1][1].append(r)
        self.restart()

    def restart(self) -> None:
        self.next, self.open, self.at = 0, [], ()

    def of(self, key: tuple[str, ...], path: str) -> Rule | None:
        if key < self.at:
            self.restart()
        self.at = key
        while self.next < len(self.nodes) and self.nodes[self.next][0] <= key:
            node = self.nodes[self.next]
            while self.open and self.open[-1][0] != node[0][: len(self.open[-1][0])]:
                self.open.pop()
            self.open.append(node)
            self.next += 1
        while self.open and self.open[-1][0] != key[: len(self.open[-1][0])]:
            self.open.pop()
        best = None
        for _, rules in self.open:  # nested hosts, shortest first
            for r in rules if len(rules) < 16 else prefixes(rules, path):
                if path.startswith(r.path) and (best is None or (len(r.host) + len(r.path), len(r.host)) > (len(best.host) + len(best.path), len(best.host))):
                    best = r
        return best


def prefixes(rules: list[Rule], path: str) -> list[Rule]:
    """Of many path rules of one host, those that can be prefixes of path: one bisection for each."""
    paths, out, hi = [r.path for r in rules], [], len(rules)
    while hi and (i := bisect_right(paths, path, 0, hi)):
        hi = i - 1
        if path.startswith(paths[hi]):
            out.append(rules[hi])
        else:  # a prefix of path that sorts before paths[hi] is a prefix of what they share
            n = next((k for k, (a, b) in enumerate(zip(paths[hi], path, strict=False)) if a != b), min(len(paths[hi]), len(path)))
            path = path[:n]
    return out


def judge(urls: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """id, host, path, rule (`host` + `path`, null where none fits), verdict (the rule's, else default)."""
    known = sorted_rules(rules)
    kind = dict(urls.dtypes)[id_col]
    base = urls.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    base = base.withColumn("k", F.reverse(F.split("host", "[.]")))
    schema = f"{id_col} {kind}, host string, path string, rule string, verdict string"
    if len(known) <= RULES_PER_RANGE:
        return base.sortWithinPartitions("k", "path").mapInArrow(tidy(_sweeper(known, id_col, default)), schema)
    return _by_ranges(base, known, id_col, default, schema)


def _sweeper(rules: list[Rule], id_col: str, default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = Sweep(rules)
        for b in batches:
            found = [sweep.of(tuple(k), p) for k, p in zip(b.column("k").to_pylist(), b.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("host"), b.column("path"), pa.array([f and f.host + f.path for f in found], pa.string()), pa.array([f.verdict if f else default for f in found], pa.string())],
                [id_col, "host", "path", "rule", "verdict"],
            )

    return run


def _by_ranges(base: DataFrame, known: list[Rule], id_col: str, default: str, schema: str) -> DataFrame:
    """Rules cut into key ranges. A range also gets the open rules above its first key, at most one host a label."""
    spark = base.sparkSession
    starts = [known[i].key for i in range(0, len(known), RULES_PER_RANGE)]
    starts = sorted({(), *starts})
    place = {}
    for r in known:
        first, last = bisect_right(starts, r.key) - 1, bisect_right(starts, (*r.key, chr(0x10FFFF))) - 1
        for i in range(first, last + 1):
            place.setdefault(i, []).append(r)
    bounds = F.array(*[F.array(*[F.lit(x) for x in s]).cast("array<string>") for s in starts])
    base = base.withColumn("part", F.size(F.filter(bounds, lambda s: s <= F.col("k"))) - 1)
    counts = {r["part"]: r["count"] for r in base.groupBy("part").count().collect()}  # a row for each range
    salts = F.create_map(*[F.lit(x) for i in range(len(starts)) for x in (i, 1 + counts.get(i, 0) // URLS_PER_TASK)])
    base = base.withColumn("salt", F.pmod(F.xxhash64("path", "id"), salts[F.col("part")]))
    # ranges without a url get no rules, so no group of rules stands alone
    rows = [(i, s, r.host, r.path, r.verdict) for i, k in counts.items() for s in range(1 + k // URLS_PER_TASK) for r in place.get(i, [])]
    right = spark.createDataFrame(pd.DataFrame(rows, columns=["part", "salt", "host", "path", "verdict"]), "part int, salt long, host string, path string, verdict string")

    def merge(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:  # a salt that no url has
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in (id_col, "host", "path", "rule", "verdict")})
        sweep = Sweep(sorted_rules([Rule(*x) for x in zip(right.host, right.path, right.verdict, strict=True)]))
        left = left.assign(key=[tuple(k) for k in left.k]).sort_values(["key", "path"])
        found = [sweep.of(k, p) for k, p in zip(left.key, left.path, strict=True)]
        return pd.DataFrame({id_col: left.id, "host": left.host, "path": left.path, "rule": [f and f.host + f.path for f in found], "verdict": [f.verdict if f else default for f in found]})

    return base.groupBy("part", "salt").cogroup(right.groupBy("part", "salt")).applyInPandas(merge, schema)
