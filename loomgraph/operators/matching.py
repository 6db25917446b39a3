"""Fuzzy joins on names, name resolution in phases, and consensus words of synonym groups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.similarity import partial_column, ratio_column
from loomgraph.functions.text import let, part_combinations, strip_dots, token_sort

GRAM = 2


def _counted(parts: Column) -> Column:
    """(occurrence, hash) of each entry of a list: the second `e` is another token than the first."""
    one = lambda g: F.transform(g, lambda x, i: F.struct((-F.size(F.filter(F.slice(g, 1, i + 1), lambda y: y == x))).alias("o"), F.xxhash64(x).alias("h")))
    return let(parts, one)


def _blocks(name: Column, cutoff: float) -> Column:
    """Blocking keys of a name such that two names of ratio >= cutoff share one.

    A name x of n characters has at least c n (n + m) / 2 of them, with their number of occurrence, in common with a partner of
    m; so the first n - least + 1 in one order of all characters hold one that the partner's first have, too. The order puts
    later occurrences first, as fewer names have them. Where inserts and deletes leave enough of the bigrams, which tell more,
    the same is done with them: D of them touch at most GRAM * D bigrams. Names that may have a partner with too few bigrams
    have keys of both kinds.
    """
    c = cutoff / 100
    n = F.char_length(name)
    share = GRAM * 2 * (1 - c) / c
    least = F.ceil(c / 2 * (n + F.ceil(n * c / (2 - c) - 1e-9)) - 1e-9)  # the shortest partner has n c / (2 - c) characters
    letters = F.array_sort(_counted(F.split(name, "")))
    single = F.transform(F.slice(letters, 1, F.greatest(n - least + 1, F.lit(1)).cast("int")), lambda t: F.xxhash64(t["o"], t["h"]))
    if share >= 1:
        return single
    d = F.floor((1 - c) * 2 * n / c + 1e-9)  # the partner has at most n (2 - c) / c characters
    grams = F.transform(F.sequence(F.lit(1), F.greatest(n - GRAM + 1, F.lit(1))), lambda i: F.substring(name, i, F.lit(GRAM)))
    double = F.transform(F.slice(F.array_sort(_counted(grams)), 1, (GRAM * d + 1).cast("int")), lambda t: F.xxhash64(F.lit(2), t["o"], t["h"]))
    # below this length a name may share no bigram with its partner, and its partner is hardly longer
    short = n <= 2 + math.ceil((1 + GRAM) / (1 - share)) * (2 - c) / c
    return F.when(short, F.concat(double, single)).otherwise(double)


def partial_join(left: DataFrame, right: DataFrame, a: str, b: str, cutoff: float) -> DataFrame:
    """Pairs of distinct names (a, b, score) with partial ratio >= cutoff (50 or more): the best window of the longer name.

    A window of ratio c with a name of n characters differs from it by 2 n (1 - c) inserts and deletes at most, each of which
    touches GRAM of its bigrams at most: of the first so many and one more, one stands in the longer name. Either side may be
    the shorter one. Names too short for that meet on all their characters.
    """
    x = left.select(a).filter(F.col(a).isNotNull()).distinct()
    y = right.select(b).filter(F.col(b).isNotNull()).distinct()
    la, lb = F.char_length(a), F.char_length(b)

    def keys(name: Column, size: int) -> Column:
        n = F.char_length(name)
        return F.when(n >= size, F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.substring(name, i, F.lit(size)))).otherwise(F.array())

    def few(name: Column) -> Column:
        n = F.char_length(name)
        touched = (GRAM * F.floor(2 * n * (1 - cutoff / 100) + 1e-9) + 1).cast("int")
        return F.when(n - GRAM + 1 >= touched, F.slice(keys(name, GRAM), 1, touched)).otherwise(keys(name, 1))

    def every(name: Column) -> Column:
        return F.array_distinct(F.concat(keys(name, GRAM), keys(name, 1)))

    one = x.withColumn("_k", F.explode(few(F.col(a)))).distinct().join(y.withColumn("_k", F.explode(every(F.col(b)))), "_k").filter(la <= lb)
    two = x.withColumn("_k", F.explode(every(F.col(a)))).join(y.withColumn("_k", F.explode(few(F.col(b)))).distinct(), "_k").filter(la > lb)
    pairs = one.select(a, b).unionByName(two.select(a, b)).distinct()
    return pairs.withColumn("score", partial_column(a, b, cutoff)).filter(F.col("score") >= cutoff)


def fuzzy_join(left: DataFrame, right: DataFrame, a: str, b: str, cutoff: float) -> DataFrame:
    """Pairs of distinct names (a, b, score) with ratio >= cutoff: an equi-join on blocks, then the scorer."""
    x = left.select(a).filter(F.col(a).isNotNull()).distinct()
    y = right.select(b).filter(F.col(b).isNotNull()).distinct()
    bx = x.withColumn("_k", F.explode(_blocks(F.col(a), cutoff)))
    by = y.withColumn("_k", F.explode(_blocks(F.col(b), cutoff)))
    la, lb = F.char_length(a), F.char_length(b)
    able = 200 * F.least(la, lb) >= cutoff * (la + lb) - 1e-9
    # an edit that replaces a character is an insert and a delete, so the edit distance bounds theirs from below
    close = F.levenshtein(a, b) <= F.floor((1 - cutoff / 100) * (la + lb) + 1e-9)
    pairs = bx.join(by, "_k").filter(able).select(a, b).distinct().filter(close)
    return pairs.withColumn("score", ratio_column(a, b)).filter(F.col("score") >= cutoff)


def best_unique(scored: DataFrame, key: str, ident: str, score: str = "score") -> DataFrame:
    """Of each key the rows of the highest score, if all have one id; the first by all columns stays."""
    top = scored.withColumn("_r", F.rank().over(Window.partitionBy(key).orderBy(F.desc(score)))).filter("_r = 1").drop("_r")
    one = top.groupBy(key).agg(F.countDistinct(ident).alias("_n")).filter("_n = 1").select(key)
    order = Window.partitionBy(key).orderBy(ident, *[c for c in scored.columns if c not in (key, ident)])
    return top.join(one, key).withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def guard(candidates: DataFrame, key: str, most: int = 2000) -> DataFrame:
    """Without keys that have `most` candidates or more: such a key tells nothing apart."""
    few = candidates.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") < most).select(key)
    return candidates.join(few, key, "left_semi")


def vocabulary(vertices: DataFrame, suffix: str, kinds: tuple[str, ...], marks: tuple[str, ...]) -> DataFrame:
    """vertices (name, ident, kind) whose kind has not the suffix and is none of kinds, and whose name holds none of the marks."""
    out = vertices.filter(~F.col("kind").endswith(suffix) & ~F.col("kind").isin(*kinds))
    for m in marks:
        out = out.filter(~F.col("name").contains(m))
    return out


def resolve(keys: DataFrame, names: DataFrame, partial_cutoff: float = 95, cutoff: float = 90, least_parts: float = 90, weak_kind: str = "biocyc_pgdb", most: int = 2000) -> DataFrame:
    """keys (key) left joined with their name, ident, kind, phase and score in names (name, ident, kind).

    Keys are stripped of dots at both ends and need more than two characters besides dots. First by the partial ratio: a key
    with `most` candidates or more tells nothing apart; of the best ones all must have one ident; the best ratio of the key with
    a selection of the name's dot-separated parts is its part score, and a name of weak_kind needs more than least_parts there.
    Keys that this leaves are matched by the full ratio, best and unique again. Keys without a match stay, with nulls.
    """
    asked = keys.select("key").distinct().withColumn("_s", strip_dots(F.col("key"))).filter(F.char_length(F.replace("_s", F.lit("."), F.lit(""))) > 2)
    strains = asked.select("_s").distinct()
    near = guard(partial_join(strains, names, "_s", "name", partial_cutoff), "_s", most).join(names, "name")
    first = best_unique(near, "_s", "ident")
    parts = F.transform(part_combinations(F.split("name", r"[.]")), lambda p: F.struct(F.col("_s").alias("a"), p.alias("b")))
    rated = first.select("_s", "name", F.explode(parts).alias("p")).select("_s", "name", ratio_column("p.a", "p.b").alias("r")).groupBy("_s", "name").agg(F.max("r").alias("parts"))
    kept = first.join(rated, ["_s", "name"]).filter(~((F.col("parts") <= least_parts) & (F.col("kind") == weak_kind)))
    kept = kept.select("_s", "name", "ident", "kind", "score").withColumn("phase", F.lit("partial"))
    rest = strains.join(kept, "_s", "left_anti")
    full = best_unique(fuzzy_join(rest, names, "_s", "name", cutoff).join(names, "name"), "_s", "ident")
    found = kept.unionByName(full.select("_s", "name", "ident", "kind", "score").withColumn("phase", F.lit("full")))
    return keys.select("key").distinct().join(asked, "key", "left").join(found, "_s", "left").drop("_s")


def consensus(counts: DataFrame, word: str, n: str) -> DataFrame:
    """word, group: of the words with equal sorted tokens the most frequent one, ties to the smaller word. counts: (word, n)."""
    w = Window.partitionBy("_t").orderBy(F.desc(n), word)
    return counts.withColumn("_t", token_sort(F.col(word))).select(word, F.first(word).over(w).alias("group"))


def consensus_fuzzy(counts: DataFrame, word: str, n: str, kind: str | None = None, cutoff: float = 95) -> DataFrame:
    """counts (word, n, and kind if given) with group: the consensus word of similar ones, by sorted tokens, within a kind.

    Each word of count over 1 is paired with every word like it. A pair goes to its more frequent word (over all kinds; of
    equal ones the second). A group is all words of the pairs that go to one word; its label is the member with the largest
    count times number of pairs. A word of several groups takes the label with the largest such total, ties the smaller.
    """
    k = F.col(kind) if kind else F.lit("")
    c = counts.select(F.col(word).alias("w"), F.col(n).alias("n"), k.alias("k")).filter("w is not null")
    total = c.groupBy("w").agg(F.sum("n").alias("c"))
    c = c.join(total, "w").withColumn("t", token_sort(F.col("w")))
    like = fuzzy_join(c.filter("n > 1").select(F.col("t").alias("ta")), c.select(F.col("t").alias("tb")), "ta", "tb", cutoff)
    x = c.filter("n > 1").select("k", F.col("w").alias("w0"), F.col("c").alias("c0"), F.col("t").alias("ta"))
    y = c.select("k", F.col("w").alias("w1"), F.col("c").alias("c1"), F.col("t").alias("tb"))
    pairs = x.join(like, "ta").join(y, ["k", "tb"]).filter("w0 <> w1").withColumn("to", F.when(F.col("c0") > F.col("c1"), F.col("w0")).otherwise(F.col("w1")))
    ends = pairs.select("k", "to", F.explode(F.array(F.struct(F.col("w0").alias("w"), F.col("c0").alias("c")), F.struct(F.col("w1").alias("w"), F.col("c1").alias("c")))).alias("e")).select("k", "to", "e.w", "e.c")
    rated = ends.groupBy("k", "w").agg(F.sum("c").alias("v"))  # count times number of pairs
    members = ends.select("k", "to", "w").distinct().join(rated, ["k", "w"])
    best = lambda w: F.struct((-F.col("v")).alias("v"), F.col(w).alias("w"))
    label = members.groupBy("k", "to").agg(F.min(best("w")).alias("m")).select("k", "to", F.col("m.w").alias("label"), (-F.col("m.v")).alias("v"))
    mine = members.select("k", "to", "w").join(label, ["k", "to"]).groupBy("k", "w").agg(F.min(best("label")).alias("m")).select("k", "w", F.col("m.w").alias("group"))
    out = counts.withColumn("_k", k).join(mine.withColumnsRenamed({"k": "_k", "w": "_w"}).withColumnRenamed("_k", "_k2"), (F.col("_k") == F.col("_k2")) & (F.col(word) == F.col("_w")), "left")
    return out.select(*counts.columns, F.coalesce("group", F.col(word)).alias("group"))
