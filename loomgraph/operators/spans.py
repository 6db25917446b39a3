"""Entity spans: merging of B/I runs, pairing, masking and relabelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import cut

#: Largest gap, in positions, between a span's end and the next part that still belongs to it.
GAP = 4


def merge_strict(spans: DataFrame, key: str, gap: int = GAP) -> DataFrame:
    """Gaps and islands: each B opens a span, an I within `gap` of the part before joins it; other I stand alone.

    spans has key, tag (B or I), start, end, score. Gives key, start, end, score (mean), parts.
    """
    w = Window.partitionBy(key).orderBy("start", "end", "tag")
    opens = (F.col("tag") == "B") | F.lag("end").over(w).isNull() | (F.col("start") - F.lag("end").over(w) > gap)
    island = F.sum(opens.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return spans.withColumn("_i", island).groupBy(key, "_i").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.avg("score").alias("score"), F.count("*").alias("parts")).drop("_i")


def merge_compat(spans: DataFrame, key: str, gap: int = GAP) -> DataFrame:
    """As merge_strict for spans that begin with B, but the second and later I that joined one are also given alone; every I
    that joined none is given alone, also where merge_strict would chain it to another I."""
    w = Window.partitionBy(key).orderBy("start", "end", "tag")
    far = F.lag("end").over(w).isNull() | (F.col("start") - F.lag("end").over(w) > gap)
    opens = (F.col("tag") == "B") | far
    own = spans.withColumn("_i", F.sum(opens.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(key, "_i").orderBy("start", "end", "tag")
    own = own.withColumn("_n", F.row_number().over(inside)).withColumn("_b", F.first("tag").over(inside) == "B")
    merged = own.filter("_b").groupBy(key, "_i").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.avg("score").alias("score"), F.count("*").alias("parts")).drop("_i")
    alone = own.filter("not _b or _n >= 3").select(key, "start", "end", "score", F.lit(1).cast("long").alias("parts"))
    return merged.unionByName(alone)


def pairs(left: DataFrame, right: DataFrame, on: str, suffix: str = "_strain") -> DataFrame:
    """Every left span with every right span of the same text; the left columns but the key get a suffix, rows with nulls go."""
    named = left.select(on, *[F.col(c).alias(c + suffix) for c in left.columns if c != on])
    return named.join(right, on).dropna()


def mask(text: Column, s1: Column, e1: Column, mark1: Column, s2: Column, e2: Column, mark2: Column) -> Column:
    """text with two spans replaced by marks, the later one first; empty where the earlier starting span ends last (nested)."""
    first = F.concat(cut(text, F.lit(0), s2), mark2, cut(text, e2, s1), mark1, cut(text, e1, F.char_length(text)))
    second = F.concat(cut(text, F.lit(0), s1), mark1, cut(text, e1, s2), mark2, cut(text, e2, F.char_length(text)))
    return F.when(s1 > s2, F.when(e1 > e2, first).otherwise("")).otherwise(F.when(e2 > e1, second).otherwise(""))


def keep_label(tag: Column, label: str) -> Column:
    """A B-/I- tag of the label stays, any other becomes O."""
    return F.when(tag.isin(f"B-{label}", f"I-{label}"), tag).otherwise("O")
