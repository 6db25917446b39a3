"""Ranks, tests, metrics and sampling."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from loomgraph.storage import materialise


def average_rank(group: list[str], value: str) -> Column:
    """Descending rank; ties share the mean of their places, so a tied leader has 1.5 or more."""
    w = Window.partitionBy(*group).orderBy(F.desc(value))
    same = Window.partitionBy(*group, value)
    return F.rank().over(w) + (F.count("*").over(same) - 1) / 2.0


def numbered(df: DataFrame, order: list[str], group: list[str] | None = None, name: str = "_n") -> DataFrame:
    """df with name: the place, from 1, of each row in the order of a whole table, or of each group, however large.

    Rows are dealt out by ranges of (group, order), so one group spreads over many tasks; a task numbers its own rows and adds
    the counts of the ranges before. The dealt rows are written once, as ranges are drawn anew at each run.
    """
    by = group or []
    dealt = materialise(df.repartitionByRange(*by, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    keys = [F.col(c).alias(f"_g{i}") for i, c in enumerate(by)]
    counts = dealt.groupBy(*keys, F.col("_p").alias("_q")).agg(F.count("*").alias("_c"))  # a row for each task and group in it
    named = [f"_g{i}" for i in range(len(by))]
    before = Window.partitionBy(*named).orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*named, "_q", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_s"))
    on = F.col("_p") == F.col("_q")
    for c, g in zip(by, named, strict=True):
        on = on & F.col(c).eqNullSafe(F.col(g))
    placed = dealt.join(base, on).drop("_q", *named)
    own = F.row_number().over(Window.partitionBy(*by, "_p").orderBy(*order))
    return placed.withColumn(name, (own + F.col("_s")).cast("long")).drop("_p", "_s")


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def prf(tp: Column, predicted: Column, actual: Column) -> list[Column]:
    """precision, recall, f1 with zero guards."""
    p, r = ratio(tp, predicted), ratio(tp, actual)
    return [p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1")]


def benjamini_hochberg(df: DataFrame, p: str, group: list[str]) -> DataFrame:
    """df with q: the false discovery rate adjusted value within a group, ties in p alike."""
    n = F.count(p).over(Window.partitionBy(*group))
    r = F.count(p).over(Window.partitionBy(*group).orderBy(p).rangeBetween(Window.unboundedPreceding, 0))
    down = Window.partitionBy(*group).orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_q", F.col(p) * n / r).withColumn("q", F.least(F.lit(1.0), F.min("_q").over(down))).drop("_q")


def beta_fraction(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_fraction(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    out = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / ((1 + num * d) or tiny), (1 + num / c) or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def t_test_p(r: float | None, n: int | None) -> float | None:
    """Two-sided p-value of a correlation r of n points (Student's t with n - 2 degrees of freedom)."""
    if r is None or n is None or math.isnan(r) or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    t2 = r * r * (n - 2) / (1 - r * r)
    return beta_fraction((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))


def hypergeometric_p(k: int, drawn: int, marked: int, total: int) -> float:
    """P(X >= k) for `drawn` of `total`, `marked` of which count."""
    lc = lambda n, r: math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1)
    lo, hi = max(k, drawn + marked - total, 0), min(drawn, marked)
    return min(1.0, sum(math.exp(lc(marked, i) + lc(total - marked, drawn - i) - lc(total, drawn)) for i in range(lo, hi + 1)))


def t_test_column(r: Column, n: Column) -> Column:
    def f(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([t_test_p(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return F.pandas_udf(f, DoubleType())(r, n)


def hypergeometric_column(k: Column, drawn: Column, marked: Column, total: Column) -> Column:
    def f(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([hypergeometric_p(*x) for x in zip(a, b, c, d, strict=True)], dtype="float64")

    return F.pandas_udf(f, DoubleType())(k, drawn, marked, total)


def regression(df: DataFrame, x: str, y: str, group: list[str]) -> DataFrame:
    """n, slope, intercept, r, p of y on x, in all or by group; rows with null, NaN or infinite values do not count."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    g = df.filter(ok(x) & ok(y)).groupBy(*group).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("r"))
    return g.withColumn("p", t_test_column(F.col("r"), F.col("n")))


def hashed(seed: str, *ids: str) -> Column:
    """A repeatable random order: the same in every run and engine that has md5."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(i).cast("string") for i in ids]))


def sample_per_group(df: DataFrame, group: str, n: int, seed: str, ident: str) -> DataFrame:
    """n rows of each group by hash order."""
    w = Window.partitionBy(group).orderBy(hashed(seed, ident), ident)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def stratified_split(df: DataFrame, label: str, ident: str, held: float, seed: str) -> DataFrame:
    """df with split: within each label, by hash order, the last `held` share is halved into dev and test."""
    n = df.groupBy(F.col(label).alias("_l")).agg(F.count("*").alias("_k"))
    placed = numbered(df.withColumn("_h", hashed(seed, ident)), ["_h", ident], [label])
    df = placed.join(F.broadcast(n) if n.count() <= 100_000 else n, F.col(label).eqNullSafe(F.col("_l")))
    part = (F.col("_n") - 1) / F.col("_k")
    return df.withColumn("split", F.when(part < 1 - held, "train").when(part < 1 - held / 2, "dev").otherwise("test")).drop("_h", "_n", "_l", "_k")
