"""Queries on runs, vocabularies, positions and bounded choices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.operators import stats as S
from loomgraph.plans.registry import query
from loomgraph.storage import table


@query(
    "tag_runs",
    """
    WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS i FROM events)
    SELECT user_id, event_type, min(event_id) AS start, string_agg(CAST(event_id AS VARCHAR), ' ' ORDER BY event_id) AS parts FROM r GROUP BY user_id, event_type, i HAVING count(*) > 1
    """,
)
def tag_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joined parts of each run of one tag; runs end with their sentence (here the user)."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    g = e.withColumn("i", i).groupBy("user_id", "event_type", "i").agg(F.min("event_id").alias("start"), F.array_sort(F.collect_list("event_id")).alias("p"))
    return g.filter(F.size("p") > 1).select("user_id", "event_type", "start", F.array_join(F.transform("p", lambda x: x.cast("string")), " ").alias("parts"))


@query(
    "vocabulary_diff",
    r"""
    WITH b AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS w FROM benchmark), d AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS w FROM documents)
    SELECT w FROM b WHERE w NOT IN (SELECT w FROM d)
    """,
)
def vocabulary_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of one text set that the other lacks: the large side is cut to the small side's words before it is reduced."""
    words = lambda df: df.select(F.explode(F.split(F.lower("text"), " ")).alias("w"))
    b = words(table(spark, sf_dir, "benchmark")).distinct()
    d = words(table(spark, sf_dir, "documents").select("text"))
    return b.join(d.join(b, "w", "left_semi").distinct(), "w", "left_anti")


@query(
    "eligible_choice",
    """
    SELECT s_nationkey, s_suppkey FROM (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY md5('7|' || s_suppkey), s_suppkey) AS r FROM supplier WHERE s_acctbal >= 1000) WHERE r <= 3
    """,
)
def eligible_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three members of each group in a repeatable random order; undersized ones are replaced by eligible ones or skipped."""
    s = table(spark, sf_dir, "supplier").filter("s_acctbal >= 1000").select("s_nationkey", "s_suppkey")
    return S.sample_per_group(s, "s_nationkey", 3, "7", "s_suppkey")


@query(
    "alias_shortest",
    "SELECT p_brand, first(p_name ORDER BY length(p_name), p_name) AS alias, CAST(min(length(p_name)) AS INTEGER) AS n FROM part GROUP BY 1",
)
def alias_shortest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest name of a group stands for it, ties by name."""
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min_by("p_name", F.struct(F.char_length("p_name"), F.col("p_name"))).alias("alias"), F.min(F.char_length("p_name")).alias("n"))


@query(
    "incident_edges",
    """
    WITH e AS (SELECT DISTINCT 'S' || l_suppkey AS src, 'P' || l_partkey AS dst FROM lineitem), k AS (SELECT src FROM e GROUP BY src HAVING count(*) > 40)
    SELECT e.src, e.dst FROM e WHERE src IN (SELECT src FROM k) AND dst IN (SELECT dst FROM e GROUP BY dst HAVING count(*) > 2)
    """,
)
def incident_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node-induced subgraph: both ends by degree, isolates gone."""
    e = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("S"), "l_suppkey").alias("src"), F.concat(F.lit("P"), "l_partkey").alias("dst")).distinct()
    big = lambda c, n: e.groupBy(c).agg(F.count("*").alias("k")).filter(F.col("k") > n).select(c)
    return e.join(big("src", 40), "src", "left_semi").join(big("dst", 2), "dst", "left_semi").select("src", "dst")
