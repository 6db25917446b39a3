"""Queries on counts, ranks, samples and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.operators import stats as S
from loomgraph.plans.registry import query
from loomgraph.storage import table


@query(
    "union_labelled",
    """
    SELECT 'urgent' AS ner, o_orderkey AS id, o_totalprice AS score FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL
    SELECT 'high', o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '2-HIGH' UNION ALL SELECT 'low', o_orderkey, NULL FROM orders WHERE o_orderpriority = '5-LOW'
    """,
)
def union_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of one label each, a column missing in one, united in one scan."""
    p = F.col("o_orderpriority")
    label = F.when(p == "1-URGENT", "urgent").when(p == "2-HIGH", "high").otherwise("low")
    o = table(spark, sf_dir, "orders").filter(p.isin("1-URGENT", "2-HIGH", "5-LOW"))
    return o.select(label.alias("ner"), F.col("o_orderkey").alias("id"), F.when(p != "5-LOW", F.col("o_totalprice")).alias("score"))


@query(
    "value_counts",
    "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) < 2000 AND count(*) >= 15",
)
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group sizes with guards from both sides."""
    return table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n")).filter("n < 2000 and n >= 15")


@query(
    "group_max_first",
    """
    WITH m AS (SELECT l_suppkey, max(l_quantity) AS q FROM lineitem GROUP BY 1),
    t AS (SELECT l.l_suppkey, l_partkey, l_orderkey, l_linenumber FROM lineitem l JOIN m ON l.l_suppkey = m.l_suppkey AND l_quantity = q),
    u AS (SELECT l_suppkey FROM t GROUP BY 1 HAVING count(DISTINCT l_partkey % 7) > 1)
    SELECT l_suppkey, l_orderkey, l_partkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS r FROM t WHERE l_suppkey IN (SELECT l_suppkey FROM u)) WHERE r = 1
    """,
)
def group_max_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of their group's largest value; groups with more than one kind; the first row of each."""
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_quantity"))
    t = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "l_quantity").withColumn("r", F.rank().over(w)).filter("r = 1")
    first = F.min(F.struct("l_orderkey", "l_linenumber", "l_partkey"))
    g = t.groupBy("l_suppkey").agg(first.alias("m"), F.countDistinct(F.col("l_partkey") % 7).alias("k")).filter("k > 1")
    return g.select("l_suppkey", "m.l_orderkey", "m.l_partkey", "m.l_linenumber")


@query(
    "genus_diversity",
    """
    WITH r AS (SELECT l_partkey AS word, s_nationkey AS genus, l_suppkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity > 20),
    k AS (SELECT word FROM r GROUP BY word HAVING count(DISTINCT genus) > 1 AND count(*) >= 15)
    SELECT r.word, n_name AS genus, count(*) AS n FROM r JOIN nation ON genus = n_nationkey WHERE word IN (SELECT word FROM k) GROUP BY 1, 2
    """,
)
def genus_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that at least two genera and 15 rows have, counted by genus. Counts by (word, genus) come first; what follows works on them."""
    li = table(spark, sf_dir, "lineitem").filter("l_quantity > 20").select("l_partkey", "l_suppkey")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey"))
    c = li.join(s, "l_suppkey").groupBy(F.col("l_partkey").alias("word"), "s_nationkey").agg(F.count("*").alias("n"))
    w = Window.partitionBy("word")
    k = c.withColumn("g", F.count("s_nationkey").over(w)).withColumn("t", F.sum("n").over(w)).filter("g > 1 and t >= 15")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("genus"))
    return k.join(nation, "s_nationkey").select("word", "genus", "n")


@query(
    "count_matrix",
    """
    SELECT l_suppkey AS sample, CAST(count(*) FILTER (l_returnflag = 'A') AS BIGINT) AS a, CAST(count(*) FILTER (l_returnflag = 'N') AS BIGINT) AS n,
      CAST(count(*) FILTER (l_returnflag = 'R') AS BIGINT) AS r FROM lineitem GROUP BY 1 HAVING count(*) > 1
    """,
)
def count_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature by sample counts, wide for the few named features, missing ones 0."""
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("sample")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.count(F.lit(1))).fillna(0)
    return m.select("sample", F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r")).filter("a + n + r > 1")


@query(
    "count_matrix_long",
    """
    WITH c AS (SELECT l_suppkey AS sample, l_partkey % 50 AS feature, count(*) AS n FROM lineitem GROUP BY 1, 2), k AS (SELECT feature, count(*) AS samples, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY 1)
    SELECT sample, feature, n, samples, total FROM c JOIN k USING (feature) WHERE samples > 1
    """,
)
def count_matrix_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix in long form, for any number of features: columns with more than one non-null entry."""
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("sample"), (F.col("l_partkey") % 50).alias("feature")).agg(F.count("*").alias("n"))
    k = c.groupBy("feature").agg(F.count("*").alias("samples"), F.sum("n").alias("total")).filter("samples > 1")
    return c.join(k, "feature").select("sample", "feature", "n", "samples", "total")


@query(
    "pivot_max",
    """
    SELECT p_brand, max(p_retailprice) FILTER (p_type = 'ECONOMY') AS economy, max(p_retailprice) FILTER (p_type = 'SMALL') AS small, round(sum(p_retailprice) FILTER (p_type = 'LARGE'), 4) AS large_sum
    FROM part GROUP BY 1 HAVING count(p_retailprice) > 1
    """,
)
def pivot_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pivot with several aggregates."""
    of = lambda t: F.when(F.col("p_type") == t, F.col("p_retailprice"))
    g = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.max(of("ECONOMY")).alias("economy"), F.max(of("SMALL")).alias("small"), F.round(F.sum(of("LARGE")), 4).alias("large_sum"), F.count("p_retailprice").alias("k"))
    return g.filter("k > 1").drop("k")


@query(
    "importance_rank_avg",
    "SELECT p_partkey, p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS rank FROM part",
)
def importance_rank_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descending rank, ties share the mean place."""
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", S.average_rank(["p_brand"], "p_size").alias("rank"))


@query(
    "topn_per_group",
    "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders WHERE o_totalprice > 10) WHERE r <= 3",
)
def topn_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three largest of each group above a value."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    o = table(spark, sf_dir, "orders").filter("o_totalprice > 10")
    return o.select("o_custkey", "o_orderkey", "o_totalprice", F.row_number().over(w).alias("r")).filter("r <= 3").drop("r")


@query(
    "gain_positions",
    """
    WITH r AS (SELECT p_brand, p_partkey, p_retailprice AS v, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
    SELECT p_brand, max(v) FILTER (r = 1) AS first, coalesce(max(v) FILTER (r = 2), 0) AS second, coalesce(max(v) FILTER (r = 3), 0) AS third, coalesce(max(v) FILTER (r = n AND n >= 4), 0) AS last,
      max(p_partkey) FILTER (r = 1) AS leader FROM r GROUP BY 1
    """,
)
def gain_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First, second, third and last value of each group, defaults 0; the last only of four or more."""
    w = Window.partitionBy("p_brand")
    r = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_retailprice").alias("v"), F.row_number().over(w.orderBy(F.desc("p_retailprice"), "p_partkey")).alias("r"), F.count("*").over(w).alias("n"))
    at = lambda c, d="v": F.max(F.when(c, F.col(d)))
    zero = lambda c: F.coalesce(at(c), F.lit(0.0))
    x = F.col("r")
    return r.groupBy("p_brand").agg(at(x == 1).alias("first"), zero(x == 2).alias("second"), zero(x == 3).alias("third"), zero((x == F.col("n")) & (F.col("n") >= 4)).alias("last"), at(x == 1, "p_partkey").alias("leader"))


@query("round_robin", "SELECT s_suppkey, ['gpu0', 'gpu1', 'gpu2'][CAST((row_number() OVER (ORDER BY s_suppkey) - 1) % 3 AS INTEGER) + 1] AS device FROM supplier")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices dealt out in turn. The running number comes from counts of ranges, not from one global window."""
    s = S.numbered(table(spark, sf_dir, "supplier").select("s_suppkey"), ["s_suppkey"])
    return s.select("s_suppkey", F.element_at(F.array(*map(F.lit, ("gpu0", "gpu1", "gpu2"))), F.pmod(F.col("_n") - 1, F.lit(3)).cast("int") + 1).alias("device"))


@query("batch_split", "SELECT o_orderkey, CAST(ntile(500) OVER (ORDER BY o_orderkey) AS INTEGER) AS batch FROM orders")
def batch_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """500 contiguous batches whose sizes differ by one at most, the larger first."""
    o = S.numbered(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"])
    n = table(spark, sf_dir, "orders").agg(F.count("*").alias("_t"))
    i, q, r = F.col("_n") - 1, F.floor(F.col("_t") / 500), F.col("_t") % 500
    batch = F.when(i < r * (q + 1), F.floor(i / (q + 1))).otherwise(r + F.floor((i - r * (q + 1)) / F.greatest(q, F.lit(1)))) + 1
    return o.join(F.broadcast(n)).select("o_orderkey", batch.cast("int").alias("batch"))


@query("row_index", "SELECT doc_id, CAST(row_number() OVER (PARTITION BY toxic ORDER BY doc_id) - 1 AS INTEGER) AS idx, toxic FROM labels")
def row_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places within a few large groups."""
    r = S.numbered(table(spark, sf_dir, "labels").select("doc_id", "toxic"), ["doc_id"], ["toxic"])
    return r.select("doc_id", (F.col("_n") - 1).cast("int").alias("idx"), "toxic")


@query(
    "stratified_split",
    """
    WITH r AS (SELECT doc_id, toxic, (row_number() OVER (PARTITION BY toxic ORDER BY md5('s1|' || doc_id), doc_id) - 1.0) / count(*) OVER (PARTITION BY toxic) AS p FROM labels)
    SELECT doc_id, toxic, CASE WHEN p < 0.75 THEN 'train' WHEN p < 0.875 THEN 'dev' ELSE 'test' END AS split FROM r
    """,
)
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stratified_split(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "toxic", "doc_id", 0.25, "s1")


@query(
    "sample_per_group",
    "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('42|' || doc_id), doc_id) AS r FROM documents) WHERE r <= 15",
)
def sample_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifteen rows of each source in a repeatable random order."""
    return S.sample_per_group(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", 15, "42", "doc_id")


@query(
    "set_difference",
    "SELECT k FROM (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 48 EXCEPT SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity < 2)",
)
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of one side only (anti join)."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), "l_quantity")
    return li.filter("l_quantity > 48").select("k").join(li.filter("l_quantity < 2").select("k"), "k", "left_anti").distinct()


@query("dedupe_keep_first", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def dedupe_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """drop_duplicates on a key subset, the smallest id survives."""
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("duplicated_rows", "SELECT doc_id FROM (SELECT doc_id, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE n > 1")
def duplicated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All members of groups of equal texts, by hash."""
    h = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return h.join(h.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "h", "left_semi").select("doc_id")


@query(
    "unpivot_metrics",
    """
    WITH m AS (SELECT toxic AS label, count(*) AS eval_n, CAST(sum(quality) AS BIGINT) AS eval_quality FROM labels GROUP BY 1)
    SELECT label, replace(name, 'eval_', '') AS metric, value FROM (UNPIVOT m ON eval_n, eval_quality INTO NAME name VALUE value)
    """,
)
def unpivot_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide to long, prefixes stripped."""
    m = table(spark, sf_dir, "labels").groupBy(F.col("toxic").alias("label")).agg(F.count("*").alias("eval_n"), F.sum("quality").alias("eval_quality"))
    return m.unpivot("label", ["eval_n", "eval_quality"], "metric", "value").withColumn("metric", F.regexp_replace("metric", "^eval_", ""))


@query(
    "transpose_metrics",
    "SELECT 'n' AS metric, count(*) FILTER (toxic = 0) AS l0, count(*) FILTER (toxic = 1) AS l1 FROM labels UNION ALL SELECT 'quality', CAST(sum(quality) FILTER (toxic = 0) AS BIGINT), CAST(sum(quality) FILTER (toxic = 1) AS BIGINT) FROM labels",
)
def transpose_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = unpivot_metrics(spark, sf_dir)
    return long.groupBy("metric").pivot("label", [0, 1]).agg(F.max("value")).select("metric", F.col("0").alias("l0"), F.col("1").alias("l1"))
