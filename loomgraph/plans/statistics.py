"""Queries on metrics, tests and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import stats as S
from loomgraph.plans.registry import query
from loomgraph.storage import table


@query(
    "prf1",
    """
    WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 1) AS pp, count(*) FILTER (toxic = 1) AS ap, avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0 END) AS accuracy FROM labels),
    m AS (SELECT *, CASE WHEN pp = 0 THEN 0 ELSE tp * 1.0 / pp END AS p, CASE WHEN ap = 0 THEN 0 ELSE tp * 1.0 / ap END AS r FROM c)
    SELECT round(p, 9) AS "precision", round(r, 9) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 9) AS f1, round(accuracy, 9) AS accuracy FROM m
    """,
)
def prf1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall, F1 and accuracy with zero guards."""
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    c = table(spark, sf_dir, "labels").agg(F.count_if(q & t).alias("tp"), F.count_if(q).alias("pp"), F.count_if(t).alias("ap"), F.avg((F.col("quality") == F.col("toxic")).cast("double")).alias("accuracy"))
    m = c.select(*S.prf(F.col("tp"), F.col("pp"), F.col("ap")), "accuracy")
    return m.select(*[F.round(x, 9).alias(x) for x in m.columns])


@query(
    "prf1_doc_level",
    """
    WITH d AS (SELECT source, max(quality) AS q, max(toxic) AS t FROM documents JOIN labels USING (doc_id) GROUP BY source),
    c AS (SELECT count(*) FILTER (q = 1 AND t = 1) AS tp, count(*) FILTER (q = 1) AS pp, count(*) FILTER (t = 1) AS ap FROM d)
    SELECT round(tp * 1.0 / pp, 9) AS "precision", round(tp * 1.0 / ap, 9) AS recall, round(2.0 * tp / (pp + ap), 9) AS f1 FROM c
    """,
)
def prf1_doc_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels united by document (here the source) before counting."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("source").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    c = d.agg(F.count_if((F.col("q") == 1) & (F.col("t") == 1)).alias("tp"), F.count_if(F.col("q") == 1).alias("pp"), F.count_if(F.col("t") == 1).alias("ap"))
    m = c.select(*S.prf(F.col("tp"), F.col("pp"), F.col("ap")))
    return m.select(*[F.round(x, 9).alias(x) for x in m.columns])


@query(
    "span_prf",
    """
    WITH a AS (SELECT user_id, event_id FROM events WHERE event_type = 'purchase'), p AS (SELECT user_id, event_id FROM events WHERE value > 10),
    x AS (SELECT coalesce(a.user_id, p.user_id) % 5 AS label, a.event_id IS NOT NULL AS ia, p.event_id IS NOT NULL AS ip FROM a FULL JOIN p ON a.user_id = p.user_id AND a.event_id = p.event_id)
    SELECT label, count(*) FILTER (ia AND ip) AS tp, count(*) FILTER (ip) AS predicted, count(*) FILTER (ia) AS actual FROM x GROUP BY 1
    """,
)
def span_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity-level counts: predicted and actual spans in a full join on their keys."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    a = e.filter("event_type = 'purchase'").select("user_id", "event_id", F.lit(True).alias("ia"))
    p = e.filter("value > 10").select("user_id", "event_id", F.lit(True).alias("ip"))
    return a.join(p, ["user_id", "event_id"], "full").groupBy((F.col("user_id") % 5).alias("label")).agg(F.count_if(F.col("ia") & F.col("ip")).alias("tp"), F.count_if("ip").alias("predicted"), F.count_if("ia").alias("actual"))


@query(
    "regression_by_group",
    """
    SELECT l_returnflag, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(corr(l_quantity, l_extendedprice), 6) AS r
    FROM lineitem GROUP BY 1
    """,
)
def regression_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = S.regression(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return g.select("l_returnflag", "n", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"), F.round("r", 6).alias("r"))


@query("regression_p")
def regression_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The p-value of each group's correlation (Student's t); tested against tabled values."""
    g = S.regression(table(spark, sf_dir, "orders").withColumn("x", F.col("o_custkey").cast("double")), "x", "o_totalprice", ["o_orderpriority"])
    return g.select("o_orderpriority", F.round("p", 6).alias("p"))


@query(
    "significance_share",
    """
    SELECT event_type, count(*) FILTER (value < 5) * 1.0 / count(*) FILTER (value > 0) AS ratio, 100.0 * count(*) FILTER (value < 5) / count(value) AS percent, CASE WHEN min(value) > 0 THEN round(-log10(min(value)), 6) END AS top FROM events GROUP BY 1
    """,
)
def significance_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratio of two filtered counts, share of significant rows, -log10."""
    v = F.col("value")
    low = F.count_if(v < 5)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.try_divide(low, F.count_if(v > 0)).alias("ratio"), F.try_divide(100.0 * low, F.count(v)).alias("percent"), F.when(F.min(v) > 0, F.round(-F.log10(F.min(v)), 6)).alias("top"))


@query(
    "membership_patterns",
    """
    WITH f AS (SELECT user_id, bool_or(event_type = 'purchase' AND value > 20) AS a, bool_or(event_type = 'error' AND value > 20) AS b, bool_or(event_type = 'signup' AND value > 30) AS c FROM events GROUP BY 1)
    SELECT a, b, c, a <> b AS one_side, count(*) AS n FROM f GROUP BY 1, 2, 3
    """,
)
def membership_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the combinations of flags, with the exclusive or of two."""
    is_ = lambda t, v: F.bool_or((F.col("event_type") == t) & (F.col("value") > v))
    f = table(spark, sf_dir, "events").groupBy("user_id").agg(is_("purchase", 20).alias("a"), is_("error", 20).alias("b"), is_("signup", 30).alias("c"))
    return f.groupBy("a", "b", "c").agg(F.count("*").alias("n")).withColumn("one_side", F.col("a") != F.col("b"))


@query(
    "bh_fdr",
    """
    WITH p AS (SELECT event_id, event_type, value / 100 AS p FROM events WHERE value < 100),
    r AS (SELECT *, p * count(*) OVER (PARTITION BY event_type) / count(*) OVER (PARTITION BY event_type ORDER BY p) AS q0 FROM p),
    q AS (SELECT event_id, event_type, least(1.0, min(q0) OVER (PARTITION BY event_type ORDER BY p DESC)) AS q FROM r)
    SELECT event_type, count(*) AS n, count(*) FILTER (q < 0.05) AS significant, round(min(q), 9) AS least_q FROM q GROUP BY 1
    """,
)
def bh_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """False discovery rates, counted below 0.05."""
    p = table(spark, sf_dir, "events").filter("value < 100").select("event_id", "event_type", (F.col("value") / 100).alias("p"))
    q = S.benjamini_hochberg(p, "p", ["event_type"])
    return q.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("q") < 0.05).alias("significant"), F.round(F.min("q"), 9).alias("least_q"))


_ENRICH = """WITH m AS (SELECT p_type, p_brand, count(*) AS k FROM part WHERE p_size > 40 GROUP BY 1, 2), d AS (SELECT p_type, count(*) AS drawn FROM part WHERE p_size > 40 GROUP BY 1),
    b AS (SELECT p_brand, count(*) AS marked FROM part GROUP BY 1) SELECT p_type, p_brand, k, drawn, marked, (SELECT count(*) FROM part) AS total FROM m JOIN d USING (p_type) JOIN b USING (p_brand)"""


def _enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_type", "p_brand", "p_size")
    big = p.filter("p_size > 40")
    k = big.groupBy("p_type", "p_brand").agg(F.count("*").alias("k"))
    out = k.join(big.groupBy("p_type").agg(F.count("*").alias("drawn")), "p_type").join(p.groupBy("p_brand").agg(F.count("*").alias("marked")), "p_brand")
    return out.join(F.broadcast(p.agg(F.count("*").alias("total")))).select("p_type", "p_brand", "k", "drawn", "marked", "total")


@query("enrichment_counts", _ENRICH)
def enrichment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four counts of each group's test."""
    return _enrich(spark, sf_dir)


@query("enrichment_p")
def enrichment_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hypergeometric p-values and their false discovery rates; tested against exact sums."""
    p = _enrich(spark, sf_dir).withColumn("p", S.hypergeometric_column(F.col("k"), F.col("drawn"), F.col("marked"), F.col("total")))
    q = S.benjamini_hochberg(p, "p", ["p_type"])
    return q.select("p_type", "p_brand", F.round("p", 9).alias("p"), F.round("q", 9).alias("q"))


@query(
    "json_extract_results",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) >= 50",
)
def json_extract_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested key of a JSON column; rows without it go."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k")).filter("k >= 50")


@query(
    "fixed_bins",
    "SELECT CAST(floor(l_quantity / 0.4) AS INTEGER) AS bin, count(*) AS n FROM lineitem WHERE l_quantity >= 0 AND l_quantity < 40 GROUP BY 1",
)
def fixed_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 bins of one width from 0 to 40."""
    return table(spark, sf_dir, "lineitem").filter("l_quantity >= 0 and l_quantity < 40").groupBy(F.floor(F.col("l_quantity") / 0.4).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query(
    "gene_sets",
    r"""
    SELECT lang, list_sort(list_distinct(list(regexp_extract(source, 'src([0-9]+)', 1)))) AS sets FROM documents GROUP BY 1
    """,
)
def gene_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-to-many map from extracted keys."""
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.array_sort(F.collect_set(F.regexp_extract("source", "src([0-9]+)", 1))).alias("sets"))


@query(
    "best_epoch",
    "SELECT user_id, arg_max(event_id, (value, -event_id)) AS epoch, max(value) AS metric FROM events GROUP BY 1",
)
def best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The epoch of the best metric, the first of ties."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("epoch"), F.max("value").alias("metric"))


@query(
    "class_share",
    "WITH c AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1) SELECT p_partkey, p_retailprice / n AS per FROM part JOIN c USING (p_type) WHERE n > 10",
)
def class_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value divided by the size of its class."""
    p = table(spark, sf_dir, "part")
    return p.join(p.groupBy("p_type").agg(F.count("*").alias("n")), "p_type").filter("n > 10").select("p_partkey", (F.col("p_retailprice") / F.col("n")).alias("per"))


@query("one_vs_rest_gbt")
def one_vs_rest_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A boosted tree model for each class of the embeddings against the rest; accuracy on the held-out fifth."""
    from loomgraph.operators.boosting import one_vs_rest

    return one_vs_rest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
