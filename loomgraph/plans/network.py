"""Queries on the labelled network."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.text import capital
from loomgraph.operators import graph as G
from loomgraph.operators.components import connected_components
from loomgraph.plans.registry import query
from loomgraph.storage import table


@query(
    "triples_network",
    """
    WITH triples AS (
      SELECT DISTINCT 'C' || o_custkey AS source, 'S' || l_suppkey AS target, l_returnflag AS rel
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    sized AS (SELECT source, count(*) AS degree FROM triples GROUP BY source)
    SELECT source, degree FROM sized ORDER BY degree DESC, source LIMIT 30
    """,
)
def triples_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct customer-supplier-flag triples; the 30 sources with most edges, ties by name."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag")
    triples = (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .select(F.concat(F.lit("C"), "o_custkey").alias("source"), F.concat(F.lit("S"), "l_suppkey").alias("target"), F.col("l_returnflag").alias("rel"))
        .distinct()
    )
    return triples.groupBy("source").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "source").limit(30)


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier to part by return flag, as an edge table with line order. Relations: A produces, N degrades, R inhibits."""
    li = table(spark, sf_dir, "lineitem")
    rel = F.when(F.col("l_returnflag") == "A", "PRODUCES").when(F.col("l_returnflag") == "N", "DEGRADES").otherwise("INHIBITS")
    return li.select(F.concat(F.lit("S"), "l_suppkey").alias("src"), F.concat(F.lit("P"), "l_partkey").alias("dst"), rel.alias("rel"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"), "l_quantity")


_E = """e AS (SELECT 'S' || l_suppkey AS src, 'P' || l_partkey AS dst, CASE l_returnflag WHEN 'A' THEN 'PRODUCES' WHEN 'N' THEN 'DEGRADES' ELSE 'INHIBITS' END AS rel,
      l_orderkey * 8 + l_linenumber AS k, l_quantity FROM lineitem)"""
_LAST = "s AS (SELECT src, dst, last(rel ORDER BY k, rel) AS rel FROM e GROUP BY src, dst)"


def _simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _edges(spark, sf_dir)
    return G.last_edge(e.withColumn("o", F.struct("k", "rel")), "o")


@query(
    "degree_topk",
    f"WITH {_E}, d AS (SELECT id, sum(i) AS in_degree, sum(o) AS out_degree FROM (SELECT src AS id, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY id) "
    "SELECT id, CAST(in_degree AS BIGINT) AS in_degree, CAST(out_degree AS BIGINT) AS out_degree, CAST(in_degree + out_degree AS BIGINT) AS degree FROM d ORDER BY degree DESC, id LIMIT 30",
)
def degree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In, out and total degree; the 30 largest, ties by name."""
    d = G.degrees(_edges(spark, sf_dir))
    return d.select("id", F.col("in_degree").cast("long"), F.col("out_degree").cast("long"), "degree").orderBy(F.desc("degree"), "id").limit(30)


@query(
    "degree_histogram",
    f"WITH {_E}, d AS (SELECT dst, count(*) AS n FROM e GROUP BY dst) SELECT CAST(least(floor(n / 5.0), 99) AS INTEGER) AS bin, count(*) AS vertices, min(n) AS lo, max(n) AS hi, round(avg(n), 6) AS mean FROM d GROUP BY 1",
)
def degree_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degree distribution in bins of fixed width, with least, largest and mean degree."""
    d = _edges(spark, sf_dir).groupBy("dst").agg(F.count("*").alias("n"))
    return d.groupBy(F.least(F.floor(F.col("n") / 5), F.lit(99)).cast("int").alias("bin")).agg(F.count("*").alias("vertices"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.round(F.avg("n"), 6).alias("mean"))


@query("wcc_sizes")
def wcc_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the weakly connected components, named by their smallest vertex; SQL is too slow on all of lineitem."""
    return connected_components(_all_bonds(spark, sf_dir)).groupBy("component").agg(F.count("*").alias("n"))


def _sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """custkey, partkey, suppkey, l_returnflag of every row of lineitem."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("c"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("p"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("s"), "l_returnflag")
    return o.join(li, o.o_orderkey == li.l_orderkey)


def _all_bonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and parts, over all of lineitem."""
    return _sales(spark, sf_dir).select(F.col("c").alias("src"), F.col("p").alias("dst")).distinct()


@query("scc_sizes")
def scc_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strongly connected components of the flow of goods: supplier to part and part to customer, returned ones from customer to supplier."""
    t = _sales(spark, sf_dir)
    e = t.select(F.explode(F.array(F.struct(F.col("s").alias("src"), F.col("p").alias("dst")), F.struct(F.col("p").alias("src"), F.col("c").alias("dst")), F.when(F.col("l_returnflag") == "R", F.struct(F.col("c").alias("src"), F.col("s").alias("dst"))))).alias("e")).filter("e is not null").select("e.*").distinct()
    return G.strongly_connected(e).groupBy("component").agg(F.count("*").alias("n"))


@query(
    "jaccard_pairs",
    f"""
    WITH {_E}, u AS (SELECT DISTINCT src, dst FROM e), d AS (SELECT src, count(*) AS n FROM u GROUP BY src),
    c AS (SELECT a.src AS a, b.src AS b, count(*) AS common FROM u a JOIN u b ON a.dst = b.dst AND a.src < b.src GROUP BY 1, 2)
    SELECT c.a, c.b, common, round(common * 1.0 / (x.n + y.n - common), 9) AS jaccard FROM c JOIN d x ON x.src = c.a JOIN d y ON y.src = c.b
    """,
)
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of the neighbour sets of suppliers that share a part."""
    j = G.jaccard_pairs(_edges(spark, sf_dir))
    return j.withColumn("jaccard", F.round("jaccard", 9))


@query(
    "edge_type_subgraph",
    f"""
    WITH {_E}, f AS (SELECT * FROM e WHERE rel = 'INHIBITS' AND NOT (src = 'S1' AND dst = 'P1')), k AS (SELECT src FROM f GROUP BY src HAVING count(*) >= 50)
    SELECT src, count(*) AS edges, count(DISTINCT dst) AS targets FROM f WHERE src IN (SELECT src FROM k) GROUP BY src
    """,
)
def edge_type_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of one type, their sources of sufficient degree."""
    f = _edges(spark, sf_dir).filter("rel = 'INHIBITS' and not (src = 'S1' and dst = 'P1')")
    return f.groupBy("src").agg(F.count("*").alias("edges"), F.countDistinct("dst").alias("targets")).filter("edges >= 50")


@query("edge_type_counts", f"WITH {_E} SELECT rel, count(*) AS n, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM e GROUP BY rel")
def edge_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).groupBy("rel").agg(F.count("*").alias("n"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))


@query("triad_counts", f"WITH {_E}, {_LAST} SELECT least(a.rel, b.rel) || '|' || greatest(a.rel, b.rel) AS kind, count(*) AS n FROM s a JOIN s b ON a.dst = b.dst AND a.src < b.src GROUP BY 1")
def triad_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two strains on one compound, by the sorted pair of relations. Counted from each compound's counts of relations, so the
    pairs themselves are never made."""
    c = _simple(spark, sf_dir).groupBy("dst", "rel").agg(F.count("*").alias("n"))
    own = c.select(F.concat_ws("|", "rel", "rel").alias("kind"), (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("n"))
    o = c.select("dst", F.col("rel").alias("r2"), F.col("n").alias("n2"))
    mixed = c.join(o, "dst").filter("rel < r2").select(F.concat_ws("|", "rel", "r2").alias("kind"), (F.col("n") * F.col("n2")).alias("n"))
    return own.unionByName(mixed).groupBy("kind").agg(F.sum("n").alias("n")).filter("n > 0")


_SIGNED = f"""WITH {_E}, {_LAST}, t AS (SELECT a.src AS a, b.src AS b, least(a.rel, b.rel) AS x, greatest(a.rel, b.rel) AS y FROM s a JOIN s b ON a.dst = b.dst AND a.src < b.src),
    g AS (SELECT a, b, CASE WHEN x = 'DEGRADES' AND y = 'DEGRADES' OR x = 'INHIBITS' AND y = 'PRODUCES' THEN -1 WHEN x = 'DEGRADES' AND y = 'PRODUCES' THEN 1 END AS sign FROM t),
    p AS (SELECT a, b, CAST(sum(CASE WHEN sign > 0 THEN 1 ELSE 0 END) AS BIGINT) AS plus, CAST(sum(CASE WHEN sign < 0 THEN 1 ELSE 0 END) AS BIGINT) AS minus FROM g WHERE sign IS NOT NULL GROUP BY a, b)"""


def _projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.signed_pairs(_simple(spark, sf_dir))


@query("signed_projection", f"{_SIGNED} SELECT * FROM p")
def signed_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of strains with their counts of positive and negative triads."""
    return _projection(spark, sf_dir)


@query("signed_degree", f"{_SIGNED}, v AS (SELECT a AS id, minus FROM p UNION ALL SELECT b, minus FROM p) SELECT id, CAST(sum(CASE WHEN minus > 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative, CAST(sum(CASE WHEN minus > 0 THEN 0 ELSE 1 END) AS BIGINT) AS positive FROM v GROUP BY id")
def signed_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degree by sign; a pair with both signs counts as negative."""
    v = _projection(spark, sf_dir).select(F.explode(F.array("a", "b")).alias("id"), (F.col("minus") > 0).cast("long").alias("m"))
    return v.groupBy("id").agg(F.sum("m").alias("negative"), F.sum(1 - F.col("m")).alias("positive"))


@query(
    "node_types",
    f"""
    WITH {_E}, n AS (SELECT src AS id FROM e UNION SELECT dst FROM e), s AS (SELECT DISTINCT src FROM e)
    SELECT n.id, CASE WHEN s.src IS NOT NULL THEN 'STRAIN' ELSE 'COMPOUND' END AS type, upper(left(n.id, 1)) || lower(substr(n.id, 2)) AS display FROM n LEFT JOIN s ON n.id = s.src
    """,
)
def node_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vertex table: both ends, type of the source role first, else of the target."""
    e = _edges(spark, sf_dir)
    ends = e.select(F.col("src").alias("id"), F.lit(0).alias("t")).unionByName(e.select(F.col("dst").alias("id"), F.lit(1).alias("t")))
    n = ends.groupBy("id").agg(F.min("t").alias("t"))
    return n.select("id", F.when(F.col("t") == 0, "STRAIN").otherwise("COMPOUND").alias("type"), capital(F.col("id")).alias("display"))


@query("edge_betweenness_topk")
def edge_betweenness_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten edges on most shortest paths of the trade between nations and segments; tested on fixtures."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("n"), "c_nationkey").alias("src"))
    o = table(spark, sf_dir, "orders").select("o_custkey", F.concat(F.lit("m"), F.date_format("o_orderdate", "yyyyMM")).alias("dst"))
    e = c.join(o, F.col("c_custkey") == F.col("o_custkey")).select("src", "dst").distinct()
    return G.edge_betweenness(e).select("a", "b", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "a", "b").limit(10)


@query("betweenness_topk")
def betweenness_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vertices on most shortest paths between customers and parts, over all of lineitem; tested on fixtures."""
    return G.betweenness(_all_bonds(spark, sf_dir)).select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(10)


@query("eigen_topk")
def eigen_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most central vertices by power iteration; tested on fixtures."""
    return G.eigenvector(_all_bonds(spark, sf_dir)).select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(10)


@query("community_modularity")
def community_modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modularity of communities by label propagation; the reference's heuristic is random, so there is no SQL."""
    return G.label_modularity(_all_bonds(spark, sf_dir)).select(F.round("modularity", 9).alias("modularity"))
