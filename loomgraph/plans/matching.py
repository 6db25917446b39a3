"""Queries on names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.text import token_sort
from loomgraph.operators import matching as M
from loomgraph.plans.registry import query
from loomgraph.storage import table


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_brand").alias("name")).distinct()


def _lcs_sql(pairs: str) -> str:
    """CTE l(a, b, score): the ratio of the pairs, 200 LCS / (|a| + |b|), a character of a in each round."""
    cell = "CASE WHEN j = 0 THEN 0 WHEN a[i + 1] = b[j] THEN st[j] + 1 ELSE st[j + 1] END"
    row = f"list_transform(range(len(b) + 1), lambda j: {cell})"
    step = f"list_transform(range(len(b) + 1), lambda k: list_max({row}[1 : k + 1]))"
    return f"""r(a, b, i, st) AS (SELECT a, b, 0, list_transform(range(len(b) + 1), lambda x: CAST(0 AS BIGINT)) FROM {pairs} UNION ALL SELECT a, b, i + 1, {step} FROM r WHERE i < len(a)),
    l AS (SELECT a, b, 200.0 * st[len(b) + 1] / (len(a) + len(b)) AS score FROM r WHERE i = len(a))"""


# An edit that replaces a character is an insert and a delete: levenshtein bounds the indel distance from below.
_NEAR = "levenshtein(x.a, y.b) <= floor((1 - {c}) * (len(x.a) + len(y.b)) + 1e-9)"


@query(
    "fuzzy_best_unique",
    f"""
    WITH RECURSIVE n AS (SELECT DISTINCT p_name || ' ' || p_brand AS a FROM part), m AS (SELECT a AS b FROM n),
    p AS (SELECT x.a, y.b FROM n x, m y WHERE x.a <> y.b AND {_NEAR.format(c=0.9)}), {_lcs_sql("p")},
    k AS (SELECT * FROM l WHERE score >= 90), g AS (SELECT a FROM k GROUP BY a HAVING count(*) < 2000),
    t AS (SELECT *, rank() OVER (PARTITION BY a ORDER BY score DESC) AS r FROM k WHERE a IN (SELECT a FROM g))
    SELECT a, min(b) AS b, round(max(score), 6) AS score FROM t WHERE r = 1 GROUP BY a HAVING count(DISTINCT b) = 1
    """,
)
def fuzzy_best_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar names, best and unique."""
    n = _names(spark, sf_dir)
    scored = M.fuzzy_join(n.withColumnRenamed("name", "a"), n.withColumnRenamed("name", "b"), "a", "b", 90).filter("a <> b")
    return M.best_unique(M.guard(scored, "a"), "a", "b").select("a", "b", F.round("score", 6).alias("score"))


#: Entries of a vocabulary that is an array literal; a longer one is refused.
MOST_WORDS = 1000


@query(
    "levenshtein_best",
    """
    WITH t AS (SELECT DISTINCT p_type AS a FROM part), s AS (SELECT DISTINCT c_mktsegment AS b FROM customer),
    r AS (SELECT a, b, levenshtein(a, b) AS d, row_number() OVER (PARTITION BY a ORDER BY levenshtein(a, b), b) AS r FROM t, s)
    SELECT a, b, CAST(d AS INTEGER) AS d FROM r WHERE r = 1
    """,
)
def levenshtein_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest entry of a short list: the list, a vocabulary of fixed size, is an array literal of the row."""
    words = [r[0] for r in table(spark, sf_dir, "customer").select("c_mktsegment").distinct().orderBy("c_mktsegment").limit(MOST_WORDS + 1).collect()]
    if len(words) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} entries in the vocabulary")
    far = F.array(*[F.struct(F.levenshtein("a", F.lit(w)).alias("d"), F.lit(w).alias("b")) for w in words])
    return table(spark, sf_dir, "part").select(F.col("p_type").alias("a")).distinct().withColumn("m", F.array_min(far)).select("a", "m.b", "m.d")


@query(
    "two_phase_match",
    """
    WITH k AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE replace(p_name, ' ', '') END AS k FROM part),
    v AS (SELECT p_name AS name, min(p_partkey) AS id FROM part GROUP BY 1),
    e AS (SELECT k, name, id, 0 AS d FROM k JOIN v ON k = name),
    f AS (SELECT k, name, id, levenshtein(k, name) AS d FROM k JOIN v ON left(k, 2) = left(name, 2) WHERE k NOT IN (SELECT k FROM e) AND levenshtein(k, name) <= 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d, id) AS r FROM f)
    SELECT k.k, m.name, m.id, CAST(m.d AS INTEGER) AS d FROM k LEFT JOIN (SELECT * FROM e UNION ALL SELECT k, name, id, d FROM r WHERE r = 1) m ON k.k = m.k
    """,
)
def two_phase_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact keys first; what they leave (anti-join) by edit distance within a block; all keys stay (left join)."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    k = p.select(F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.replace("p_name", F.lit(" "), F.lit(""))).alias("k")).distinct()
    v = p.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))
    exact = k.join(v, k.k == v.name).select("k", "name", "id", F.lit(0).alias("d"))
    rest = k.join(exact.select("k"), "k", "left_anti").withColumn("_b", F.substring("k", 1, 2))
    near = rest.join(v.withColumn("_b", F.substring("name", 1, 2)), "_b").withColumn("d", F.levenshtein("k", "name", 2)).filter("d >= 0")
    best = near.groupBy("k").agg(F.min(F.struct("d", "id", "name")).alias("m")).select("k", "m.name", "m.id", "m.d")
    return k.join(exact.unionByName(best), "k", "left")


@query(
    "token_sort_group",
    """
    WITH c AS (SELECT w, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 3 = 0 THEN split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) ELSE p_name END AS w FROM part) GROUP BY 1),
    t AS (SELECT w, n, array_to_string(list_sort(string_split(w, ' ')), ' ') AS t FROM c)
    SELECT w, first_value(w) OVER (PARTITION BY t ORDER BY n DESC, w) AS "group" FROM t
    """,
)
def token_sort_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with equal sorted tokens get the most frequent one of them."""
    swapped = F.concat_ws(" ", F.split_part("p_name", F.lit(" "), F.lit(2)), F.split_part("p_name", F.lit(" "), F.lit(1)))
    w = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 3 == 0, swapped).otherwise(F.col("p_name")).alias("w"))
    return M.consensus(w.groupBy("w").agg(F.count("*").alias("n")), "w", "n")


@query(
    "synonym_consensus",
    f"""
    WITH RECURSIVE c AS (SELECT p_name || ' ' || p_brand AS w, p_type AS kind, count(*) AS n FROM part GROUP BY 1, 2),
    o AS (SELECT w, sum(n) AS c FROM c GROUP BY w),
    e AS (SELECT c.w, kind, n, o.c, array_to_string(list_sort(string_split(c.w, ' ')), ' ') AS t FROM c JOIN o USING (w)),
    p AS (SELECT DISTINCT x.a, y.b FROM (SELECT t AS a, kind FROM e WHERE n > 1) x, (SELECT t AS b, kind FROM e) y WHERE x.kind = y.kind AND {_NEAR.format(c=0.92)}), {_lcs_sql("p")},
    q AS (SELECT x.kind, x.w AS w0, x.c AS c0, y.w AS w1, y.c AS c1, CASE WHEN x.c > y.c THEN x.w ELSE y.w END AS dest FROM e x JOIN l ON x.t = l.a JOIN e y ON y.t = l.b AND y.kind = x.kind
      WHERE x.n > 1 AND l.score >= 92 AND x.w <> y.w),
    s AS (SELECT kind, dest, w0 AS w, c0 AS c FROM q UNION ALL SELECT kind, dest, w1, c1 FROM q),
    v AS (SELECT kind, w, sum(c) AS v FROM s GROUP BY 1, 2),
    m AS (SELECT DISTINCT s.kind, s.dest, s.w, v.v FROM s JOIN v ON s.kind = v.kind AND s.w = v.w),
    b AS (SELECT kind, dest, w AS label, v FROM (SELECT *, row_number() OVER (PARTITION BY kind, dest ORDER BY v DESC, w) AS r FROM m) WHERE r = 1),
    f AS (SELECT kind, w, label FROM (SELECT m.kind, m.w, b.label, row_number() OVER (PARTITION BY m.kind, m.w ORDER BY b.v DESC, b.label) AS r FROM m JOIN b ON m.kind = b.kind AND m.dest = b.dest) WHERE r = 1)
    SELECT c.w, c.kind, c.n, coalesce(f.label, c.w) AS "group" FROM c LEFT JOIN f ON c.kind = f.kind AND c.w = f.w
    """,
)
def synonym_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of names with similar sorted tokens within a type, and the word that stands for each."""
    w = table(spark, sf_dir, "part").groupBy(F.concat_ws(" ", "p_name", "p_brand").alias("w"), F.col("p_type").alias("kind")).agg(F.count("*").alias("n"))
    return M.consensus_fuzzy(w, "w", "n", "kind", 92)


@query("name_resolution")
def name_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names found in a vocabulary by a part of them, then as a whole; tested against brute force on fixtures."""
    p = table(spark, sf_dir, "part")
    name = F.concat_ws(".", F.regexp_replace("p_name", " ", "."), F.regexp_replace(F.lower("p_brand"), "#", "."))
    keys = p.select(F.when(F.col("p_partkey") % 3 == 0, name).when(F.col("p_partkey") % 3 == 1, F.concat(name, F.lit("."))).otherwise(F.regexp_replace(name, "e", "")).alias("key"))
    vertices = p.groupBy(name.alias("name")).agg(F.min("p_partkey").alias("ident"), F.min(F.when(F.col("p_size") > 45, "rs_assembly").when(F.col("p_size") > 35, "biocyc_pgdb").otherwise("gss")).alias("kind"))
    found = M.resolve(keys, M.vocabulary(vertices, "_assembly", ("gold_org",), ("brand.25",)))
    return found.select("key", "name", "ident", "kind", "phase", F.round("score", 6).alias("score"))
