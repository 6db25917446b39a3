"""Queries on text: corpus filters, normalisation, spans and masking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import spans
from loomgraph.plans.registry import query
from loomgraph.storage import table


@query(
    "corpus_filter",
    """
    WITH one AS (SELECT doc_id, text, source, length(text) AS n, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents WHERE lang IN ('en', 'fr'))
    SELECT doc_id, source, n AS n_chars FROM one
    WHERE r = 1 AND n BETWEEN 40 AND 3000 AND NOT regexp_matches(text, 'Apache|(?i)mit license|copyright') AND source NOT IN ('src3', 'src7')
    """,
)
def corpus_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, first of equal texts, length range, negated patterns with a case-insensitive tail, source black list. The
    hash of a text stands for it in the shuffle, so only ids and 8 bytes travel."""
    docs = table(spark, sf_dir, "documents").filter(F.col("lang").isin("en", "fr"))
    n = F.char_length("text")
    firsts = docs.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    good = docs.filter(n.between(40, 3000) & ~F.col("text").rlike("Apache|(?i)mit license|copyright") & ~F.col("source").isin("src3", "src7"))
    return good.select("doc_id", "source", n.cast("long").alias("n_chars")).join(firsts, "doc_id", "left_semi")


@query(
    "section_filter",
    """
    SELECT doc_id, split_part(text, ' ', 1) AS head FROM documents
    WHERE NOT starts_with(text, 'Th') AND NOT regexp_matches(text, '(?i)license') AND length(text) > 0
    """,
)
def section_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix and pattern exclusions in conjunction; empty strings go."""
    t = F.col("text")
    docs = table(spark, sf_dir, "documents").filter(~t.startswith("Th") & ~t.rlike("(?i)license") & (F.char_length(t) > 0))
    return docs.select("doc_id", F.split_part(t, F.lit(" "), F.lit(1)).alias("head"))


@query(
    "url_parse_filter",
    """
    WITH u AS (SELECT page_id, split_part(url, '/', 3) AS host, split_part(split_part(url, '?', 1), '#', 1) AS base FROM pages WHERE NOT regexp_matches(url, '/(18[0-9]{2}|19[0-6][0-9])([/?#]|$)'))
    SELECT page_id, host, split_part(base, '/', 4) AS lang, regexp_extract(base, '([^/]*)$', 1) AS stem, CAST(length(base) AS BIGINT) AS n FROM u WHERE host <> ''
    """,
)
def url_parse_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split and index, last path part, exclusion of old years."""
    url = F.col("url")
    base = F.split_part(F.split_part(url, F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    u = table(spark, sf_dir, "pages").filter(~url.rlike("/(18[0-9]{2}|19[0-6][0-9])([/?#]|$)"))
    u = u.select("page_id", F.split_part(url, F.lit("/"), F.lit(3)).alias("host"), base.alias("base")).filter("host <> ''")
    return u.select("page_id", "host", F.split_part("base", F.lit("/"), F.lit(4)).alias("lang"), F.substring_index("base", "/", -1).alias("stem"), F.char_length("base").cast("long").alias("n"))


@query(
    "hyphen_normalise",
    r"""
    SELECT doc_id, md5(regexp_replace(regexp_replace(replace(text, ',', '-'), '([\p{L}\p{N}_])-([\p{L}\p{N}_])', '\1 \2', 'g'), '([\p{L}\p{N}_])-([\p{L}\p{N}_])', '\1 \2', 'g')) AS h FROM documents
    """,
)
def hyphen_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hyphens inside words become spaces (commas stand for hyphens first, as the tables have few)."""
    t = T.plain_hyphens(F.replace(F.col("text"), F.lit(","), F.lit("-")))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(t).alias("h"))


@query(
    "span_explode",
    r"""
    WITH w AS (SELECT item_id, string_split(text, ' ') AS ws FROM benchmark),
    t AS (SELECT item_id, ws, unnest(generate_series(1, len(ws))) AS i FROM w)
    SELECT item_id, CAST(i - 1 AS INTEGER) AS pos, lower(ws[i]) AS word, CAST(i - 1 + list_sum(list_transform(ws[1:i-1], lambda x: length(x))) AS BIGINT) AS start_,
      CAST(i - 1 + list_sum(list_transform(ws[1:i], lambda x: length(x))) AS BIGINT) AS end_ FROM t WHERE i > 1
    """,
)
def span_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with code point offsets: explode with positions, running sum of lengths."""
    w = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("pos", "w"))
    before = Window.partitionBy("item_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("start_", F.coalesce(F.sum(F.char_length("w") + 1).over(before), F.lit(0)).cast("long"))
    return w.filter("pos > 0").select("item_id", "pos", F.lower("w").alias("word"), "start_", (F.col("start_") + F.char_length("w")).cast("long").alias("end_"))


_SPANS = """
    s AS (SELECT user_id, CASE event_type WHEN 'purchase' THEN 'B' ELSE 'I' END AS tag, 3 * event_id AS start, 3 * event_id + 2 AS "end", value AS score
          FROM (SELECT event_id // 40 AS user_id, event_id, event_type, value FROM events WHERE event_type IN ('purchase', 'view'))),
    l AS (SELECT *, lag("end") OVER (PARTITION BY user_id ORDER BY start, "end", tag) AS le FROM s),
    i AS (SELECT *, sum(CASE WHEN tag = 'B' OR le IS NULL OR start - le > 4 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start, "end", tag) AS i FROM l)
"""


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as spans of three positions: a purchase begins one, a view goes on; forty events are a text."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin("purchase", "view"))
    return e.select(F.floor(F.col("event_id") / 40).alias("user_id"), F.when(F.col("event_type") == "purchase", "B").otherwise("I").alias("tag"), (3 * F.col("event_id")).alias("start"), (3 * F.col("event_id") + 2).alias("end"), F.col("value").alias("score"))


@query("bio_merge_strict", f'WITH {_SPANS} SELECT user_id, min(start) AS start, max("end") AS "end", round(avg(score), 6) AS score, count(*) AS parts FROM i GROUP BY user_id, i')
def bio_merge_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.merge_strict(_tagged(spark, sf_dir), "user_id").withColumn("score", F.round("score", 6))


@query(
    "bio_merge_compat",
    f"""
    WITH {_SPANS}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id, i ORDER BY start, "end", tag) AS n, first(tag) OVER (PARTITION BY user_id, i ORDER BY start, "end", tag) AS f FROM i)
    SELECT user_id, min(start) AS start, max("end") AS "end", round(avg(score), 6) AS score, count(*) AS parts FROM n WHERE f = 'B' GROUP BY user_id, i
    UNION ALL SELECT user_id, start, "end", round(score, 6), 1 FROM n WHERE f <> 'B' OR n >= 3
    """,
)
def bio_merge_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.merge_compat(_tagged(spark, sf_dir), "user_id").withColumn("score", F.round("score", 6))


@query(
    "entity_pairs",
    """
    SELECT a.user_id, a.event_id AS event_id_strain, a.value AS value_strain, b.event_id, b.value
    FROM events a JOIN events b ON a.user_id = b.user_id WHERE a.event_type = 'purchase' AND b.event_type = 'error' AND a.value > 0.5 AND a.value IS NOT NULL AND b.value IS NOT NULL
    """,
)
def entity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase above the cutoff with each error of the same user."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value", "event_type")
    return spans.pairs(e.filter("event_type = 'purchase' and value > 0.5").drop("event_type"), e.filter("event_type = 'error'").drop("event_type"), "user_id")


@query(
    "mask_spans",
    """
    WITH p AS (SELECT doc_id, text, instr(text, ' de ') AS a, instr(text, ' la ') AS b FROM documents),
    s AS (SELECT doc_id, text, a AS s1, a + 2 AS e1, b AS s2, b + 2 AS e2 FROM p WHERE a > 0 AND b > 0)
    SELECT doc_id, md5(CASE WHEN s1 > s2 THEN CASE WHEN e1 > e2 THEN substr(text, 1, s2) || '@GENE$' || substr(text, e2 + 1, s1 - e2) || '@STRAIN$' || substr(text, e1 + 1) ELSE '' END
      ELSE CASE WHEN e2 > e1 THEN substr(text, 1, s1) || '@STRAIN$' || substr(text, e1 + 1, s2 - e1) || '@GENE$' || substr(text, e2 + 1) ELSE '' END END) AS h FROM s
    """,
)
def mask_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two spans of a text become placeholders; the later one is replaced first."""
    a, b = F.instr("text", " de "), F.instr("text", " la ")
    d = table(spark, sf_dir, "documents").filter((a > 0) & (b > 0)).select("doc_id", "text", a.alias("s1"), (a + 2).alias("e1"), b.alias("s2"), (b + 2).alias("e2"))
    m = spans.mask(F.col("text"), F.col("s1"), F.col("e1"), F.lit("@STRAIN$"), F.col("s2"), F.col("e2"), F.lit("@GENE$"))
    return d.select("doc_id", F.md5(m).alias("h"))


@query(
    "mask_tokens",
    "SELECT item_id, replace(replace(text, ' the ', ' @A$ '), ' of ', ' @B$ ') AS masked, starts_with(text, 'T') AS head FROM benchmark WHERE contains(text, ' the ')",
)
def mask_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of two tokens becomes a placeholder."""
    t = F.col("text")
    return table(spark, sf_dir, "benchmark").filter(t.contains(" the ")).select("item_id", T.rewrite(t, [(" the ", " @A$ ", False), (" of ", " @B$ ", False)]).alias("masked"), t.startswith("T").alias("head"))


@query(
    "relation_permutations",
    """
    SELECT a.l_orderkey AS k, a.l_linenumber AS line1, b.l_linenumber AS line2, a.l_returnflag || '-' || b.l_returnflag AS label,
      CASE WHEN a.l_returnflag = b.l_returnflag THEN 1 ELSE 0 END AS same FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber <> b.l_linenumber WHERE a.l_quantity > 45
    """,
)
def relation_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered pairs of the lines of an order, the first one large, with their label."""
    cols = [F.col("l_orderkey").alias("k"), F.col("l_linenumber"), F.col("l_returnflag")]
    lines = table(spark, sf_dir, "lineitem")
    a = lines.filter("l_quantity > 45").select(*cols).alias("a")
    j = a.join(lines.select(*cols).alias("b"), "k").filter("a.l_linenumber <> b.l_linenumber")
    return j.select("k", F.col("a.l_linenumber").alias("line1"), F.col("b.l_linenumber").alias("line2"), F.concat_ws("-", "a.l_returnflag", "b.l_returnflag").alias("label"), F.when(F.expr("a.l_returnflag = b.l_returnflag"), 1).otherwise(0).alias("same"))


@query(
    "relation_combinations",
    "SELECT a.l_orderkey AS k, count(*) AS pairs FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber GROUP BY 1",
)
def relation_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unordered pairs of different lines within an order, counted without making them: (n^2 - sum of squares) / 2."""
    line = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), "l_linenumber").agg(F.count("*").alias("c"))
    n = F.sum("c")
    return line.groupBy("k").agg(((n * n - F.sum(F.col("c") * F.col("c"))) / 2).cast("long").alias("pairs")).filter("pairs > 0")


@query(
    "bio_label_rewrite",
    """
    SELECT conv_id, turn, CASE WHEN tag IN ('B-user', 'I-user') THEN tag ELSE 'O' END AS tag
    FROM (SELECT conv_id, turn, (CASE WHEN turn % 2 = 0 THEN 'B-' ELSE 'I-' END) || role AS tag FROM conversations)
    """,
)
def bio_label_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the tags of one label stay."""
    tag = F.concat(F.when(F.col("turn") % 2 == 0, "B-").otherwise("I-"), F.col("role"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", spans.keep_label(tag, "user").alias("tag"))


@query(
    "normalise_rules",
    r"""
    SELECT p_partkey, regexp_replace(regexp_replace(replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '.', 'g'), 'part', 'p'), '\.0+', '.', 'g'), '^p\.', '') AS name FROM part
    """,
)
def normalise_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule table folded over the name; literal and regular expression rules mix and their order counts."""
    rules = [("[^a-z0-9]+", ".", True), ("part", "p", False), (r"\.0+", ".", True), (r"^p\.", "", True)]
    return table(spark, sf_dir, "part").select("p_partkey", T.rewrite(F.lower("p_name"), rules).alias("name"))


@query(
    "match_key",
    r"""
    WITH n AS (SELECT 'S' AS side, s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT 'C', c_custkey, c_name FROM customer),
    k AS (SELECT side, id, regexp_replace(regexp_replace(regexp_replace(lower(name) || '.', '[#_ -]', '.', 'g'), '\.$', ''), '^\.', '') AS key FROM n)
    SELECT side, id, key FROM k WHERE NOT regexp_matches(key, '^[a-z]\.[a-z]+$') AND length(replace(key, '.', '')) > 2
    """,
)
def match_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match keys: separators to dots, one dot stripped at each end, short and initial-like keys dropped."""
    s = table(spark, sf_dir, "supplier").select(F.lit("S").alias("side"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    c = table(spark, sf_dir, "customer").select(F.lit("C").alias("side"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    key = T.strip_dots(F.regexp_replace(F.concat(F.lower("name"), F.lit(".")), "[#_ -]", "."))
    k = s.unionByName(c).select("side", "id", key.alias("key"))
    return k.filter(~F.col("key").rlike(r"^[a-z]\.[a-z]+$") & (F.char_length(F.replace("key", F.lit("."), F.lit(""))) > 2))


@query(
    "dot_combinations",
    """
    WITH p AS (SELECT p_partkey, string_split(p_name || ' ' || p_brand, ' ') AS ws FROM part),
    m AS (SELECT p_partkey, ws, unnest(generate_series(1, (1 << len(ws)) - 1)) AS m FROM p WHERE len(ws) <= 8)
    SELECT p_partkey, array_to_string(list_filter(ws, lambda x, i: (m >> (i - 1)) & 1 = 1), '.') AS key FROM m
    """,
)
def dot_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All non-empty selections of a name's parts."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.explode(T.part_combinations(F.split(F.concat_ws(" ", "p_name", "p_brand"), " "))).alias("key"))


@query(
    "token_labels",
    "SELECT item_id, list_sort(list_distinct(list_transform(string_split(text, ' '), lambda x: left(lower(x), 1)))) AS labels FROM benchmark",
)
def token_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted union of the labels of an item's tokens."""
    first = F.transform(F.split("text", " "), lambda x: F.substring(F.lower(x), 1, 1))
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_sort(F.array_distinct(first)).alias("labels"))
