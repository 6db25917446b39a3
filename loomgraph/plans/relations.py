"""Queries on scored relations: from sentences to the network, its feature tables and their checks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.text import file_name, rewrite
from loomgraph.operators import relations as R
from loomgraph.operators import stats as S
from loomgraph.plans.registry import query
from loomgraph.storage import table

# Relations of the driver's tables: a supplier and a brand, named by the return flag of the lines that join them.
_REL = """rel AS (SELECT DISTINCT l_suppkey AS strain, p_brand AS word, CASE l_returnflag WHEN 'A' THEN 'STRAIN-GENE:PRODUCES' WHEN 'N' THEN 'DISEASE-STRAIN:CAUSED' ELSE 'STRAIN-GENE:INHIBITS' END AS rel
      FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 20)"""


def _relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("l_returnflag") == "A", "STRAIN-GENE:PRODUCES").when(F.col("l_returnflag") == "N", "DISEASE-STRAIN:CAUSED").otherwise("STRAIN-GENE:INHIBITS")
    li = table(spark, sf_dir, "lineitem").filter("l_quantity > 20").select("l_partkey", F.col("l_suppkey").alias("strain"), name.alias("rel")).distinct()
    return li.join(table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("word")), F.col("l_partkey") == F.col("p_partkey")).select("strain", "word", "rel").distinct()


@query(
    "network_build",
    f"""
    WITH {_REL}, n AS (SELECT DISTINCT 'S' || strain AS strain, word, rel FROM rel WHERE NOT regexp_matches(word, '#1$|#22'))
    SELECT CASE WHEN starts_with(rel, 'STRAIN') THEN strain ELSE word END AS source, CASE WHEN starts_with(rel, 'STRAIN') THEN word ELSE strain END AS target,
      split_part(rel, ':', 2) AS rel, split_part(split_part(rel, ':', 1), '-', 1) AS source_ner, split_part(split_part(rel, ':', 1), '-', 2) AS target_ner FROM n
    """,
)
def network_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The network of distinct triples, directed by its relation `A-B:REL`; words on a black list go."""
    return R.network(_relations(spark, sf_dir).withColumn("strain", F.concat(F.lit("S"), "strain")), "#1$|#22")


@query(
    "download_list",
    """
    WITH v AS (SELECT s_suppkey AS strain, s_name AS vertex, CASE WHEN s_suppkey % 3 = 0 THEN 'rs_assembly' ELSE 'gss' END AS kind FROM supplier),
    p AS (SELECT l_suppkey AS strain FROM lineitem WHERE l_quantity > 45)
    SELECT DISTINCT p.strain || '/' || v.vertex AS assembly FROM p JOIN v ON p.strain = v.strain WHERE v.kind = 'rs_assembly'
    """,
)
def download_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`strain/assembly` of all assemblies of the strains that have a prediction, once each."""
    v = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("strain"), F.col("s_name").alias("vertex"), F.when(F.col("s_suppkey") % 3 == 0, "rs_assembly").otherwise("gss").alias("vertex_type"))
    p = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_suppkey").alias("strain"))
    return R.assemblies(p, v)


_ANNOTATED = f"""{_REL},
    g AS (SELECT word FROM rel JOIN supplier ON strain = s_suppkey WHERE rel = 'STRAIN-GENE:PRODUCES' GROUP BY word HAVING count(*) > 1 AND count(DISTINCT s_nationkey) > 1),
    das AS (SELECT DISTINCT l_suppkey AS strain, l_linestatus AS assembly FROM lineitem WHERE l_suppkey % 4 = 0),
    ann AS (SELECT l_suppkey AS strain, l_linestatus AS assembly, p_type AS feature FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_discount > 0.05 AND p_type <> 'PROMO'),
    j AS (SELECT rel.strain || '!' || das.assembly || '!' || rel.word AS sa_ner, rel.word, feature FROM rel JOIN das USING (strain) JOIN ann ON ann.strain = das.strain AND ann.assembly = das.assembly
      WHERE rel.rel = 'STRAIN-GENE:PRODUCES' AND rel.word IN (SELECT word FROM g))"""


@query("relation_annotations", f"WITH {_ANNOTATED} SELECT sa_ner, word, feature, count(*) AS n FROM j WHERE word IN (SELECT word FROM j GROUP BY word HAVING count(*) > 1) GROUP BY 1, 2, 3")
def relation_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations of all assemblies of a relation's strains, counted by feature: two equi-joins, pre-aggregated before them."""
    rel = _relations(spark, sf_dir).filter("rel = 'STRAIN-GENE:PRODUCES'")
    genus = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("strain"), F.col("s_nationkey").alias("genus"))
    li = table(spark, sf_dir, "lineitem")
    das = li.filter("l_suppkey % 4 = 0").select(F.col("l_suppkey").alias("strain"), F.col("l_linestatus").alias("assembly")).distinct()
    feature = table(spark, sf_dir, "part").filter("p_type <> 'PROMO'").select("p_partkey", F.col("p_type").alias("feature"))
    ann = li.filter("l_discount > 0.05").select("l_partkey", F.col("l_suppkey").alias("strain"), F.col("l_linestatus").alias("assembly")).join(feature, F.col("l_partkey") == F.col("p_partkey"))
    return R.annotated(R.varied(rel, genus), das, ann)


@query(
    "relation_scoring",
    """
    WITH s AS (SELECT conv_id, turn, role, text, (length(text) % 100) / 100.0 AS score FROM conversations WHERE text <> '')
    SELECT conv_id, turn, role || ':SAYS' AS rel, round(score, 6) AS rel_score FROM s WHERE score >= 0.5 AND role IN ('user', 'assistant')
    """,
)
def relation_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every relation's sentences scored in one pass by a scorer that the caller gives; label 1 stays."""

    def scorer(texts: pd.Series, relation: str) -> pd.DataFrame:
        score = (texts.str.len() % 100) / 100
        return pd.DataFrame({"label": "LABEL_" + (score >= 0.5).astype(int).astype(str), "score": score})

    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    got = R.scored(c, scorer, {"user:SAYS": "user", "assistant:SAYS": "assistant"}, "role", "text")
    return got.select("conv_id", "turn", "rel", F.round("rel_score", 6).alias("rel_score"))


@query(
    "importance_evolution",
    """
    WITH i AS (SELECT p_brand AS ner, p_type AS rel, p_partkey AS gene, p_retailprice AS gain FROM part),
    e AS (SELECT replace(lower(p_brand), '#', '_') AS ner, lower(p_type) AS rel, p_partkey AS gene, p_size / 50.0 AS p_value FROM part WHERE p_size % 2 = 0)
    SELECT i.ner, i.rel, i.gene, round(i.gain, 4) AS gain, round(e.p_value, 6) AS p_value, e.p_value < 0.2 AS significant FROM i JOIN e ON replace(lower(i.ner), '#', '_') = e.ner AND lower(i.rel) = e.rel AND i.gene = e.gene
    """,
)
def importance_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importances with the selection test of the same gene; both sides' keys are normalised alike first."""
    p = table(spark, sf_dir, "part")
    key = lambda c: F.replace(F.lower(c), F.lit("#"), F.lit("_"))
    i = p.select(F.col("p_brand").alias("ner"), F.col("p_type").alias("rel"), F.col("p_partkey").alias("gene"), F.round("p_retailprice", 4).alias("gain"), key("p_brand").alias("k1"), key("p_type").alias("k2"))
    e = p.filter("p_size % 2 = 0").select(key("p_brand").alias("k1"), key("p_type").alias("k2"), F.col("p_partkey").alias("gene"), (F.col("p_size") / 50).alias("v"))
    return i.join(e, ["k1", "k2", "gene"]).select("ner", "rel", "gene", "gain", F.round("v", 6).alias("p_value"), (F.col("v") < 0.2).alias("significant"))


@query(
    "has_relation",
    """
    WITH r AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 30),
    f AS (SELECT o.o_orderkey % 10 AS ner, r.l_orderkey IS NOT NULL AS linked FROM orders o LEFT JOIN (SELECT DISTINCT l_orderkey FROM r) r ON o.o_orderkey = r.l_orderkey)
    SELECT ner, count(*) AS n, count(*) FILTER (linked) AS related FROM f GROUP BY ner
    """,
)
def has_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities left joined with relations: how many have one, by type."""
    r = table(spark, sf_dir, "lineitem").filter("l_quantity > 30").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.flagged(table(spark, sf_dir, "orders").select("o_orderkey"), r, ["o_orderkey"], "linked").groupBy((F.col("o_orderkey") % 10).alias("ner")).agg(F.count("*").alias("n"), F.count_if("linked").alias("related"))


@query(
    "validated_join",
    "SELECT s_suppkey, s_name, n FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_quantity > 48 GROUP BY 1) ON s_suppkey = l_suppkey",
)
def validated_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A left join that raises when a key repeats on either side."""
    n = table(spark, sf_dir, "lineitem").filter("l_quantity > 48").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    return R.one_to_one(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), n, ["s_suppkey"])


_TYPED = "t AS (SELECT 'S' || l_suppkey AS src, 'P' || l_partkey AS dst, CASE l_returnflag WHEN 'A' THEN 'PRODUCES' WHEN 'N' THEN 'DEGRADES' ELSE 'INHIBITS' END AS rel FROM lineitem)"


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = F.when(F.col("l_returnflag") == "A", "PRODUCES").when(F.col("l_returnflag") == "N", "DEGRADES").otherwise("INHIBITS")
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("S"), "l_suppkey").alias("src"), F.concat(F.lit("P"), "l_partkey").alias("dst"), rel.alias("rel"))


@query("either_end", f"WITH {_TYPED} SELECT rel, count(*) AS n FROM t WHERE src IN ('S1', 'S2', 'S3') OR dst IN ('P1', 'P2', 'P3') GROUP BY rel")
def either_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose source or target is in a list."""
    return _typed(spark, sf_dir).filter(F.col("src").isin("S1", "S2", "S3") | F.col("dst").isin("P1", "P2", "P3")).groupBy("rel").agg(F.count("*").alias("n"))


@query("linked_to_constant", f"WITH {_TYPED} SELECT DISTINCT src AS id FROM t WHERE dst = 'P7' AND rel = 'PRODUCES' UNION SELECT DISTINCT dst FROM t WHERE src = 'S3' AND rel = 'INHIBITS'")
def linked_to_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that an edge of a type links with a given node."""
    e = _typed(spark, sf_dir)
    return e.filter("dst = 'P7' and rel = 'PRODUCES'").select(F.col("src").alias("id")).unionByName(e.filter("src = 'S3' and rel = 'INHIBITS'").select(F.col("dst").alias("id"))).distinct()


@query("value_search", "SELECT p_name AS value, count(*) AS n FROM part WHERE contains(p_name, 'ing') GROUP BY 1 ORDER BY n DESC, value")
def value_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted values that contain a pattern, most frequent first."""
    return table(spark, sf_dir, "part").filter(F.col("p_name").contains("ing")).groupBy(F.col("p_name").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


@query("path_counts", "SELECT split_part(url, '/', 3) AS host, count(*) AS n, count(DISTINCT list_extract(string_split(url, '/'), -1)) AS leaves FROM pages GROUP BY 1")
def path_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by a component of their path, and how many last components each has."""
    u = F.split("url", "/")
    return table(spark, sf_dir, "pages").groupBy(F.element_at(u, 3).alias("host")).agg(F.count("*").alias("n"), F.countDistinct(F.element_at(u, -1)).alias("leaves"))


@query(
    "vocabulary_filter",
    "SELECT s_suppkey, s_name FROM supplier WHERE NOT ends_with(s_name, '7') AND s_name <> 'Supplier#000000003' AND NOT contains(s_name, '01')",
)
def vocabulary_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without some suffix, some value and some part, all at once."""
    n = F.col("s_name")
    return table(spark, sf_dir, "supplier").filter(~n.endswith("7") & (n != "Supplier#000000003") & ~n.contains("01")).select("s_suppkey", "s_name")


@query(
    "span_scores",
    """
    WITH t AS (SELECT conv_id, turn, role, (turn + conv_id) % 3 AS x, turn % 3 AS y FROM conversations),
    b AS (SELECT conv_id, turn, role, CASE x WHEN 0 THEN 'B' WHEN 1 THEN 'I' ELSE 'O' END AS a, CASE y WHEN 0 THEN 'B' WHEN 1 THEN 'I' ELSE 'O' END AS p FROM t),
    o AS (SELECT *, a <> 'O' AND (a = 'B' OR lag(a) OVER w IS NULL OR lag(a) OVER w = 'O' OR lag(role) OVER w <> role) AS sa, p <> 'O' AND (p = 'B' OR lag(p) OVER w IS NULL OR lag(p) OVER w = 'O' OR lag(role) OVER w <> role) AS sp FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    i AS (SELECT *, sum(CAST(sa AS INT)) OVER w AS ia, sum(CAST(sp AS INT)) OVER w AS ip FROM o WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    sa AS (SELECT conv_id, role AS label, min(turn) AS s, max(turn) AS e FROM i WHERE a <> 'O' GROUP BY conv_id, role, ia),
    sp AS (SELECT conv_id, role AS label, min(turn) AS s, max(turn) AS e FROM i WHERE p <> 'O' GROUP BY conv_id, role, ip),
    c AS (SELECT label, count(*) FILTER (ok) AS tp, count(*) FILTER (pp) AS pp, count(*) FILTER (aa) AS ap FROM
      (SELECT coalesce(sa.label, sp.label) AS label, sa.s IS NOT NULL AND sp.s IS NOT NULL AS ok, sp.s IS NOT NULL AS pp, sa.s IS NOT NULL AS aa FROM sa FULL JOIN sp ON sa.conv_id = sp.conv_id AND sa.label = sp.label AND sa.s = sp.s AND sa.e = sp.e) GROUP BY label),
    u AS (SELECT label, tp, pp, ap FROM c UNION ALL SELECT '(all)', sum(tp), sum(pp), sum(ap) FROM c),
    m AS (SELECT label, CASE WHEN pp = 0 THEN 0 ELSE tp * 1.0 / pp END AS p, CASE WHEN ap = 0 THEN 0 ELSE tp * 1.0 / ap END AS r, CASE WHEN pp + ap = 0 THEN 0 ELSE 2.0 * tp / (pp + ap) END AS f FROM u)
    SELECT label, round(p, 9) AS "precision", round(r, 9) AS recall, round(f, 9) AS f1 FROM m UNION ALL SELECT '(macro)', round(avg(p), 9), round(avg(r), 9), round(avg(f), 9) FROM m WHERE label <> '(all)'
    """,
)
def span_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of whole entities from two tag columns: by label, over all, and the macro mean."""
    tag = lambda x: F.when(x == 0, "B").when(x == 1, "I").otherwise("O")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", tag((F.col("turn") + F.col("conv_id")) % 3).alias("a"), tag(F.col("turn") % 3).alias("p"))
    return R.span_scores(R.tag_spans(c, "conv_id", "turn", "role", "a"), R.tag_spans(c, "conv_id", "turn", "role", "p"), "conv_id")


@query(
    "sequence_dataset",
    """
    WITH lead AS (SELECT p_brand AS ner, p_type AS rel, arg_max(p_partkey, struct_pack(v := p_retailprice, k := -p_partkey)) AS gene FROM part GROUP BY 1, 2),
    a AS (SELECT l_suppkey AS strain, l_partkey AS gene, min(struct_pack(o := l_orderkey, l := l_linenumber)) AS first FROM lineitem GROUP BY 1, 2),
    s AS (SELECT lead.ner, lead.rel, lead.gene, a.strain, a.first.o AS protein FROM lead JOIN a USING (gene)),
    d AS (SELECT *, row_number() OVER (PARTITION BY ner, rel, gene, protein ORDER BY strain) AS r FROM s)
    SELECT regexp_replace(replace(replace(ner || '_' || rel || '_' || gene, '#', '-'), ' ', '_'), '[^A-Za-z0-9_-]+', '', 'g') || '.faa' AS file, strain, protein FROM d WHERE r = 1
    """,
)
def sequence_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the leading feature of each relation, the first protein of each strain that has it, one strain for each protein; file names are cleaned."""
    gains = table(spark, sf_dir, "part").select(F.col("p_brand").alias("ner"), F.col("p_type").alias("rel"), F.col("p_partkey").alias("gene"), F.col("p_retailprice").alias("gain"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("strain"), F.col("l_partkey").alias("gene"), F.col("l_orderkey").alias("protein"), F.col("l_linenumber").alias("place"))
    d = R.leading_sequences(gains, li)
    return d.select(F.concat(file_name(F.concat_ws("_", "ner", "rel", "gene")), F.lit(".faa")).alias("file"), "strain", "protein")


#: So many rewriting rules, made by a rule: leading zeros, then one word for each size, in this order.
CHAIN = [(rf"\b0+{i}\b", str(i), True) for i in range(1, 101)] + [(f"size {i} ", f"s{i}.", False) for i in range(1, 101)]


def _chain_sql(value: str) -> str:
    for pattern, new, regex in CHAIN:
        value = f"regexp_replace({value}, '{pattern}', '{new}', 'g')" if regex else f"replace({value}, '{pattern}', '{new}')"
    return value


@query("normalise_chain", f"WITH p AS (SELECT p_partkey, 'size ' || p_size || ' ' || p_name || ' 00' || (p_partkey % 130) AS x FROM part) SELECT p_partkey, {_chain_sql('x')} AS name FROM p")
def normalise_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hundred rules, expressions and literals, one after the other on every name."""
    x = F.concat(F.lit("size "), "p_size", F.lit(" "), "p_name", F.lit(" 00"), (F.col("p_partkey") % 130).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", rewrite(x, CHAIN).alias("name"))


@query("first_label", "SELECT event_id, event_type AS label, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def first_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of a list of labels, and a value unwrapped from a list's text `['x']`."""
    e = table(spark, sf_dir, "events").select("event_id", F.array("event_type").alias("labels"), F.concat(F.lit("['"), F.get_json_object("props", "$.k"), F.lit("']")).alias("text"))
    return e.select("event_id", F.element_at("labels", 1).alias("label"), R.unwrapped(F.col("text")).cast("int").alias("k"))


@query(
    "position_join",
    """
    WITH a AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS n FROM supplier), b AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS n FROM customer)
    SELECT s_suppkey, c_custkey FROM a JOIN b USING (n)
    """,
)
def position_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables side by side, by the places of their rows."""
    a, b = table(spark, sf_dir, "supplier").select("s_suppkey"), table(spark, sf_dir, "customer").select("c_custkey")
    return S.numbered(a, ["s_suppkey"]).join(S.numbered(b, ["c_custkey"]), "_n").select("s_suppkey", "c_custkey")


@query("literal_hyphen", "SELECT p_partkey, replace(p_brand || '-a b', '(?<=\\w)-(?=\\w)', ' ') AS name FROM part")
def literal_hyphen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern taken as a literal changes nothing: hyphens stay."""
    return table(spark, sf_dir, "part").select("p_partkey", F.replace(F.concat("p_brand", F.lit("-a b")), F.lit(r"(?<=\w)-(?=\w)"), F.lit(" ")).alias("name"))


@query("column_order")
def column_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands in the order of an average-linkage clustering of their counts by type; no SQL: merging is iterative."""
    counts = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return R.linkage_order(counts, "p_brand", "p_type", "n")
