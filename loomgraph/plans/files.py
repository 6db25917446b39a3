"""Queries that write tables in a file format and read them back with the readers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.plans.registry import query
from loomgraph.sources import readers, writers
from loomgraph.storage import new_path, table


def _headed(lines: DataFrame, heading: list[str]) -> DataFrame:
    """lines (value), those of each task behind heading lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(heading)], ["value"])
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("value")], ["value"])

    return lines.mapInArrow(run, "value string")


@query("tsv_round_trip", "SELECT p_partkey, p_name, p_size FROM part")
def tsv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with a header; only some columns are read."""
    writers.tsv(table(spark, sf_dir, "part"), path := new_path(spark, "tsv"))
    got = readers.tsv(spark, path, ["p_partkey", "p_name", "p_size"])
    return got.select(F.col("p_partkey").cast("long"), "p_name", F.col("p_size").cast("int"))


@query("headerless_round_trip", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 > 0 THEN s_name END AS name, CASE WHEN s_suppkey % 2 > 0 THEN s_acctbal END AS balance FROM supplier")
def headerless_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No header, two marks of a missing value, a column left out."""
    name = F.when(F.col("s_suppkey") % 3 == 0, "-").otherwise(F.col("s_name"))
    balance = F.when(F.col("s_suppkey") % 2 == 0, "None").otherwise(F.col("s_acctbal").cast("string"))
    writers.tsv(table(spark, sf_dir, "supplier").select("s_suppkey", name.alias("n"), "s_nationkey", balance.alias("b")), path := new_path(spark, "headerless"), header=False)
    return readers.headerless(spark, path, "id long, name string, nation int, balance double", ("nation",))


@query("jsonl_round_trip", "SELECT event_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value", F.struct(F.get_json_object("props", "$.k").cast("int").alias("k")).alias("props"))
    writers.jsonl(e, path := new_path(spark, "jsonl"))
    return spark.read.schema("event_id long, event_type string, value double, props struct<k:int>").json(path).select("event_id", "event_type", "value", "props.k")


@query("text_shards", r"SELECT md5(t) AS h, count(*) AS n FROM (SELECT regexp_replace(text, '[\r\n]+', ' ', 'g') AS t FROM benchmark) WHERE t <> '' GROUP BY 1")
def text_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text a line, few lines a file; read as a corpus."""
    writers.lines(table(spark, sf_dir, "benchmark").filter("text is not null"), path := new_path(spark, "lines"), "text", 7)
    return readers.corpus_lines(spark, path).groupBy(F.md5("text").alias("h")).agg(F.count("*").alias("n"))


@query(
    "conll_round_trip",
    "SELECT conv_id, count(*) AS tokens, count(*) FILTER (role = 'user') AS tagged FROM conversations GROUP BY conv_id",
)
def conll_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of `token tag` lines behind a heading in each file."""
    line = F.concat_ws(" ", F.concat_ws("x", "conv_id", "turn"), F.when(F.col("role") == "user", "B-USER").otherwise("O"))
    s = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("v"))
    _headed(s.select(F.col("v").alias("value")), ["-DOCSTART-"]).write.option("lineSep", "\n\n").text(path := new_path(spark, "conll"))
    c = readers.conll(spark, path)
    return c.select(F.split_part(F.element_at("tokens", 1), F.lit("x"), F.lit(1)).cast("long").alias("conv_id"), F.size("tokens").cast("long").alias("tokens"), F.size(F.filter("ner_tags", lambda t: t == "B-USER")).cast("long").alias("tagged"))


@query("fasta_round_trip", "SELECT 'g' || p_partkey AS id, 'P' || p_size AS protein_id, upper(replace(p_name, ' ', '')) AS seq FROM part")
def fasta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of several lines, many in a file."""
    n = F.upper(F.replace("p_name", F.lit(" "), F.lit("")))
    record = F.concat(F.lit(">g"), "p_partkey", F.lit(" [protein_id=P"), F.col("p_size").cast("string"), F.lit("]\n"), F.substring(n, 1, 4), F.lit("\n"), F.substring(n, 5, 1000))
    table(spark, sf_dir, "part").select(record.alias("value")).write.text(path := new_path(spark, "fasta"))
    return readers.fasta(spark, path).select("id", "protein_id", "seq")


@query("edge_list_round_trip", "SELECT rel, count(*) AS n, count(DISTINCT src) AS sources FROM (SELECT DISTINCT 'S' || l_suppkey AS src, 'P' || l_partkey AS dst, l_returnflag AS rel FROM lineitem) GROUP BY rel")
def edge_list_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge list whose heading is no edge."""
    e = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("S"), "l_suppkey").alias("source"), F.concat(F.lit("P"), "l_partkey").alias("target"), F.col("l_returnflag").alias("rel")).distinct()
    writers.tsv(e, path := new_path(spark, "edges"))
    return readers.edges(spark, path).groupBy("rel").agg(F.count("*").alias("n"), F.countDistinct("src").alias("sources"))


@query("category_folders", "SELECT p_type AS label, count(*) AS n, min(p_partkey) AS least FROM part GROUP BY 1")
def category_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder for each category; the category comes back from its name."""
    writers.by_category(table(spark, sf_dir, "part"), path := new_path(spark, "categories"), "p_type")
    return spark.read.parquet(path).groupBy(F.col("p_type").alias("label")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("least"))


@query("raw_lines", "SELECT c_mktsegment AS segment, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer GROUP BY 1")
def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`GO:key ; segment` lines cut by a pattern; two lines before them are skipped in each file."""
    lines = table(spark, sf_dir, "customer").select(F.concat(F.lit("GO:"), "c_custkey", F.lit(" ; "), "c_mktsegment").alias("value"))
    _headed(lines.repartition(3), ["! heading", "GO:5 ; heading"]).write.text(path := new_path(spark, "raw"))
    got = readers.parsed_lines(spark, path, r"^GO:(\d+) ; (.*)$", ["k", "segment"], 2)
    return got.groupBy("segment").agg(F.count("*").alias("n"), F.sum(F.col("k").cast("long")).alias("keys"))


@query("ontology_round_trip", "SELECT 'N:' || n_nationkey AS identifier, n_name AS value, 'name' AS type FROM nation UNION ALL SELECT 'N:' || n_nationkey, lower(n_name), 'synonym' FROM nation")
def ontology_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of an ontology file, some of their keys."""
    term = F.concat(F.lit("[Term]\nid: N:"), "n_nationkey", F.lit("\nname: "), "n_name", F.lit('\nsynonym: "'), F.lower("n_name"), F.lit('" EXACT []\nis_a: N:0\n'))
    table(spark, sf_dir, "nation").select(term.alias("value")).write.text(path := new_path(spark, "ontology"))
    return readers.ontology(spark, path, ["name", "synonym"])


@query("triples_round_trip", "SELECT 'http://n/' || n_nationkey AS identifier, n_name AS value, 'label' AS type FROM nation")
def triples_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`<s> <p> \"o\" .` lines, one predicate of two."""
    line = lambda p, o: F.concat(F.lit("<http://n/"), "n_nationkey", F.lit(f"> <http://p#{p}> "), o, F.lit(" ."))
    n = table(spark, sf_dir, "nation").select(F.explode(F.array(line("label", F.concat(F.lit('"'), "n_name", F.lit('"@en'))), line("part", F.concat(F.lit("<http://r/"), F.col("n_regionkey").cast("string"), F.lit(">"))))).alias("value"))
    n.write.text(path := new_path(spark, "triples"))
    return readers.triples(spark, path, ["label"])


@query("annotation_export", "SELECT conv_id AS id, count(*) AS n, count(*) FILTER (role = 'user') AS users FROM conversations GROUP BY conv_id")
def annotation_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested annotations, exported as one tree a line and taken apart again."""
    one = F.struct(F.col("role").alias("type"), F.array("role").alias("labels"), F.struct(F.col("text")).alias("value"))
    d = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.array(F.struct(F.collect_list(one).alias("result"))).alias("annotations"))
    writers.jsonl(d, path := new_path(spark, "annotations"))
    back = spark.read.schema("id long, annotations array<struct<result:array<struct<type:string,labels:array<string>,value:struct<text:string>>>>>").json(path)
    r = back.select("id", F.explode(F.element_at("annotations", 1)["result"]).alias("r"))
    return r.groupBy("id").agg(F.count("*").alias("n"), F.count_if(F.element_at("r.labels", 1) == "user").alias("users"))
