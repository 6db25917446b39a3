"""Readers: delimited tables, text corpora, JSON exports, XML articles, FASTA records and ontologies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import stem


def tsv(spark: SparkSession, path: str | list[str], columns: list[str] | None = None, sep: str = "\t") -> DataFrame:
    """A delimited table with a header; only the named columns."""
    df = spark.read.csv(path, sep=sep, header=True)
    return df.select(*columns) if columns else df


def headerless(spark: SparkSession, path: str, schema: str, drop: tuple[str, ...] = (), missing: tuple[str, ...] = ("-", "None"), sep: str = "\t") -> DataFrame:
    """A delimited table without header: names and types by schema, several marks of a missing value, columns dropped."""
    types = spark.createDataFrame([], schema).schema
    raw = spark.read.schema(", ".join(f"`{f.name}` string" for f in types)).csv(path, sep=sep)
    value = lambda c: F.when(~F.col(c).isin(*missing), F.col(c))
    return raw.select(*[value(f.name).try_cast(f.dataType).alias(f.name) for f in types if f.name not in drop])


def parsed_lines(spark: SparkSession, path: str, pattern: str, names: list[str], skip: int = 0) -> DataFrame:
    """Lines of raw files, the first `skip` of each file left out, cut by the groups of a pattern. Files are read in splits; only
    lines of a file's first block are numbered."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("at"))
    if skip:
        first = lines.filter("at = 0").withColumn("n", F.row_number().over(Window.partitionBy("f").orderBy(F.monotonically_increasing_id()))).filter(F.col("n") > skip).drop("n")
        lines = first.unionByName(lines.filter("at > 0"))
    lines = lines.withColumn("value", F.regexp_replace("value", r"\r$", "")).filter("value <> ''")
    return lines.select(*[F.regexp_extract("value", pattern, i + 1).alias(c) for i, c in enumerate(names)])


def or_empty(spark: SparkSession, df: DataFrame, path: str, schema: str, sep: str = "\t") -> DataFrame:
    """df united with a table that may be empty (no header, no rows)."""
    return df.unionByName(spark.read.schema(schema).csv(path, sep=sep, header=True), allowMissingColumns=True)


def labelled_files(spark: SparkSession, path: str, reader: str = "json", column: str = "label", **options: str) -> DataFrame:
    """All files of a glob, with their name's stem as a column."""
    return spark.read.format(reader).options(**options).load(path).withColumn(column, stem(F.col("_metadata.file_name")))


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Annotation exports: one JSON tree a file."""
    return spark.read.schema(schema).json(path, multiLine=True)


def results(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """Nested values of result files by JSON path; damaged and empty files are left out. name: the file's stem."""
    raw = spark.read.text(path, wholetext=True).select(F.col("value"), stem(F.col("_metadata.file_name")).alias("name"))
    got = raw.select("name", *[F.get_json_object("value", p).try_cast("double").alias(c) for c, p in fields.items()], F.try_parse_json("value").isNotNull().alias("_ok"))
    return got.filter("_ok").drop("_ok")


def corpus_lines(spark: SparkSession, path: str) -> DataFrame:
    """A sentence a line; empty lines go, the last line stays also without a line end."""
    return spark.read.text(path).select(F.col("value").alias("text")).filter("text <> ''")


def conll(spark: SparkSession, path: str) -> DataFrame:
    """tokens, ner_tags, id of each sentence of `token tag` lines; a first line is a heading; the last sentence needs no blank line."""
    raw = spark.read.text(path, wholetext=True).select(stem(F.col("_metadata.file_name")).alias("f"), F.regexp_replace("value", "^[^\n]*\n", "").alias("v"))
    s = raw.select("f", F.posexplode(F.split("v", r"\n[ \t\r]*\n")).alias("n", "s")).filter("trim(s) <> ''")
    lines = F.filter(F.split("s", "\r?\n"), lambda x: F.trim(x) != "")
    part = lambda i: F.transform(lines, lambda x: F.element_at(F.split(F.trim(x), r"\s+"), i))
    return s.select(part(1).alias("tokens"), part(-1).alias("ner_tags"), F.concat_ws("-", "f", "n").alias("id"))


def articles(spark: SparkSession, path: str, row_tag: str = "p", schema: str = "_VALUE string, _id string") -> DataFrame:
    """Paragraphs of XML articles, with the file's stem; damaged files give no rows."""
    x = spark.read.schema(schema).option("rowTag", row_tag).option("mode", "DROPMALFORMED").format("xml").load(path)
    return x.withColumn("pmcid", stem(F.col("_metadata.file_name")))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """id, description, seq, protein_id (from the description, if there) and file of each record; a row is one record, not one file."""
    raw = spark.read.text(path, lineSep="\n>").select(stem(F.col("_metadata.file_name")).alias("file"), F.regexp_replace("value", "^>", "").alias("r")).filter("trim(r) <> ''")
    head = F.regexp_extract("r", "^([^\r\n]*)", 1)
    seq = F.regexp_replace(F.regexp_replace("r", "^[^\r\n]*", ""), r"\s+", "")
    return raw.select(F.split_part(head, F.lit(" "), F.lit(1)).alias("id"), head.alias("description"), seq.alias("seq"), F.regexp_extract(head, r"protein_id=([^\]]*)", 1).alias("protein_id"), "file")


def complete_folders(spark: SparkSession, path: str, files: int = 5) -> DataFrame:
    """strain, assembly of the folders strain/assembly that hold exactly so many files (names only are read)."""
    names = spark.read.format("binaryFile").load(path).select(F.split("path", "/").alias("p"))
    at = lambda i: F.element_at("p", i)
    return names.groupBy(at(-3).alias("strain"), at(-2).alias("assembly")).count().filter(F.col("count") == files).drop("count")


def ontology(spark: SparkSession, path: str, predicates: list[str]) -> DataFrame:
    """identifier, value, type of an OBO file's terms, for the named keys."""
    raw = spark.read.text(path, lineSep="[Term]").select(F.col("value").alias("t"))
    line = raw.select(F.regexp_extract("t", r"(?m)^id: (\S+)", 1).alias("identifier"), F.explode(F.split("t", "\r?\n")).alias("l")).filter("identifier <> ''")
    kind = F.split_part("l", F.lit(":"), F.lit(1))
    value = F.trim(F.regexp_replace(F.regexp_replace("l", "^[^:]*:", ""), r'^\s*"([^"]*)".*$', "$1"))
    return line.select("identifier", value.alias("value"), kind.alias("type")).filter(F.col("type").isin(*predicates))


def triples(spark: SparkSession, path: str, predicates: list[str]) -> DataFrame:
    """identifier, value, type of `<s> <p> "o"` lines, for predicates that end in one of the names."""
    t = parsed_lines(spark, path, r'^<([^>]*)>\s+<([^>]*)>\s+(.*?)\s*\.\s*$', ["identifier", "type", "value"])
    last = F.regexp_extract("type", "([^/#]*)$", 1)
    return t.select("identifier", F.regexp_replace("value", r'^"(.*)"(@\w+|\^\^\S+)?$|^<(.*)>$', "$1$3").alias("value"), last.alias("type")).filter(F.col("type").isin(*predicates))


def edges(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """src, dst, rel of an edge list with the header source, target, rel."""
    return tsv(spark, path, ["source", "target", "rel"], sep).toDF("src", "dst", "rel")


def aliased(label: Column, names: dict[str, str]) -> Column:
    """Whole labels replaced by a table."""
    out = label
    for old, new in names.items():
        out = F.when(label == old, new).otherwise(out)
    return out
