"""Relations between strains and words: scoring, network, feature tables and evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.stats import prf


def scored(sentences: DataFrame, scorer: Callable[[pd.Series, str], pd.DataFrame], relations: dict[str, str], type_col: str, text_col: str) -> DataFrame:
    """sentences with label, rel_score and rel, for every relation whose entity type (relations: name -> type) a row has.

    scorer(texts, relation) gives label (`..._0` or `..._1`) and score of each text; it is called on Arrow batches, once a
    relation and batch, so all relations take one pass. Empty texts go, and so do rows of label 0.
    """
    schema = sentences.schema.simpleString().removeprefix("struct<").removesuffix(">")
    names = sentences.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rel, kind in relations.items():
                own = pdf[pdf[type_col] == kind].reset_index(drop=True)
                if len(own):
                    got = scorer(own[text_col], rel)
                    yield own.assign(label=got["label"].str.rsplit("_", n=1).str[-1].astype("int32"), rel_score=got["score"].astype(float), rel=rel)[[*names, "label", "rel_score", "rel"]]

    able = sentences.filter(F.col(text_col) != "")
    return able.mapInPandas(run, f"{schema}, label int, rel_score double, rel string").filter("label = 1")


def network(rows: DataFrame, black_list: str) -> DataFrame:
    """source, target, rel, source_ner, target_ner of distinct (strain, word, rel) with `A-B:REL` relations: the side named
    first is the source. Rows without strain or with a word that the pattern finds go."""
    n = rows.filter(F.col("strain").isNotNull() & ~F.col("word").rlike(black_list)).select("strain", "word", "rel").distinct()
    first = F.col("rel").startswith("STRAIN")
    ends = F.split_part("rel", F.lit(":"), F.lit(1))
    return n.select(
        F.when(first, F.col("strain")).otherwise(F.col("word")).alias("source"), F.when(first, F.col("word")).otherwise(F.col("strain")).alias("target"),
        F.split_part("rel", F.lit(":"), F.lit(2)).alias("rel"), F.split_part(ends, F.lit("-"), F.lit(1)).alias("source_ner"), F.split_part(ends, F.lit("-"), F.lit(2)).alias("target_ner"),
    )


def assemblies(predictions: DataFrame, vertices: DataFrame, kind: str = "rs_assembly") -> DataFrame:
    """assembly: `strain/vertex` of the vertices of a kind of all strains with a prediction, once each."""
    strains = predictions.filter("strain is not null").select("strain").distinct()
    return vertices.filter(F.col("vertex_type") == kind).join(strains, "strain", "left_semi").select(F.concat_ws("/", F.col("strain").cast("string"), "vertex").alias("assembly")).distinct()


def varied(relations: DataFrame, genus: DataFrame) -> DataFrame:
    """Relations of words that more than one strain has, of more than one genus; strains without genus count as none."""
    words = relations.join(genus, "strain", "left").groupBy("word").agg(F.count("*").alias("n"), F.countDistinct("genus").alias("g")).filter("n > 1 and g > 1").select("word")
    return relations.join(words, "word", "left_semi")


def annotated(relations: DataFrame, downloaded: DataFrame, annotations: DataFrame) -> DataFrame:
    """sa_ner (`strain!assembly!word`), word, feature, n: annotations of all downloaded assemblies of a relation's strains.

    Annotations are counted before the joins, and the words of a strain join counts: no row is made for each annotation and
    word. Annotations without a feature, and words with a single one, go.
    """
    counts = annotations.filter("feature is not null").groupBy("strain", "assembly", "feature").agg(F.count("*").alias("n")).join(downloaded.select("strain", "assembly").distinct(), ["strain", "assembly"], "left_semi")
    j = relations.select("strain", "word").distinct().join(counts, "strain")
    many = j.groupBy("word").agg(F.sum("n").alias("k")).filter("k > 1").select("word")
    return j.join(many, "word", "left_semi").select(F.concat_ws("!", F.col("strain").cast("string"), "assembly", "word").alias("sa_ner"), "word", "feature", "n")


def flagged(left: DataFrame, right: DataFrame, on: list[str], flag: str) -> DataFrame:
    """left with a column that tells whether right has its key; left's rows are never multiplied."""
    return left.join(right.select(*on).distinct().withColumn(flag, F.lit(True)), on, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def one_to_one(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """left join; raises when a key repeats on either side, in the job that reads the result."""

    def single(df: DataFrame, side: str) -> DataFrame:
        rest = [c for c in df.columns if c not in on]
        one = df.groupBy(*on).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in rest])
        checked = F.when(F.col("_n") == 1, F.col(on[0])).otherwise(F.raise_error(F.concat(F.lit(f"a key repeats on the {side}: "), F.col(on[0]).cast("string"))).cast(df.schema[on[0]].dataType))
        return one.withColumn(on[0], checked).select(*df.columns)

    return single(left, "left").join(single(right, "right"), on, "left")


def tag_spans(tags: DataFrame, key: str, place: str, label: str, tag: str) -> DataFrame:
    """key, label, start, end of the entities of B, I and O tags: a B, or an I after an O or another label, opens one."""
    w = Window.partitionBy(key).orderBy(place)
    t, before = F.col(tag), F.lag(tag).over(w)
    opens = (t != "O") & ((t == "B") | before.isNull() | (before == "O") | (F.lag(label).over(w) != F.col(label)))
    island = tags.withColumn("_o", opens.cast("int")).withColumn("_i", F.sum("_o").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter(t != "O")
    return island.groupBy(key, F.col(label).alias("label"), "_i").agg(F.min(place).alias("start"), F.max(place).alias("end")).drop("_i")


def span_scores(actual: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """label, precision, recall, f1 of entities that agree in key, label and both ends; rows (all) and (macro) besides."""
    on = [key, "label", "start", "end"]
    j = actual.select(*on).distinct().withColumn("a", F.lit(1)).join(predicted.select(*on).distinct().withColumn("p", F.lit(1)), on, "full")
    c = j.groupBy("label").agg(F.count_if(F.col("a").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count("p").alias("pp"), F.count("a").alias("ap"))
    both = c.unionByName(c.agg(F.sum("tp").alias("tp"), F.sum("pp").alias("pp"), F.sum("ap").alias("ap")).withColumn("label", F.lit("(all)")))
    m = both.select("label", *prf(F.col("tp"), F.col("pp"), F.col("ap")))
    names = [x for x in m.columns if x != "label"]
    mean = m.filter("label <> '(all)'").agg(*[F.avg(x).alias(x) for x in names]).withColumn("label", F.lit("(macro)"))
    return m.unionByName(mean).select("label", *[F.round(x, 9).alias(x) for x in names])


def leading_sequences(gains: DataFrame, proteins: DataFrame) -> DataFrame:
    """ner, rel, gene, strain, protein: of each (ner, rel) the gene of the largest gain (ties to the smaller), of each strain its
    first protein with that gene, and of each protein its first strain."""
    lead = gains.groupBy("ner", "rel").agg(F.max_by("gene", F.struct("gain", (-F.col("gene")).alias("k"))).alias("gene"))
    first = proteins.groupBy("strain", "gene").agg(F.min(F.struct("protein", "place")).alias("m")).select("strain", "gene", "m.protein")
    s = lead.join(first, "gene")
    return s.groupBy("ner", "rel", "gene", "protein").agg(F.min("strain").alias("strain"))


def unwrapped(text: Column) -> Column:
    """x of the text `['x']` of a list."""
    return F.substring(text, F.lit(3), F.char_length(text) - 4)


#: Columns of a pivot that are clustered at most; the distances of all pairs are held on the driver.
MOST_COLUMNS = 2000


def linkage_order(cells: DataFrame, column: str, row: str, value: str) -> DataFrame:
    """column, place: the order of leaves of an average-linkage clustering of a small pivot's columns (Euclidean distance).

    Of a merge the side with the smaller first column comes first, and ties of distance go to the smaller columns. More than
    MOST_COLUMNS columns are refused.
    """
    spark = cells.sparkSession
    names = [r[0] for r in cells.select(column).distinct().orderBy(column).limit(MOST_COLUMNS + 1).collect()]
    if len(names) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} columns")
    at = F.element_at(F.create_map(*[x for i, c in enumerate(names) for x in (F.lit(c), F.lit(i))]), F.col(column)) if names else F.lit(0)
    # inner products of columns, summed over rows on the executors: rows may be many
    one = cells.groupBy(row, at.alias("i")).agg(F.sum(value).cast("double").alias("v"))
    dots = one.join(one.select(row, F.col("i").alias("j"), F.col("v").alias("w")), row).groupBy("i", "j").agg(F.sum(F.col("v") * F.col("w")).alias("d")).collect()
    g = np.zeros((len(names), len(names)))
    for r in dots:
        g[r["i"], r["j"]] = r["d"]
    d = np.sqrt(np.maximum(np.diag(g)[:, None] + np.diag(g)[None, :] - 2 * g, 0))
    leaves = average_linkage(d)
    return spark.createDataFrame([(names[i], k) for k, i in enumerate(leaves)], f"{column} string, place int")


def average_linkage(d: np.ndarray) -> list[int]:
    """Leaves in the order of an average-linkage clustering of a distance matrix."""
    n = len(d)
    d = d.copy()
    np.fill_diagonal(d, np.inf)
    members = {i: [i] for i in range(n)}
    while len(members) > 1:
        i, j = divmod(int(np.argmin(d)), n)
        i, j = min(i, j), max(i, j)
        a, b = len(members[i]), len(members[j])
        d[i] = d[:, i] = (a * d[i] + b * d[j]) / (a + b)
        d[i, i] = np.inf
        d[j] = d[:, j] = np.inf
        members[i] += members.pop(j)
    return next(iter(members.values()), [])
