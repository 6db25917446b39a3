"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lines(df: DataFrame, path: str, column: str, per_file: int = 550_000) -> None:
    """One unquoted column as text, a fixed number of lines a file at most. Line ends inside a value become spaces."""
    df.select(F.regexp_replace(F.col(column).cast("string"), r"[\r\n]+", " ").alias("value")).write.option("maxRecordsPerFile", per_file).text(path)


def jsonl(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", "false").json(path)


def tsv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.csv(path, sep="\t", header=header)


def matrix(df: DataFrame, path: str, sample: str, feature: str, value: str) -> None:
    """A count matrix in long form, by feature, so that a reader can skip the others."""
    df.select(sample, feature, value).repartitionByRange(feature).sortWithinPartitions(feature, sample).write.parquet(path)


def by_category(df: DataFrame, path: str, category: str) -> None:
    """A folder for each category."""
    df.write.partitionBy(category).parquet(path)


def merged(frames: list[DataFrame], path: str) -> None:
    """Frames of one schema as one table; a frame with another schema raises."""
    out = frames[0]
    for f in frames[1:]:
        if [x.name for x in f.schema] != [x.name for x in out.schema]:
            raise ValueError("schemas differ")
        out = out.unionByName(f)
    out.write.parquet(path)
