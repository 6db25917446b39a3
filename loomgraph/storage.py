"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where that is unset and all tasks run on this machine."""
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"{SETTING} must name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set(SETTING, folder)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: what follows survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", compression) if compression else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_bucket(df: DataFrame, name: str, column: str, buckets: int, compression: str | None = None) -> tuple[DataFrame, str]:
    """As materialise, dealt into buckets by a column, so that joins of such tables on it move no rows; and the table's name, for `drop_table`."""
    spark = df.sparkSession
    path = new_path(spark, name)
    known = "loomgraph_" + path.rsplit("/", 1)[1].replace("-", "_")
    writer = df.write.option("compression", compression) if compression else df.write
    writer.format("parquet").bucketBy(buckets, column).option("path", path).saveAsTable(known)
    return spark.table(known), known


def drop_table(spark: SparkSession, *names: str) -> None:
    """Forget tables made by `by_bucket` and delete their files."""
    for name in names:
        paths = {f.rsplit("/", 1)[0] for f in spark.table(name).inputFiles()}
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        release(spark, *paths)


def swept(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files that no plan refers to any more: it does so when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by `materialise` that nothing reads any more; others are left alone."""
    for df in tables:
        folder = shared_folder(df.sparkSession)
        local = folder.removeprefix("file:")
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/" + local.strip("/") + "/" in path:
                release(df.sparkSession, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
