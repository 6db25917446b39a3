"""One boosted tree classifier for each class against the rest."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from loomgraph.operators.stats import stratified_split
from loomgraph.storage import dropped, materialise


#: A model is fitted for each class; more classes are refused.
MOST_CLASSES = 1000
#: Classes that are fitted at once: a fit is a long row of short jobs, which leaves most cores idle.
AT_ONCE = 8


def one_vs_rest(df: DataFrame, ident: str, features: str, label: str, least: int = 10, trees: int = 10, depth: int = 6, step: float = 0.3) -> DataFrame:
    """label, accuracy on the held-out fifth, and the leading feature's place and gain, for classes of `least` rows or more.

    The split is stratified by the label in a repeatable order. Classes are a bounded list: one model is fitted for each.
    """
    spark = df.sparkSession
    kept = df.filter(F.col(features).isNotNull() & F.col(label).isNotNull())
    sizes = kept.groupBy(label).agg(F.count("*").alias("n")).filter(F.col("n") >= least).orderBy(label)
    split = stratified_split(kept.select(ident, label, features), label, ident, 0.2, "gbt").withColumn("x", array_to_vector(F.transform(features, lambda v: v.cast("double")))).select(label, "split", "x")
    classes = sizes.limit(MOST_CLASSES + 1).collect()
    if len(classes) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes")
    # written once: as many partitions as the rows need, where a cached split has one for each shuffle partition, in each of the fits' many jobs
    stored = materialise(split, "gbt")
    data = stored.persist()

    def fitted(r: Row) -> tuple[int, float, int, float]:
        one = data.withColumn("y", (F.col(label) == r[label]).cast("double"))
        train, test = one.filter("split = 'train'"), one.filter("split <> 'train'")
        m = GBTClassifier(featuresCol="x", labelCol="y", maxDepth=depth, stepSize=step, maxIter=trees, seed=0).fit(train)
        right = m.transform(test).agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0]
        gains = m.featureImportances.toArray()
        return int(r[label]), float(right or 0), int(gains.argmax()), float(gains.max())

    with ThreadPoolExecutor(AT_ONCE) as pool:
        rows = list(pool.map(inheritable_thread_target(spark)(fitted), classes))
    data.unpersist()
    dropped(stored)
    return spark.createDataFrame(rows, "label int, accuracy double, feature int, gain double")
