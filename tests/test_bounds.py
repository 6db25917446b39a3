import pytest

import __spark_entry__ as entry
from loomgraph.operators import boosting


def test_more_entries_than_the_bound_are_refused(spark, tmp_path):
    spark.createDataFrame([(f"segment {i}",) for i in range(1001)], "c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([("segment 1000",)], "p_type string").write.parquet(f"{tmp_path}/part.parquet")
    with pytest.raises(ValueError, match="1000"):
        entry.queries()["levenshtein_best"](spark, str(tmp_path)).collect()


def test_more_classes_than_the_bound_are_refused(spark, monkeypatch):
    monkeypatch.setattr(boosting, "MOST_CLASSES", 2)
    df = spark.createDataFrame([(i, [float(i), 1.0], i % 3) for i in range(60)], "id long, x array<double>, label int")
    with pytest.raises(ValueError, match="classes"):
        boosting.one_vs_rest(df, "id", "x", "label")


def test_fits_run_on_as_many_tasks_as_rows_need(spark, monkeypatch):
    widths, fit = [], boosting.GBTClassifier.fit
    monkeypatch.setattr(boosting.GBTClassifier, "fit", lambda self, df, *a: widths.append(df.rdd.getNumPartitions()) or fit(self, df, *a))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        df = spark.createDataFrame([(i, [float(i % 7), float(i % 3)], i % 3) for i in range(90)], "id long, x array<double>, label int")
        got = boosting.one_vs_rest(df, "id", "x", "label", trees=2, depth=2).orderBy("label").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert [(r["label"], r["accuracy"], r["feature"]) for r in got] == [(0, 1.0, 1), (1, 1.0, 1), (2, 1.0, 1)]
    assert len(widths) == 3 and max(widths) < 10
