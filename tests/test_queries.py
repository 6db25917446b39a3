import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DIR = "/root/testdata/sf0.001"
CHECKED = sorted(k for k in entry.oracle_sql() if not k.startswith(("op", "pipeline")))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return "~" if v != v else repr(round(v, 6) + 0.0)
    return "~" if v is None else str(v)


@pytest.mark.parametrize("name", CHECKED)
def test_like_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, DIR).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    rows = lambda df: sorted(tuple(map(plain, r)) for r in df[cols].itertuples(index=False))
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
