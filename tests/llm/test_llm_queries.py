import pytest

import __spark_entry__ as entry
from tests.test_queries import DIR, duck, plain  # noqa: F401

SQL = sorted(k for k in entry.oracle_sql() if k.startswith("op"))


@pytest.mark.parametrize("name", SQL)
def test_like_sql(spark, duck, name):  # noqa: F811
    got, want = entry.queries()[name](spark, DIR).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda df: sorted(tuple(map(plain, r)) for r in df[cols].itertuples(index=False))
    assert rows(got) == rows(want)


def test_all_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
