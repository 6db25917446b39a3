"""String similarity from 0 to 100: normalised insert/delete distance, its best window, and sorted tokens."""

from __future__ import annotations

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each place of a in one integer."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = s = (1 << len(a)) - 1
    for c in b:
        m = s & at.get(c, 0)
        s = ((s + m) | (s - m)) & full
    return len(a) - s.bit_count()


def ratio(a: str | None, b: str | None) -> float | None:
    """200 LCS / (|a| + |b|); 100 for two empty strings, null if one is null."""
    if a is None or b is None:
        return None
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial(a: str | None, b: str | None, least: float = 0) -> float | None:
    """The best ratio of the shorter string with a window, of its length or cut by an end, of the longer; 0 where it cannot be
    `least` or more, as no window has more in common with the shorter string than the longer one has."""
    if a is None or b is None:
        return None
    a, b = sorted((a, b), key=len)
    n = len(a)
    if not n:
        return 0.0 if b else 100.0
    if least and (most := lcs(a, b)) * 200 < least * (n + most) - 1e-9:
        return 0.0
    return max(ratio(a, b[max(0, i) : i + n]) for i in range(1 - n, len(b)))


def token_sorted(a: str | None, b: str | None) -> float | None:
    return None if a is None or b is None else ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def _column(f):
    def scorer(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    def column(a, b):
        return pandas_udf(scorer, DoubleType())(a, b)

    return column


def partial_column(a, b, least: float = 0):
    return _column(lambda x, y: partial(x, y, least))(a, b)


ratio_column, token_sort_column = _column(ratio), _column(token_sorted)
