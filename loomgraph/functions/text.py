"""Column functions on text."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f) -> Column:
    """f(value), with value computed once: Spark would compute it again wherever a lambda names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def cut(text: Column, start: Column, end: Column) -> Column:
    """text[start:end] by code points, 0-based, the end exclusive; empty where the end is not behind the start."""
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def plain_hyphens(text: Column) -> Column:
    """A hyphen between two word characters of any script becomes a space."""
    return F.regexp_replace(text, r"(?U)(?<=[\p{L}\p{N}_])-(?=[\p{L}\p{N}_])", " ")


def rewrite(text: Column, rules: list[tuple[str, str, bool]]) -> Column:
    """Rules (pattern, replacement, is a regular expression) one after the other; order counts."""
    return reduce(lambda t, r: F.regexp_replace(t, r[0], r[1]) if r[2] else F.replace(t, F.lit(r[0]), F.lit(r[1])), rules, text)


def strip_dots(text: Column) -> Column:
    """Without one leading and one trailing dot."""
    return F.regexp_replace(F.regexp_replace(text, r"\.$", ""), r"^\.", "")


def capital(text: Column) -> Column:
    """First letter upper case, all others lower."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, F.lit(2), F.char_length(text))))


def stem(path: Column) -> Column:
    """Base name of a path without its last extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def file_name(text: Column) -> Column:
    """A name that is safe for files: `#` and `/` become hyphens, white space underscores, other signs go."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[#/]", "-"), r"\s", "_"), "[^A-Za-z0-9_-]+", "")


#: A row gives 2**k - 1 selections of k parts; more parts than this are refused.
MOST_PARTS = 20


def part_combinations(parts: Column, most: int = MOST_PARTS) -> Column:
    """All non-empty selections of the parts, order kept, joined by dots: 2**k - 1 strings. A bit of a mask takes a part.

    A list of more than `most` parts raises an error, as its row would grow without bound.
    """
    n = F.size(parts)
    chosen = lambda m: F.array_join(F.filter(parts, lambda _, i: F.call_function("getbit", m, i) == 1), ".")
    all_ = F.transform(F.sequence(F.lit(1).cast("long"), F.expr("1L").cast("long") * F.pow(F.lit(2), n).cast("long") - 1), chosen)
    return F.when(n <= most, all_).otherwise(F.when(n > most, F.raise_error(F.concat(F.lit("too many parts: "), n.cast("string"))).cast("array<string>")))


def token_sort(text: Column) -> Column:
    """Space-separated tokens in order, joined by one space."""
    return F.array_join(F.array_sort(F.filter(F.split(text, r"\s+"), lambda t: t != "")), " ")


def subsets(parts: list[str]) -> list[str]:
    """part_combinations for a Python list, for tests."""
    return [".".join(c) for k in range(1, len(parts) + 1) for c in combinations(parts, k)]
