"""Small fixed tables as literal expressions.

A rule list written in code has a known size, so it is folded into the
expression itself: no join, no broadcast, no shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def string_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def lookup(mapping: dict, key: Column, kind: str) -> Column:
    """Value of ``key`` in a literal map, null when it is absent."""
    if not mapping:
        return F.lit(None).cast(kind)
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key).cast(kind)


def lowest(columns: list[Column], kind: str) -> Column:
    """Least of the non-null columns, null when there is none."""
    columns = list(columns)
    if not columns:
        return F.lit(None).cast(kind)
    return F.least(*columns) if len(columns) > 1 else columns[0]


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
