"""Queries by operator id, each beside the DuckDB SQL it must agree with.

A query takes a :class:`checks.tables.Plant`.  Results are flattened for the
comparison: timestamps as microseconds, arrays as text, derived averages
rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.base_sql import sql
from checks.tables import Plant
from wirebook.session import configure

QUERIES: dict[str, Callable[[Plant], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def add(name: str, query: Callable[[Plant], DataFrame], oracle: str | None = None, raw: bool = False) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = query
    if oracle is not None:
        ORACLE[name] = oracle if raw else sql(oracle)


def flat(df: DataFrame) -> DataFrame:
    """Timestamps to microseconds, arrays to text; structs are spread out."""
    columns: list[Column] = []
    for field in df.schema.fields:
        columns.extend(_flat(F.col(f"`{field.name}`"), field.name, field.dataType))
    return df.select(*columns)


def _flat(column: Column, name: str, kind: T.DataType) -> list[Column]:
    if isinstance(kind, T.TimestampType):
        return [F.unix_micros(column).alias(name)]
    if isinstance(kind, T.ArrayType):
        return [F.when(column.isNotNull(), F.concat_ws("|", column.cast("array<string>"))).alias(name)]
    if isinstance(kind, T.StructType):
        return [c for f in kind.fields for c in _flat(column[f.name], f"{name}_{f.name}", f.dataType)]
    return [column.alias(name)]


def steady(value: Column) -> Column:
    """Cut to six places at a point where exact fractions have no tie.

    Means of intervals often end exactly between two roundings, where the
    last bit of a sum would decide.
    """
    return F.floor(value * 1e6 + 0.3) / 1e6


def rounded(df: DataFrame, *names: str, places: int | None = 6) -> DataFrame:
    return df.withColumns({n: steady(F.col(n)) if places is None else F.round(n, places) for n in names})


def runner(query: Callable[[Plant], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return flat(query(Plant(configure(spark), sf_dir)))

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: runner(query) for name, query in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
