"""Evaluating an expensive expression once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that the optimizer will not inline into later steps.

    A filter on a computed column is normally pushed below the projection
    with the whole expression copied into it.  Generating a one-element array
    keeps the value and stops the copy; it needs no shuffle.
    """
    packed = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_once")
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, packed).select(*kept, *[F.col(f"_once.{n}").alias(n) for n in columns])
