"""Scores and quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wirebook.functions.once import compute_once

FLAT_STD = 1e-9
MIN_IQR_SAMPLES = 4
#: Size of quantile sketches, and how many times their usual error a bracket is wide on each side.
SKETCH_K, SKETCH_MARGIN = 2048, 3.0
#: Equal steps of rank at which a sketch is read.
SKETCH_GRID = 512


def z_score(value: Column, mean: Column, std: Column) -> Column:
    """Signed z-score, 0 when the spread is practically zero."""
    return F.when(std < FLAT_STD, F.lit(0.0)).otherwise(F.try_divide(value - mean, std))


def std_pop(value: Column) -> Column:
    """Population deviation, 0 for one value or none."""
    return F.coalesce(F.stddev_pop(value), F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def array_quantile(values: Column, p: float) -> Column:
    """Linearly interpolated quantile of an array; null when it is empty."""
    ordered = F.sort_array(values)
    at = (F.size(values) - 1) * F.lit(p)
    low = F.floor(at).cast("int")
    below = F.get(ordered, low)
    above = F.get(ordered, F.ceil(at).cast("int"))
    return below + (above - below) * (at - low)


def tukey_fences(q1: Column, q3: Column) -> tuple[Column, Column]:
    reach = (q3 - q1) * 1.5
    return q1 - reach, q3 + reach


def iqr_bounds(values: Column) -> tuple[Column, Column]:
    """Fences of the values in an array; (0, inf) for fewer than four."""
    enough = F.size(values) >= MIN_IQR_SAMPLES
    low, high = tukey_fences(array_quantile(values, 0.25), array_quantile(values, 0.75))
    return F.when(enough, low).otherwise(0.0), F.when(enough, high).otherwise(float("inf"))


def grouped_quantiles(df: DataFrame, keys: list[str], value: str, names: dict[str, float], k: int = SKETCH_K) -> DataFrame:
    """Exact, linearly interpolated quantiles of every group, in three passes.

    The built-in ``percentile`` holds all distinct values of a group in one
    task.  Here a mergeable sketch of each group brackets every quantile, some
    times wider than the sketch errs; a second pass counts the values in the
    few cells between the brackets' ends, which tells exactly which cells hold
    the wanted ranks; a third ranks the values of those cells, counted value
    by value.  A sketch that errs more costs a wider cell and no correctness.
    ``k`` is the size of the sketch.
    """
    values = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"))
    sketches = values.groupBy(*keys).agg(F.count("*").alias("n"), F.kll_sketch_agg_double("v", F.lit(k)).alias("sketch"))
    grid = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(i / SKETCH_GRID) for i in range(SKETCH_GRID + 1)]))
    reach = SKETCH_MARGIN * 2.296 / k**0.9021
    ends = []
    for p in names.values():
        at = (F.col("n") - 1) * F.lit(p)
        first = F.floor((F.floor(at) / F.col("n") - reach) * SKETCH_GRID).cast("int")
        last = F.ceil(((F.ceil(at) + 1) / F.col("n") + reach) * SKETCH_GRID).cast("int")
        ends += [F.when(first > 0, F.get("grid", first)), F.when(last < SKETCH_GRID, F.get("grid", last))]
    ends = compute_once(sketches, grid=grid).select(*keys, F.array_sort(F.array_distinct(F.array_compact(F.array(*ends)))).alias("ends"))
    # Cells are open below and closed above; null is no end.
    place = F.size(F.filter("ends", lambda e: e < F.col("v")))
    cells = _same_keys(values, ends, keys).groupBy(
        *keys, F.get("ends", place - 1).alias("low"), F.get("ends", place).alias("high")
    ).agg(F.count("*").alias("n"))
    group = W.partitionBy(*keys)
    cells = cells.withColumns({"upto": F.sum("n").over(group.orderBy(F.asc_nulls_first("low"))), "total": F.sum("n").over(group)})
    # A quantile between two ranks needs both; they may lie in two cells.
    wanted = []
    for name, p in names.items():
        at = (F.col("total") - 1) * F.lit(p)
        wanted += [F.struct(F.lit(name).alias("name"), at.alias("at"), r.cast("bigint").alias("rank")) for r in (F.floor(at), F.ceil(at))]
    start = F.col("upto") - F.col("n")
    held = F.filter(F.array(*wanted), lambda w: (w["rank"] >= F.col("upto") - F.col("n")) & (w["rank"] < F.col("upto")))
    held = F.transform(held, lambda w: F.struct(w["name"].alias("name"), w["at"].alias("at"), (w["rank"] - start).alias("rank")))
    holding = cells.select(*keys, "low", "high", held.alias("held")).where(F.size("held") > 0)
    inside = (F.col("low").isNull() | (F.col("v") > F.col("low"))) & (F.col("high").isNull() | (F.col("v") <= F.col("high")))
    counted = _same_keys(values, holding, keys).where(inside).groupBy(*keys, "low", "high", "held", "v").agg(F.count("*").alias("n"))
    ranked = counted.withColumn("upto", F.sum("n").over(W.partitionBy(*keys, "low", "high").orderBy("v")))
    found = ranked.select(*keys, "v", "n", "upto", F.explode("held").alias("w"))
    found = found.where((F.col("w.rank") >= F.col("upto") - F.col("n")) & (F.col("w.rank") < F.col("upto")))
    columns = []
    for name in names:
        mine = F.col("w.name") == name
        below, above = F.min(F.when(mine, F.col("v"))), F.max(F.when(mine, F.col("v")))
        at = F.max(F.when(mine, F.col("w.at")))
        columns.append((below + (above - below) * (at - F.floor(at))).alias(name))
    return found.groupBy(*keys).agg(*columns)


def _same_keys(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beside the columns of their group; null keys are a group too."""
    named = groups.withColumnsRenamed({c: f"_{c}" for c in keys})
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(named, same).drop(*[f"_{c}" for c in keys])
