"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirebook.sources.tables import shared_dir


def _least(edges: DataFrame) -> DataFrame:
    """The smallest of each larger end's neighbours; combined before the shuffle, so a node may have many."""
    return edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to the smallest of all: an edge's smaller end gives way to its own smallest."""
    met = edges.join(_least(edges), F.col("b") == F.col("id"), "left")
    return met.select("a", F.coalesce("m", "b").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of these; both links come from one pass over the join."""
    met = edges.join(_least(edges), F.col("a") == F.col("id"))
    links = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
    return met.select(F.inline(links)).where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, label) of every node of the edges (a, b); the label is the component's smallest id.

    Edges with a null end, and loops, are no edges; all others have their
    larger end first, in every round.  Each round is written to the shared
    folder; the loop ends when every node has one neighbour that is smaller, or
    is such a neighbour, but not both.
    """
    spark, root = edges.sparkSession, shared_dir(edges.sparkSession)

    def put(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{root}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{root}/{name}")

    now = put(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "0")
    for k in range(1, rounds + 1):
        if _are_stars(now):
            break
        now = put(_small_star(_large_star(now)), str(k))
    else:
        raise RuntimeError("components did not settle")
    pairs = now.select(F.col("a").alias("id"), F.col("b").alias("label"))
    return pairs.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Whether every larger end is in one edge, and is no smaller end of another; one shuffle of partial counts."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not nodes.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).head(1)
