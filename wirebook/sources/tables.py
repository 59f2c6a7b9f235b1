"""Table layout for incremental folds: deltas per batch and merged bases.

A batch of events is folded on its own and written under its batch number.
Writing a batch again replaces it, so a replayed batch is not counted twice.
A base merges everything up to its batch.  Which base is current is told by a
pointer that is set in one step once the base is whole, and readers take that
base and the deltas after it, so they see one state whatever ``compact`` is
doing.  It removes what the base before the new one had covered already: a
reader that has begun keeps its files until the next compaction but one, and
the folders hold the deltas of two compactions at most.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from wirebook.operators.fold import EVENT_TIME, merge_edges
from wirebook.schemas import EDGES

def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one the cluster names for shared files, ``spark.checkpoint.dir``.

    Where that is unset it lies in the warehouse, unless that is a folder of
    one machine and the executors are others.  It goes when the driver ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir", None)
        local = spark.sparkContext.master.startswith("local")
        if not root or not local and (root.startswith("file:") or "://" not in root):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{root.rstrip('/')}/wirebook-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is not None:
        folder = context._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


class Folder:
    """A folder of the cluster's file system, as its driver sees it."""

    def __init__(self, spark: SparkSession, path: str):
        context = spark.sparkContext
        self.path, self._paths = path, context._jvm.org.apache.hadoop.fs.Path
        self._fs = self._paths(path).getFileSystem(context._jsc.hadoopConfiguration())

    def names(self, inside: str) -> list[str]:
        """Entries of a folder below; none where there is no such folder."""
        folder = self._paths(f"{self.path}/{inside}" if inside else self.path)
        return [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []

    def has(self, inside: str) -> bool:
        return self._fs.exists(self._paths(f"{self.path}/{inside}"))

    def touch(self, inside: str) -> None:
        self._fs.create(self._paths(f"{self.path}/{inside}"), True).close()

    def remove(self, inside: str) -> None:
        self._fs.delete(self._paths(f"{self.path}/{inside}"), True)

    def numbers(self, inside: str, stem: str) -> list[int]:
        """Numbers of the entries named by a stem and a number, rising."""
        return sorted(int(n[len(stem) :]) for n in self.names(inside) if n.startswith(stem) and n[len(stem) :].isdigit())


#: Pointers; the highest number counts.
POINTER = "_current"


def current(folder: Folder) -> int:
    """Number of the current base, -1 where there is none yet."""
    return max(folder.numbers(POINTER, ""), default=-1)


def publish(folder: Folder, number: int) -> list[int]:
    """Make a base current, in one step; returns the pointers before it, the newest last."""
    before = [n for n in folder.numbers(POINTER, "") if n < number]
    folder.touch(f"{POINTER}/{number}")
    return before


def write_delta(edges: DataFrame, root: str, batch: int, kind: str = "delta") -> None:
    edges.write.mode("overwrite").parquet(f"{root}/kind={kind}/batch={batch}")


def _deltas(folder: Folder, after: int) -> list[int]:
    """Whole deltas after a batch; one that is being written has no mark yet."""
    found = [n for n in folder.numbers("kind=delta", "batch=") if n > after]
    return [n for n in found if folder.has(f"kind=delta/batch={n}/_SUCCESS")]


def _merged(spark: SparkSession, root: str, base: int, deltas: list[int]) -> DataFrame:
    paths = [f"{root}/kind=base/batch={base}"] if base >= 0 else []
    paths += [f"{root}/kind=delta/batch={n}" for n in deltas]
    if not paths:
        return spark.createDataFrame([], EDGES)
    return merge_edges(spark.read.schema(EDGES).parquet(*paths), mode=EVENT_TIME)


def read_edges(spark: SparkSession, root: str) -> DataFrame:
    """The edge table as of the last batch written."""
    folder = Folder(spark, root)
    base = current(folder)
    return _merged(spark, root, base, _deltas(folder, base))


def compact(spark: SparkSession, root: str) -> int:
    """Merge everything written so far into a new base; returns its batch, -1 if there is none."""
    folder = Folder(spark, root)
    base = current(folder)
    deltas = _deltas(folder, base)
    if not deltas:
        return base
    upto = deltas[-1]
    write_delta(_merged(spark, root, base, deltas), root, upto, kind="base")
    for old in publish(folder, upto):
        if old < base:
            folder.remove(f"{POINTER}/{old}")
    for n in folder.numbers("kind=base", "batch="):
        if n < base:
            folder.remove(f"kind=base/batch={n}")
    for n in folder.numbers("kind=delta", "batch="):
        if n <= base:
            folder.remove(f"kind=delta/batch={n}")
    return upto
