"""Benchmark passages inside documents, by winnowed word fingerprints.

Items and documents are both reduced to the smallest hash of ``GRAM``
consecutive words in each sliding group of hashes.  Two texts that share
``window`` consecutive words share the fingerprint of that span, so joining
fingerprints misses nothing; each join hit is then extended word by word to
both sides and counts if the shared run reaches the window.  Everything runs
on DataFrame functions.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirebook.sources.tables import shared_dir

WINDOW, GRAM = 10, 6
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Measured bytes of fingerprints with their words up to which all are sent to every executor; beyond it only their
#: hashes are, up to so many (of fixed width), and what they let through is joined by a shuffle.
BROADCAST_BYTES, BROADCAST_HASHES = 32 << 20, 2_000_000


def words(text: Column) -> Column:
    """A-Z lower-cased, then runs of digits, a-z and characters beyond ASCII."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, NOT_WORD), "")


MARKS = "array<struct<n:int,p:int,f:bigint>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for a row, however often it is used."""
    return F.get(F.transform(F.array(value), body), 0)


def _marks(hashes: Column, window: int, gram: int) -> Column:
    """(n, p, f): window length, word position and hash of each fingerprint.

    Of equal smallest hashes in a group the rightmost counts.  A group adds a
    fingerprint when it is the first, its smallest hash has changed, or the
    hash that enters it is as small.
    """
    wide = window - gram + 1

    def of_grams(g: Column) -> Column:
        groups = F.sequence(F.lit(0), F.size(g) - wide)
        least = F.transform(groups, lambda i: F.least(*[F.get(g, i + j) for j in range(wide)])) if wide > 1 else g
        return _let(least, lambda f: of_least(g, f))

    def of_least(g: Column, f: Column) -> Column:
        def fresh(i: Column) -> Column:
            return (i == 0) | (F.get(f, i) != F.get(f, i - 1)) | (F.get(g, i + wide - 1) == F.get(f, i))

        def mark(i: Column) -> Column:
            back = F.array_position(F.reverse(F.slice(g, i + 1, wide)), F.get(f, i)).cast("int")
            return F.struct(F.lit(window).alias("n"), (i + wide - back).alias("p"), F.get(f, i).alias("f"))

        return F.transform(F.filter(F.sequence(F.lit(0), F.size(f) - 1), fresh), mark)

    each = F.sequence(F.lit(0), F.size(hashes) - gram)
    grams = F.transform(each, lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(gram)]))
    return F.when(F.size(hashes) >= window, _let(grams, of_grams)).otherwise(F.array().cast(MARKS))


def _marked(text: Column, specs: list[tuple[int, int]]) -> Column:
    """An array of one struct: the words, and the fingerprints for every (window, gram).

    It is exploded, not projected, so that later steps do not compute it again.
    """

    def of_words(w: Column) -> Column:
        hashes = F.transform(w, lambda x: F.xxhash64(x))
        marks = _let(hashes, lambda h: F.concat(F.array().cast(MARKS), *[_marks(h, n, gram) for n, gram in specs]))
        return F.struct(w.alias("words"), marks.alias("marks"))

    return F.transform(F.array(words(text)), of_words)


def _sides(p: Column, n: Column) -> list[Column]:
    """Words before a fingerprint, nearest first, and those from it on: as far as a window with it reaches."""
    reach = F.when(n == WINDOW, F.lit(WINDOW - GRAM)).otherwise(F.lit(0))
    size = F.least(p, reach)
    return [F.reverse(F.slice("words", p - size + 1, size)), F.slice("words", p + 1, n)]


def _same(a: str, b: str) -> Column:
    """How many words agree before the first that doesn't."""
    differ = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differ > 0, differ - 1).otherwise(F.size(a)).cast("int")


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    item_id: str = "item_id",
    text: str = "text",
    keep: list[str] | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    broadcast_hashes: int = BROADCAST_HASHES,
) -> DataFrame:
    """Every row of ``docs`` as ``row`` (a struct of its columns, or of ``keep``) with its hits.

    Adds n_words, n_hit (words inside an occurrence of a window of some item),
    n_items, items_sha256 (of the sorted ids, comma-joined) and contaminated.
    An item with fewer words than a window is one window; items without words
    occur nowhere; ids that repeat are one item, a null id is the item "null".
    Null and empty documents have no words.  Rows that repeat get a result
    each.  If either table is empty nothing is hit.
    """
    spark = docs.sparkSession
    root = shared_dir(spark)
    items = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.col(text).alias("text")
    ).withColumn("length", F.least(F.size(words(F.col("text"))), F.lit(WINDOW)))
    # At most WINDOW different lengths.
    lengths = sorted(r.length for r in items.where("length > 0").select("length").distinct().collect())
    specs = [(n, GRAM if n == WINDOW else n) for n in lengths]
    prints = spark.createDataFrame([], "item string, n int, f bigint, left_i array<string>, right_i array<string>")
    for spec in specs:
        part = items.where(F.col("length") == spec[0]).select("item", F.explode(_marked(F.col("text"), [spec])).alias("x"))
        part = part.select("item", "x.words", F.explode("x.marks").alias("m"))
        left, right = _sides(F.col("m.p"), F.col("m.n"))
        prints = prints.unionByName(
            part.select("item", "m.n", "m.f", left.alias("left_i"), right.alias("right_i")).distinct()
        )
    prints.write.parquet(f"{root}/prints")
    prints = spark.read.schema(prints.schema).parquet(f"{root}/prints")

    rows = docs.select(F.struct(*[docs[c] for c in keep or docs.columns]).alias("row"), docs[text].alias("text"))
    rows = rows.withColumn("row_id", F.monotonically_increasing_id())
    rows = rows.select("row", "row_id", F.explode(_marked(F.col("text"), specs)).alias("x"))
    # The first mark of every row stands for the row itself.
    self_ = F.array(F.struct(F.lit(0).alias("n"), F.lit(-1).alias("p"), F.lit(0).cast("bigint").alias("f")))
    rows = rows.select("row", "row_id", "x.words", F.explode(F.concat(self_, "x.marks")).alias("m"))
    rows = rows.select("row", "row_id", "words", "m.n", "m.p", "m.f")
    kept = F.when(F.col("p") < 0, F.col("row")).alias("row")
    left, right = (c.alias(a) for c, a in zip(_sides(F.col("p"), F.col("n")), ("left_d", "right_d"), strict=True))
    narrow = ["row_id", F.when(F.col("p") < 0, F.size("words")).alias("n_words"), kept, "n", "p", "f"]
    sides = [F.when(F.col("p") >= 0, c).alias(a) for c, a in ((left, "left_d"), (right, "right_d"))]
    size = F.length("item") + 96
    for side in ("left_i", "right_i"):
        size = size + F.octet_length(F.array_join(side, "")) + 24 * F.size(side)

    def put(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    if (prints.agg(F.sum(size).alias("size")).first().size or 0) <= broadcast_bytes:
        met = rows.join(F.broadcast(prints), ["n", "f"], "left").where("p < 0 OR item IS NOT NULL")
        met = put(met.select(*narrow, *sides, "item", "left_i", "right_i"), "met")
    else:
        # Hashes first: words travel only with fingerprints that some item has.
        hashes = put(prints.select("n", "f").distinct(), "hashes").withColumn("known", F.lit(True))
        if hashes.count() <= broadcast_hashes:
            rows = rows.join(F.broadcast(hashes), ["n", "f"], "left").where("p < 0 OR known")
        near = put(rows.select(*narrow, *sides), "near")
        met = near.where("p >= 0").join(prints, ["n", "f"]).unionByName(near.where("p < 0"), allowMissingColumns=True)

    runs = (
        met.where("p >= 0")
        .withColumn("a", _same("left_d", "left_i"))
        .withColumn("b", _same("right_d", "right_i"))
        .where("a + b >= n")
        .select("row_id", "item", (F.col("p") - F.col("a")).alias("start"), (F.col("p") + F.col("b")).alias("stop"))
    )
    found = runs.groupBy("row_id").agg(F.array_join(F.sort_array(F.collect_set("item")), ",").alias("ids"), F.count_distinct("item").alias("n_items"))
    reach = Window.partitionBy("row_id").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    spans = runs.select("row_id", "start", "stop").distinct()
    spans = spans.withColumn("from", F.greatest("start", F.coalesce(F.max("stop").over(reach), F.lit(0))))
    hit = spans.groupBy("row_id").agg(F.sum(F.greatest(F.col("stop") - F.col("from"), F.lit(0))).alias("n_hit"))
    own = met.where("p < 0").select("row_id", "row", "n_words")
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("bigint")
    return (
        own.join(hit, "row_id", "left")
        .join(found, "row_id", "left")
        .select(
            "row",
            F.col("n_words").cast("bigint").alias("n_words"),
            n_hit.alias("n_hit"),
            F.coalesce(F.col("n_items"), F.lit(0)).alias("n_items"),
            F.sha2(F.coalesce(F.col("ids"), F.lit("")), 256).alias("items_sha256"),
            (n_hit > 0).alias("contaminated"),
        )
    )
