"""Process signatures: ordered steps looked for in a device's edges.

A signature matches greedily: its first step takes the first edge that fits,
the next step the first later edge that fits, and so on; a step without an
edge ends the match.  What a stretch of edges does to a match is thus a small
table: for every number of steps matched before it, the number matched after
it.  Such tables are made for stretches of bounded length and put together in
order, so the edges of a device never have to come together in one task,
however many they are, and a device with few edges costs one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirebook import catalog

#: Edges of a stretch, as a power of two.
STRETCH_BITS = 10
_PLACE = ["first_seen", "protocol", "function_code", "dst_ip", "port"]


def device_sequences(edges: DataFrame) -> DataFrame:
    """Outbound edges that have a function code, per device in order.

    The result is sorted over all devices; ties in time are broken by the
    rest of the edge key.
    """
    return _observed(edges).orderBy("ip", *_PLACE).select("ip", *_PLACE)


def _observed(edges: DataFrame) -> DataFrame:
    protocol = F.coalesce(F.when(F.col("protocol") != "", F.col("protocol")), F.lit("unknown"))
    return edges.where(F.col("function_code").isNotNull()).select(
        F.col("src_ip").alias("ip"), "first_seen", protocol.alias("protocol"), "function_code", "dst_ip", "port"
    )


def step_matches(step: catalog.Step, protocol: Column, function_code: Column) -> Column:
    """Whether an observation fits a step; no codes listed means any code."""
    same = F.lower(protocol) == step.protocol.lower()
    if not step.function_codes:
        return same
    return same & F.upper(function_code).isin([c.upper() for c in step.function_codes])


def _fits(signatures: list[catalog.Signature]) -> Column:
    """Per signature the steps that an edge fits, a bit for each."""
    masks = []
    for s in signatures:
        mask = F.lit(0).cast("bigint")
        for k, step in enumerate(s.steps):
            fits = step_matches(step, F.col("protocol"), F.col("function_code"))
            mask = mask + F.when(fits, F.lit(1 << k).cast("bigint")).otherwise(0)
        masks.append(mask)
    return F.array(*masks)


def _put_together(tables: Column, start: Column) -> Column:
    """One table out of several in order: what the next makes of where the one before ends."""

    def follow(before: Column, after: Column) -> Column:
        return F.transform(before, lambda ends, i: F.transform(ends, lambda e: F.get(F.get(after, i), e)))

    return F.aggregate(tables, start, follow)


def _progress(observed: DataFrame, signatures: list[catalog.Signature], stretch_bits: int) -> DataFrame:
    """(ip, table): steps matched by all edges of a device, for each signature and number of steps before.

    Edges are ordered by a range shuffle and numbered inside a task, which
    gives stretches; then the stretches of a task, then the tasks of a device
    are put together.
    """
    fitting = observed.withColumn("fits", _fits(signatures)).where(F.exists("fits", lambda m: m > 0))
    ordered = fitting.repartitionByRange("ip", *_PLACE).sortWithinPartitions("ip", *_PLACE)
    numbered = ordered.select("ip", "fits", F.monotonically_increasing_id().alias("at"))
    start = F.array(*[F.array(*[F.lit(k) for k in range(len(s.steps) + 1)]) for s in signatures])

    def step(before: Column, edge: Column) -> Column:
        def on(ends: Column, i: Column) -> Column:
            mask = F.get(edge["fits"], i)
            return F.transform(ends, lambda e: e + F.getbit(mask, e).cast("int"))

        return F.transform(before, on)

    # Numbers start anew with each task, at a multiple of any stretch.
    stretch, task = F.shiftright("at", stretch_bits), F.shiftright("at", 33 - stretch_bits)
    edges = F.sort_array(F.collect_list(F.struct("at", "fits")))
    tables = numbered.groupBy("ip", stretch.alias("at")).agg(F.aggregate(edges, start, step).alias("table"))
    for group in ([task.alias("task")], []):
        parts = F.sort_array(F.collect_list(F.struct("at", "table")))
        whole = _put_together(F.transform(parts, lambda x: x["table"]), start)
        tables = tables.groupBy("ip", *group).agg(F.min("at").alias("at"), whole.alias("table")).select("ip", "at", "table")
    return tables.select("ip", "table")


def match_signatures(
    edges: DataFrame,
    signatures: list[catalog.Signature] | None = None,
    partial: bool = True,
    min_score: float = catalog.PARTIAL_MATCH_SCORE,
    stretch_bits: int = STRETCH_BITS,
) -> DataFrame:
    """Signatures that devices match in full, or in part with ``partial``.

    Columns: ip, signature_name, signature_idx, full_match, matched, n_steps,
    score.  A signature has 62 steps at most.
    """
    signatures = catalog.SIGNATURES if signatures is None else signatures
    observed = _observed(edges)
    if max((len(s.steps) for s in signatures), default=0) > 62:
        raise ValueError("a signature has 62 steps at most")
    if not any(s.steps for s in signatures):
        found = catalog.local_frame(edges.sparkSession, [], "ip string, signature int, matched int")
    else:
        tables = _progress(observed, signatures, stretch_bits).select("ip", F.posexplode("table").alias("signature", "ends"))
        found = tables.select("ip", "signature", F.get("ends", F.lit(0)).alias("matched")).where("matched > 0")
    if partial and min_score <= 0:
        # Only then do devices without a single fitting edge count as well.
        every = observed.select("ip").distinct().select(
            "ip", F.explode(F.sequence(F.lit(0), F.lit(len(signatures) - 1))).alias("signature")
        )
        found = every.join(found, ["ip", "signature"], "left").select(
            "ip", "signature", F.coalesce("matched", F.lit(0)).alias("matched")
        )
    names = F.array(*[F.lit(s.name) for s in signatures])
    counts = F.array(*[F.lit(len(s.steps)) for s in signatures])
    scored = found.select(
        "ip",
        F.get(names, F.col("signature")).alias("signature_name"),
        F.col("signature").alias("signature_idx"),
        "matched",
        F.get(counts, F.col("signature")).alias("n_steps"),
    ).select(
        "*",
        (F.col("n_steps") > 0).alias("_real"),
        F.coalesce(F.try_divide(F.col("matched"), F.col("n_steps")), F.lit(0.0)).alias("score"),
    )
    full = F.col("_real") & (F.col("matched") == F.col("n_steps"))
    keep = full | (F.col("score") >= min_score) if partial else full
    return scored.where(keep).select(
        "ip", "signature_name", "signature_idx", full.alias("full_match"), "matched", "n_steps", "score"
    )


def score_matches(
    matches: DataFrame,
    threshold: float = catalog.DEVIATION_THRESHOLD,
    known: list[catalog.Signature] | None = None,
) -> DataFrame:
    """Deviation of each match from its signature.

    Step counts come from ``known`` signatures, the catalogue by default; a
    signature that is not among them counts zero steps.
    """
    known = catalog.SIGNATURES if known is None else known
    expected = F.lit(0)
    for s in known:
        expected = F.when(F.col("signature_name") == s.name, len(s.steps)).otherwise(expected)
    scored = matches.select(
        "ip",
        "signature_name",
        "signature_idx",
        "full_match",
        expected.alias("expected_steps"),
        F.bround(F.col("score") * expected, 0).cast("int").alias("matched_steps"),
        "score",
        (1.0 - F.col("score")).alias("deviation"),
    ).withColumn("flagged", F.col("deviation") > threshold)
    percent = F.bround(F.col("deviation") * 100, 0).cast("int").cast("string")
    steps = F.concat(F.col("matched_steps").cast("string"), F.lit("/"), F.col("expected_steps").cast("string"))
    return scored.select(
        "ip",
        "signature_name",
        "signature_idx",
        "expected_steps",
        "matched_steps",
        "score",
        "deviation",
        "flagged",
        F.when(
            F.col("full_match"),
            F.concat(F.lit("Full match: all "), F.col("expected_steps").cast("string"), F.lit(" steps matched.")),
        )
        .when(
            F.col("flagged"),
            F.concat(F.lit("Partial match: "), steps, F.lit(" steps matched (deviation="), percent, F.lit("%).")),
        )
        .otherwise(F.concat(F.lit("Acceptable match: "), steps, F.lit(" steps (deviation="), percent, F.lit("%).")))
        .alias("detail"),
    )


def process_deviations(
    edges: DataFrame,
    signatures: list[catalog.Signature] | None = None,
    threshold: float = catalog.DEVIATION_THRESHOLD,
    min_score: float = catalog.PARTIAL_MATCH_SCORE,
    known: list[catalog.Signature] | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Flagged deviations of all devices."""
    matches = match_signatures(edges, signatures, partial=True, min_score=min_score)
    found = score_matches(matches, threshold, known).where("flagged")
    if ordered:
        found = found.orderBy("ip", F.desc("deviation"), "signature_idx")
    return found.drop("signature_idx")
