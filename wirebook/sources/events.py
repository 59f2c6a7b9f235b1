"""Event frames: the wide frame, its typed views and the normal form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirebook.schemas import EVENT_SCHEMAS, WIDE_EVENT


def of_type(events: DataFrame, log: str) -> DataFrame:
    """Typed columns of one kind of log (``modbus``, ``dnp3`` or ``conn``)."""
    return events.where(F.col("log") == log).select(*EVENT_SCHEMAS[log].names)


def union_events(**typed: DataFrame) -> DataFrame:
    """Typed frames (``modbus=…, dnp3=…, conn=…``) as one wide frame."""
    frames = [df.withColumn("log", F.lit(log)) for log, df in typed.items()]
    wide = frames[0]
    for df in frames[1:]:
        wide = wide.unionByName(df, allowMissingColumns=True)
    present = set(wide.columns)
    extra = [c for c in wide.columns if c not in WIDE_EVENT.names]
    return wide.select(
        *[
            F.col(f.name) if f.name in present else F.lit(None).cast(f.dataType).alias(f.name)
            for f in WIDE_EVENT
        ],
        *extra,
    )


def normalize(events: DataFrame) -> DataFrame:
    """Wide events to communications: who spoke to whom, how, and when.

    A flow record carries no function code and takes its service as the
    protocol, falling back to the transport when no service was recognised.
    ``ingest_seq``, where present, is kept for arrival-order folds.
    """
    log = F.col("log")
    service = F.when(F.col("service") != "", F.col("service"))
    return events.where(log.isin("modbus", "dnp3", "conn")).select(
        "ts",
        "orig_h",
        "resp_h",
        F.when(log == "conn", F.coalesce(service, F.col("proto"))).otherwise(log).alias("protocol"),
        F.col("resp_p").alias("port"),
        F.when(log == "modbus", F.col("func"))
        .when(log == "dnp3", F.col("fc_request"))
        .otherwise("flow")
        .alias("function_code"),
        *(["ingest_seq"] if "ingest_seq" in events.columns else []),
    )
