"""Events as topic messages: encoding, sinks, decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirebook import catalog
from wirebook.functions import casts
from wirebook.functions.literals import all_of
from wirebook.functions.once import compute_once
from wirebook.schemas import EVENT_SCHEMAS, REQUIRED, WIDE_EVENT


MESSAGES = "key string, value string, seq bigint, topic string"


def topics(prefix: str = "") -> list[str]:
    return [f"{prefix}{catalog.TOPIC_STEM}{log}" for log in catalog.LOG_TYPES]


def topic_of(log: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix + catalog.TOPIC_STEM), log)


def _json(log: str) -> Column:
    columns = [casts.iso_utc(F.col(c)).alias(c) if c == "ts" else F.col(c) for c in EVENT_SCHEMAS[log].names]
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def to_messages(events: DataFrame, prefix: str = "", sequence: str | None = None) -> DataFrame:
    """Wide events to (topic, key, value).

    The key names the channel.  ``sequence`` names a column that orders the
    events; it travels as ``seq``, so that a channel written by several tasks
    can be put in order again.
    """
    order = [F.col(sequence).alias("seq")] if sequence else []
    log = F.col("log")
    value = F.lit(None).cast("string")
    for kind in catalog.LOG_TYPES:
        value = F.when(log == kind, _json(kind)).otherwise(value)
    return events.where(log.isin(*catalog.LOG_TYPES)).select(
        topic_of(log, prefix).alias("topic"),
        F.concat_ws(":", "orig_h", "resp_h").alias("key"),
        value.alias("value"),
        *order,
    )


#: Messages that a task puts in order, about.
TASK_ROWS = 250_000


def _in_order(messages: DataFrame, partitions: int | None = None) -> DataFrame:
    """Messages by channel and place in it, over as many tasks as a channel's rows need.

    Without a ``seq`` a channel has no order and its rows are dealt by value.
    Without ``partitions`` the messages are counted, so that a task's rows do not grow with the table.
    """
    place = F.col("seq") if "seq" in messages.columns else F.xxhash64("value")
    by = [F.col("topic"), F.col("key"), place]
    partitions = partitions or max(1, -(-messages.count() // TASK_ROWS))
    return messages.repartitionByRange(partitions, *by).sortWithinPartitions(*by)


def write_messages(messages: DataFrame, path: str, fmt: str = "parquet", partitions: int | None = None) -> None:
    """File sink with the columns of a topic.

    Ranges of channel and ``seq`` go to a task each, so that a busy channel is
    written by as many tasks as its share of the rows asks for, every file
    keeps the order of its channels, and a channel's files follow each other.
    """
    _in_order(messages, partitions).write.mode("append").partitionBy("topic").format(fmt).save(path)


def read_messages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Messages of a file sink in order: a channel's rows rise in ``seq`` inside a task and from one task to the next."""
    return _in_order(spark.read.schema(MESSAGES).format(fmt).load(path))


def _text_schema(log: str) -> str:
    return ", ".join(
        f"{f.name} {'array<string>' if f.dataType.simpleString() == 'array<string>' else 'string'}"
        for f in EVENT_SCHEMAS[log]
    )


def decode_messages(messages: DataFrame, prefix: str = "") -> DataFrame:
    """Messages to wide events, with ``reason`` where one is no event.

    Every field is read as text and then converted, so that a port may come as
    a number or as a string.  Columns of the input other than topic and value
    are kept.
    """
    kept = [c for c in messages.columns if c not in ("topic", "value")]
    # Bytes from a broker are checked before they are taken for text.
    raw = F.col("value").cast("binary")
    text = F.try_validate_utf8(raw.cast("string"))
    base = F.when(F.col("topic").startswith(prefix), F.expr(f"substring(topic, {len(prefix) + 1})")).otherwise(
        F.col("topic")
    )
    log = F.regexp_extract(base, r"^raw\.(modbus|dnp3|conn)$", 1)
    rows = messages.select(*kept, "topic", text.alias("value"), log.alias("log"))
    rows = compute_once(
        rows,
        **{
            kind: F.when(F.col("log") == kind, F.from_json("value", _text_schema(kind)))
            for kind in catalog.LOG_TYPES
        },
    )
    checked = {name: _converted(name, kind) for name, kind in (("ts", ""), ("orig_p", "port"), ("resp_p", "port"))}
    rows = compute_once(rows, **checked)
    columns = [
        (F.col(f.name) if f.name in checked else _converted(f.name, f.dataType.simpleString())).alias(f.name)
        for f in WIDE_EVENT.fields[1:]
    ]
    # A required field may be null but not absent.  Telling these apart takes a
    # second look at the text, which only messages with a null are given.
    full, complete = F.lit(False), F.lit(False)
    for kind in catalog.LOG_TYPES:
        mine = F.col("log") == kind
        full = F.when(mine, all_of([F.col(kind)[c].isNotNull() for c in REQUIRED[kind]])).otherwise(full)
        listed = F.array(*[F.lit(c) for c in REQUIRED[kind]])
        complete = F.when(mine, F.size(F.array_except(listed, F.col("keys"))) == 0).otherwise(complete)
    rows = compute_once(rows, full=full)
    rows = compute_once(rows, keys=F.when(~F.col("full"), F.json_object_keys("value")))
    bad = F.col("ts").isNull() | F.col("orig_p").isNull() | F.col("resp_p").isNull()
    reason = (
        F.when(F.col("value").isNull(), "bad_encoding")
        .when(F.col("log") == "", "unknown_topic")
        .when(~F.col("full") & F.col("keys").isNull(), "bad_json")
        .when(~F.col("full") & ~complete, "missing_field")
        .when(bad, "bad_value")
    )
    return rows.select(*kept, "topic", "value", "log", *columns, reason.alias("reason"))


def _converted(name: str, kind: str) -> Column:
    text = F.coalesce(*[F.col(log)[name] for log in catalog.LOG_TYPES if name in EVENT_SCHEMAS[log].names])
    if name == "ts":
        return casts.parse_iso_ts(text)
    if kind == "port":
        # A number with a fraction of zero is taken too.
        return casts.to_int(F.regexp_replace(text, r"^(\s*[+-]?\d+)\.0*\s*$", "$1"), kind="int")
    if kind in ("int", "bigint"):
        return casts.to_int(text, kind=kind)
    if kind == "double":
        return casts.to_float(text)
    if kind == "boolean":
        return text.try_cast("boolean")
    return text


def good(decoded: DataFrame) -> DataFrame:
    kept = [c for c in decoded.columns if c not in ("topic", "value", "reason", *WIDE_EVENT.names)]
    return decoded.where("reason IS NULL").select(*WIDE_EVENT.names, *kept)


def dead_letters(decoded: DataFrame) -> DataFrame:
    return decoded.where("reason IS NOT NULL").select("topic", "value", "reason")


def kafka_options(servers: str, prefix: str = "") -> dict[str, str]:
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": ",".join(topics(prefix)),
        "startingOffsets": "earliest",
        "failOnDataLoss": "false",
    }


def read_kafka_stream(spark, servers: str, prefix: str = "") -> DataFrame:
    """Stream of the three topics; needs the Kafka connector on the classpath."""
    return spark.readStream.format("kafka").options(**kafka_options(servers, prefix)).load()


def write_kafka(messages: DataFrame, servers: str) -> None:
    messages.write.format("kafka").option("kafka.bootstrap.servers", servers).save()


def read_file_stream(spark, path: str) -> DataFrame:
    """Stream over the files of ``write_messages``; ``seq`` is null where messages carry none."""
    return spark.readStream.schema(MESSAGES).parquet(path)
