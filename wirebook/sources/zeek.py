"""Zeek ASCII logs to event frames.

A Zeek log names its columns, separators and sentinels in directives at the
top of the file, so every line has to be read against the header of its own
file.  Files are read line by line, so that one log can be split over many
tasks.  Their headers are one small row per file; up to a measured size they
are sent to every task, so that no line is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirebook import catalog
from wirebook.functions import casts
from wirebook.functions.literals import all_of
from wirebook.functions.once import compute_once
from wirebook.schemas import EVENT_SCHEMAS, WIDE_EVENT
from wirebook.sources.tables import shared_dir

#: Measured size up to which the files' headers are broadcast; beyond it lines and headers meet by a shuffle.
BROADCAST_BYTES = 64 << 20

# Where a column's name in the log differs from ours.
_LOG_NAME = {"orig_h": "id.orig_h", "orig_p": "id.orig_p", "resp_h": "id.resp_h", "resp_p": "id.resp_p"}
_COLUMNS = [name for name in WIDE_EVENT.names if name != "log"]
_DIRECTIVES = ["separator", "set_separator", "empty_field", "unset_field", "path", "fields"]


@dataclass(frozen=True)
class ZeekLogs:
    """Parsed lines; ``events`` and ``rejected`` are two views of them."""

    parsed: DataFrame

    @property
    def events(self) -> DataFrame:
        """Wide event frame with ``ingest_seq``, the order of arrival."""
        return self.parsed.where("reason IS NULL").select(*WIDE_EVENT.names, "ingest_seq")

    @property
    def rejected(self) -> DataFrame:
        """Lines that are not records: file, line and the reason."""
        return self.parsed.where("reason IS NOT NULL").select("file", "log", "line", "reason")


def read_zeek(
    spark: SparkSession,
    directory: str,
    log_names: tuple[str, ...] = catalog.LOG_NAMES,
) -> ZeekLogs:
    """Read every log of the given names below ``directory``.

    A missing directory reads as empty.  The order of lines relies on
    ``spark.sql.files.maxPartitionBytes`` staying fixed while the query runs.
    """
    files = _scan(spark, directory, log_names)
    if files is None:
        return parse_lines(catalog.local_frame(spark, [], "file string, log_rank int, line_no bigint, line string"))
    # Blocks of one file start at least 64 KiB apart, rows are numbered within
    # a task below 2**33: together they order the lines of a file in a long.
    block = F.shiftleft(F.shiftright(F.col("_metadata.file_block_start"), 16), 33)
    position = block.bitwiseOR(F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    return parse_lines(files.select("file", "log_rank", position.alias("line_no"), F.col("value").alias("line")))


def parse_lines(lines: DataFrame) -> ZeekLogs:
    """Parse lines that are already rows: file, log_rank, line_no, line."""
    return ZeekLogs(_records(_split_files(lines)))


def _scan(spark: SparkSession, directory: str, log_names: tuple[str, ...]) -> DataFrame | None:
    reader = spark.read.option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "{" + ",".join(log_names) + "}"
    )
    try:
        files = reader.text(directory)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    path = F.col("_metadata.file_path")
    rank = F.lit(len(log_names))
    for i, name in reversed(list(enumerate(log_names))):
        rank = F.when(F.col("_metadata.file_name").rlike("^" + _glob_pattern(name) + "$"), i).otherwise(rank)
    return files.select("value", "_metadata", path.alias("file"), rank.alias("log_rank"))


def _glob_pattern(name: str) -> str:
    return name.replace(".", "\\.").replace("*", ".*").replace("?", ".")


def _split_files(lines: DataFrame) -> DataFrame:
    """Rows (file, log_rank, line_no, line, h) out of single lines.

    One pass over the lines notes, per file, the directives and where data
    begins; data lines become a row per file and task before the shuffle.
    What a file's directives above its data say follows from these notes
    alone.  They and the headers are written, so that the lines are not read
    for them again and the headers' size is known when they are joined.
    """
    spark, root = lines.sparkSession, shared_dir(lines.sparkSession)

    def put(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{root}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{root}/{name}")

    known = "|".join([*_DIRECTIVES, "close"])
    wanted = F.col("line").rlike(f"^(?:[^#]|$|#(?:{known}))")
    directive = F.when(F.col("line").startswith("#"), F.struct("line_no", "line"))
    notes = lines.where(wanted).groupBy("file", directive.alias("said")).agg(F.min("line_no").alias("line_no"))
    notes = put(notes, "notes")
    begin = notes.where("said IS NULL").select("file", F.col("line_no").alias("begin"))
    line, above = F.col("said.line"), F.col("line_no") < F.col("begin")
    header = (
        notes.where("said IS NOT NULL")
        .join(begin, "file")
        .groupBy("file", "begin")
        .agg(
            F.min(F.when(line.startswith("#close") & ~above, F.col("line_no"))).alias("stop"),
            *[F.max_by(line, F.when(above & line.startswith("#" + d), F.col("line_no"))).alias(d) for d in _DIRECTIVES],
        )
    )
    header = put(_with_header(header).where(_readable()).select("file", "begin", "stop", "h"), "headers")
    # A header is the text of its separators and some hundred bytes of numbers.
    size = F.length("file") + F.length(F.to_json("h")) + 64
    if (header.agg(F.sum(size).alias("size")).first().size or 0) <= BROADCAST_BYTES:
        header = F.broadcast(header)
    inside = (F.col("line_no") >= F.col("begin")) & (F.col("stop").isNull() | (F.col("line_no") < F.col("stop")))
    return lines.join(header, "file").where(inside).select("file", "log_rank", "line_no", "line", "h")


def _with_header(files: DataFrame) -> DataFrame:
    """Replace the directive lines by a header struct with column positions."""
    raw = F.regexp_extract("separator", r"^\S+\s+(.*)$", 1)
    separator = (
        F.when(raw.rlike(r"^\\x[0-9A-Fa-f]{2}$"), F.char(F.conv(F.substring(raw, 3, 2), 16, 10).cast("bigint")))
        .when((raw == "") | (raw == "\\t") | raw.isNull(), F.lit("\t"))
        .otherwise(raw)
    )
    files = compute_once(files, separator=separator)

    def setting(name: str, default: str) -> Column:
        value = F.get(casts.split_literal(F.col(name), F.col("separator"), 2), F.lit(1))
        return F.coalesce(value, F.lit(default))

    files = compute_once(
        files,
        set_separator=setting("set_separator", ","),
        empty_field=setting("empty_field", "(empty)"),
        unset_field=setting("unset_field", "-"),
        path=setting("path", ""),
        fields=casts.split_literal(F.col("fields"), F.col("separator")),
    )
    at = {c: F.array_position("fields", F.lit(_LOG_NAME.get(c, c))) for c in _COLUMNS}
    complete = F.lit(False)
    for log, schema in EVENT_SCHEMAS.items():
        complete = F.when(F.col("path") == log, all_of([at[c] > 0 for c in schema.names])).otherwise(complete)
    return compute_once(
        files,
        h=F.struct(
            F.col("separator"),
            F.col("set_separator"),
            F.col("empty_field").alias("empty"),
            F.col("unset_field").alias("unset"),
            F.col("path").alias("log"),
            (F.size("fields") - 1).alias("n_fields"),
            complete.alias("complete"),
            # The directive's own name is the first item, so position 2 is value 0.
            F.struct(*[(at[c] - 2).cast("int").alias(c) for c in _COLUMNS]).alias("at"),
        ),
    ).drop(*_DIRECTIVES)


def _readable() -> Column:
    return F.col("h.log").isin(*catalog.LOG_TYPES) & (F.col("h.n_fields") > 0)


def _records(rows: DataFrame) -> DataFrame:
    """Convert the fields of every line and say why a line is rejected."""
    rows = rows.where(~F.col("line").startswith("#") & (F.trim("line") != ""))
    rows = compute_once(rows, values=casts.split_literal(F.col("line"), F.col("h.separator")))
    unset = F.col("h.unset")

    def raw(name: str) -> Column:
        return F.get("values", F.col(f"h.at.{name}"))

    rows = compute_once(
        rows,
        ts=casts.to_ts(raw("ts")),
        orig_p=casts.to_int(raw("orig_p"), kind="int"),
        resp_p=casts.to_int(raw("resp_p"), kind="int"),
    )
    kept_as_is = {"uid", "orig_h", "resp_h", "func", "fc_request", "proto", "conn_state"}
    columns = []
    for field in WIDE_EVENT.fields[1:]:
        name, kind = field.name, field.dataType.simpleString()
        if name in ("ts", "orig_p", "resp_p"):
            column = F.col(name)
        elif name in kept_as_is:
            column = raw(name)
        elif kind == "bigint":
            column = casts.to_int(raw(name), unset)
        elif kind == "double":
            column = casts.to_float(raw(name), unset)
        elif kind == "boolean":
            column = casts.to_bool(raw(name), unset)
        elif kind == "array<string>":
            column = casts.to_set(raw(name), unset, F.col("h.empty"), F.col("h.set_separator"))
        else:
            column = casts.to_optional_str(raw(name), unset)
        columns.append(column.alias(name))

    reason = (
        F.when(F.size("values") != F.col("h.n_fields"), "field_count")
        .when(~F.col("h.complete"), "missing_field")
        .when(F.col("ts").isNull() | F.col("orig_p").isNull() | F.col("resp_p").isNull(), "bad_value")
    )
    # Paths are ordered component by component, so "/" sorts before all else.
    arrival = F.struct(
        F.col("log_rank"), F.translate("file", "/", "\u0001").alias("path"), F.col("line_no")
    )
    return rows.select(
        "file", F.col("h.log").alias("log"), "line", reason.alias("reason"), arrival.alias("ingest_seq"), *columns
    )
