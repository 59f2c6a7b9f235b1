"""Field conversions for Zeek text and JSON messages.

A conversion that cannot succeed gives null instead of raising, so one bad
value never fails a task; the callers decide whether null means "reject".
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Years 1 to 9999, the range a timestamp is accepted in.
_MIN_EPOCH, _MAX_EPOCH = -62135596800, 253402300799


def to_optional_str(value: Column, unset: Column) -> Column:
    return F.when(value != unset, value)


def to_ts(value: Column) -> Column:
    """Epoch seconds as text to a timestamp with microseconds."""
    seconds = F.trim(value).try_cast("decimal(20,6)")
    micros = (seconds * 1000000).cast("bigint")
    return F.when(seconds.between(_MIN_EPOCH, _MAX_EPOCH), F.timestamp_micros(micros))


def to_int(value: Column, unset: Column | None = None, kind: str = "bigint") -> Column:
    # The cast takes surrounding blanks and a sign, and nothing after the digits.
    number = value.try_cast(kind)
    return number if unset is None else F.when(value != unset, number)


def to_float(value: Column, unset: Column | None = None) -> Column:
    # Java numbers may be hexadecimal or end in a type letter ("1.0d"); those
    # are not numbers in a log, but "inf" is.
    text = F.lower(F.trim(value))
    typed = F.substring(text, -1, 1).isin("d", "f") & ~text.endswith("inf")
    number = F.when(~typed & ~text.contains("x"), value.try_cast("double"))
    return number if unset is None else F.when(value != unset, number)


def to_bool(value: Column, unset: Column) -> Column:
    return F.when(value != unset, value == "T")


def to_set(value: Column, unset: Column, empty: Column, separator: Column) -> Column:
    items = F.when(value == empty, F.array().cast("array<string>")).otherwise(split_literal(value, separator))
    return F.when(value != unset, items)


def split_literal(value: Column, separator: Column, limit: int = -1) -> Column:
    """Split on the separator as plain text, not as a pattern."""
    return F.split(value, F.concat(F.lit("\\Q"), separator, F.lit("\\E")), limit)


def parse_iso_ts(value: Column) -> Column:
    """ISO-8601 text to a timestamp; text without an offset is UTC."""
    has_offset = value.rlike(r"(?i)(z|[+-]\d{2}:?\d{2}(:\d{2})?)$") & value.contains(":")
    has_time = value.contains(":")
    utc = F.when(has_offset, value).when(has_time, F.concat(value, F.lit("Z"))).otherwise(
        F.concat(value, F.lit("T00:00:00Z"))
    )
    return utc.try_cast("timestamp")


def iso_utc(ts: Column) -> Column:
    """ISO-8601 text with offset; the fraction is left out when it is zero."""
    # Formatting the seconds by hand keeps the text UTC in any session zone.
    micros = F.unix_micros(ts)
    seconds = F.floor(micros / 1000000).cast("bigint")
    fraction = F.pmod(micros, F.lit(1000000))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
    of_day = F.pmod(seconds, F.lit(86400))

    def two(number: Column) -> Column:
        return F.lpad(number.cast("int").cast("string"), 2, "0")

    return F.concat(
        day.cast("string"),
        F.lit("T"),
        two(F.floor(of_day / 3600)),
        F.lit(":"),
        two(F.floor(of_day % 3600 / 60)),
        F.lit(":"),
        two(of_day % 60),
        F.when(fraction != 0, F.concat(F.lit("."), F.lpad(fraction.cast("string"), 6, "0"))).otherwise(""),
        F.lit("+00:00"),
    )
