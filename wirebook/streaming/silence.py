"""Silence on the clock: a device alerts because time passes, not because an event comes.

Every sender keeps the time it was last seen, and a processing-time timer for
the moment at which it will have been quiet for its threshold.  An event puts
the timer off; a timer that runs out gives an alert and is set again for the
next severity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import timezone

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wirebook import catalog
from wirebook.operators.coverage import SEVERITIES, threshold_for_role

ALERTS = "ip string, role string, last_seen timestamp, alert_at timestamp, silent_for_s double, threshold_s double, severity string"
STATE = "last_us bigint, role string, threshold_s double, level int"
SENDERS = "ip string, last_us bigint"


@dataclass(frozen=True)
class Clock:
    """Event time by the cluster's clock.

    ``event_us`` is what it was, or will be, in the events when the clock
    shows ``clock_ms``; ``speed`` is how fast it goes on, 0 to stop.  The
    default is a live stream: both are the same.
    """

    event_us: int = 0
    clock_ms: int = 0
    speed: float = 1.0

    def event_at(self, clock_ms: int) -> float:
        return self.event_us + (clock_ms - self.clock_ms) * 1000 * self.speed

    def clock_at(self, event_us: float) -> int | None:
        """When the clock will show a time of the events; None for never."""
        if self.speed == 0:
            return 0 if event_us <= self.event_us else None
        return math.ceil(self.clock_ms + (event_us - self.event_us) / 1000 / self.speed)


class SilenceProcessor(StatefulProcessor):
    """One row of state and at most one timer per device."""

    def __init__(self, clock: Clock):
        self.clock = clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.device = handle.getValueState("device", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kept = self.device.get() if self.device.exists() else None
        before, role, threshold, level = kept or (None, None, 0.0, 0)
        last = before
        for batch in rows:
            newest = batch.loc[batch["last_us"].idxmax()]
            role, threshold = newest["role"], float(newest["threshold_s"])
            last = int(newest["last_us"]) if last is None else max(last, int(newest["last_us"]))
        over = level > 0 and last > before
        if last != before:
            level = 0
        self._arm((last, role, threshold, level), timerValues)
        if over:
            yield self._alert(key, (last, role, threshold, level), timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, role, threshold, _ = self.device.get()
        quiet = (self.clock.event_at(timerValues.getCurrentProcessingTimeInMs()) - last) / 1e6
        level = max(k for k, (_, times) in enumerate(SEVERITIES) if not k or quiet >= times * max(threshold, 1.0)) + 1
        self._arm((last, role, threshold, level), timerValues)
        yield self._alert(key, (last, role, threshold, level), timerValues)

    def _alert(self, key: tuple, state: tuple, values: object) -> pd.DataFrame:
        last, role, threshold, level = state
        now = self.clock.event_at(values.getCurrentProcessingTimeInMs())
        times = [pd.Timestamp(int(us), unit="us", tz=timezone.utc) for us in (last, now)]
        row = (key[0], role, *times, (now - last) / 1e6, threshold, SEVERITIES[level - 1][0] if level else None)
        return pd.DataFrame([row], columns=[c.split(" ")[0] for c in ALERTS.split(", ")])

    def _arm(self, state: tuple, values: object) -> None:
        """Keep the state and set the timer for the next severity, in place of any other."""
        last, _, threshold, level = state
        self.device.update(state)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if level < len(SEVERITIES):
            times = SEVERITIES[level][1] if level else 1.0
            due = self.clock.clock_at(last + times * (max(threshold, 1.0) if level else threshold) * 1e6)
            if due is not None:
                self.handle.registerTimer(max(due, values.getCurrentProcessingTimeInMs() + 1))

    def close(self) -> None:
        pass


def _newest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = pa.Table.from_batches([batch]).group_by("ip").aggregate([("last_us", "max")])
        yield from found.rename_columns(["ip", "last_us"]).combine_chunks().to_batches()


def clock_silence_alerts(
    comm: DataFrame,
    roles: DataFrame | None = None,
    default_seconds: float = catalog.SILENCE_DEFAULT_SECONDS,
    role_seconds: dict[str, float] | None = None,
    clock: Clock = Clock(),
) -> DataFrame:
    """Alerts of senders that have been quiet for their threshold, and again as the severity rises.

    When an event ends an alert, a row without severity says so.
    They are found at every trigger, whether or not events come; the query
    needs a processing-time trigger and the RocksDB state store.  A batch's
    events of a busy sender are reduced to the newest before the shuffle.
    Write in update mode.  Events without a sender or a time say nothing.
    """
    rows = comm.select(F.col("orig_h").alias("ip"), F.unix_micros("ts").alias("last_us")).where("ip IS NOT NULL AND last_us IS NOT NULL")
    rows = rows.mapInArrow(_newest, SENDERS)
    if roles is not None:
        rows = rows.join(roles.select("ip", "role"), "ip", "left")
    else:
        rows = rows.withColumn("role", F.lit(None).cast("string"))
    rows = rows.withColumn("threshold_s", threshold_for_role(F.col("role"), default_seconds, role_seconds))
    return rows.groupBy("ip").transformWithStateInPandas(SilenceProcessor(clock), ALERTS, "update", "processingTime")
