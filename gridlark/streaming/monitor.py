"""Hourly completeness and freshness of a stream of readings.

:func:`run` keeps no state: counts, sums and maxima are additive, so each
micro-batch appends its own and an hour adds up whatever the order in which
files bring it; no reading is too late to count.

:func:`watch` closes hours by event time. An hour of a source is a key with
three numbers of state and a timer at its end; when the watermark passes the
timer the hour is appended and its state goes. Readings of an hour that is
closed come out as late rows, so every reading is in exactly one closed hour,
one late row or one hour that is still open.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gridlark.streaming.common import append_epochs, combined, drain, keep_state


def run(readings: DataFrame, instant: str, by: list[str], table: str, checkpoint: str) -> None:
    """Appends rows, valid rows and newest reading per hour and source of every micro-batch."""
    append = append_epochs(table)

    def add(batch: DataFrame, epoch: int) -> None:
        hours = batch.groupBy(F.date_trunc("hour", instant).alias("hour"), *by).agg(
            F.count(F.lit(1)).alias("readings"), F.count_if(F.col("valid")).alias("valid_readings"), F.max(instant).alias("newest")
        )
        append(hours, epoch)

    drain(readings.writeStream.foreachBatch(add), checkpoint)


def closed_hours(spark: SparkSession, table: str, by: list[str], delay: str = "2 hours") -> DataFrame:
    """Hours whose end lies `delay` or more before the newest reading of all."""
    parts = spark.read.parquet(table)
    newest = parts.agg(F.max("newest").alias("last"))
    hours = parts.groupBy("hour", *by).agg(*(f(c).alias(c) for f, c in ((F.sum, "readings"), (F.sum, "valid_readings"), (F.max, "newest"))))
    # One row: the newest instant.
    return hours.join(F.broadcast(newest), F.expr(f"hour + INTERVAL 1 HOUR <= last - INTERVAL {delay}")).drop("last")


class Hours(StatefulProcessor):
    """Open hours; the key is (hour in milliseconds, source columns...)."""

    def __init__(self, names: list[str]) -> None:
        self.row = Row(*names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "readings long, valid_readings long, newest long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        readings = valid = 0
        newest = None
        for row in rows:
            readings, valid = readings + row.readings, valid + row.valid_readings
            newest = row.newest if newest is None else max(newest, row.newest)
        end = key[0] + HOUR_MS
        held = self.open.get()
        if held is None and end <= timerValues.getCurrentWatermarkInMs():
            yield self.row(*key, "late", readings, valid, newest)
            return
        if held is None:
            self.handle.registerTimer(end)
            self.open.update((readings, valid, newest))
        else:
            self.open.update((held[0] + readings, held[1] + valid, max(held[2], newest)))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        held = self.open.get()
        self.open.clear()
        if held is not None:
            yield self.row(*key, "closed", *held)

    def close(self) -> None:
        pass


HOUR_MS = 3_600_000


def watch(readings: DataFrame, instant: str, by: list[str], delay: str = "2 hours") -> DataFrame:
    """hour, by..., kind (closed or late), readings, valid_readings, newest of a stream; rows without an instant are left out."""
    keep_state(readings.sparkSession)
    at = F.unix_millis(F.col(instant).cast("timestamp"))
    rows = readings.filter(F.col(instant).isNotNull()).withWatermark(instant, delay).select(
        (at - F.pmod(at, F.lit(HOUR_MS))).alias("hour"), *by, F.lit(1).cast("bigint").alias("readings"),
        F.coalesce(F.col("valid"), F.lit(False)).cast("bigint").alias("valid_readings"), at.alias("newest"),
    )
    merged = combined(rows, ["hour", *by], sums=["readings", "valid_readings"], most=["newest"])
    keys = [merged.schema[c] for c in ("hour", *by)]
    schema = T.StructType([*keys, *T._parse_datatype_string("kind string, readings long, valid_readings long, newest long").fields])
    out = merged.groupBy("hour", *by).transformWithState(Hours(schema.names), schema, "append", "EventTime")
    return out.withColumns({c: F.timestamp_millis(c) for c in ("hour", "newest")})


def run_watch(readings: DataFrame, instant: str, by: list[str], table: str, checkpoint: str, delay: str = "2 hours") -> None:
    """Appends closed hours and late rows until the input is drained."""
    drain(watch(readings, instant, by, delay).writeStream.outputMode("append").foreachBatch(append_epochs(table)), checkpoint)


def judged(hours: DataFrame, expected: int) -> DataFrame:
    """Completeness share per hour and source, capped at one."""
    return hours.withColumn("completeness", F.least(F.lit(1.0), F.col("valid_readings") / F.lit(expected)))
