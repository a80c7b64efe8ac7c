"""Message dedup on a stream of deliveries.

:func:`run` keeps every group for ever. State is a streaming aggregate per (message, digest): counts and first order
merge on the map side before the shuffle, so a message with very many deliveries
costs one row per task and batch.  Every batch appends the groups it changed;
the newest row of a group is its state.

:func:`expiring` forgets. The deliveries of a message that follow each other
within the horizon are one job; a message that comes again later is a new job,
a defined and visible one, not a conflict. State is one row per digest of a
job that is still open, kept by bucket of messages, with one timer where the
first job of the bucket has been silent for the horizon; when the watermark
passes it the job is appended and its state goes. Of the deliveries of one task
and batch, those of one message, digest and day reach the state as one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gridlark.functions.hashing import message_key
from gridlark.operators.messages import CONFLICT_CODE, KEY, add_code
from gridlark.streaming.common import BUCKETS, Alarm, Rows, append_epochs, bucket_of, combined, drain, keep_state


def content_groups(deliveries: DataFrame) -> DataFrame:
    return deliveries.groupBy(*KEY, "content_digest").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct("received_at", "delivery_id")).alias("first"),
        F.max("received_at").alias("last"),
    )


def run(deliveries: DataFrame, table: str, checkpoint: str) -> None:
    """Maintains the group table until the input is drained."""
    drain(content_groups(deliveries).writeStream.outputMode("update").foreachBatch(append_epochs(table)), checkpoint)


def jobs(spark: SparkSession, table: str) -> DataFrame:
    """Current jobs from the group table, in the shape of the batch operator."""
    newest = spark.read.parquet(table).groupBy(*KEY, "content_digest").agg(
        F.max_by(F.struct("n", "first", "last"), "epoch").alias("s")
    )
    out = newest.groupBy(*KEY).agg(
        F.min_by("content_digest", "s.first").alias("content_digest"),
        F.min_by("s.n", "s.first").alias("_same"),
        F.sum("s.n").alias("delivery_count"),
        F.min("s.first.received_at").alias("created_at"),
        F.max("s.last").alias("updated_at"),
    )
    conflicts = F.col("delivery_count") - F.col("_same")
    return out.withColumns(
        {
            "conflict_count": conflicts,
            "content_conflict": conflicts > 0,
            "idempotency_key": message_key(F.col("mailbox_id"), F.col("provider_message_id")),
            "reason_codes": add_code(F.array().cast("array<string>"), conflicts > 0, CONFLICT_CODE),
        }
    ).drop("_same")


def first_only(deliveries: DataFrame, horizon: str = "7 days") -> DataFrame:
    """Plain dedup where only the first delivery within a horizon matters."""
    return deliveries.withWatermark("received_at", horizon).dropDuplicatesWithinWatermark(KEY)


DAY_MS = 86_400_000
JOB = "first_at long, last_at long, deliveries long, digests long, conflicts long"


class Jobs(StatefulProcessor):
    """Open jobs of a bucket of messages: spans of deliveries by digest, closed once the horizon has passed."""

    def __init__(self, horizon_ms: int, keys: T.StructType, names: list[str]) -> None:
        self.horizon, self.row = horizon_ms, Row(*names)
        #: (first, last) of a stretch of one digest of a message -> its digest and deliveries.
        self.span = T.StructType([*keys.fields, *T._parse_datatype_string("first_at long, last_at long, digest string, n long").fields])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open, self.alarm = Rows(handle, "open", self.span), Alarm(handle)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        spans = self.open.load()
        spans += [(*(r[k] for k in KEY), r.first_at, r.last_at, r.content_digest, r.n) for r in rows]
        yield from self.settle(spans, timerValues)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        yield from self.settle(self.open.load(), timerValues)

    def settle(self, spans: list[tuple], timerValues: Any) -> Iterator[Row]:
        """Close the jobs that nothing on time can reach any more; keep one span per digest of the others."""
        closed_before = timerValues.getCurrentWatermarkInMs() - self.horizon
        kept: list[tuple] = []
        oldest: int | None = None
        messages: dict[tuple, list[tuple]] = {}
        for span in spans:
            messages.setdefault(span[: len(KEY)], []).append(span[len(KEY) :])
        for message, own in messages.items():
            for job, last in self.jobs(own):
                if last >= closed_before:
                    kept.extend((*message, first, end, digest, n) for digest, (first, end, n) in job.items())
                    oldest = last if oldest is None else min(oldest, last)
                    continue
                lead = min(job.items(), key=lambda item: (item[1][0], item[0] or ""))
                total = sum(v[2] for v in job.values())
                yield self.row(*message, min(v[0] for v in job.values()), last, total, len(job), total - lead[1][2])
        self.open.keep(kept)
        self.alarm.set(None if oldest is None else oldest + self.horizon + 1)

    def jobs(self, spans: list[tuple]) -> Iterator[tuple[dict, int]]:
        """The jobs of a message, each as (first, last, deliveries) by digest, and the last delivery of all."""
        job: dict[str, tuple] = {}
        reach = 0
        for first, end, digest, n in sorted(spans, key=lambda s: (s[0], s[2] or "")):
            if job and first > reach + self.horizon:
                yield job, reach
                job = {}
            reach = max(reach, end) if job else end
            held = job.get(digest)
            job[digest] = (first, end, n) if held is None else (held[0], max(held[1], end), held[2] + n)
        if job:
            yield job, reach

    def close(self) -> None:
        pass


def expiring(deliveries: DataFrame, horizon_days: int = 7, delay: str = "1 day", buckets: int = BUCKETS) -> DataFrame:
    """KEY..., first_at, last_at, deliveries, digests, conflicts of each job that is closed."""
    keep_state(deliveries.sparkSession)
    at = F.unix_millis(F.col("received_at").cast("timestamp"))
    rows = deliveries.filter("received_at is not null").withWatermark("received_at", delay).select(
        *KEY, "content_digest", F.floor(at / DAY_MS).alias("day"), F.lit(1).cast("bigint").alias("n"), at.alias("first_at"), at.alias("last_at")
    )
    merged = combined(rows, [*KEY, "content_digest", "day"], sums=["n"], least=["first_at"], most=["last_at"])
    keys = T.StructType([merged.schema[c] for c in KEY])
    schema = T.StructType([*keys.fields, *T._parse_datatype_string(JOB).fields])
    placed = merged.select("*", bucket_of(KEY, buckets)).groupBy("bucket")
    out = placed.transformWithState(Jobs(horizon_days * DAY_MS, keys, schema.names), schema, "append", "EventTime")
    return out.withColumns({c: F.timestamp_millis(c) for c in ("first_at", "last_at")})


def run_expiring(deliveries: DataFrame, table: str, checkpoint: str, horizon_days: int = 7, delay: str = "1 day") -> None:
    """Appends closed jobs until the input is drained."""
    drain(expiring(deliveries, horizon_days, delay).writeStream.outputMode("append").foreachBatch(append_epochs(table)), checkpoint)
