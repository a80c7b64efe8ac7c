"""Streaming queries: drained over the shared tables and read back as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridlark.functions.hashing import digest
from gridlark.operators import batches, messages
from gridlark.plans import derive as dv, q_messages
from gridlark.plans.registry import register
from gridlark.session import scratch_path
from gridlark.sources import publish
from gridlark.streaming import common, dedup, monitor, publish as stream_publish, review as stream_review


def _deliveries(orders: DataFrame, at: Column | None = None) -> DataFrame:
    at = F.col("o_orderdate").cast("timestamp") if at is None else at
    message = F.concat(F.lit("msg-"), F.col("o_custkey").cast("string"))
    body = {"body": F.col("o_orderstatus"), "mailbox_id": F.col("o_orderpriority"), "provider_message_id": message}
    return orders.select(
        F.col("o_orderpriority").alias("mailbox_id"), message.alias("provider_message_id"),
        F.col("o_orderkey").alias("delivery_id"), at.alias("received_at"),
        messages.content_digest(body).alias("content_digest"),
    )


def _attempts(orders: DataFrame) -> DataFrame:
    """Orders of a customer as attempts on one review."""
    states = ("PENDING", "CLAIMED", "CORRECTED", "REVALIDATED", "WRITE_PENDING", "ERP_CREATED", "APPROVED")
    step = F.col("o_orderkey") % 7
    return orders.select(
        F.col("o_custkey").alias("review_id"), F.col("o_orderkey").alias("attempt_id"), step.alias("expected_version"),
        F.element_at(F.array(*[F.lit(s) for s in states]), (step + 1).cast("int")).alias("state"),
        F.concat(F.lit("a"), (F.col("o_orderkey") % 2).cast("string")).alias("actor_id"),
        F.col("o_orderdate").cast("timestamp").alias("attempted_at"),
    )


@register("stream_dedup", q_messages.DEDUP_SQL)
def stream_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = scratch_path(spark, "dedup")
    source = common.read_table(spark, f"{folder}/orders.parquet")
    dedup.run(_deliveries(source), f"{out}/groups", f"{out}/checkpoint")
    return q_messages.dedup_view(dedup.jobs(spark, f"{out}/groups"))


@register(
    "stream_review",
    """WITH RECURSIVE attempts AS (SELECT o_custkey AS review_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_orderkey % 7 AS expected,
  (['PENDING', 'CLAIMED', 'CORRECTED', 'REVALIDATED', 'WRITE_PENDING', 'ERP_CREATED', 'APPROVED'])[o_orderkey % 7 + 1] AS wanted, 'a' || (o_orderkey % 2) AS actor FROM orders),
fold AS (
  SELECT DISTINCT review_id, 0::BIGINT AS n, 0::BIGINT AS version, NULL::VARCHAR AS state, NULL::VARCHAR AS owner FROM attempts
  UNION ALL
  SELECT f.review_id, a.n, CASE WHEN ok THEN version + 1 ELSE version END, CASE WHEN ok THEN wanted ELSE state END, CASE WHEN ok AND wanted = 'CLAIMED' THEN actor ELSE owner END
  FROM fold f JOIN attempts a ON a.review_id = f.review_id AND a.n = f.n + 1,
   LATERAL (SELECT expected = version AND (wanted IN ('PENDING', 'CLAIMED', 'ERP_CREATED') OR owner IS NULL OR owner = actor) AND wanted = CASE
     WHEN state IS NULL THEN 'PENDING' WHEN state = 'PENDING' THEN 'CLAIMED' WHEN state = 'CLAIMED' THEN 'CORRECTED' WHEN state = 'CORRECTED' THEN 'REVALIDATED'
     WHEN state = 'REVALIDATED' THEN 'WRITE_PENDING' WHEN state = 'WRITE_PENDING' THEN 'ERP_CREATED' WHEN state = 'ERP_CREATED' THEN 'APPROVED' ELSE '' END AS ok))
SELECT review_id, version, state, version AS applied, n - version AS refused FROM fold QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY n DESC) = 1""",
)
def stream_review_query(spark: SparkSession, folder: str) -> DataFrame:
    """Orders of a customer as attempts on one review, in key order."""
    out = scratch_path(spark, "review")
    attempts = _attempts(common.read_table(spark, f"{folder}/orders.parquet")).drop("attempted_at")
    stream_review.run(attempts, f"{out}/standing", f"{out}/checkpoint")
    return stream_review.current_states(spark, f"{out}/standing")


@register(
    "stream_monitor",
    """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, COUNT(*) AS readings, COUNT(*) FILTER (value > 5) AS valid_readings,
 strftime(MAX(ts), '%Y-%m-%d %H:%M:%S') AS newest, ROUND(LEAST(1.0, COUNT(*) FILTER (value > 5) / 3.0), 9) AS completeness
FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT MAX(ts) FROM events) - INTERVAL 2 HOUR GROUP BY ALL""",
)
def stream_monitor(spark: SparkSession, folder: str) -> DataFrame:
    """Closed hours only: those that ended two hours before the newest reading."""
    out = scratch_path(spark, "monitor")
    source = common.read_table(spark, f"{folder}/events.parquet").select(
        F.col("ts").cast("timestamp").alias("ts"), "event_type", (F.col("value") > 5).alias("valid")
    )
    monitor.run(source, "ts", ["event_type"], f"{out}/hours", f"{out}/checkpoint")
    done = monitor.judged(monitor.closed_hours(spark, f"{out}/hours", ["event_type"]), 3)
    return done.select(
        dv.text_time("hour").alias("hour"), "event_type", "readings", "valid_readings",
        dv.text_time("newest").alias("newest"), F.round("completeness", 9).alias("completeness"),
    )


@register(
    "stream_publish",
    "SELECT 'M' || o_orderpriority || year(o_orderdate) AS batch_id, COUNT(*) AS row_count, true AS intact FROM orders GROUP BY 1",
)
def stream_publish_query(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as forecast records, published twice from two drained streams."""
    out = scratch_path(spark, "stream-publish")
    for attempt in (1, 2):
        source = common.read_table(spark, f"{folder}/orders.parquet")
        records = source.select(
            F.concat(F.lit("M"), "o_orderpriority", F.year("o_orderdate").cast("string")).alias("batch_id"),
            F.col("o_orderkey").cast("string").alias("station_id"), F.col("o_orderdate").cast("timestamp").alias("target_timestamp"),
            F.col("o_totalprice").alias("forecast_continuous"), F.lit(batches.CHAMPION).alias("model_role"),
            F.lit(batches.HEALTHY).alias("batch_status"), digest({"s": F.col("o_orderstatus")}).alias("source_hash"),
        )
        stream_publish.run(records, f"{out}/published", f"{out}/checkpoint-{attempt}", f"{out}/staged-{attempt}")
    return publish.verify_published(spark, f"{out}/published").select("batch_id", "row_count", "intact")


@register(
    "stream_hours",
    """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, COUNT(*) AS readings, COUNT(*) FILTER (value > 5) AS valid_readings
FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT MAX(ts) FROM events) - INTERVAL 2 HOUR GROUP BY ALL""",
)
def stream_hours(spark: SparkSession, folder: str) -> DataFrame:
    """Hours closed by the watermark, from keyed state."""
    out = scratch_path(spark, "hours")
    source = common.read_table(spark, f"{folder}/events.parquet").select(
        F.col("ts").cast("timestamp").alias("ts"), "event_type", (F.col("value") > 5).alias("valid")
    )
    monitor.run_watch(source, "ts", ["event_type"], f"{out}/hours", f"{out}/checkpoint")
    closed = spark.read.parquet(f"{out}/hours").filter("kind = 'closed'")
    return closed.select(dv.text_time("hour").alias("hour"), "event_type", "readings", "valid_readings")


@register(
    "stream_jobs",
    """WITH deliveries AS (SELECT o_orderpriority AS mailbox_id, 'msg-' || o_custkey AS provider_message_id, o_orderstatus AS body,
  o_orderdate::TIMESTAMP + to_seconds(o_orderkey % 86400) AS ts FROM orders),
gaps AS (SELECT *, COALESCE(ts > lag(ts) OVER w + INTERVAL 60 DAY, false)::INT AS opens FROM deliveries WINDOW w AS (PARTITION BY mailbox_id, provider_message_id ORDER BY ts)),
numbered AS (SELECT *, SUM(opens) OVER (PARTITION BY mailbox_id, provider_message_id ORDER BY ts) AS job FROM gaps),
firsts AS (SELECT *, first_value(body) OVER (PARTITION BY mailbox_id, provider_message_id, job ORDER BY ts) AS own FROM numbered)
SELECT mailbox_id, provider_message_id, strftime(MIN(ts), '%Y-%m-%d %H:%M:%S') AS first_at, COUNT(*) AS deliveries, COUNT(DISTINCT body) AS digests,
 COUNT(*) FILTER (body <> own) AS conflicts
FROM firsts GROUP BY mailbox_id, provider_message_id, job HAVING MAX(ts) + INTERVAL 60 DAY < (SELECT MAX(ts) - INTERVAL 1 DAY FROM deliveries)""",
)
def stream_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs whose messages have been silent for 60 days; a message that comes again is another job."""
    out = scratch_path(spark, "jobs")
    orders = common.read_table(spark, f"{folder}/orders.parquet")
    at = F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 86400)
    dedup.run_expiring(_deliveries(orders, at), f"{out}/jobs", f"{out}/checkpoint", horizon_days=60)
    closed = spark.read.parquet(f"{out}/jobs")
    return closed.select("mailbox_id", "provider_message_id", dv.text_time("first_at").alias("first_at"), "deliveries", "digests", "conflicts")


@register(
    "stream_standings",
    """WITH RECURSIVE attempts AS (SELECT o_custkey AS review_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n, o_orderkey % 7 AS expected,
  (['PENDING', 'CLAIMED', 'CORRECTED', 'REVALIDATED', 'WRITE_PENDING', 'ERP_CREATED', 'APPROVED'])[o_orderkey % 7 + 1] AS wanted, 'a' || (o_orderkey % 2) AS actor FROM orders),
fold AS (
  SELECT DISTINCT review_id, 0::BIGINT AS n, 0::BIGINT AS version, NULL::VARCHAR AS state, NULL::VARCHAR AS owner FROM attempts
  UNION ALL
  SELECT f.review_id, a.n, CASE WHEN ok THEN version + 1 ELSE version END, CASE WHEN ok THEN wanted ELSE state END, CASE WHEN ok AND wanted = 'CLAIMED' THEN actor ELSE owner END
  FROM fold f JOIN attempts a ON a.review_id = f.review_id AND a.n = f.n + 1,
   LATERAL (SELECT expected = version AND (wanted IN ('PENDING', 'CLAIMED', 'ERP_CREATED') OR owner IS NULL OR owner = actor) AND wanted = CASE
     WHEN state IS NULL THEN 'PENDING' WHEN state = 'PENDING' THEN 'CLAIMED' WHEN state = 'CLAIMED' THEN 'CORRECTED' WHEN state = 'CORRECTED' THEN 'REVALIDATED'
     WHEN state = 'REVALIDATED' THEN 'WRITE_PENDING' WHEN state = 'WRITE_PENDING' THEN 'ERP_CREATED' WHEN state = 'ERP_CREATED' THEN 'APPROVED' ELSE '' END AS ok))
SELECT review_id, version, state, version AS applied, n - version AS refused FROM fold QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY n DESC) = 1""",
)
def stream_standings(spark: SparkSession, folder: str) -> DataFrame:
    """Orders of a customer as attempts on one review, in the order of their dates, from keyed state."""
    out = scratch_path(spark, "standings")
    attempts = _attempts(common.read_table(spark, f"{folder}/orders.parquet"))
    stream_review.run_follow(attempts, f"{out}/standings", f"{out}/checkpoint", delay="30 days")
    return stream_review.standings(spark, f"{out}/standings")
