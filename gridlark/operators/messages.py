"""Inbound messages: dedup with conflict detection, transport, sender, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridlark.functions.hashing import digest, message_key

KEY = ["mailbox_id", "provider_message_id"]
CONFLICT_CODE = "MESSAGE_ID_CONTENT_CONFLICT"  # fixed value


def content_digest(fields: dict[str, Column]) -> Column:
    """Digest of everything a delivery carries."""
    return digest(fields)


def transport_codes(verified: Column, spf: Column, dkim: Column, dmarc: Column) -> Column:
    """Codes of failed transport checks in fixed order."""
    def verdict(name: str, value: Column) -> Column:
        word = F.coalesce(F.lower(value), F.lit("unknown"))
        return F.when(word != "pass", F.concat(F.lit(f"{name}_"), F.upper(word)))

    unverified = F.when(~F.coalesce(verified, F.lit(False)), "WEBHOOK_UNVERIFIED")
    return F.array_compact(
        F.array(unverified, verdict("SPF", spf), verdict("DKIM", dkim), verdict("DMARC", dmarc))
    )


def first_delivery(deliveries: DataFrame) -> DataFrame:
    """Digest of the first delivery per message; partial aggregation tames hot keys."""
    order = F.struct("received_at", "delivery_id")
    return deliveries.groupBy(*KEY).agg(
        F.min_by("content_digest", order).alias("content_digest"),
        F.min("received_at").alias("created_at"),
        F.max("received_at").alias("updated_at"),
    )


def reserve(deliveries: DataFrame) -> DataFrame:
    """One job per message: delivery count, conflict count, reasons and key.

    Deliveries first collapse to (message, digest), so even a message that makes
    up a third of all deliveries reaches the final step as a few rows.  A conflict
    sets its own flag and never overwrites an outcome.
    """
    order = F.struct("received_at", "delivery_id")
    by_content = deliveries.groupBy(*KEY, "content_digest").agg(
        F.count(F.lit(1)).alias("n"), F.min(order).alias("first"), F.max("received_at").alias("last")
    )
    jobs = by_content.groupBy(*KEY).agg(
        F.min_by("content_digest", "first").alias("content_digest"),
        F.min_by("n", "first").alias("_same"),
        F.sum("n").alias("delivery_count"),
        F.min("first.received_at").alias("created_at"),
        F.max("last").alias("updated_at"),
    )
    conflicts = F.col("delivery_count") - F.col("_same")
    return jobs.withColumns(
        {
            "conflict_count": conflicts,
            "content_conflict": conflicts > 0,
            "idempotency_key": message_key(F.col("mailbox_id"), F.col("provider_message_id")),
        }
    ).withColumn("reason_codes", add_code(F.array().cast("array<string>"), F.col("content_conflict"), CONFLICT_CODE)).drop("_same")


def add_code(codes: Column, hit: Column, code: str) -> Column:
    """Sorted union of a code set with one more code where ``hit``."""
    return F.when(hit, F.array_sort(F.array_union(codes, F.array(F.lit(code))))).otherwise(F.array_sort(codes))


def conflicts(deliveries: DataFrame) -> DataFrame:
    """Every delivery whose digest differs from the first one of its message."""
    first = first_delivery(deliveries).select(*KEY, F.col("content_digest").alias("_first"))
    return deliveries.join(first, KEY).filter(F.col("content_digest") != F.col("_first")).drop("_first")


def dispositions(deliveries: DataFrame) -> DataFrame:
    """Every delivery as new, duplicate or content conflict."""
    order = F.struct("received_at", "delivery_id")
    first = deliveries.groupBy(*KEY).agg(
        F.min_by("content_digest", order).alias("_first"), F.min(order).alias("_order")
    )
    return deliveries.join(first, KEY).withColumn(
        "disposition",
        F.when(order == F.col("_order"), "new")
        .when(F.col("content_digest") == F.col("_first"), "duplicate")
        .otherwise("content_conflict"),
    ).drop("_first", "_order")


def resolve_customer(messages: DataFrame, customers: DataFrame) -> DataFrame:
    """Sender to active customer, ignoring case; unmatched senders get a code."""
    active = customers.filter("active").select(
        F.lower("email").alias("_sender"), F.col("customer_id").alias("customer_id")
    )
    joined = messages.withColumn("_sender", F.lower(F.trim("envelope_sender"))).join(active, "_sender", "left")
    return joined.withColumn(
        "customer_code", F.when(F.col("customer_id").isNull(), "UNKNOWN_SENDER")
    ).drop("_sender")


def reconcile_writes(jobs: DataFrame, orders: DataFrame) -> DataFrame:
    """Open jobs whose order exists become created; everything else stays as it is."""
    written = orders.select("idempotency_key", F.col("order_id").alias("_order"))
    joined = jobs.join(written, "idempotency_key", "left")
    found = F.col("outcome").isin("RECEIVED", "PROCESSING") & F.col("_order").isNotNull()
    return joined.withColumns(
        {
            "reconciled": found,
            "order_id": F.when(found, F.col("_order")).otherwise(F.col("order_id")),
            "reason_code": F.when(found, "ERP_WRITE_RECONCILED"),
            "outcome": F.when(found, "ERP_CREATED").otherwise(F.col("outcome")),
        }
    ).drop("_order")


# Stage of a code decides which stage stopped a message first.
STAGES = ("duplicate", "transport", "customer", "attachment", "screen", "extraction", "policy", "write")


def first_stage(codes: dict[str, Column], outcomes: dict[str, Column]) -> tuple[Column, Column]:
    """First stage with a code, and the outcome that stage stands for."""
    stage = F.coalesce(*[F.when(codes[s].isNotNull(), s) for s in STAGES if s in codes])
    outcome = F.coalesce(*[F.when(codes[s].isNotNull(), outcomes[s]) for s in STAGES if s in codes])
    return stage, outcome
