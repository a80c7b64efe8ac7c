"""Canonical JSON digests and order-free table fingerprints."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

GENESIS = "0" * 64  # fixed value: predecessor hash of the first event
DIGEST_PATTERN = r"^[a-f0-9]{64}$"


def canonical_json(fields: Mapping[str, Column]) -> Column:
    """JSON object with sorted names and explicit nulls."""
    ordered = [fields[name].alias(name) for name in sorted(fields)]
    return F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"})


def digest(fields: Mapping[str, Column]) -> Column:
    return F.sha2(canonical_json(fields), 256)


def message_key(mailbox: Column, message: Column) -> Column:
    """Write-once key of a message, from provider identity and never content."""
    return digest(
        {
            "domain": F.lit("order-idempotency-v1"),
            "mailbox_id": mailbox,
            "provider_message_id": message,
        }
    )


def attachment_key(mailbox: Column, message: Column, ordinal: Column, content_digest: Column) -> Column:
    """Id bound to the owning message and the content, parts split by NUL."""
    return F.sha2(
        F.concat_ws("\u0000", mailbox, message, ordinal.cast("string"), content_digest), 256
    )


def table_fingerprint(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Row count and order-free content sum, one row per group.

    The sum is taken in decimal so that it can neither overflow nor depend on
    the order of rows.
    """
    row_hash = F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).cast("decimal(38,0)")
    return df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum(row_hash), F.lit(0)).cast("string").alias("content_sum"),
    )
