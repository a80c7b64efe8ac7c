"""Deterministic screen first, advisory verdicts only for what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridlark.functions.text import injection_codes, normalize_text, screening_forms


def injection_hits(contents: DataFrame, text: str = "content") -> DataFrame:
    """Adds ``hits``: sorted injection codes of the whole, normalised text."""
    return _screened(contents, text).select(*contents.columns, "hits")


def _screened(contents: DataFrame, text: str) -> DataFrame:
    prepared = screening_forms(contents.withColumn("_text", normalize_text(F.col(text))), "_text")
    return prepared.withColumn("hits", injection_codes("_text"))


def screen(contents: DataFrame, verdicts: DataFrame, text: str = "content") -> DataFrame:
    """Disposition per content: a hit blocks, no verdict or a suspicious one means review."""
    hit = _screened(contents, text).select(*contents.columns, "hits", F.sha2("_text", 256).alias("content_digest"))
    advice = verdicts.select("content_digest", F.col("suspicious").alias("_suspicious"))
    joined = hit.join(advice, "content_digest", "left")
    blocked = F.size("hits") > 0
    return joined.withColumns(
        {
            "disposition": F.when(blocked, "block")
            .when(F.coalesce("_suspicious", F.lit(True)), "review")
            .otherwise("allow"),
            "reason_code": F.when(blocked, "DETERMINISTIC_INJECTION")
            .when(F.col("_suspicious").isNull(), "ADVISORY_SCREEN_FAILURE")
            .when(F.col("_suspicious"), "ADVISORY_SECURITY_HIT"),
        }
    ).drop("_suspicious")
