"""Audit logs: sequence, hash chain, verification, intent pairing, redaction."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from gridlark.functions.hashing import GENESIS, digest
from gridlark.functions.text import redact_map
from gridlark.operators.ordered import number_within


def with_sequence(events: DataFrame, order: tuple[str, ...] = ("occurred_at", "event_id")) -> DataFrame:
    """1-based sequence per trace, also when one trace holds much of the log."""
    return number_within(events, ["trace_id"], list(order), "sequence")


def content_digest(fields: dict[str, Column]) -> Column:
    """Digest of an event without its place in the chain."""
    return digest(fields)


def link_hash(content: Column, previous: Column) -> Column:
    return F.sha2(F.concat(content, previous), 256)


def _linker():
    """The walk over sorted batches; nested so that workers need no package.

    It carries the last hash from row to row and keeps nothing else.
    """
    genesis = GENESIS

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = genesis
        for batch in batches:
            previous, linked = [], []
            for place, content, head in zip(batch["_place"], batch["content_digest"], batch["head_hash"]):
                if place == 1:
                    last = head
                previous.append(last)
                last = hashlib.sha256((content + last).encode()).hexdigest()
                linked.append(last)
            out = batch[["trace_id", "sequence"]].copy()
            out["previous_hash"], out["event_hash"] = previous, linked
            yield out

    return link


def build_chain(events: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Appends events (trace_id, sequence, content_digest) to their chains.

    ``heads`` holds the last hash of traces that already have a chain.  Links of
    one trace depend on each other, so a trace is walked in order; the walk
    streams keys and digests in sorted batches and holds one hash.  Content is
    hashed before, in parallel.

    The walk itself states no need for whole traces in one task, so a plan that
    changes while it runs may read a ``repartition`` by pieces.  The window does
    state it, and the order, for every plan.
    """
    slim = events.select("trace_id", "sequence", "content_digest")
    if heads is None:
        ready = slim.withColumn("head_hash", F.lit(GENESIS))
    else:
        ready = slim.join(heads.select("trace_id", F.col("event_hash").alias("_h")), "trace_id", "left").select(
            "trace_id", "sequence", "content_digest", F.coalesce("_h", F.lit(GENESIS)).alias("head_hash")
        )
    ordered = ready.withColumn("_place", F.row_number().over(Window.partitionBy("trace_id").orderBy("sequence")))
    types = dict(slim.dtypes)
    return ordered.mapInPandas(
        _linker(),
        f"trace_id {types['trace_id']}, sequence {types['sequence']}, previous_hash string, event_hash string",
    )


def chain_heads(chain: DataFrame) -> DataFrame:
    """Last hash and sequence per trace."""
    return chain.groupBy("trace_id").agg(
        F.max_by("event_hash", "sequence").alias("event_hash"), F.max("sequence").alias("sequence")
    )


def check_links(events: DataFrame) -> DataFrame:
    """First reason each event breaks its chain, NULL when it holds.

    Every event meets its predecessor by an equi-join on (trace, sequence), so
    links are checked independently of each other and of the length of a trace.
    """
    previous = events.groupBy("trace_id", "sequence").agg(
        F.min("event_hash").alias("_before"), F.count(F.lit(1)).alias("_copies")
    )
    before = previous.select(
        "trace_id", (F.col("sequence") + 1).alias("sequence"), F.col("_before"), F.lit(True).alias("_linked")
    )
    own = previous.select("trace_id", "sequence", "_copies")
    joined = events.join(before, ["trace_id", "sequence"], "left").join(own, ["trace_id", "sequence"])
    first = F.col("sequence") == 1
    code = (
        F.when(F.col("_copies") > 1, "SEQUENCE_REPEATED")
        .when(~first & F.col("_linked").isNull(), "SEQUENCE_GAP")
        .when(F.col("previous_hash") != F.when(first, GENESIS).otherwise(F.col("_before")), "PREVIOUS_HASH")
        .when(F.col("event_hash") != link_hash(F.col("content_digest"), F.col("previous_hash")), "EVENT_HASH")
    )
    return joined.withColumn("break_code", code).drop("_before", "_linked", "_copies")


def verify_traces(events: DataFrame) -> DataFrame:
    """Verdict per trace with the first break."""
    place = F.when(F.col("break_code").isNotNull(), F.struct("sequence", "break_code"))
    out = check_links(events).groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("events"), F.min(place).alias("_first")
    )
    return out.select(
        "trace_id", "events", F.col("_first").isNull().alias("verified"),
        F.col("_first.sequence").alias("first_break"), F.col("_first.break_code").alias("break_code"),
    )


def pair_intents(events: DataFrame) -> DataFrame:
    """Problems in intent and outcome pairs: lost or foreign intents, open intents.

    ``events``: trace_id, event_id, status, intent_event_id.
    """
    intents = events.filter("status = 'intent'").select("trace_id", F.col("event_id").alias("intent_event_id"))
    outcomes = events.filter("intent_event_id is not null")
    lost = outcomes.join(intents, ["trace_id", "intent_event_id"], "left_anti").select(
        "trace_id", "event_id", F.lit("OUTCOME_WITHOUT_INTENT").alias("problem")
    )
    loops = outcomes.filter("status = 'intent'").select(
        "trace_id", "event_id", F.lit("OUTCOME_IS_INTENT").alias("problem")
    )
    closed = outcomes.select("trace_id", "intent_event_id").distinct()
    still_open = intents.join(closed, ["trace_id", "intent_event_id"], "left_anti").select(
        "trace_id", F.col("intent_event_id").alias("event_id"), F.lit("INTENT_OPEN").alias("problem")
    )
    return lost.unionByName(loops).unionByName(still_open)


def redacted(events: DataFrame, payload: str = "payload") -> DataFrame:
    """Payload map with sensitive, personal and bulky values replaced."""
    return events.withColumn(payload, redact_map(F.col(payload)))


def trace_log(events: DataFrame, payload: str = "payload") -> DataFrame:
    """The log in time order, payload as JSON."""
    return events.withColumn(payload, F.to_json(payload)).orderBy("occurred_at", "trace_id", "sequence")
