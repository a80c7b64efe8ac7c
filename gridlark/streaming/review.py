"""Review state machine on a stream of revision attempts.

The attempts of a review count in the order of their ids, in whatever order
files bring them. The stream stages them by micro-batch and keeps no state.
Once it is drained they are folded in rounds: the first legal attempt after a
review's last applied one takes it to its next version. No state of the
workflow comes back, so there are at most as many rounds as states. A round
finds the first attempt by minima over blocks of a review's attempts, so a
review with very many attempts is never gathered in one task.

An id that comes again is the same attempt; of different contents under one id
the one that sorts first counts.

:func:`follow` is incremental. Attempts count in the order of their time, then
their id. A review's state is its standing after all attempts that are final,
and those ahead that could still apply; attempts that no order can apply are
counted and dropped at once. State is kept by bucket of reviews, with one timer
at the oldest attempt ahead, which is final when the watermark passes it. Each micro-batch gives the standing of the
reviews that it touched as if all that has arrived were all there is. Attempts
older than what a review has made final are late: they come out as rows of
their own and change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gridlark.operators.review import NEXT_STATES, may_follow
from gridlark.session import scratch_path
from gridlark.streaming.common import BUCKETS, Alarm, Rows, append_epochs, bucket_of, drain, keep_state

ATTEMPT_COLUMNS = ("review_id", "attempt_id", "expected_version", "state", "actor_id")
UNOWNED = ("PENDING", "CLAIMED", "ERP_CREATED")


def run(attempts: DataFrame, table: str, checkpoint: str) -> None:
    """Stages every attempt until the input is drained; a replay stages nothing twice."""
    drain(attempts.select(*ATTEMPT_COLUMNS).writeStream.foreachBatch(append_epochs(table)), checkpoint)


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _advanced(held: DataFrame, due: DataFrame) -> DataFrame:
    """Reviews that move on from `held`, by the first legal one of the attempts that expect their version."""
    # Each block of a review's attempts meets its own copy of the review's standing.
    blocks = due.select("review_id", "block").distinct()
    own = held.select(F.col("review_id").alias("_review"), "last", F.col("state").alias("before"), "owner")
    spread = blocks.join(own, F.col("review_id").eqNullSafe(F.col("_review"))).select("_review", F.col("block").alias("_block"), "last", "before", "owner")
    met = due.join(spread, F.col("review_id").eqNullSafe(F.col("_review")) & (F.col("block") == F.col("_block")))
    allowed = F.col("state").isin(*UNOWNED) | F.col("owner").isNull() | (F.col("owner") == F.col("actor_id"))
    legal = met.where((F.col("attempt_id") > F.col("last")) & may_follow(F.col("before"), F.col("state")) & allowed)
    return legal.groupBy("review_id").agg(F.min(F.struct("attempt_id", "state", "actor_id", "owner")).alias("a")).select(
        "review_id", F.col("a.attempt_id").alias("last"), "a.state",
        F.when(F.col("a.state") == "CLAIMED", F.col("a.actor_id")).otherwise(F.col("a.owner")).alias("owner"),
    )


def current_states(spark: SparkSession, table: str) -> DataFrame:
    """Version, state and counts of each review after all attempts."""
    staged = spark.read.parquet(table)
    blocks = F.lit(int(spark.conf.get("spark.sql.shuffle.partitions")))
    attempts = _stored(
        staged.groupBy("review_id", "attempt_id").agg(F.min(F.struct("expected_version", "state", "actor_id")).alias("a"))
        .select("review_id", "attempt_id", "a.*", F.pmod(F.xxhash64("attempt_id"), blocks).cast("int").alias("block")),
        "attempts",
    )
    first = attempts.where((F.col("expected_version") == 0) & (F.col("state") == "PENDING") & F.col("attempt_id").isNotNull())
    held = _stored(
        first.groupBy("review_id").agg(F.min("attempt_id").alias("last")).select(
            "review_id", "last", F.lit("PENDING").alias("state"), F.lit(None).cast(attempts.schema["actor_id"].dataType).alias("owner")
        ),
        "reviews-1",
    )
    reached = [held.select("review_id", F.lit(1).cast("bigint").alias("version"), "state")]
    for version in range(1, len(NEXT_STATES)):
        held = _stored(_advanced(held, attempts.where(F.col("expected_version") == version)), f"reviews-{version + 1}")
        if held.isEmpty():
            break
        reached.append(held.select("review_id", F.lit(version + 1).cast("bigint").alias("version"), "state"))
    counted = attempts.groupBy("review_id").agg(F.count(F.lit(1)).alias("attempts"))
    newest = reduce(DataFrame.unionByName, reached).groupBy(F.col("review_id").alias("_review")).agg(
        F.max("version").alias("version"), F.max_by("state", "version").alias("state")
    )
    version = F.coalesce("version", F.lit(0).cast("bigint"))
    return counted.join(newest, F.col("review_id").eqNullSafe(F.col("_review")), "left").select(
        "review_id", version.alias("version"), "state", version.alias("applied"), (F.col("attempts") - version).alias("refused")
    )


def _reachable() -> list[set[str]]:
    """For each expected version, the states that some review of that version may take."""
    now, out = {None}, []
    while now:
        targets = {t for s in now for t in (("PENDING",) if s is None else NEXT_STATES[s])}
        out.append(targets)
        now = targets
    return out


REACHABLE = _reachable()
STANDING = "version long, state string, owner string, refused long, final_until long"
AHEAD = "at long, attempt_id long, expected_version long, state string, actor_id string"
Attempt = tuple  # (time in milliseconds, id, expected version, state, actor)


def fold(standing: tuple, attempts: list[Attempt]) -> tuple:
    """The standing (version, state, owner, refused) after attempts in order."""
    version, state, owner, refused = standing
    for _, _, expected, wanted, actor in attempts:
        follows = wanted == "PENDING" if state is None else wanted in NEXT_STATES[state]
        if expected == version and follows and (wanted in UNOWNED or owner is None or owner == actor):
            version, state, owner = version + 1, wanted, actor if wanted == "CLAIMED" else owner
        else:
            refused += 1
    return version, state, owner, refused


class Standings(StatefulProcessor):
    """A bucket of reviews: what is final of each, and the attempts ahead of it that may still apply."""

    row = Row("review_id", "kind", "version", "state", "refused", "attempt_id")

    def __init__(self, review_id: T.StructField) -> None:
        self.schemas = [T.StructType([review_id, *T._parse_datatype_string(s).fields]) for s in (STANDING, AHEAD)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.standing, self.ahead = (Rows(handle, name, s) for name, s in zip(("standing", "ahead"), self.schemas))
        self.alarm = Alarm(handle)

    def load(self) -> dict[Any, tuple[tuple, int, list[Attempt]]]:
        """review -> standing, time until which it is final, attempts ahead in order."""
        held = {r[0]: (r[1:5], r[5], []) for r in self.standing.load()}
        for r in self.ahead.load():
            held[r[0]][2].append(r[1:])
        return held

    def keep(self, held: dict[Any, tuple[tuple, int, list[Attempt]]]) -> None:
        self.standing.keep([(review, *standing, final) for review, (standing, final, _) in held.items()])
        self.ahead.keep([(review, *a) for review, (_, _, ahead) in held.items() for a in ahead])
        self.alarm.set(min((ahead[0][0] + 1 for _, _, ahead in held.values() if ahead), default=None))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = self.load()
        came: dict[Any, list[Attempt]] = {}
        for r in rows:
            came.setdefault(r[0], []).append(tuple(r)[1:6])
        for review, attempts in came.items():
            standing, final, ahead = held.get(review, ((0, None, None, 0), -1, []))
            known = {a[1] for a in ahead}
            for row in sorted(attempts, key=lambda a: (a[0], a[1], a[2] is not None, a[2] or 0, a[3] or "", a[4] or "")):
                at, attempt, expected, state, _ = row
                if attempt in known:
                    continue
                if at < final:
                    yield self.row(review, "late", standing[0], standing[1], standing[3], attempt)
                    continue
                known.add(attempt)
                if expected is None or not standing[0] <= expected < len(REACHABLE) or state not in REACHABLE[expected]:
                    standing = (*standing[:3], standing[3] + 1)  # refused in any order
                else:
                    ahead.append(row)
            ahead.sort(key=lambda a: a[:2])
            held[review] = standing, final, ahead
            version, state, _, refused = fold(standing, ahead)
            yield self.row(review, "standing", version, state, refused, None)
        self.keep(held)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        held, now = self.load(), timerValues.getCurrentWatermarkInMs()
        for review, (standing, final, ahead) in held.items():
            due = [a for a in ahead if a[0] < now]
            if due:
                held[review] = fold(standing, due), max(final, now), ahead[len(due) :]
        self.keep(held)
        yield from ()

    def close(self) -> None:
        pass


def follow(attempts: DataFrame, delay: str = "1 day", buckets: int = BUCKETS) -> DataFrame:
    """review_id, kind (standing or late), version, state, refused, attempt_id (of a late attempt); attempts: ATTEMPT_COLUMNS and attempted_at."""
    keep_state(attempts.sparkSession)
    timed = attempts.filter("attempted_at is not null and attempt_id is not null").withWatermark("attempted_at", delay)
    # The copy of the time carries no watermark, so late attempts reach the state.
    rows = timed.select(
        "review_id", F.unix_millis(F.col("attempted_at").cast("timestamp")).alias("at"), F.col("attempt_id").cast("bigint"),
        F.col("expected_version").cast("bigint"), F.col("state").cast("string"), F.col("actor_id").cast("string"),
        bucket_of(["review_id"], buckets),
    )
    schema = T.StructType([rows.schema["review_id"], *T._parse_datatype_string("kind string, version long, state string, refused long, attempt_id long").fields])
    return rows.groupBy("bucket").transformWithState(Standings(rows.schema["review_id"]), schema, "update", "EventTime")


def run_follow(attempts: DataFrame, table: str, checkpoint: str, delay: str = "1 day") -> None:
    """Appends the standings that each micro-batch changes, and late attempts, until the input is drained."""
    drain(follow(attempts, delay).writeStream.outputMode("update").foreachBatch(append_epochs(table)), checkpoint)


def standings(spark: SparkSession, table: str) -> DataFrame:
    """Newest standing of each review."""
    rows = spark.read.parquet(table).filter("kind = 'standing'")
    newest = rows.groupBy("review_id").agg(F.max_by(F.struct("version", "state", "refused"), "epoch").alias("s"))
    return newest.select("review_id", "s.version", "s.state", F.col("s.version").alias("applied"), "s.refused")
