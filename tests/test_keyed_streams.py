"""Streams with keyed state: shuffled files, late rows, state that goes."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gridlark.streaming import common, dedup, monitor, review

BASE = dt.datetime(2026, 1, 1)
DAY = dt.timedelta(days=1)


def at(hours):
    return BASE + dt.timedelta(hours=hours)


def files(spark, folder, batches, schema):
    """One file per list of rows, in order of time for the file source."""
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{number:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def state_rows(spark, frame, mode, checkpoint, seen):
    """Runs a stream batch by batch; state rows after each."""
    query = frame.writeStream.outputMode(mode).foreachBatch(lambda batch, epoch: seen.extend(batch.collect())).option("checkpointLocation", checkpoint)
    query = query.trigger(availableNow=True).start()
    query.awaitTermination()
    return [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in query.recentProgress]


def test_hours_close_and_late_rows_are_listed(spark, tmp_path):
    rng = random.Random(1)
    rows = [(at(rng.uniform(0, 48)), rng.choice("ab"), rng.random() < 0.7) for _ in range(600)]
    rows.sort(key=lambda r: r[0])
    shuffled = [rows[i : i + 100] for i in range(0, 600, 100)]
    for part in shuffled:
        rng.shuffle(part)
    late = [(at(1.5), "a", True), (at(2.5), "b", False)]
    source = files(spark, str(tmp_path / "in"), [*shuffled, late], "ts timestamp, kind_of string, valid boolean").withColumnRenamed("kind_of", "source")
    seen = []
    sizes = state_rows(spark, monitor.watch(source, "ts", ["source"], "3 hours"), "append", str(tmp_path / "check"), seen)
    closed = {(r["hour"], r["source"]): (r["readings"], r["valid_readings"], r["newest"]) for r in seen if r["kind"] == "closed"}
    want = {}
    for ts, source_name, valid in rows:
        hour = ts.replace(minute=0, second=0, microsecond=0)
        n, v, newest = want.get((hour, source_name), (0, 0, ts))
        want[hour, source_name] = (n + 1, v + valid, max(newest, ts))
    horizon = rows[-1][0] - dt.timedelta(hours=3)
    due = {k: v for k, v in want.items() if k[0] + dt.timedelta(hours=1) <= horizon}
    assert {k: v[:2] for k, v in closed.items()} == {k: v[:2] for k, v in due.items()}
    assert sum(r["readings"] for r in seen if r["kind"] == "late") == len(late)
    still = sum(v[0] for k, v in want.items() if k not in due)
    assert sum(r["readings"] for r in seen) + still == len(rows) + len(late)  # none is lost
    assert max(sizes) < 60 and sizes[-1] <= 10


def jobs_of(rows, horizon):
    """Closed and open jobs of deliveries (key, digest, time) by gaps."""
    out = []
    for key in {r[0] for r in rows}:
        job = []
        for _, digest, time in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            if job and time > max(t for _, t in job) + horizon:
                out.append((key, job))
                job = []
            job.append((digest, time))
        out.append((key, job))
    return out


@pytest.mark.parametrize("order", ["ordered", "shuffled"])
def test_jobs_expire_and_come_again(spark, tmp_path, order):
    rng = random.Random(2)
    rows = [(rng.choice("uvwxyz"), rng.choice("pq"), at(rng.uniform(0, 24 * 120)).replace(microsecond=0)) for _ in range(150)]
    rows += [("hot", "p", at(h)) for h in range(0, 24 * 100, 5)]  # one message with most deliveries
    rows.sort(key=lambda r: r[2])
    parts = [rows[i : i + 90] for i in range(0, len(rows), 90)]
    if order == "shuffled":
        for part in parts:
            rng.shuffle(part)
    rows_in = [[("m", k, i, d, t) for i, (k, d, t) in enumerate(part)] for part in parts]
    schema = "mailbox_id string, provider_message_id string, delivery_id int, content_digest string, received_at timestamp"
    seen = []
    sizes = state_rows(spark, dedup.expiring(files(spark, str(tmp_path / "in"), rows_in, schema), 7, "1 day"), "append", str(tmp_path / "check"), seen)
    got = {(r["provider_message_id"], r["first_at"]): (r["last_at"], r["deliveries"], r["digests"], r["conflicts"]) for r in seen}
    want = {}
    for key, job in jobs_of(rows, 7 * DAY):
        last = max(t for _, t in job)
        if last + 7 * DAY < rows[-1][2] - DAY:
            digests = {d for d, _ in job}
            want[key, job[0][1]] = (last, len(job), len(digests), sum(d != job[0][0] for d, _ in job))
    assert got == want
    assert len({k for k, _ in want}) < len(want)  # messages that came again
    assert max(sizes) < 40 and sizes[-1] < max(sizes)


def attempts_of(rng, n):
    states = [*review.NEXT_STATES]
    rows = []
    for i in range(n):
        name = rng.choice(["r1", "r2", "r3", "hot", "hot", "hot"])
        rows.append((name, i, rng.randrange(8), rng.choice(states), rng.choice("ab"), at(3 * i)))
    for name in ("r1", "hot"):  # a path that goes through
        for step, (wanted, actor) in enumerate([("PENDING", "s"), ("CLAIMED", "a"), ("CORRECTED", "a"), ("REVALIDATED", "a")]):
            rows.append((name, n + step, step, wanted, actor, at(3 * step - 12)))
    return sorted(rows, key=lambda r: r[5])


def folded(rows):
    out = {}
    for name in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == name), key=lambda r: (r[5], r[1]))
        version, state, _, refused = review.fold((0, None, None, 0), [(r[5], *r[1:5]) for r in own])
        out[name] = (version, state, refused)
    return out


@pytest.mark.parametrize("order", ["ordered", "shuffled"])
def test_standings_equal_the_fold_after_every_batch(spark, tmp_path, order):
    rng = random.Random(3)
    rows = attempts_of(rng, 240)
    parts = [rows[i : i + 40] for i in range(0, len(rows), 40)]
    if order == "shuffled":
        # Neighbouring files swap rows: out of order, yet within the delay.
        for a, b in zip(parts, parts[1:]):
            a[-5:], b[:5] = b[:5], a[-5:]
        for part in parts:
            rng.shuffle(part)
    schema = "review_id string, attempt_id int, expected_version int, state string, actor_id string, attempted_at timestamp"
    source = files(spark, str(tmp_path / "in"), parts, schema)
    now, matched, seen = {}, [], []

    def check(batch, epoch):
        for r in batch.collect():
            seen.append(r)
            now[r["review_id"]] = (r["version"], r["state"], r["refused"])
        arrived = [r for part in parts[: epoch + 1] for r in part]
        matched.append(now == folded(arrived))

    query = review.follow(source, "4 days").writeStream.outputMode("update").foreachBatch(check)
    query = query.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(matched) >= len(parts) and all(matched)
    assert not [r for r in seen if r["kind"] == "late"]
    assert now["hot"][0] >= 4
    # A review with half of all attempts holds no more than the others.
    sizes = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in query.recentProgress]
    assert max(sizes) < 40


def test_late_attempts_come_out_and_change_nothing(spark, tmp_path):
    first = [("r", 1, 0, "PENDING", "s", at(0)), ("r", 2, 1, "CLAIMED", "a", at(24 * 10)), ("r", 3, 2, "CORRECTED", "a", at(24 * 30))]
    parts = [first[:2], first[2:], [("q", 8, 0, "PENDING", "s", at(24 * 60))], [("r", 9, 1, "REJECTED", "a", at(1))]]
    schema = "review_id string, attempt_id int, expected_version int, state string, actor_id string, attempted_at timestamp"
    review.run_follow(files(spark, str(tmp_path / "in"), parts, schema), str(tmp_path / "out"), str(tmp_path / "check"), "1 day")
    out = spark.read.parquet(str(tmp_path / "out"))
    assert [r["attempt_id"] for r in out.filter("kind = 'late'").collect()] == [9]
    found = {r["review_id"]: (r["version"], r["state"]) for r in review.standings(spark, str(tmp_path / "out")).collect()}
    assert found == {"r": (3, "CORRECTED"), "q": (1, "PENDING")}


def test_batches_merge_before_the_shuffle(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 3), (None, 4, 4), (None, 1, 9)], "k string, n long, t long").coalesce(1)
    merged = common.combined(rows.select("k", "n", F.col("t").alias("low"), F.col("t").alias("high")), ["k"], ["n"], ["low"], ["high"])
    assert sorted(map(tuple, merged.collect()), key=str) == [("a", 3, 3, 5), (None, 5, 4, 9)]


def test_many_messages_share_the_state_of_a_bucket(spark, tmp_path):
    rows = [[("m", f"k{i}", i, "p", at(i % 50)) for i in range(400)], [("m", "k0", 0, "p", at(24 * 40))]]
    schema = "mailbox_id string, provider_message_id string, delivery_id int, content_digest string, received_at timestamp"
    seen = []
    source = files(spark, str(tmp_path / "in"), rows, schema)
    sizes = state_rows(spark, dedup.expiring(source, 7, "1 day", buckets=4), "append", str(tmp_path / "check"), seen)
    assert max(sizes) <= 4 * 5 and len(seen) == 400 and {r["deliveries"] for r in seen} == {1}


def test_many_reviews_share_the_state_of_a_bucket(spark, tmp_path):
    rows = [(f"r{i}", i, 0, "PENDING", "s", at(i % 50)) for i in range(400)]
    schema = "review_id string, attempt_id int, expected_version int, state string, actor_id string, attempted_at timestamp"
    seen = []
    source = files(spark, str(tmp_path / "in"), [rows, [("r0", 900, 1, "CLAIMED", "a", at(24 * 40))]], schema)
    sizes = state_rows(spark, review.follow(source, "1 day", buckets=4), "update", str(tmp_path / "check"), seen)
    now = {r["review_id"]: (r["version"], r["state"]) for r in seen}
    assert max(sizes) <= 4 * 6 and now.pop("r0") == (2, "CLAIMED") and set(now.values()) == {(1, "PENDING")} and len(now) == 399
