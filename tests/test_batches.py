import datetime as dt
import os
import uuid

import pytest
from pyspark.sql import functions as F

from gridlark.operators import batches, contracts, folds, messages, monitoring, review
from gridlark.plans import q_forecast
from gridlark.session import scratch_path
from gridlark.sources import publish, tables
from gridlark.streaming import common, dedup, monitor, publish as stream_publish, review as stream_review

ORIGIN = "2025-03-27 11:00:00"


def records(spark, role="champion", stations=10):
    ids = spark.range(1, stations + 1).select(F.col("id").cast("string").alias("station_id"))
    origin = F.lit(ORIGIN).cast("timestamp")
    grid = folds.target_grid(ids, origin, "Europe/Berlin")
    rows = grid.withColumns(
        {
            "batch_id": F.lit("b1"), "origin": origin, "forecast": F.col("station_id").cast("double") + 10.5,
            "model_role": F.lit(role), "batch_status": F.lit("healthy"),
            **{h: F.sha2(F.lit(h), 256) for h in ("source_hash", "model_hash", "config_hash")},
        }
    )
    return grid.withColumn("batch_id", F.lit("b1")), batches.forecast_records(rows)


def test_grid_records_and_contract(spark):
    grid, made = records(spark)
    assert made.count() == 420
    assert contracts.violations(made, contracts.forecast_record_rules(), ["station_id"]).isEmpty()
    assert made.filter("station_id = '1'").first().forecast_count == 12
    keyed = made.withColumns(
        {"local_date": F.to_date(F.from_utc_timestamp("target_timestamp", "Europe/Berlin")),
         "local_hour": F.hour(F.from_utc_timestamp("target_timestamp", "Europe/Berlin")).cast("short")}
    )
    assert keyed.agg(F.array_sort(F.collect_set("local_hour"))).first()[0] == [7, 8, 9, 10, 11, 12]
    stations = grid.select("station_id").distinct()
    expected = batches.expected_grid(keyed, stations, "Europe/Berlin")
    cells = ["batch_id", "station_id", "local_date", "local_hour"]
    assert expected.count() == 420 and expected.exceptAll(grid.select(*cells)).isEmpty()
    # A station without any record is missing too.
    more = batches.expected_grid(keyed, stations.unionByName(stations.limit(1).withColumn("station_id", F.lit("unseen"))), "Europe/Berlin")
    assert batches.batch_contract(keyed, more).first().problems == ["ROW_COUNT", "GRID_CELLS_MISSING"]
    assert batches.origin_contract(keyed, more.select("station_id"), "Europe/Berlin").first() == batches.batch_contract(keyed, more).first()
    good = batches.batch_contract(keyed, expected).first()
    assert batches.origin_contract(keyed, stations, "Europe/Berlin").first() == good
    assert good.publishable and good.row_count == 420 and good.full_station_days == 70
    hurt = keyed.filter("not (station_id = '3' and local_hour = 9)").withColumn(
        "model_role", F.when(F.col("station_id") == "1", "other").otherwise(F.col("model_role"))
    )
    bad = batches.batch_contract(hurt.unionByName(keyed.limit(1)), grid).first()
    assert {"GRID_CELLS_MISSING", "KEY_REPEATED", "MIXED_ROLE_OR_STATUS", "ROW_COUNT"} <= set(bad.problems)
    assert batches.origin_contract(hurt.unionByName(keyed.limit(1)), stations, "Europe/Berlin").first() == bad
    moved = keyed.withColumn("local_hour", F.when(F.col("local_hour") == 9, 14).otherwise(F.col("local_hour")).cast("short"))
    assert batches.origin_contract(moved, stations, "Europe/Berlin").first() == batches.batch_contract(moved, grid).first()


def test_one_bad_champion_row_turns_the_batch(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 9.0), ("a", float("nan"), 8.0), ("b", 2.0, None), ("c", None, None)],
        "batch_id string, champion_forecast double, fallback_forecast double",
    )
    got = {(r.batch_id, r.model_role, r.batch_status) for r in batches.champion_or_fallback(df).collect()}
    assert got == {("a", "seasonal_naive_fallback", "degraded"), ("b", "champion", "healthy"), ("c", None, "blocked")}


def test_serving_decisions(spark):
    rows = [("ok", "stations", True, True, True), ("opt", "weather", False, False, True), ("opt", "stations", True, True, True),
            ("crit", "passengers", True, True, False), ("crit", "weather", False, False, True)]
    df = spark.createDataFrame(rows, "batch_id string, name string, critical boolean, available boolean, valid boolean")
    got = {r.batch_id: (r.model_role, r.batch_status, r.reasons) for r in batches.serving_decision(df).collect()}
    assert got == {
        "ok": ("champion", "healthy", []),
        "opt": ("seasonal_naive_fallback", "degraded", ["optional_source_unavailable:weather"]),
        "crit": (None, "blocked", ["passengers"]),
    }


def monitored(spark):
    start = dt.datetime(2025, 4, 1, 7)
    rows = []
    for s in range(1, 11):
        for i in range(42):
            label = None if i == 0 and s in (1, 8, 10) else 10.0
            rows.append(("b", str(s), start + dt.timedelta(hours=i), 11.0, label, 12.0))
    return spark.createDataFrame(
        rows, "batch_id string, station_id string, target_timestamp timestamp, forecast_continuous double, actual double, baseline_forecast double"
    )


def test_monitoring_numbers_and_actions(spark):
    df = monitored(spark)
    joined = monitoring.join_labels(
        df.select("batch_id", "station_id", "target_timestamp", "forecast_continuous"), df, df
    )
    scoped = monitoring.rolling_scope(joined, ["batch_id"])
    row = monitoring.performance(scoped, ["batch_id"]).first()
    assert (row.scored, row.rmse, row.bias, row.baseline_rmse, row["lift"]) == (417, 1.0, 1.0, 2.0, 0.5)
    per = {r.station_id: r.scored for r in monitoring.performance(scoped, ["station_id"]).collect()}
    assert sorted(per.values()) == [41] * 3 + [42] * 7
    full = monitoring.completeness(df, 420).first()
    assert full.completeness == 1.0 and full.severity == "info"
    short = monitoring.completeness(df.filter("station_id <> '1'"), 420)
    found = monitoring.completeness_findings(short, ["batch_id"])
    assert monitoring.decide(found, ["batch_id"]).first().action == "block_publication"
    marks = spark.createDataFrame([("weather", None), ("passenger_history", "2025-04-01 00:00:00")], "source string, w string").select(
        "source", F.to_timestamp("w").alias("watermark")
    )
    now = F.lit("2025-04-01 05:00:00").cast("timestamp")
    fresh = monitoring.freshness(marks, monitoring.source_ages({"passenger_history": 6.0}, spark), now)
    soft = monitoring.freshness_findings(fresh.withColumn("batch_id", F.lit("b")), ["batch_id"])
    assert monitoring.decide(soft, ["batch_id"]).first().action == "fallback"


def test_publishing_is_immutable_and_idempotent(spark):
    out = scratch_path(spark, "test-publish")
    _, made = records(spark, stations=3)
    assert publish.publish_batches(made, out).first().disposition == "NEW"
    assert publish.publish_batches(made.orderBy(F.rand(1)), out).first().disposition == "REPLAY"
    with pytest.raises(publish.PublishError):
        publish.publish_batches(made.withColumn("forecast_continuous", F.col("forecast_continuous") + 1), out)
    stored = publish.verify_published(spark, out).collect()
    assert len(stored) == 1 and stored[0].intact and stored[0].row_count == 126
    assert publish.current_pointer(publish.read_manifest(spark, out)).first().batch_id == "b1"
    assert tables.read_by_suffix(spark, f"{out}/csv/batch_id=b1/*.csv").count() == 126


def test_a_published_batch_is_placed_by_one_shuffle(spark, monkeypatch):
    out = scratch_path(spark, "test-publish")
    _, made = records(spark, stations=3)
    plans = []
    save = publish._replace
    monkeypatch.setattr(publish, "_replace", lambda writer, target: plans.append(writer._df) or save(writer, target))
    publish.publish_batches(made, out)
    text = [p._jdf.queryExecution().executedPlan().toString() for p in plans]
    assert ["Exchange rangepartitioning" in t for t in text] == [True, False]
    stored = spark.read.schema(made.schema).parquet(f"{out}/records").select(*made.columns)
    listed = spark.read.schema(made.schema).option("header", True).csv(f"{out}/csv").select(*made.columns)
    assert stored.count() == 126 and stored.exceptAll(listed).isEmpty()


def test_stored_batches_serve_verdict_and_records(spark):
    plan = q_forecast.records(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan


def test_guarded_csv(spark):
    path = scratch_path(spark, "test-csv")
    _, made = records(spark, stations=2)
    assert publish.publish_csv(made, path, 84).count() == 84
    with pytest.raises(publish.PublishError):
        publish.publish_csv(made.unionByName(made), path, 168)
    assert publish.read_published_csv(spark, path).count() == 84


def test_stream_dedup_equals_the_batch_operator(spark):
    rows = [(f"m{i % 2}", str(i % 5), i, f"2025-01-{1 + i % 28:02d} 00:00:00", "xyz"[i % 3 if i % 5 == 0 else 0]) for i in range(60)]
    df = spark.createDataFrame(rows, "mailbox_id string, provider_message_id string, delivery_id int, t string, content_digest string").withColumn(
        "received_at", F.to_timestamp("t")
    ).drop("t")
    base = scratch_path(spark, "test-dedup")
    for part in range(3):
        df.filter(F.col("delivery_id") % 3 == part).coalesce(1).write.mode("append").parquet(f"{base}/in")
    dedup.run(common.read_table(spark, f"{base}/in", 1), f"{base}/groups", f"{base}/checkpoint")
    got, want = dedup.jobs(spark, f"{base}/groups"), messages.reserve(df)
    columns = sorted(want.columns)
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))


def as_tables(spark, df, base, key):
    """The same rows as one file, as three files in an order of their own, and as many part files."""
    df.coalesce(1).write.parquet(f"{base}/one")
    for part in (2, 0, 1):
        df.filter(F.pmod(F.hash(key), F.lit(3)) == part).coalesce(1).write.mode("append").parquet(f"{base}/three")
    df.orderBy(F.desc(key)).repartition(7).write.parquet(f"{base}/many")
    return [f"{base}/{name}" for name in ("one", "three", "many")]


def test_stream_review_counts_attempts_in_the_order_of_their_ids(spark):
    steps = [(1, 0, "PENDING", "w"), (2, 1, "CLAIMED", "ann"), (3, 1, "CLAIMED", "bob"), (4, 2, "APPROVED", "ann"),
             (5, 2, "CORRECTED", "bob"), (6, 2, "CORRECTED", "ann")]
    rows = [(7, *s) for s in steps] + [(8, a, (a * a) % 4, ("PENDING", "CLAIMED", "CORRECTED", "REJECTED")[(a * a) % 4], f"p{a % 2}") for a in range(10, 40)]
    df = spark.createDataFrame(rows, "review_id bigint, attempt_id bigint, expected_version bigint, state string, actor_id string")
    base = scratch_path(spark, "test-review")
    results = []
    for number, path in enumerate(as_tables(spark, df, base, "attempt_id")):
        stream_review.run(common.read_table(spark, path, 1), f"{base}/out{number}", f"{base}/checkpoint{number}")
        results.append(sorted(map(tuple, stream_review.current_states(spark, f"{base}/out{number}").collect())))
    assert results[0][0] == (7, 3, "CORRECTED", 3, 3)
    assert results[0] == results[1] == results[2]


def test_stream_review_spreads_the_attempts_of_one_review(spark):
    """One review with nearly all attempts: it equals the sequential fold, and its attempts are not state of one task."""
    states = ("PENDING", "CLAIMED", "CORRECTED", "REVALIDATED", "WRITE_PENDING", "ERP_CREATED", "APPROVED", "REJECTED")
    rows = [(1, a, a * 5 % 9, states[a * 5 % 9 % 7], f"p{a // 9 % 3}") for a in range(5000)] + [(None, 1, 0, "PENDING", None), (2, 1, 0, "REJECTED", "p")]
    df = spark.createDataFrame(rows, "review_id bigint, attempt_id bigint, expected_version bigint, state string, actor_id string")
    base = scratch_path(spark, "test-hot-review")
    df.repartition(3).write.parquet(f"{base}/in")
    stream_review.run(common.read_table(spark, f"{base}/in", 1), f"{base}/out", f"{base}/checkpoint")
    version, current, owner = 0, None, None
    for _, _, expected, wanted, actor in rows[:5000]:
        legal = wanted in (review.NEXT_STATES[current] if current else ("PENDING",))
        if expected == version and legal and (wanted in stream_review.UNOWNED or owner in (None, actor)):
            version, current, owner = version + 1, wanted, actor if wanted == "CLAIMED" else owner
    assert version == 7
    got = {r.review_id: tuple(r)[1:] for r in stream_review.current_states(spark, f"{base}/out").collect()}
    assert got == {1: (version, current, version, 5000 - version), None: (1, "PENDING", 1, 0), 2: (0, None, 0, 1)}
    assert not os.path.exists(f"{base}/checkpoint/state")


def test_stream_monitor_counts_every_file_order_alike(spark):
    start = dt.datetime(2025, 1, 1)
    rows = [(start + dt.timedelta(minutes=17 * i), f"s{i % 2}", i % 3 > 0) for i in range(120)]
    df = spark.createDataFrame(rows, "ts timestamp, source string, valid boolean")
    base = scratch_path(spark, "test-monitor")
    results = []
    for number, path in enumerate(as_tables(spark, df, base, "ts")):
        monitor.run(common.read_table(spark, path, 1), "ts", ["source"], f"{base}/out{number}", f"{base}/checkpoint{number}")
        results.append(sorted(map(tuple, monitor.closed_hours(spark, f"{base}/out{number}", ["source"]).collect())))
    last = max(r[0] for r in rows) - dt.timedelta(hours=2)
    closed = [r for r in rows if r[0].replace(minute=0) + dt.timedelta(hours=1) <= last]
    assert sum(r[2] for r in results[0]) == len(closed) and sum(r[3] for r in results[0]) == sum(r[2] for r in closed)
    assert results[0] == results[1] == results[2]


def test_stream_publish_takes_batches_that_span_files(spark):
    _, made = records(spark, stations=4)
    base = scratch_path(spark, "test-publish")
    for number, path in enumerate(as_tables(spark, made, base, "station_id")):
        first = stream_publish.run(common.read_table(spark, path, 1), f"{base}/published", f"{base}/checkpoint{number}", f"{base}/staged{number}")
        assert [r.disposition for r in first.collect()] == ["REPLAY" if number else "NEW"]
    assert [(r.row_count, r.intact) for r in publish.verify_published(spark, f"{base}/published").collect()] == [(made.count(), True)]


def test_labels_and_baselines_are_one_to_one(spark):
    at = dt.datetime(2026, 1, 5, 8)
    forecasts = spark.createDataFrame([("b", "1", at, 5.0), ("c", "1", at, 6.0), ("b", "2", at, 7.0)], "batch_id string, station_id string, target_timestamp timestamp, forecast_continuous double")
    labels = spark.createDataFrame([("1", at, 4.0), ("2", at, None), ("9", at, 1.0), ("9", at, 1.0)], "station_id string, target_timestamp timestamp, actual double")
    base = labels.filter("station_id = '1'").withColumnRenamed("actual", "baseline_forecast")
    # A key that no forecast meets may repeat.
    joined = monitoring.join_labels(forecasts, labels.filter("station_id <> '9'"), base)
    assert sorted((r.batch_id, r.station_id, r.actual, r.baseline_forecast) for r in joined.collect()) == [("b", "1", 4.0, 4.0), ("b", "2", None, None), ("c", "1", 4.0, 4.0)]
    for wrong_labels, wrong_base in ((labels.union(labels.filter("station_id = '1'")), base), (labels, base.union(base))):
        with pytest.raises(Exception, match="comes more than once for 1"):
            monitoring.join_labels(forecasts, wrong_labels, wrong_base).collect()
