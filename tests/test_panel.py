import datetime as dt
import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridlark.operators import baselines, contracts, evaluation, features, folds, models, spatial
from gridlark.plans import derive as dv, load_all, q_models

FOLDER = "/root/testdata/sf0.001"
DAY = dt.date(2025, 1, 1)


def panel_frame(seed=3, stations=3, days=120):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(stations):
        for d in range(days):
            for h in (7, 8):
                if rng.random() < 0.7:
                    value = None if rng.random() < 0.1 else float(rng.integers(0, 40))
                    rows.append((str(s), DAY + dt.timedelta(days=d), h, value))
    return pd.DataFrame(rows, columns=["station_id", "local_date", "local_hour", "target"])


def to_spark(spark, frame):
    rows = [(a, b, int(c), None if pd.isna(d) else float(d)) for a, b, c, d in frame.itertuples(index=False)]
    df = spark.createDataFrame(rows, "station_id string, local_date date, local_hour short, target double")
    return df.withColumn(
        "timestamp_utc", F.timestamp_seconds(F.unix_date("local_date").cast("long") * 86400 + F.col("local_hour") * 3600)
    )


def test_lags_and_windows_match_brute_force(spark):
    frame = panel_frame()
    df = to_spark(spark, frame)
    ahead = [(str(s), DAY + dt.timedelta(days=125), 7) for s in range(3)]
    targets = df.select("station_id", "local_date", "local_hour").unionByName(
        spark.createDataFrame(ahead, "station_id string, local_date date, local_hour short")
    )
    got = features.passenger_features(df, targets).toPandas()
    assert len(got) == len(frame) + 3
    known = {(r.station_id, r.local_date, r.local_hour): r.target for r in frame.itertuples()}
    for row in got.itertuples():
        lag = known.get((row.station_id, row.local_date - dt.timedelta(days=7), row.local_hour))
        lag = None if lag is None or pd.isna(lag) else lag
        assert (None if pd.isna(row.passenger_lag_7d) else row.passenger_lag_7d) == lag
        assert row.passenger_lag_7d_missing == (lag is None)
        window = [
            v for (s, d, h), v in known.items()
            if s == row.station_id and h == row.local_hour and not pd.isna(v)
            and dt.timedelta(0) < row.local_date - d <= dt.timedelta(days=28)
        ]
        if window:
            assert math.isclose(row.passenger_mean_28d, np.mean(window))
            assert row.passenger_median_28d == np.median(window)
        else:
            assert pd.isna(row.passenger_mean_28d) and pd.isna(row.passenger_median_28d)


def test_in_place_features_equal_joined_features(spark):
    df = to_spark(spark, panel_frame(seed=5))
    names = ["station_id", "local_date", "local_hour", "passenger_lag_14d", "passenger_mean_56d", "passenger_median_91d"]
    joined = features.passenger_features(df, df.drop("target")).select(names)
    placed = features.passenger_features_in_place(df, "target").select(names)
    assert joined.exceptAll(placed).isEmpty() and placed.exceptAll(joined).isEmpty()


def world(spark, frame):
    df = to_spark(spark, frame)
    stations = spark.createDataFrame(
        [(str(s), 50.0 + s, 8.0 + s, 30.0, s % 2 == 0, 1.0 * s) for s in range(3)],
        "station_id string, latitude double, longitude double, station_capacity double, interchange boolean, connectivity double",
    )
    sensors = [("n0", 50.1, 8.1), ("n1", 52.2, 10.1)]
    traffic = df.select(
        F.when(F.col("station_id") == "0", "n0").otherwise("n1").alias("sensor_id"), "local_date", "local_hour",
        (F.coalesce("target", F.lit(1.0)) * 3).alias("traffic"), "timestamp_utc",
    )
    weather = df.select("timestamp_utc").distinct().withColumns({"temperature": F.lit(1.0), "precipitation": F.lit(0.0)})
    sites = spark.createDataFrame(sensors, "sensor_id string, latitude double, longitude double")
    mapping = spatial.nearest_site(stations, sites, "station_id", "sensor_id").withColumnRenamed("distance_km", "sensor_distance_km")
    return df, stations, traffic, weather, mapping


def test_nothing_after_the_origin_moves_a_feature(spark):
    frame = panel_frame(seed=9)
    cut = DAY + dt.timedelta(days=100)
    changed = frame.copy()
    late = changed["local_date"] > cut
    changed.loc[late, "target"] = 999.0
    origin = F.lit(f"{cut} 12:00:00").cast("timestamp")
    tables = []
    for version in (frame, changed):
        df, stations, traffic, weather, mapping = world(spark, version)
        targets = df.filter(F.col("local_date") > F.lit(str(cut)).cast("date")).select("station_id", "timestamp_utc", "local_date", "local_hour")
        tables.append(
            features.build_features(
                targets, stations, features.cut_at(df, origin), weather, features.cut_at(traffic, origin), mapping
            )
        )
    a, b = (t.toPandas().sort_values(["station_id", "timestamp_utc"]).reset_index(drop=True) for t in tables)
    assert len(a) > 0
    pd.testing.assert_frame_equal(a, b)
    names = features.feature_names(tables[0])
    assert len(names) == 100 and len(set(names)) == 100


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="shared tables are not here")
@pytest.mark.parametrize("name", ["feature_table", "traffic_lags"])
def test_panel_rows_move_once(spark, name):
    """Rows of the panel go through one shuffle, by station and before they are wide; tables that join are bounded."""
    plan = load_all()[name].build(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line and "station_id" in line]
    assert len(moved) == 1 and "hashpartitioning(station_id" in moved[0], moved
    assert "SortMergeJoin" not in plan


def test_slots_by_sensor_give_the_rows_own_keys_the_same_features(spark):
    df, stations, traffic, weather, mapping = world(spark, panel_frame(seed=3))
    targets = df.select("station_id", "timestamp_utc", "local_date", "local_hour", F.col("target").alias("visible"))
    slots = targets.select("local_date", "local_hour").distinct()
    tables = features.traffic_tables(traffic, features.slot_keys(slots, mapping))
    want, got = (
        features.build_features(targets, stations, "visible", weather, traffic, mapping, tables=t).toPandas()
        .sort_values(["station_id", "timestamp_utc"]).reset_index(drop=True) for t in (None, tables)
    )
    pd.testing.assert_frame_equal(want, got)
    names = list(got.columns)
    assert names[:4] == ["local_hour", "local_date", "station_id", "timestamp_utc"]
    assert names.index("rain_indicator") + 1 == names.index("sensor_distance_km") == names.index("traffic_nearest_lag_7d") - 1


def test_repeated_autumn_hour_keeps_one_row(spark):
    rows = [("s", "2025-10-26 00:30:00", 10.0), ("s", "2025-10-26 01:30:00", 20.0)]
    df = spark.createDataFrame(rows, "sensor_id string, t string, traffic double").withColumn("timestamp_utc", F.to_timestamp("t"))
    from gridlark.functions.calendar import with_local_keys

    out = features.sensor_traffic(with_local_keys(df, "Europe/Berlin")).collect()
    assert len(out) == 1 and out[0].traffic_nearest == 15.0


def test_nearest_site_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    points = [(i, float(rng.uniform(-90, 90)), float(rng.uniform(-180, 180))) for i in range(80)]
    points += [(100, 90.0, 0.0), (101, -90.0, 10.0), (102, 0.0, 180.0), (103, 0.0, -179.99)]
    sites = [(f"s{i:02d}", float(rng.uniform(-80, 80)), float(rng.uniform(-180, 180))) for i in range(40)]
    # A crowd of sites in one place, and two sites at the same spot.
    sites += [(f"c{i:03d}", 52.5 + i * 1e-4, 13.4) for i in range(200)] + [("t1", 10.0, 10.0), ("t0", 10.0, 10.0)]
    points.append((104, 10.0, 10.1))
    got = {
        r.p: (r.s, r.distance_km)
        for r in spatial.nearest_site(
            spark.createDataFrame(points, "p int, latitude double, longitude double"),
            spark.createDataFrame(sites, "s string, latitude double, longitude double"), "p", "s",
        ).collect()
    }

    def distance(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
        return 2 * 6371.0088 * math.asin(min(1.0, math.sqrt(h)))

    assert len(got) == len(points)
    for p, lat, lon in points:
        best = min(distance(lat, lon, y, x) for _, y, x in sites)
        assert math.isclose(got[p][1], best, abs_tol=1e-6)
    assert got[104][0] == "t0"


def test_baselines_follow_the_hierarchy(spark):
    frame = panel_frame(seed=11, days=30)
    cut = DAY + dt.timedelta(days=22)
    df = to_spark(spark, frame)
    history = df.filter(F.col("local_date") <= F.lit(str(cut)).cast("date"))
    extra = spark.createDataFrame([("9", cut + dt.timedelta(days=1), 7), ("0", cut + dt.timedelta(days=1), 12)], "station_id string, local_date date, local_hour short")
    targets = df.filter(F.col("local_date") > F.lit(str(cut)).cast("date")).select("station_id", "local_date", "local_hour").unionByName(extra)
    past = frame[(frame["local_date"] <= cut) & frame["target"].notna()].copy()
    past["weekday"] = [d.weekday() for d in past["local_date"]]
    for row in baselines.seasonal_naive(targets, history).collect():
        levels = [
            past[(past.station_id == row.station_id) & (past.weekday == row.local_date.weekday()) & (past.local_hour == row.local_hour)],
            past[(past.station_id == row.station_id) & (past.local_hour == row.local_hour)],
            past[past.station_id == row.station_id], past,
        ]
        median = next(float(np.median(level.target)) for level in levels if len(level))
        assert row.median_forecast == median
        week = past[(past.station_id == row.station_id) & (past.local_hour == row.local_hour) & (past.local_date == row.local_date - dt.timedelta(days=7))]
        assert row.used_fallback == (len(week) == 0)
        assert row.seasonal_forecast == (float(week.target.iloc[0]) if len(week) else median)


def test_coarser_medians_are_sought_for_unserved_targets_only(spark, monkeypatch):
    df = to_spark(spark, panel_frame(seed=5, days=60)).filter("target is not null")
    targets = df.select("station_id", "local_date", "local_hour")
    asked = []
    ranked = baselines.median_by_rank
    monkeypatch.setattr(baselines, "median_by_rank", lambda rows, keys, *names: asked.append(list(keys)) or ranked(rows, keys, *names))
    monkeypatch.setattr(baselines, "exact_median", lambda *_: pytest.fail("no target needs the overall median"))
    served = baselines.historical_median(targets, df)
    assert served.filter("median_forecast is null").isEmpty() and asked == [["station_id", "weekday", "local_hour"]]


def test_batches_shuffle_cells_once_and_stations_once(spark):
    plan = dv.batches(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan


def test_training_rows_of_all_folds_share_their_windows(spark):
    from gridlark.plans import q_panel

    plan = q_panel.asof_features(spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    # Of the two families of windows, only that of the validation weeks runs by fold.
    by_fold = [line for line in plan.splitlines() if " Window " in line or line.strip().startswith("Window")]
    assert any("[fold_id" in line for line in by_fold) and any("[station_id" in line for line in by_fold)


def test_folds_expand_and_splits_ignore_row_order(spark):
    df = to_spark(spark, panel_frame(seed=2))
    windows = folds.FoldWindows(F.lit(str(DAY + dt.timedelta(days=119))).cast("date"), "Europe/Berlin")
    rows = {(r.fold_id, r.role): r for r in folds.fold_summary(df, windows).collect()}
    assert rows["fold_1", "train"].row_count < rows["fold_3", "train"].row_count
    present = {d for d in panel_frame(seed=2)["local_date"]}
    for k in (1, 2, 3):
        week = {DAY + dt.timedelta(days=119 - 7 * (4 - k) + n) for n in range(1, 8)}
        assert rows[f"fold_{k}", "validation"].dates == len(week & present)
    assert str(rows["fold_3", "train"].origin) == "2025-04-23 10:00:00"
    split = folds.date_split(df).groupBy("role").count().collect()
    again = folds.date_split(df.orderBy(F.rand(1))).groupBy("role").count().collect()
    assert sorted(split) == sorted(again)


def test_scores(spark):
    rows = [("a", 1.0, -1.0), ("a", 3.0, 5.0), ("b", 10.0, 16.0), ("b", None, 8.0)]
    df = spark.createDataFrame(rows, "station_id string, actual double, forecast double")
    whole = evaluation.score(df).first()
    assert whole.coverage == 0.75 and math.isclose(whole.rmse, math.sqrt((1 + 4 + 36) / 3))
    by = {r.station_id: r for r in evaluation.score_station(df).collect()}
    assert by["b"].scored == 1 and by["b"].rmse == 6.0
    assert not math.isclose(whole.rmse, (by["a"].rmse + by["b"].rmse) / 2)


def test_selection_prefers_the_better_worst_station_in_the_band(spark):
    rows = [("m", "a", 100.0, 300.0, 1.0, 10, True), ("m", "b", 100.5, 250.0, 2.0, 20, True), ("m", "c", 102.0, 100.0, 1.0, 1, True),
            ("m", "d", 1.0, 1.0, 1.0, 1, False)]
    df = spark.createDataFrame(
        rows, "model_family string, candidate_id string, mean_rmse double, worst_station_rmse double, inference_latency_ms double, artifact_size_bytes int, completed boolean"
    )
    assert evaluation.select_champion(df).first().candidate_id == "b"
    chosen = evaluation.best_per_family(df, evaluation.select_champion(df)).first()
    assert chosen.candidate_id == "b" and chosen.selected


def test_hotspots(spark):
    df = spark.createDataFrame([(1.0, 2.0, 7), (5.0, 3.0, 7), (None, 1.0, 8)], "actual double, forecast double, hour int")
    assert [tuple(r) for r in evaluation.error_hotspots(df).collect()] == [(7, 1.5, 2)]


def test_headers_and_rules(spark):
    raw = spark.createDataFrame([(1, "91", "8.5", "False")], " Station int, LAT string, lng string, is_interchange string")
    table = contracts.stations_table(raw)
    row = table.first()
    assert row.station_id == "1" and row.interchange is False and row.station_name == "" and row.connectivity == 0.0
    broken = contracts.violations(table, contracts.station_rules(), ["station_id"]).collect()
    assert [r.rule for r in broken] == ["LATITUDE_RANGE"]
    with pytest.raises(contracts.ContractError):
        contracts.passengers_table(raw, "UTC")


def test_gaps_and_lookup_problems(spark):
    hours = spark.createDataFrame([("a", "2025-03-30 00:00:00"), ("a", "2025-03-30 03:00:00"), ("b", "2025-01-01 00:00:00")], "k string, t string")
    df = hours.select("k", F.to_timestamp("t").alias("timestamp_utc"))
    assert contracts.missing_hours(df, ["k"]).count() == 2
    facts = spark.createDataFrame([("x",), ("y",)], "k string")
    dim = spark.createDataFrame([("x", 1), ("x", 2)], "k string, v int")
    _, problems = contracts.lookup(facts, dim, ["k"])
    assert sorted((r.k, r.problem) for r in problems.collect()) == [("x", "KEY_REPEATED"), ("y", "KEY_UNMATCHED")]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="shared tables are not here")
def test_fold_features_are_written_once_and_equal_those_of_each_fold(spark):
    got = q_models.fold_features(spark, FOLDER)
    stored = sum(spark.read.parquet(f).count() for f in got.inputFiles() if "passenger_lag_7d" in spark.read.parquet(f).columns)
    panel = dv.panel(spark, FOLDER).cache()
    assert stored < 1.1 * panel.count()
    windows = folds.FoldWindows(dv.last_day(spark, FOLDER), dv.ZONE)
    targets = folds.fold_rows(panel, windows).drop("start_date", "end_date").withColumn(
        "visible", F.when(F.col("timestamp_utc") <= F.col("origin"), F.col("target"))
    )
    traffic = features.cut_at(folds.expand_folds(dv.traffic(spark, FOLDER), windows), F.col("origin"))
    want = features.build_features(
        targets, dv.stations(spark, FOLDER), "visible", dv.weather(spark, FOLDER), traffic, q_models.station_mapping(spark, FOLDER), ["fold_id"]
    )
    assert features.feature_names(got) == features.feature_names(want)
    rounded = [F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in got.dtypes]
    got, want = got.select(*rounded).cache(), want.select(*rounded).cache()
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_model_queries_run_the_whole_search(spark, monkeypatch):
    """All 38 seeded trials, five families, three folds and all columns; costs are measured."""
    rows = spark.createDataFrame(
        [(f"fold_{f}", role, f"s{i % 2}", float(i % 5), float(i % 3), float(i % 7)) for f in (1, 2, 3) for role in ("train", "validation") for i in range(30)],
        "fold_id string, role string, station_id string, target double, traffic_index double, hour double",
    )
    calls = []
    study, ablate = models.study, models.ablate
    monkeypatch.setattr(q_models, "prepared", lambda *_: rows)
    monkeypatch.setattr(q_models, "inputs", lambda df: ["station_id", "traffic_index", "hour"])
    monkeypatch.setattr(models, "study", lambda *a: calls.append(a) or study([models.Candidate("tweedie_00", "tweedie")], *a[1:]))
    monkeypatch.setattr(models, "ablate", lambda *a: calls.append(a) or ablate(models.Candidate("tweedie_00", "tweedie"), *a[1:], ("calendar",)))
    found = q_models.candidate_search(spark, "").collect()
    assert len(found) == 1 and found[0].selected and found[0].folds == 3
    assert found[0].inference_latency_ms > 0 and found[0].artifact_size_bytes > 0
    q_models.family_ablation(spark, "")
    (trials, _, folds_used, columns), ablated = calls
    assert trials == models.sample_candidates(models.Budget()) and len(trials) == 38
    assert folds_used == ablated[2] == ("fold_1", "fold_2", "fold_3") and columns == ablated[3] == ["station_id", "traffic_index", "hour"]
    assert len(ablated) == 4 and len(models.FEATURE_FAMILIES) == 5
