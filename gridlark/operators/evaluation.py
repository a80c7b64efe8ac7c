"""Forecast scores, candidate summaries and selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridlark.functions.numeric import at_least_zero, is_finite

# Fixed values.
SELECTION_BAND = 1.01
FEATURE_FAMILIES: dict[str, tuple[str, ...]] = {
    "calendar": (
        "local_hour", "weekday", "is_weekend", "month", "day_of_year", "weekday_sin", "weekday_cos",
        "day_of_year_sin", "day_of_year_cos", "hour_sin", "hour_cos", "trend_index",
    ),
    "station": (
        "station_id", "latitude", "longitude", "station_capacity", "interchange", "connectivity",
        "sensor_distance_km",
    ),
    "passenger_history": ("passenger_",),
    "weather": ("temperature", "precipitation", "rain_indicator"),
    "traffic": ("traffic_",),
}


def rmse(error: Column) -> Column:
    return F.sqrt(F.avg(error * error))


def score(df: DataFrame, by: Sequence[str] = (), actual: str = "actual", forecast: str = "forecast") -> DataFrame:
    """RMSE, signed bias, scored and forecast rows and coverage per group.

    Forecasts are clipped at zero; rows without a label count as forecast rows
    but are not scored.
    """
    known = is_finite(F.col(actual))
    error = F.when(known, at_least_zero(F.col(forecast)) - F.col(actual))
    return df.groupBy(*by).agg(
        rmse(error).alias("rmse"),
        F.avg(error).alias("bias"),
        F.count(error).alias("scored"),
        F.count(F.lit(1)).alias("forecasts"),
        (F.count(error) / F.count(F.lit(1))).alias("coverage"),
    )


def score_station(df: DataFrame, by: Sequence[str] = (), **names: str) -> DataFrame:
    """Scores per station; stations without any label drop out."""
    return score(df, [*by, "station_id"], **names).filter("scored > 0").drop("forecasts", "coverage")


def invalid_forecasts(df: DataFrame, forecast: str = "forecast") -> DataFrame:
    """Rows that make an evaluation inadmissible."""
    return df.filter(~is_finite(F.col(forecast)))


def score_models(df: DataFrame, models: Mapping[str, str], by: Sequence[str] = ()) -> DataFrame:
    """Several forecast columns scored in one pass, one row per model and group."""
    pairs = F.array(
        *[F.struct(F.lit(m).alias("model"), F.col(c).alias("forecast")) for m, c in models.items()]
    )
    long = df.select(*by, "actual", F.explode(pairs).alias("_m")).select(*by, "actual", "_m.*")
    return score(long, [*by, "model"])


def error_hotspots(df: DataFrame, by: Sequence[str] = ("hour",)) -> DataFrame:
    """Mean absolute error and count by hour over labelled rows."""
    labelled = df.filter(F.col("actual").isNotNull())
    return labelled.groupBy(*by).agg(
        F.avg(F.abs(F.col("forecast") - F.col("actual"))).alias("mae"), F.count(F.lit(1)).alias("n")
    )


def station_series(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per batch and station with its time-ordered points and scores.

    A series holds one batch horizon, so the array is bounded by horizon days
    times service hours.
    """
    point = F.struct("target_timestamp", "actual", "forecast", "local_hour", "lead_time_hours")
    nested = df.groupBy(*by, "station_id").agg(F.array_sort(F.collect_list(point)).alias("series"))
    return nested.join(score_station(df, by), [*by, "station_id"], "left")


def reconcile_stations(results: DataFrame, expected: DataFrame, by: Sequence[str]) -> DataFrame:
    """Station results per evaluation against the expected multiset of sample counts.

    Both sides are histograms of sample counts, so nothing is collected.
    """
    shape = results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("station_rows"),
        F.countDistinct("station_id").alias("stations"),
        F.count_if(~is_finite(F.col("rmse")) | (F.col("rmse") < 0) | (F.col("scored") <= 0)).alias("invalid"),
    )
    found = results.groupBy(*by, "scored").agg(F.count(F.lit(1)).alias("_found"))
    wanted = expected.groupBy(*by, "scored").agg(F.count(F.lit(1)).alias("_wanted"))
    off = (
        found.join(wanted, [*by, "scored"], "full_outer")
        .groupBy(*by)
        .agg(F.count_if(~F.col("_found").eqNullSafe(F.col("_wanted"))).alias("count_mismatches"))
    )
    good = (
        (F.col("station_rows") == F.col("stations")) & (F.col("invalid") == 0) & (F.col("count_mismatches") == 0)
    )
    return shape.join(off, list(by), "full_outer").withColumn("reconciled", F.coalesce(good, F.lit(False)))


def artifact_check(df: DataFrame, by: Sequence[str], forecast: str = "forecast") -> DataFrame:
    """Rows, stations, repeated keys and invalid values per published artifact."""
    keyed = df.groupBy(*by, "station_id", "target_timestamp").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~is_finite(F.col(forecast)) | (F.col(forecast) < 0)).alias("bad"),
    )
    out = keyed.groupBy(*by).agg(
        F.sum("n").alias("row_count"),
        F.countDistinct("station_id").alias("stations"),
        F.count_if(F.col("n") > 1).alias("repeated_keys"),
        F.sum("bad").alias("invalid_values"),
    )
    return out.withColumn("acceptable", (F.col("repeated_keys") == 0) & (F.col("invalid_values") == 0))


def candidate_summary(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per candidate: mean of its fold RMSEs and worst station RMSE over pooled folds.

    One aggregation to (candidate, fold, station) feeds both results, so raw
    predictions shuffle once.  A candidate with an invalid forecast is kept as
    failed, with a reason and no metrics.
    """
    candidate = [*by, "model_family", "candidate_id"]
    known = is_finite(F.col("actual"))
    error = F.when(known, at_least_zero(F.col("forecast")) - F.col("actual"))
    cells = predictions.groupBy(*candidate, "fold_id", "station_id").agg(
        F.sum(error * error).alias("sse"),
        F.count(error).alias("n"),
        F.count_if(~is_finite(F.col("forecast"))).alias("invalid"),
    )
    folds = cells.groupBy(*candidate, "fold_id").agg(
        F.sqrt(F.try_divide(F.sum("sse"), F.sum("n"))).alias("fold_rmse"), F.sum("invalid").alias("invalid")
    )
    means = folds.groupBy(*candidate).agg(
        F.avg("fold_rmse").alias("mean_rmse"),
        F.count(F.lit(1)).alias("folds"),
        F.count_if(F.col("fold_rmse").isNull()).alias("unscored"),
        F.sum("invalid").alias("invalid"),
    )
    worst = (
        cells.groupBy(*candidate, "station_id")
        .agg(F.sqrt(F.try_divide(F.sum("sse"), F.sum("n"))).alias("station_rmse"))
        .groupBy(*candidate)
        .agg(F.max("station_rmse").alias("worst_station_rmse"))
    )
    reason = F.when(F.col("invalid") > 0, "INVALID_FORECASTS").when(F.col("unscored") > 0, "FOLD_WITHOUT_LABELS")
    done = reason.isNull()
    return (
        means.join(worst, candidate)
        .withColumns({"failure_reason": reason, "completed": done})
        .withColumns({c: F.when(done, F.col(c)) for c in ("mean_rmse", "worst_station_rmse")})
        .drop("invalid", "unscored")
    )


SELECTION_ORDER = (
    "worst_station_rmse", "inference_latency_ms", "artifact_size_bytes", "mean_rmse", "candidate_id",
)


def select_champion(candidates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Within one percent of the best mean, the least by the fixed order of criteria.

    Both steps are aggregations (a minimum, then a minimum of a struct).
    """
    done = candidates.filter("completed")
    if by:
        best = done.groupBy(*by).agg(F.min("mean_rmse").alias("_best"))
        near = done.join(best, list(by))
    else:
        near = done.withColumn("_best", done.agg(F.min("mean_rmse")).scalar())
    near = near.filter(F.col("mean_rmse") <= F.col("_best") * SELECTION_BAND)
    rest = [c for c in candidates.columns if c not in (*by, *SELECTION_ORDER)]
    pick = F.min(F.struct(*SELECTION_ORDER, *rest)).alias("_pick")
    return near.groupBy(*by).agg(pick).select(*by, "_pick.*")


def best_per_family(candidates: DataFrame, selected: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per family the selected candidate if it belongs there, else the lowest mean."""
    mark = selected.select(*by, "candidate_id", "model_family", F.lit(True).alias("_sel"))
    done = candidates.filter("completed").join(
        mark, [*by, "candidate_id", "model_family"], "left"
    ).withColumn("selected", F.coalesce("_sel", F.lit(False)))
    order = F.struct((~F.col("selected")).alias("a"), F.col("mean_rmse").alias("b"), F.col("candidate_id").alias("c"))
    return done.groupBy(*by, "model_family").agg(
        F.min_by(F.struct("candidate_id", "mean_rmse", "worst_station_rmse", "selected"), order).alias("_p")
    ).select(*by, "model_family", "_p.*")


def family_columns(columns: Sequence[str], family: str) -> list[str]:
    """Feature columns of a family: exact names or name prefixes."""
    return [c for c in columns if any(c == p or c.startswith(p) for p in FEATURE_FAMILIES[family])]


def ablation_rank(results: DataFrame, base: str = "none") -> DataFrame:
    """RMSE of each ablated run against the full run, largest loss first."""
    full = results.filter(F.col("feature_family") == base).agg(F.max("overall_rmse")).scalar()
    runs = results.filter(F.col("feature_family") != base).withColumn("delta_rmse", F.col("overall_rmse") - full)
    # One row per feature family: a ranking over a fixed handful of rows.
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("delta_rmse"), "feature_family")
    return runs.withColumn("place", F.row_number().over(order))
