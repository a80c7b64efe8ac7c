"""Forecast batches: records, contract, serving decision, fallback."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridlark.functions.calendar import HORIZON_DAYS, SERVICE_HOURS, lead_hours
from gridlark.functions.hashing import digest
from gridlark.functions.numeric import at_least_zero, half_up, is_finite
from gridlark.operators.folds import target_grid

# Fixed values.
RECORD_COLUMNS = (
    "batch_id", "origin", "target_timestamp", "station_id", "lead_time_hours", "forecast_continuous",
    "forecast_count", "model_role", "batch_status", "source_hash", "model_hash", "config_hash",
)
CHAMPION, FALLBACK = "champion", "seasonal_naive_fallback"
HEALTHY, DEGRADED = "healthy", "degraded"


def batch_identity(origin: Column, source_hash: Column, model_hash: Column, config_hash: Column) -> Column:
    """Batch id from the four inputs that determine a batch."""
    return digest(
        {
            "origin": F.date_format(origin, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
            "source_snapshots": source_hash,
            "model_artifact_hash": model_hash,
            "feature_config_hash": config_hash,
        }
    )


def forecast_records(df: DataFrame, forecast: str = "forecast") -> DataFrame:
    """Record columns from a frame that already holds keys, origin, role and hashes."""
    value = at_least_zero(F.col(forecast).cast("double"))
    return df.withColumns(
        {
            "lead_time_hours": lead_hours(F.col("target_timestamp"), F.col("origin")),
            "forecast_continuous": value,
            "forecast_count": half_up(value),
        }
    ).select(*RECORD_COLUMNS)


def serving_decision(
    states: DataFrame, by: Sequence[str] = ("batch_id",), artifact_valid: str | None = None
) -> DataFrame:
    """Role, status and reasons per batch from the health of its sources.

    Any unhealthy critical source blocks; any unhealthy optional source or an
    invalid champion artifact falls back.  Reasons come from the fixed list of
    sources, so the collected arrays stay small.
    """
    healthy = F.col("available") & F.col("valid")
    bad_critical = F.when(F.col("critical") & ~healthy, F.col("name"))
    bad_optional = F.when(~F.col("critical") & ~healthy, F.concat(F.lit("optional_source_unavailable:"), "name"))
    artifact = F.bool_and(F.col(artifact_valid)) if artifact_valid else F.lit(True)
    found = states.groupBy(*by).agg(
        F.array_sort(F.collect_set(bad_critical)).alias("_critical"),
        F.array_sort(F.collect_set(bad_optional)).alias("_optional"),
        artifact.alias("_artifact"),
    )
    reasons = F.array_compact(
        F.concat("_optional", F.array(F.when(~F.col("_artifact"), "champion_artifact_invalid")))
    )
    blocked = F.size("_critical") > 0
    return (
        found.withColumn("_reasons", F.when(blocked, F.col("_critical")).otherwise(reasons))
        .withColumns(
            {
                "model_role": F.when(blocked, F.lit(None)).when(F.size("_reasons") > 0, FALLBACK).otherwise(CHAMPION),
                "batch_status": F.when(blocked, "blocked").when(F.size("_reasons") > 0, DEGRADED).otherwise(HEALTHY),
                "reasons": F.col("_reasons"),
            }
        )
        .select(*by, "model_role", "batch_status", "reasons")
    )


def champion_or_fallback(
    grid: DataFrame,
    by: Sequence[str] = ("batch_id",),
    champion: str = "champion_forecast",
    fallback: str = "fallback_forecast",
) -> DataFrame:
    """One bad champion row turns its whole batch to the fallback; a bad fallback blocks it."""
    verdict = grid.groupBy(*by).agg(
        F.bool_and(is_finite(F.col(champion))).alias("_c"), F.bool_and(is_finite(F.col(fallback))).alias("_f")
    )
    # One row of two booleans for each batch, of which a calendar has few.
    joined = grid.join(F.broadcast(verdict), list(by))
    role = F.when(F.col("_c"), CHAMPION).when(F.col("_f"), FALLBACK)
    return joined.withColumns(
        {
            "model_role": role,
            "batch_status": F.when(F.col("_c"), HEALTHY).when(F.col("_f"), DEGRADED).otherwise("blocked"),
            "forecast": F.when(F.col("_c"), F.col(champion)).when(F.col("_f"), F.col(fallback)),
        }
    ).drop("_c", "_f")


def expected_grid(
    records: DataFrame, stations: DataFrame, zone: str, days: int = HORIZON_DAYS, hours: Sequence[int] = SERVICE_HOURS
) -> DataFrame:
    """What each batch must hold by its origin: every station, the next ``days`` local dates, the service hours."""
    origins = records.groupBy("batch_id").agg(F.min("origin").alias("origin")).withColumn("_one", F.lit(1))
    wanted = stations.select("station_id", F.lit(1).alias("_one")).join(origins, "_one")
    grid = target_grid(wanted, F.col("origin"), zone, days, tuple(hours), keep=("batch_id",))
    return grid.select("batch_id", "station_id", "local_date", "local_hour")


PARTS = ("origin", "model_role", "batch_status")


def _cells(records: DataFrame) -> DataFrame:
    """Records by batch, station, date and hour: how many, how many bad, and the range of what a batch must agree on."""
    value = F.col("forecast_continuous")
    invalid = ~is_finite(value) | (value < 0)
    return records.groupBy("batch_id", "station_id", "local_date", "local_hour").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(invalid).alias("bad"),
        F.count_if(~F.coalesce(half_up(value) == F.col("forecast_count"), F.lit(False))).alias("unrounded"),
        *[F.min(c).alias(f"lo_{c}") for c in PARTS],
        *[F.max(c).alias(f"hi_{c}") for c in PARTS],
    )


def _judged(cells: DataFrame, hours: Sequence[int], expected: Column) -> DataFrame:
    """The contract of cells that know whether they are held (_have) and wanted (_want); ``expected`` is the batch's number of wanted cells."""
    day = cells.groupBy("batch_id", "station_id", "local_date").agg(
        F.count("_have").alias("have"), F.count("_want").alias("want"),
        F.count(F.when(F.col("_want").isNotNull(), F.col("_have"))).alias("inside"),
        F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("unrounded").alias("unrounded"),
        F.count_if(F.col("n") > 1).alias("doubled"), F.count_if(F.col("_want").isNull()).alias("extra"),
        *[F.min(f"lo_{c}").alias(f"lo_{c}") for c in PARTS],
        *[F.max(f"hi_{c}").alias(f"hi_{c}") for c in PARTS],
    )
    batch = day.groupBy("batch_id").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), expected.alias("expected_rows"),
        F.count_if(F.col("have") == len(hours)).alias("full_station_days"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("unrounded"), F.lit(0)).alias("unrounded"),
        F.sum("doubled").alias("doubled"), F.sum("inside").alias("inside"), F.sum("extra").alias("extra"),
        *[(~F.min(f"lo_{c}").eqNullSafe(F.max(f"hi_{c}"))).alias(f"mixed_{c}") for c in PARTS],
    )
    code = lambda hit, name: F.when(hit, name)
    problems = F.array_compact(
        F.array(
            code(F.col("row_count") != F.col("expected_rows"), "ROW_COUNT"),
            code(F.col("doubled") > 0, "KEY_REPEATED"),
            code(F.col("inside") < F.col("expected_rows"), "GRID_CELLS_MISSING"),
            code(F.col("extra") > 0, "OUTSIDE_GRID"),
            code(F.col("bad") > 0, "FORECAST_INVALID"),
            code(F.col("unrounded") > 0, "ROUNDING"),
            code(F.col("mixed_origin"), "MIXED_ORIGIN"),
            code(F.col("mixed_model_role") | F.col("mixed_batch_status"), "MIXED_ROLE_OR_STATUS"),
        )
    )
    return batch.select("batch_id", "row_count", "expected_rows", "full_station_days", problems.alias("problems")).withColumn(
        "publishable", F.size("problems") == 0
    )


def batch_contract(records: DataFrame, grid: DataFrame, hours: Sequence[int] = SERVICE_HOURS) -> DataFrame:
    """One row per batch with the parts of the contract it breaks.

    ``records`` carry local_date and local_hour; ``grid`` is any expected
    (batch_id, station_id, local_date, local_hour) set, see :func:`expected_grid`.  Rows first shrink to
    station-days, then to batches, so no batch is ever gathered.
    """
    keys = ["batch_id", "station_id", "local_date", "local_hour"]
    mark = grid.select(*keys, F.lit(1).alias("_want"))
    both = _cells(records).withColumn("_have", F.lit(1)).join(mark, keys, "full_outer")
    return _judged(both, hours, F.sum("want"))


def origin_contract(
    records: DataFrame, stations: DataFrame, zone: str, days: int = HORIZON_DAYS, hours: Sequence[int] = SERVICE_HOURS
) -> DataFrame:
    """:func:`batch_contract` against the grid of each batch's origin, without building it.

    A cell is wanted if its station is known and its date and hour lie in the
    horizon of the batch's first origin; how many cells are wanted is stations
    times days times hours.  Repeated stations count once.
    """
    known = stations.filter("station_id is not null").select("station_id").distinct()
    wanted = known.agg(F.count(F.lit(1)) * (days * len(hours))).scalar()
    origins = records.groupBy("batch_id").agg(F.min("origin").alias("_origin"))
    first = F.date_add(F.to_date(F.from_utc_timestamp("_origin", zone)), 1)
    due = F.col("local_date").between(first, F.date_add(first, days - 1)) & F.col("local_hour").isin(*hours)
    cells = (
        _cells(records).withColumn("_have", F.lit(1))
        .join(origins, "batch_id").join(known.withColumn("_known", F.lit(1)), "station_id", "left")
        .withColumn("_want", F.when(due, F.col("_known")))
    )
    return _judged(cells, hours, F.max(wanted))
