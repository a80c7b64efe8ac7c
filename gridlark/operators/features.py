"""Point-in-time feature table: lags and trailing calendar windows.

All lags and windows of one series family share one partitioning and one sort:
an exact calendar lag of n days is a RANGE frame from -n to -n, a trailing
window is a RANGE frame from -n to -1.  Every window partition is one
(entity, hour) series with at most one row per calendar day, because rows are
pre-aggregated to that grain, so no partition grows with the number of raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridlark.functions.calendar import CALENDAR_COLUMNS, with_calendar

# Fixed values.
PASSENGER_LAGS = (7, 14, 21, 28, 364)
TRAFFIC_LAGS = (7, 14, 28)
WINDOW_DAYS = (28, 56, 91)
CITY_STATISTICS = ("mean", "min", "max", "std")
#: Rows of a table that may go to every executor, each of some 150 bytes.
SENT_ROWS = 500_000


def lag_columns(value: str, keys: Sequence[str], days: Sequence[int], prefix: str) -> dict[str, Column]:
    """Value exactly n calendar days earlier, NULL where that day has no row or no value."""
    order = Window.partitionBy(*keys).orderBy(F.unix_date("local_date"))
    return {f"{prefix}_lag_{n}d": F.max(value).over(order.rangeBetween(-n, -n)) for n in days}


def window_columns(
    value: str,
    keys: Sequence[str],
    days: Sequence[int],
    prefix: str,
    statistics: Sequence[str] = ("mean", "median"),
) -> dict[str, Column]:
    """Mean and median over [day - n, day); an empty frame gives NULL."""
    order = Window.partitionBy(*keys).orderBy(F.unix_date("local_date"))
    out: dict[str, Column] = {}
    for n in days:
        frame = order.rangeBetween(-n, -1)
        if "mean" in statistics:
            out[f"{prefix}_mean_{n}d"] = F.avg(value).over(frame)
        if "median" in statistics:
            out[f"{prefix}_median_{n}d"] = F.percentile(value, F.lit(0.5)).over(frame)
    return out


def with_missing_flags(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{n}_missing": F.col(n).isNull().cast("byte") for n in names})


def series_features(
    history: DataFrame,
    targets: DataFrame,
    keys: Sequence[str],
    columns: dict[str, Column],
    values: Sequence[str],
) -> DataFrame:
    """Window columns at target keys that need not exist in the history.

    Target keys enter as rows without a value, so a frame never sees them; the
    history must already be cut at the origin.
    """
    grain = [*keys, "local_date"]
    past = history.select(*grain, *values, F.lit(False).alias("_target"))
    ahead = targets.select(*grain).distinct().select(
        *grain, *[F.lit(None).cast("double").alias(v) for v in values], F.lit(True).alias("_target")
    )
    return past.unionByName(ahead).withColumns(columns).filter("_target").select(*grain, *columns)


def passenger_features(
    history: DataFrame, targets: DataFrame, scope: Sequence[str] = ()
) -> DataFrame:
    keys = [*scope, "station_id", "local_hour"]
    columns = lag_columns("target", keys, PASSENGER_LAGS, "passenger") | window_columns(
        "target", keys, WINDOW_DAYS, "passenger"
    )
    found = series_features(history, targets, keys, columns, ["target"])
    return with_missing_flags(targets.join(found, [*keys, "local_date"], "left"), list(columns))


def passenger_features_in_place(rows: DataFrame, visible: str, scope: Sequence[str] = ()) -> DataFrame:
    """The same columns when the rows hold their whole history themselves.

    ``visible`` is the label where it is known at the origin and NULL after it, so
    one window pass over the rows replaces the union and the join back.
    """
    keys = [*scope, "station_id", "local_hour"]
    columns = lag_columns(visible, keys, PASSENGER_LAGS, "passenger") | window_columns(
        visible, keys, WINDOW_DAYS, "passenger"
    )
    return with_missing_flags(rows.withColumns(columns), list(columns))


def city_traffic(traffic: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Statistics over all sensors by local date and hour."""
    return traffic.groupBy(*scope, "local_date", "local_hour").agg(
        F.avg("traffic").alias("traffic_city_mean"),
        F.min("traffic").alias("traffic_city_min"),
        F.max("traffic").alias("traffic_city_max"),
        F.stddev_samp("traffic").alias("traffic_city_std"),
    )


def sensor_traffic(traffic: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """One row per sensor, local date and hour: the repeated autumn hour collapses here."""
    return traffic.groupBy(*scope, "sensor_id", "local_date", "local_hour").agg(
        F.avg("traffic").alias("traffic_nearest")
    )


def slot_keys(slots: DataFrame, mapping: DataFrame) -> DataFrame:
    """Every sensor of the mapping at every slot, in place of the keys that rows have: no pass over the rows."""
    return slots.crossJoin(F.broadcast(mapping.select("sensor_id").filter("sensor_id is not null").distinct()))


def sent(table: DataFrame) -> DataFrame:
    """A stored table, marked to go whole to every executor while it is small, else to be hashed by partition."""
    return F.broadcast(table) if table.count() <= SENT_ROWS else table.hint("shuffle_hash")


def traffic_tables(traffic: DataFrame, placed: DataFrame, scope: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Lags and windows of each sensor and of the whole city at the keys of ``placed``.

    The tables have 24 rows at most for each calendar day, fold and sensor, or city.
    """
    near_keys = [*scope, "sensor_id", "local_hour"]
    near_columns = lag_columns("traffic_nearest", near_keys, TRAFFIC_LAGS, "traffic_nearest") | (
        window_columns("traffic_nearest", near_keys, WINDOW_DAYS, "traffic_nearest")
    )
    near = series_features(
        sensor_traffic(traffic, scope), placed.filter("sensor_id is not null"), near_keys,
        near_columns, ["traffic_nearest"],
    )
    city_keys = [*scope, "local_hour"]
    city_values = [f"traffic_city_{s}" for s in CITY_STATISTICS]
    city_columns: dict[str, Column] = {}
    for value in city_values:
        city_columns |= lag_columns(value, city_keys, TRAFFIC_LAGS, value)
    city_columns |= window_columns("traffic_city_mean", city_keys, WINDOW_DAYS, "traffic_city")
    city = series_features(city_traffic(traffic, scope), placed, city_keys, city_columns, city_values)
    return near, city


def with_traffic(placed: DataFrame, near: DataFrame, city: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Rows that know their sensor with the columns of both tables."""
    near_keys, city_keys = [*scope, "sensor_id", "local_hour", "local_date"], [*scope, "local_hour", "local_date"]
    # The city table has 24 rows at most for each calendar day and fold: that bounds the broadcast.
    joined = placed.join(near, near_keys, "left").join(F.broadcast(city), city_keys, "left")
    return with_missing_flags(
        joined, [c for c in near.columns if c not in near_keys] + [c for c in city.columns if c not in city_keys]
    )


def traffic_features(
    traffic: DataFrame, targets: DataFrame, mapping: DataFrame, scope: Sequence[str] = ()
) -> DataFrame:
    """Lags and windows of the nearest sensor and of the whole city."""
    placed = targets.join(mapping, "station_id", "left")
    return with_traffic(placed, *traffic_tables(traffic, placed, scope), scope)


def weather_features(targets: DataFrame, weather: DataFrame) -> DataFrame:
    """Weather valid at the target instant; deliberately not cut at the origin."""
    values = weather.select("timestamp_utc", "temperature", "precipitation")
    joined = with_missing_flags(
        # One row for each calendar hour: that bounds the broadcast.
        targets.join(F.broadcast(values), "timestamp_utc", "left"), ("temperature", "precipitation")
    )
    rain = F.coalesce(F.col("precipitation"), F.lit(0.0)) > 0
    return joined.withColumn("rain_indicator", rain.cast("byte"))


STATION_COLUMNS = ("latitude", "longitude", "station_capacity", "interchange", "connectivity")


def station_features(targets: DataFrame, stations: DataFrame) -> DataFrame:
    return targets.join(stations.select("station_id", *STATION_COLUMNS), "station_id", "left")


def cut_at(df: DataFrame, origin: Column, instant: str = "timestamp_utc") -> DataFrame:
    """History known at the origin, the origin itself included."""
    return df.filter(F.col(instant) <= origin)


def build_features(
    targets: DataFrame,
    stations: DataFrame,
    passengers: DataFrame | str,
    weather: DataFrame,
    traffic: DataFrame,
    mapping: DataFrame,
    scope: Sequence[str] = (),
    tables: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """The full feature table; passenger and traffic histories arrive already cut.

    ``scope`` names extra leading keys (a fold) that histories and targets share.
    ``passengers`` is the history, or the name of the targets' column with the
    labels visible at the origin when the targets include their own history.
    ``tables`` are the traffic tables where the caller has stored them.
    """
    if isinstance(passengers, str):
        df = passenger_features_in_place(targets, passengers, scope).drop(passengers)
    else:
        df = passenger_features(passengers, targets, scope)
    # What is known of a station joins in the partitions of the windows, what is known of a slot where the rows are:
    # windows sort narrow rows, and wide ones stay in place.
    df = station_features(df, stations).join(mapping, "station_id", "left")
    df = weather_features(with_calendar(df), weather)
    near, city = tables or traffic_tables(traffic, df, scope)
    wide = with_traffic(df, near, city, scope).drop("sensor_id")
    lead = [*scope, "local_hour", "local_date", "station_id", "timestamp_utc"]
    lead += [c for c in targets.columns if c not in (*lead, passengers if isinstance(passengers, str) else None)]
    lead += [*CALENDAR_COLUMNS, *STATION_COLUMNS]
    rest = [c for c in wide.columns if c not in (*lead, "sensor_distance_km")]
    at = rest.index("rain_indicator") + 1
    return wide.select(*lead, *rest[:at], "sensor_distance_km", *rest[at:])


IDENTITY = ("timestamp_utc", "local_date", "target", "fold_id", "role", "origin", "position")


def feature_names(df: DataFrame) -> list[str]:
    """Ordered model inputs: every column that is not row identity."""
    return [c for c in df.columns if c not in IDENTITY]


def lineage_of(name: str) -> str:
    """Where a feature comes from and how it is kept safe in time."""
    if name.endswith("_missing"):
        return f"missingness indicator for {name.removesuffix('_missing')}"
    if name == "station_id":
        return "target station key"
    if name == "local_hour" or name in CALENDAR_COLUMNS:
        return "service calendar of the target instant"
    if name in STATION_COLUMNS:
        return "station metadata, descriptive"
    if name == "sensor_distance_km":
        return "great-circle distance to the nearest sensor"
    if name in ("temperature", "precipitation", "rain_indicator"):
        return "weather valid at the target instant"
    if "_lag_" in name:
        return "same key and hour at the exact calendar lag, not after the origin"
    return "same key and hour over the trailing window before the target, not after the origin"


def feature_registry(df: DataFrame, version: str = "1.0.0") -> DataFrame:
    """Ordered schema rows with lineage and one stable hash over all of them.

    Only column names pass through here, never data.
    """
    session = df.sparkSession
    rows = [(i, n, n == "station_id", lineage_of(n)) for i, n in enumerate(feature_names(df))]
    table = session.createDataFrame(
        rows, "position int, feature string, categorical boolean, lineage string"
    )
    whole = table.agg(
        F.sha2(
            F.concat(
                F.lit(version),
                F.to_json(
                    F.array_sort(F.collect_list(F.struct("position", "feature", "categorical", "lineage")))
                ),
            ),
            256,
        ).alias("schema_hash")
    )
    return table.withColumns(
        {"schema_version": F.lit(version), "schema_hash": whole.scalar()}
    )
