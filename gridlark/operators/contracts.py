"""Table contracts. Checks return rows that break a rule; nothing raises mid-plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridlark.functions.calendar import SERVICE_HOURS, has_offset, parse_instant, with_local_keys
from gridlark.functions.geo import sensor_key
from gridlark.functions.hashing import DIGEST_PATTERN
from gridlark.functions.numeric import half_up_exact, is_finite, is_whole, lenient_number

# Accepted header names per canonical column, best first.
HEADER_NAMES: dict[str, tuple[str, ...]] = {
    "timestamp": ("timestamp", "datetime", "date_time", "time"),
    "station_id": ("station_id", "station", "id"),
    "target": ("target", "passengers", "passenger_count", "passenger_counts", "entries"),
    "latitude": ("latitude", "lat"),
    "longitude": ("longitude", "lon", "lng"),
    "station_name": ("station_name", "name"),
    "station_capacity": ("station_capacity", "capacity"),
    "interchange": ("interchange", "is_interchange", "transfer_station"),
    "connectivity": ("connectivity", "connectivity_score", "connections", "num_connections"),
    "temperature": ("temperature", "temperature_c", "temp", "temp_c"),
    "precipitation": ("precipitation", "precipitation_mm", "precip_mm", "rainfall", "precip"),
    "traffic": ("traffic", "traffic_index", "traffic_volume", "vehicle_count", "count"),
}


class ContractError(ValueError):
    """A table lacks columns it cannot do without."""


def find_header(columns: Sequence[str], names: Sequence[str]) -> str | None:
    """First accepted name present, ignoring case and outer blanks."""
    present = {column.strip().lower(): column for column in columns}
    return next((present[name] for name in names if name in present), None)


def canonical(
    df: DataFrame,
    required: Sequence[str],
    optional: Mapping[str, Column] | None = None,
    names: Mapping[str, Sequence[str]] = HEADER_NAMES,
) -> DataFrame:
    """Projection onto canonical names; absent optional columns get their default."""
    chosen: list[Column] = []
    for field in required:
        found = find_header(df.columns, names[field])
        if found is None:
            raise ContractError(f"no column for {field}; accepted: {', '.join(names[field])}")
        chosen.append(F.col(f"`{found}`").alias(field))
    for field, default in (optional or {}).items():
        found = find_header(df.columns, names[field])
        chosen.append((F.col(f"`{found}`") if found is not None else default).alias(field))
    return df.select(*chosen)


def truth(text: Column) -> Column:
    """Explicit reading of a flag: the words for yes are true, all else false."""
    return F.coalesce(F.lower(F.trim(text.cast("string"))).isin("true", "1", "yes", "t", "y"), F.lit(False))


def stations_table(raw: DataFrame) -> DataFrame:
    df = canonical(
        raw,
        ("station_id", "latitude", "longitude"),
        {
            "station_name": F.lit(""),
            "station_capacity": F.lit(None).cast("double"),
            "interchange": F.lit(False),
            "connectivity": F.lit(0.0),
        },
    )
    return df.select(
        F.col("station_id").cast("string").alias("station_id"),
        F.col("station_name").cast("string").alias("station_name"),
        F.col("latitude").cast("double").alias("latitude"),
        F.col("longitude").cast("double").alias("longitude"),
        lenient_number(F.col("station_capacity").cast("string")).alias("station_capacity"),
        truth(F.col("interchange")).alias("interchange"),
        lenient_number(F.col("connectivity").cast("string")).alias("connectivity"),
    )


def _instants(df: DataFrame, zone: str) -> DataFrame:
    return with_local_keys(
        df.withColumn("timestamp_utc", parse_instant(F.col("timestamp").cast("string"))), zone
    )


def passengers_table(raw: DataFrame, zone: str) -> DataFrame:
    df = _instants(canonical(raw, ("timestamp", "station_id", "target")), zone)
    return df.select(
        "timestamp_utc",
        "local_date",
        "local_hour",
        F.col("station_id").cast("string").alias("station_id"),
        lenient_number(F.col("target").cast("string")).alias("target"),
    )


def traffic_table(raw: DataFrame, zone: str) -> DataFrame:
    df = _instants(canonical(raw, ("timestamp", "latitude", "longitude", "traffic")), zone)
    df = df.withColumns(
        {c: lenient_number(F.col(c).cast("string")) for c in ("latitude", "longitude", "traffic")}
    )
    return df.select(
        "timestamp_utc",
        "local_date",
        "local_hour",
        F.when(F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), sensor_key(F.col("latitude"), F.col("longitude"))).alias("sensor_id"),
        "latitude",
        "longitude",
        "traffic",
    )


def weather_table(raw: DataFrame, zone: str) -> DataFrame:
    df = _instants(canonical(raw, ("timestamp", "temperature", "precipitation")), zone)
    return df.select(
        "timestamp_utc",
        "local_date",
        "local_hour",
        lenient_number(F.col("temperature").cast("string")).alias("temperature"),
        lenient_number(F.col("precipitation").cast("string")).alias("precipitation"),
    )


def offset_rule(text: Column) -> Column:
    """Reason a timestamp text is refused, NULL when it is fine."""
    return (
        F.when(text.isNull(), "TIMESTAMP_NULL")
        .when(~has_offset(text), "OFFSET_MISSING")
        .when(parse_instant(text).isNull(), "TIMESTAMP_MALFORMED")
    )


def station_rules() -> dict[str, Column]:
    """Domain rules: a row breaks a rule where its predicate is true."""
    lat, lon = F.col("latitude"), F.col("longitude")
    return {
        "IDENTITY_NULL": F.col("station_id").isNull() | lat.isNull() | lon.isNull(),
        "LATITUDE_RANGE": ~lat.between(-90, 90),
        "LONGITUDE_RANGE": ~lon.between(-180, 180),
    }


def passenger_rules() -> dict[str, Column]:
    target = F.col("target")
    return {"TARGET_NEGATIVE": target < 0, "TARGET_NOT_WHOLE": ~is_whole(target)}


def traffic_rules() -> dict[str, Column]:
    return {
        "COORDINATES_NULL": F.col("latitude").isNull() | F.col("longitude").isNull(),
        "TRAFFIC_NEGATIVE": F.col("traffic") < 0,
    }


def weather_rules() -> dict[str, Column]:
    return {"PRECIPITATION_NEGATIVE": F.col("precipitation") < 0}


def forecast_record_rules() -> dict[str, Column]:
    """Row contract of one forecast record."""
    hashes = ("source_hash", "model_hash", "config_hash")
    lead = (F.unix_micros("target_timestamp") - F.unix_micros("origin")) / 3.6e9
    value = F.col("forecast_continuous")
    return {
        "ROLE_UNKNOWN": ~F.col("model_role").isin("champion", "seasonal_naive_fallback"),
        "STATUS_UNKNOWN": ~F.col("batch_status").isin("healthy", "degraded"),
        "LEAD_NOT_POSITIVE": F.col("lead_time_hours") <= 0,
        "LEAD_INCONSISTENT": F.abs(lead - F.col("lead_time_hours")) > 1e-9,
        "FORECAST_INVALID": ~is_finite(value) | (value < 0),
        "ROUNDING_INCONSISTENT": is_finite(value) & (half_up_exact(value) != F.col("forecast_count")),
        **{f"{name.upper()}_INVALID": ~F.col(name).rlike(DIGEST_PATTERN) for name in hashes},
    }


def broken_rules(rules: Mapping[str, Column]) -> Column:
    """Array of the names of the rules a row breaks."""
    return F.array_compact(F.array(*[F.when(F.coalesce(p, F.lit(False)), n) for n, p in rules.items()]))


def violations(df: DataFrame, rules: Mapping[str, Column], keep: Sequence[str]) -> DataFrame:
    """One row per broken rule."""
    hit = df.withColumn("_rules", broken_rules(rules)).filter(F.size("_rules") > 0)
    return hit.select(*keep, F.explode("_rules").alias("rule"))


def rule_counts(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """One row per rule with the number of rows breaking it, zeros included; one pass."""
    one = df.agg(*[F.count_if(F.coalesce(p, F.lit(False))).alias(n) for n, p in rules.items()])
    return one.select(
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("broken")) for n in rules])
        ).alias("r")
    ).select("r.*")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, with the number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def missing_hours(df: DataFrame, keys: Sequence[str], instant: str = "timestamp_utc") -> DataFrame:
    """Hours absent between the first and last instant of each group (UTC, DST safe)."""
    seen = df.select(*keys, instant).distinct()
    bounds = seen.groupBy(*keys).agg(F.min(instant).alias("_lo"), F.max(instant).alias("_hi"))
    spine = bounds.select(
        *keys, F.explode(F.expr("sequence(_lo, _hi, interval 1 hour)")).alias(instant)
    )
    return spine.join(seen, [*keys, instant], "left_anti")


def orphans(facts: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Distinct fact keys without a dimension row."""
    return facts.select(key).distinct().join(dimension.select(key), key, "left_anti")


def uncovered(df: DataFrame, cover: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key has no row in ``cover``."""
    return df.join(cover.select(*keys).distinct(), list(keys), "left_anti")


def lookup(facts: DataFrame, dimension: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Many-to-one left join and the check rows that break it.

    The second frame lists dimension keys that repeat and fact keys without a
    match; an empty frame means the join kept one row per fact.
    """
    names = list(key)
    doubled = duplicate_keys(dimension, names).select(*names, F.lit("KEY_REPEATED").alias("problem"))
    lost = (
        facts.select(*names)
        .distinct()
        .join(dimension.select(*names), names, "left_anti")
        .select(*names, F.lit("KEY_UNMATCHED").alias("problem"))
    )
    return facts.join(dimension, names, "left"), doubled.unionByName(lost)


def panel_audit(
    passengers: DataFrame, stations: DataFrame, traffic: DataFrame, weather: DataFrame
) -> DataFrame:
    """Dataset facts as (fact, value) rows.

    Distinct counts are taken over (entity, date) groups, so the expansion that
    several distinct counts need runs on the grouped rows only.
    """
    by_station = passengers.groupBy("station_id", "local_date").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("target").isNull()).alias("nulls")
    )
    facts_p = by_station.agg(
        F.sum("n").alias("passenger_rows"),
        F.countDistinct("station_id").alias("stations"),
        F.countDistinct("local_date").alias("dates"),
        F.sum("nulls").alias("null_targets"),
    )
    capacity = stations.select("station_id", "station_capacity")
    facts_c = passengers.join(capacity, "station_id").agg(
        F.count_if(F.col("target") > F.col("station_capacity")).alias("capacity_exceedances")
    )
    facts_s = stations.agg(F.count(F.lit(1)).alias("station_rows"))
    by_sensor = traffic.groupBy("sensor_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("traffic").isNull()).alias("nulls")
    )
    facts_t = by_sensor.agg(
        F.sum("n").alias("traffic_rows"),
        F.count(F.lit(1)).alias("sensors"),
        F.sum("nulls").alias("traffic_nulls"),
    )
    facts_w = weather.agg(
        F.count(F.lit(1)).alias("weather_rows"),
        F.count_if(F.col("temperature").isNull()).alias("temperature_nulls"),
        F.count_if(F.col("precipitation").isNull()).alias("precipitation_nulls"),
    )
    parts = [melt(part, [], "fact", "value") for part in (facts_p, facts_c, facts_s, facts_t, facts_w)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def melt(df: DataFrame, ids: Sequence[str], name: str, value: str) -> DataFrame:
    """Wide to long over all other columns."""
    columns = [c for c in df.columns if c not in ids]
    return df.unpivot(list(ids), columns, name, value)


def facts_gate(observed: DataFrame, expected: DataFrame, key: str = "fact") -> DataFrame:
    """Full outer comparison of two (key, value) tables with a status per key."""
    both = observed.withColumnRenamed("value", "observed").join(
        expected.withColumnRenamed("value", "expected"), key, "full_outer"
    )
    status = (
        F.when(F.col("observed").isNull(), "MISSING")
        .when(F.col("expected").isNull(), "EXTRA")
        .when(F.col("observed") != F.col("expected"), "DIFFERENT")
        .otherwise("OK")
    )
    return both.withColumn("status", status)


def rows_per_date(df: DataFrame, expected: Column | int) -> DataFrame:
    """Dates whose row count differs from the expected one."""
    wanted = expected if isinstance(expected, Column) else F.lit(expected)
    return (
        df.groupBy("local_date")
        .agg(F.count(F.lit(1)).alias("found"))
        .filter(F.col("found") != wanted)
    )


def hour_set(df: DataFrame, hours: Sequence[int] = SERVICE_HOURS) -> DataFrame:
    """Distinct local hours of the panel and whether they are exactly the service hours."""
    wanted = F.array(*[F.lit(h).cast("short") for h in sorted(hours)])
    found = df.agg(F.array_sort(F.collect_set("local_hour")).alias("hours"))
    return found.withColumn("complete", F.col("hours") == wanted)


def set_difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Symmetric difference of two key sets, tagged by side."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    missing = a.join(b, list(keys), "left_anti").withColumn("side", F.lit("left_only"))
    extra = b.join(a, list(keys), "left_anti").withColumn("side", F.lit("right_only"))
    return missing.unionByName(extra)


def schema_rows(df: DataFrame) -> DataFrame:
    """Ordered (position, column, type) rows of a frame's schema."""
    session = df.sparkSession
    rows = [(i, name, kind) for i, (name, kind) in enumerate(df.dtypes)]
    return session.createDataFrame(rows, "position int, column_name string, data_type string")


def schema_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Positions at which two ordered schemas differ."""
    a = schema_rows(left).selectExpr("position", "column_name as left_name", "data_type as left_type")
    b = schema_rows(right).selectExpr("position", "column_name as right_name", "data_type as right_type")
    same = F.col("left_name").eqNullSafe(F.col("right_name")) & F.col("left_type").eqNullSafe(
        F.col("right_type")
    )
    return a.join(b, "position", "full_outer").filter(~same)


def opaque_reference(text: Column) -> Column:
    """True for a reference that is no absolute path and has no parent step."""
    parts = F.split(F.regexp_replace(text, r"\\", "/"), "/")
    return ~text.startswith("/") & ~text.rlike(r"^[A-Za-z]:") & ~F.array_contains(parts, "..")


def locator_consistent(source: str) -> Column:
    """Attachment sources carry an id; subject and body carry no locator at all."""
    part = lambda name: F.col(f"{source}.{name}")
    located = F.lit(False)
    for name in ("attachment_id", "page", "slide", "sheet", "row", "cell"):
        located = located | part(name).isNotNull()
    return F.when(part("kind") == "attachment", part("attachment_id").isNotNull()).otherwise(~located)
