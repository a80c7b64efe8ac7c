"""Panel queries: baselines, contracts, calendar, features, folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from gridlark.functions import calendar as cal, numeric as num
from gridlark.functions.geo import sensor_key
from gridlark.functions.hashing import table_fingerprint
from gridlark.operators import baselines, contracts, evaluation, features, folds, spatial
from gridlark.plans import derive as dv
from gridlark.plans.registry import register
from gridlark.session import keep_methods_small, materialize
from gridlark.sources.tables import read_shared as table

FOLD_HISTORY_SQL = """fold_rows AS (
  SELECT f.fold_id, f.origin, p.*, CASE WHEN p.local_date < f.start_date THEN 'train' ELSE 'validation' END AS role
  FROM panel p JOIN folds f ON p.local_date <= f.end_date),
history AS (SELECT f.fold_id, p.* FROM panel p JOIN folds f ON p.timestamp_utc <= f.origin),
known AS (SELECT *, isodow(local_date) - 1 AS weekday FROM history WHERE target IS NOT NULL),
m_detail AS (SELECT fold_id, station_id, weekday, local_hour, MEDIAN(target) AS m FROM known GROUP BY ALL),
m_hour AS (SELECT fold_id, station_id, local_hour, MEDIAN(target) AS m FROM known GROUP BY ALL),
m_station AS (SELECT fold_id, station_id, MEDIAN(target) AS m FROM known GROUP BY ALL),
m_all AS (SELECT fold_id, MEDIAN(target) AS m FROM known GROUP BY ALL),
based AS (
  SELECT t.fold_id, t.station_id, t.local_date, t.local_hour, t.target AS actual,
         GREATEST(COALESCE(d.m, h.m, s.m, a.m), 0) AS median_forecast,
         GREATEST(COALESCE(l.target, d.m, h.m, s.m, a.m), 0) AS seasonal_forecast,
         l.target IS NULL AS used_fallback
  FROM fold_rows t
  LEFT JOIN history l ON l.fold_id = t.fold_id AND l.station_id = t.station_id
       AND l.local_hour = t.local_hour AND l.local_date = t.local_date - 7
  LEFT JOIN m_detail d ON d.fold_id = t.fold_id AND d.station_id = t.station_id
       AND d.weekday = isodow(t.local_date) - 1 AND d.local_hour = t.local_hour
  LEFT JOIN m_hour h ON h.fold_id = t.fold_id AND h.station_id = t.station_id AND h.local_hour = t.local_hour
  LEFT JOIN m_station s ON s.fold_id = t.fold_id AND s.station_id = t.station_id
  LEFT JOIN m_all a ON a.fold_id = t.fold_id
  WHERE t.role = 'validation')"""


def _folds(spark: SparkSession, folder: str):
    return folds.FoldWindows(dv.last_day(spark, folder), dv.ZONE)


def _fold_baselines(spark: SparkSession, folder: str) -> DataFrame:
    """Validation rows of all folds with both baselines, each fold cut at its own origin."""
    windows = _folds(spark, folder)
    panel = materialize(dv.panel(spark, folder))  # targets, history and every median level read it
    targets = folds.fold_rows(panel, windows).filter("role = 'validation'").drop("role", "start_date", "end_date")
    history = features.cut_at(folds.expand_folds(panel, windows), F.col("origin")).select(
        "fold_id", "station_id", "local_date", "local_hour", "target"
    )
    done = baselines.seasonal_naive(targets.drop("origin"), history, ["fold_id"])
    return done.withColumnRenamed("target", "actual")


@register(
    "seasonal_naive_eval",
    dv.with_ctes(
        dv.PANEL_SQL, dv.FOLDS_SQL, FOLD_HISTORY_SQL,
        final="""SELECT fold_id, station_id, ROUND(SQRT(AVG((seasonal_forecast - actual) ** 2)), 6) AS rmse,
  ROUND(AVG(seasonal_forecast - actual), 6) AS bias, COUNT(actual) AS scored,
  ROUND(SQRT(AVG((median_forecast - actual) ** 2)), 6) AS median_rmse
FROM based GROUP BY ALL HAVING COUNT(actual) > 0""",
    ),
)
def seasonal_naive_eval(spark: SparkSession, folder: str) -> DataFrame:
    based = _fold_baselines(spark, folder)
    error = num.at_least_zero(F.col("seasonal_forecast")) - F.col("actual")
    median_error = num.at_least_zero(F.col("median_forecast")) - F.col("actual")
    return (
        based.groupBy("fold_id", "station_id")
        .agg(
            F.round(evaluation.rmse(error), 6).alias("rmse"),
            F.round(F.avg(error), 6).alias("bias"),
            F.count("actual").alias("scored"),
            F.round(evaluation.rmse(median_error), 6).alias("median_rmse"),
        )
        .filter("scored > 0")
    )


@register(
    "seasonal_naive_rows",
    dv.with_ctes(
        dv.PANEL_SQL, dv.FOLDS_SQL, FOLD_HISTORY_SQL,
        final="""SELECT fold_id, station_id, strftime(local_date, '%Y-%m-%d') AS local_date, local_hour, actual,
  median_forecast, seasonal_forecast, used_fallback FROM based""",
    ),
)
def seasonal_naive_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _fold_baselines(spark, folder).select(
        "fold_id", "station_id", dv.text_day("local_date").alias("local_date"), "local_hour", "actual",
        "median_forecast", "seasonal_forecast", "used_fallback",
    )


@register(
    "three_way_eval",
    dv.with_ctes(
        dv.PANEL_SQL, dv.FOLDS_SQL, FOLD_HISTORY_SQL,
        final="""SELECT fold_id, model, ROUND(SQRT(AVG((forecast - actual) ** 2)), 6) AS rmse,
  ROUND(AVG(forecast - actual), 6) AS bias, COUNT(actual) AS scored, COUNT(*) AS forecasts,
  ROUND(COUNT(actual) / COUNT(*), 6) AS coverage
FROM (SELECT fold_id, actual, 'seasonal_naive' AS model, seasonal_forecast AS forecast FROM based
  UNION ALL SELECT fold_id, actual, 'historical_median', median_forecast FROM based
  UNION ALL SELECT fold_id, actual, 'blend', (seasonal_forecast + median_forecast) / 2 FROM based)
GROUP BY ALL""",
    ),
)
def three_way_eval(spark: SparkSession, folder: str) -> DataFrame:
    based = _fold_baselines(spark, folder).withColumn(
        "blend", (F.col("seasonal_forecast") + F.col("median_forecast")) / 2
    )
    models = {"seasonal_naive": "seasonal_forecast", "historical_median": "median_forecast", "blend": "blend"}
    out = evaluation.score_models(based, models, ["fold_id"])
    return out.select(
        "fold_id", "model", F.round("rmse", 6).alias("rmse"), F.round("bias", 6).alias("bias"), "scored",
        "forecasts", F.round("coverage", 6).alias("coverage"),
    )


@register(
    "error_hotspots",
    dv.with_ctes(
        dv.PANEL_SQL, dv.BATCHES_SQL,
        final="""SELECT local_hour, ROUND(AVG(ABS(forecast_continuous - actual)), 6) AS mae, COUNT(*) AS n
FROM batches WHERE actual IS NOT NULL GROUP BY 1""",
    ),
)
def error_hotspots(spark: SparkSession, folder: str) -> DataFrame:
    rows = dv.batches(spark, folder).withColumnRenamed("forecast_continuous", "forecast")
    out = evaluation.error_hotspots(rows, ["local_hour"])
    return out.select("local_hour", F.round("mae", 6).alias("mae"), "n")


# ---- contracts and audits -------------------------------------------------

SNAPSHOT_SQL = """
SELECT 'orders' AS source, COUNT(*) AS row_count, strftime(MAX(o_orderdate), '%Y-%m-%d %H:%M:%S') AS watermark FROM orders
UNION ALL SELECT 'lineitem', COUNT(*), strftime(MAX(l_shipdate), '%Y-%m-%d %H:%M:%S') FROM lineitem
UNION ALL SELECT 'events', COUNT(*), strftime(MAX(ts), '%Y-%m-%d %H:%M:%S') FROM events
UNION ALL SELECT 'supplier', COUNT(*), NULL FROM supplier"""

SOURCE_CLOCKS = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts", "supplier": None}


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, newest instant and content sum per source, one pass each."""
    out = None
    for name, clock in SOURCE_CLOCKS.items():
        df = table(spark, folder, name)
        newest = F.max(clock).cast("timestamp") if clock else F.lit(None).cast("timestamp")
        part = df.agg(
            F.count(F.lit(1)).alias("row_count"), newest.alias("watermark"),
            F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")).cast("string").alias("content_sum"),
        ).withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@register("source_snapshot", SNAPSHOT_SQL)
def source_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    out = snapshots(spark, folder)
    return out.select("source", "row_count", dv.text_time("watermark").alias("watermark"))


@register(
    "fingerprint_gate",
    """WITH observed AS (SELECT o_orderpriority AS fact, COUNT(*) AS value FROM orders GROUP BY 1),
expected AS (SELECT o_orderpriority AS fact, COUNT(*) AS value FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW' GROUP BY 1
  UNION ALL SELECT c_mktsegment, COUNT(*) FROM customer GROUP BY 1)
SELECT fact, o.value AS observed, e.value AS expected,
  CASE WHEN o.value IS NULL THEN 'MISSING' WHEN e.value IS NULL THEN 'EXTRA' WHEN o.value <> e.value THEN 'DIFFERENT' ELSE 'OK' END AS status
FROM observed o FULL OUTER JOIN expected e USING (fact)""",
)
def fingerprint_gate(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    count = F.count(F.lit(1)).alias("value")
    observed = orders.groupBy(F.col("o_orderpriority").alias("fact")).agg(count)
    expected = (
        orders.filter("o_orderstatus <> 'P' and o_orderpriority <> '5-LOW'")
        .groupBy(F.col("o_orderpriority").alias("fact"))
        .agg(count)
        .unionByName(table(spark, folder, "customer").groupBy(F.col("c_mktsegment").alias("fact")).agg(count))
    )
    return contracts.facts_gate(observed, expected)


@register(
    "dataset_audit",
    dv.with_ctes(
        *dv.PANEL_WORLD,
        final="""SELECT 'passenger_rows' AS fact, COUNT(*) AS value FROM panel
UNION ALL SELECT 'stations', COUNT(DISTINCT station_id) FROM panel
UNION ALL SELECT 'dates', COUNT(DISTINCT local_date) FROM panel
UNION ALL SELECT 'null_targets', COUNT(*) FROM panel WHERE target IS NULL
UNION ALL SELECT 'capacity_exceedances', COUNT(*) FROM panel JOIN stations USING (station_id) WHERE target > station_capacity
UNION ALL SELECT 'station_rows', COUNT(*) FROM stations
UNION ALL SELECT 'traffic_rows', COUNT(*) FROM traffic
UNION ALL SELECT 'sensors', COUNT(DISTINCT sensor_id) FROM traffic
UNION ALL SELECT 'traffic_nulls', COUNT(*) FROM traffic WHERE traffic IS NULL
UNION ALL SELECT 'weather_rows', COUNT(*) FROM weather
UNION ALL SELECT 'temperature_nulls', COUNT(*) FROM weather WHERE temperature IS NULL
UNION ALL SELECT 'precipitation_nulls', COUNT(*) FROM weather WHERE precipitation IS NULL""",
    ),
)
def dataset_audit(spark: SparkSession, folder: str) -> DataFrame:
    return contracts.panel_audit(
        dv.panel(spark, folder), dv.stations(spark, folder), dv.traffic(spark, folder), dv.weather(spark, folder)
    )


@register(
    "duplicate_keys",
    "SELECT l_orderkey, l_linenumber, COUNT(*) AS copies FROM lineitem GROUP BY ALL HAVING COUNT(*) > 1",
)
def duplicate_keys(spark: SparkSession, folder: str) -> DataFrame:
    return contracts.duplicate_keys(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@register(
    "rows_per_date",
    dv.with_ctes(
        dv.PANEL_SQL,
        final="""SELECT strftime(local_date, '%Y-%m-%d') AS local_date, COUNT(*) AS found, w.wanted FROM panel,
 (SELECT CAST(MEDIAN(n) AS BIGINT) AS wanted FROM (SELECT COUNT(*) AS n FROM panel GROUP BY local_date)) w
GROUP BY ALL HAVING COUNT(*) <> w.wanted""",
    ),
)
def rows_per_date(spark: SparkSession, folder: str) -> DataFrame:
    panel = dv.panel(spark, folder)
    typical = (
        panel.groupBy("local_date").agg(F.count(F.lit(1)).alias("n")).agg(F.round(F.percentile("n", F.lit(0.5))).cast("long"))
    ).scalar()
    out = contracts.rows_per_date(panel, typical).withColumn("wanted", typical)
    return out.withColumn("local_date", dv.text_day("local_date"))


@register(
    "hour_set",
    dv.with_ctes(
        dv.PANEL_SQL,
        final="""SELECT string_agg(h, ',' ORDER BY k) AS hours, string_agg(h, ',' ORDER BY k) = '7,8,9,10,11,12' AS complete
FROM (SELECT DISTINCT local_hour AS k, CAST(local_hour AS VARCHAR) AS h FROM panel)""",
    ),
)
def hour_set(spark: SparkSession, folder: str) -> DataFrame:
    out = contracts.hour_set(dv.panel(spark, folder))
    return out.withColumn("hours", F.array_join(F.col("hours").cast("array<string>"), ","))


@register(
    "missing_hours",
    """WITH seen AS (SELECT DISTINCT user_id, date_trunc('hour', ts) AS hour FROM events),
spine AS (SELECT user_id, unnest(generate_series(MIN(hour), MAX(hour), INTERVAL 1 HOUR)) AS hour FROM seen GROUP BY user_id)
SELECT user_id, strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour FROM spine
WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.user_id = spine.user_id AND seen.hour = spine.hour)""",
)
def missing_hours(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("user_id", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour"))
    return contracts.missing_hours(events, ["user_id"], "hour").select("user_id", dv.text_time("hour").alias("hour"))


@register(
    "orphans",
    "SELECT DISTINCT l_orderkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'F')",
)
def orphans(spark: SparkSession, folder: str) -> DataFrame:
    open_orders = table(spark, folder, "orders").filter("o_orderstatus <> 'F'")
    return contracts.orphans(
        table(spark, folder, "lineitem"), open_orders.withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey"
    )


@register(
    "coverage_gaps",
    dv.with_ctes(
        dv.PANEL_SQL, dv.WEATHER_SQL,
        final="""SELECT strftime(timestamp_utc, '%Y-%m-%d %H:%M:%S') AS timestamp_utc, COUNT(*) AS target_rows FROM panel p
WHERE NOT EXISTS (SELECT 1 FROM weather w WHERE w.timestamp_utc = p.timestamp_utc) GROUP BY 1""",
    ),
)
def coverage_gaps(spark: SparkSession, folder: str) -> DataFrame:
    hours = dv.panel(spark, folder).groupBy("timestamp_utc").agg(F.count(F.lit(1)).alias("target_rows"))
    gaps = contracts.uncovered(hours, dv.weather(spark, folder), ["timestamp_utc"])
    return gaps.select(dv.text_time("timestamp_utc").alias("timestamp_utc"), "target_rows")


@register(
    "lookup_check",
    dv.with_ctes(
        dv.PANEL_SQL,
        final="""SELECT key, problem FROM (
  SELECT CAST(l_orderkey AS VARCHAR) AS key, 'KEY_REPEATED' AS problem FROM lineitem GROUP BY l_orderkey HAVING COUNT(*) > 1
  UNION ALL SELECT DISTINCT CAST(o_orderkey AS VARCHAR), 'KEY_UNMATCHED' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))""",
    ),
)
def lookup_check(spark: SparkSession, folder: str) -> DataFrame:
    facts = table(spark, folder, "orders").select(F.col("o_orderkey").cast("string").alias("key"))
    dimension = table(spark, folder, "lineitem").select(F.col("l_orderkey").cast("string").alias("key"))
    _, problems = contracts.lookup(facts, dimension, ["key"])
    return problems


@register(
    "alias_projection",
    """SELECT CAST(s_suppkey AS VARCHAR) AS station_id, s_name AS station_name,
 CAST(s_suppkey % 90 AS DOUBLE) AS latitude, CAST(s_nationkey AS DOUBLE) AS longitude,
 CAST(NULL AS DOUBLE) AS station_capacity, s_acctbal > 0 AS interchange, 0.0::DOUBLE AS connectivity FROM supplier""",
)
def alias_projection(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias(" Station "),
        F.col("s_name").alias("NAME"),
        (F.col("s_suppkey") % 90).alias("Lat"),
        F.col("s_nationkey").alias("LNG"),
        F.when(F.col("s_acctbal") > 0, "True").otherwise("False").alias("is_interchange"),
    )
    return contracts.stations_table(raw)


@register(
    "timestamp_contract",
    """WITH raw AS (SELECT event_id, CASE event_type
    WHEN 'signup' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 'error' THEN NULL
    WHEN 'view' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+0100' WHEN 'click' THEN 'at noon Z'
    ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' END AS text, ts, event_type FROM events)
SELECT event_id, CASE event_type WHEN 'signup' THEN 'OFFSET_MISSING' WHEN 'error' THEN 'TIMESTAMP_NULL'
    WHEN 'click' THEN 'TIMESTAMP_MALFORMED' ELSE 'OK' END AS verdict,
  CASE event_type WHEN 'view' THEN strftime(date_trunc('second', ts) - INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S')
    WHEN 'purchase' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS instant FROM raw""",
)
def timestamp_contract(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    kind = F.col("event_type")
    raw = (
        F.when(kind == "signup", text)
        .when(kind == "view", F.concat(text, F.lit("+0100")))
        .when(kind == "click", "at noon Z")
        .when(kind == "purchase", F.concat(text, F.lit("Z")))
    )
    verdict = F.coalesce(contracts.offset_rule(F.col("raw")), F.lit("OK"))
    return events.select("event_id", raw.alias("raw")).select(
        "event_id", verdict.alias("verdict"), dv.text_time(cal.parse_instant(F.col("raw"))).alias("instant")
    )


NUMERIC_RAW_SQL = """raw AS (SELECT event_id, CASE event_type WHEN 'signup' THEN 'n/a' WHEN 'error' THEN CAST(-value AS VARCHAR)
  WHEN 'view' THEN CAST(ROUND(value) AS VARCHAR) WHEN 'click' THEN 'NaN' ELSE CAST(value AS VARCHAR) END AS text FROM events)"""


@register(
    "numeric_contract",
    dv.with_ctes(
        NUMERIC_RAW_SQL,
        final="""SELECT rule, CAST(COUNT(*) FILTER (hit) AS BIGINT) AS broken FROM (
  SELECT 'NOT_A_NUMBER' AS rule, v IS NULL AS hit FROM (SELECT CASE WHEN isnan(TRY_CAST(text AS DOUBLE)) THEN NULL ELSE TRY_CAST(text AS DOUBLE) END AS v FROM raw)
  UNION ALL SELECT 'TARGET_NEGATIVE', v < 0 FROM (SELECT CASE WHEN isnan(TRY_CAST(text AS DOUBLE)) THEN NULL ELSE TRY_CAST(text AS DOUBLE) END AS v FROM raw)
  UNION ALL SELECT 'TARGET_NOT_WHOLE', ABS(v - ROUND(v)) > 1e-9 + 1e-5 * ABS(ROUND(v)) FROM (SELECT CASE WHEN isnan(TRY_CAST(text AS DOUBLE)) THEN NULL ELSE TRY_CAST(text AS DOUBLE) END AS v FROM raw))
GROUP BY rule""",
    ),
)
def numeric_contract(spark: SparkSession, folder: str) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    text = (
        F.when(kind == "signup", "n/a")
        .when(kind == "error", (-value).cast("string"))
        .when(kind == "view", F.round(value).cast("string"))
        .when(kind == "click", "NaN")
        .otherwise(value.cast("string"))
    )
    rows = table(spark, folder, "events").select(num.lenient_number(text).alias("target"))
    rules = {"NOT_A_NUMBER": F.col("target").isNull(), **contracts.passenger_rules()}
    return contracts.rule_counts(rows, rules)


@register(
    "calendar_features",
    dv.with_ctes(
        dv.PANEL_SQL,
        final="""SELECT strftime(local_date, '%Y-%m-%d') AS local_date, local_hour,
 CAST(isodow(local_date) - 1 AS TINYINT) AS weekday, CAST(isodow(local_date) > 5 AS TINYINT) AS is_weekend,
 CAST(month(local_date) AS TINYINT) AS month, CAST(dayofyear(local_date) AS SMALLINT) AS day_of_year,
 ROUND(sin(2 * pi() * (isodow(local_date) - 1) / 7), 9) AS weekday_sin, ROUND(cos(2 * pi() * (isodow(local_date) - 1) / 7), 9) AS weekday_cos,
 ROUND(sin(2 * pi() * dayofyear(local_date) / 365.2425), 9) AS day_of_year_sin, ROUND(cos(2 * pi() * dayofyear(local_date) / 365.2425), 9) AS day_of_year_cos,
 ROUND(sin(2 * pi() * local_hour / 24), 9) AS hour_sin, ROUND(cos(2 * pi() * local_hour / 24), 9) AS hour_cos,
 CAST(local_date - DATE '0001-01-01' + 1 AS INTEGER) AS trend_index, COUNT(*) AS panel_rows
FROM panel GROUP BY ALL""",
    ),
)
def calendar_features(spark: SparkSession, folder: str) -> DataFrame:
    slots = dv.panel(spark, folder).groupBy("local_date", "local_hour").agg(F.count(F.lit(1)).alias("panel_rows"))
    waves = [c for c in cal.CALENDAR_COLUMNS if c.endswith(("_sin", "_cos"))]
    out = cal.with_calendar(slots)
    return out.withColumns({c: F.round(c, 9) for c in waves} | {"local_date": dv.text_day("local_date")})


GRID_SQL = dv.with_ctes(
    dv.STATIONS_SQL,
    final="""SELECT station_id, strftime(d, '%Y-%m-%d') AS local_date, CAST(h AS SMALLINT) AS local_hour,
 strftime((CAST(d AS TIMESTAMP) + INTERVAL 1 HOUR * h) AT TIME ZONE 'Europe/Berlin' AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS target_timestamp,
 date_diff('minute', o.origin, (CAST(d AS TIMESTAMP) + INTERVAL 1 HOUR * h) AT TIME ZONE 'Europe/Berlin' AT TIME ZONE 'UTC') / 60.0 AS lead_time_hours
FROM stations, (SELECT CAST(MAX(l_shipdate) AS TIMESTAMP) + INTERVAL 11 HOUR AS origin FROM lineitem) o,
 (SELECT unnest([1,2,3,4,5,6,7]) AS k), (SELECT unnest([7,8,9,10,11,12]) AS h), LATERAL (SELECT CAST(CAST(o.origin AS DATE) + CAST(k AS INTEGER) AS DATE) AS d)""",
)


@register("target_grid", GRID_SQL)
def target_grid(spark: SparkSession, folder: str) -> DataFrame:
    midnight = dv.last_day(spark, folder).cast("timestamp")
    origin = midnight + F.expr("interval 11 hours")
    grid = folds.target_grid(dv.stations(spark, folder), origin, "Europe/Berlin")
    return grid.select(
        "station_id", dv.text_day("local_date").alias("local_date"), "local_hour",
        dv.text_time("target_timestamp").alias("target_timestamp"),
        cal.lead_hours(F.col("target_timestamp"), origin).alias("lead_time_hours"),
    )


# ---- spatial ----------------------------------------------------------------

HAVERSINE_SQL = """2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(b.latitude - a.latitude) / 2), 2)
  + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin(radians(b.longitude - a.longitude) / 2), 2))))"""


@register(
    "nearest_sensor",
    dv.with_ctes(
        dv.STATIONS_SQL,
        f"""shops AS (SELECT c_custkey, -89.0 + CAST((c_custkey * 71) % 1780 AS DOUBLE) / 10 AS latitude,
  -180.0 + CAST((c_custkey * 97) % 3600 AS DOUBLE) / 10 AS longitude FROM customer),
pairs AS (SELECT a.c_custkey, b.station_id, {HAVERSINE_SQL} AS d FROM shops a, stations b)""",
        final="""SELECT c_custkey, station_id, ROUND(d, 4) AS distance_km FROM pairs
QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY ROUND(d, 7), station_id) = 1""",
    ),
)
def nearest_sensor(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    shops = table(spark, folder, "customer").select(
        "c_custkey",
        (F.lit(-89.0) + ((key * 71) % 1780).cast("double") / 10).alias("latitude"),
        (F.lit(-180.0) + ((key * 97) % 3600).cast("double") / 10).alias("longitude"),
    )
    out = spatial.nearest_site(shops, dv.stations(spark, folder), "c_custkey", "station_id")
    return out.withColumn("distance_km", F.round("distance_km", 4))


MAPPING_SQL = f"""mapping AS (SELECT station_id, sensor_id, d AS sensor_distance_km FROM (
  SELECT a.station_id, b.sensor_id, {HAVERSINE_SQL} AS d FROM stations a, sensors b)
  QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY ROUND(d, 7), sensor_id) = 1)"""


def station_mapping(spark: SparkSession, folder: str) -> DataFrame:
    found = spatial.nearest_site(dv.stations(spark, folder), dv.sensors(spark, folder), "station_id", "sensor_id")
    return found.withColumnRenamed("distance_km", "sensor_distance_km")


@register(
    "station_mapping",
    dv.with_ctes(
        dv.STATIONS_SQL, dv.SENSORS_SQL, MAPPING_SQL,
        final="SELECT station_id, sensor_id, ROUND(sensor_distance_km, 4) AS sensor_distance_km FROM mapping",
    ),
)
def station_mapping_query(spark: SparkSession, folder: str) -> DataFrame:
    return station_mapping(spark, folder).withColumn("sensor_distance_km", F.round("sensor_distance_km", 4))


# ---- features ---------------------------------------------------------------

def _lags_sql(prefix: str, value: str, source: str, join: str, days: tuple[int, ...]) -> tuple[str, str]:
    select = ", ".join(f"l{n}.{value} AS {prefix}_lag_{n}d" for n in days)
    joins = "\n".join(
        f"LEFT JOIN {source} l{n} ON {join.format(a=f'l{n}')} AND l{n}.local_date = p.local_date - {n}" for n in days
    )
    return select, joins


_P_SELECT, _P_JOINS = _lags_sql(
    "passenger", "target", "panel", "{a}.station_id = p.station_id AND {a}.local_hour = p.local_hour", features.PASSENGER_LAGS
)


@register(
    "lag_features",
    dv.with_ctes(
        dv.PANEL_SQL,
        final=f"""SELECT p.station_id, strftime(p.local_date, '%Y-%m-%d') AS local_date, p.local_hour, {_P_SELECT},
 CAST(l7.target IS NULL AS TINYINT) AS passenger_lag_7d_missing FROM panel p {_P_JOINS}""",
    ),
)
def lag_features(spark: SparkSession, folder: str) -> DataFrame:
    keys = ["station_id", "local_hour"]
    columns = features.lag_columns("target", keys, features.PASSENGER_LAGS, "passenger")
    out = features.with_missing_flags(dv.panel(spark, folder).withColumns(columns), ["passenger_lag_7d"])
    return out.select(
        "station_id", dv.text_day("local_date").alias("local_date"), "local_hour", *columns, "passenger_lag_7d_missing"
    )


def _frame(n: int, keys: str) -> str:
    return f"OVER (PARTITION BY {keys} ORDER BY local_date RANGE BETWEEN INTERVAL {n} DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)"


def _windows_sql(fn: str, value: str, prefix: str, stat: str, keys: str) -> str:
    digits = 6
    return ", ".join(f"ROUND({fn}({value}) {_frame(n, keys)}, {digits}) AS {prefix}_{stat}_{n}d" for n in features.WINDOW_DAYS)


@register(
    "window_mean",
    dv.with_ctes(
        dv.PANEL_SQL,
        final="SELECT station_id, strftime(local_date, '%Y-%m-%d') AS local_date, local_hour, "
        + _windows_sql("AVG", "target", "passenger", "mean", "station_id, local_hour") + " FROM panel",
    ),
)
def window_mean(spark: SparkSession, folder: str) -> DataFrame:
    return _windowed(spark, folder, "mean")


@register(
    "window_median",
    dv.with_ctes(
        dv.PANEL_SQL,
        final="SELECT station_id, strftime(local_date, '%Y-%m-%d') AS local_date, local_hour, "
        + _windows_sql("MEDIAN", "target", "passenger", "median", "station_id, local_hour") + " FROM panel",
    ),
)
def window_median(spark: SparkSession, folder: str) -> DataFrame:
    return _windowed(spark, folder, "median")


def _windowed(spark: SparkSession, folder: str, statistic: str) -> DataFrame:
    keys = ["station_id", "local_hour"]
    columns = features.window_columns("target", keys, features.WINDOW_DAYS, "passenger", (statistic,))
    rounded = {name: F.round(column, 6) for name, column in columns.items()}
    return dv.panel(spark, folder).withColumns(rounded).select(
        "station_id", dv.text_day("local_date").alias("local_date"), "local_hour", *columns
    )


NEAR_SQL = """near AS (SELECT sensor_id, local_date, local_hour, AVG(traffic) AS traffic FROM traffic GROUP BY ALL),
city AS (SELECT local_date, local_hour, AVG(traffic) AS mean, MIN(traffic) AS min, MAX(traffic) AS max, STDDEV_SAMP(traffic) AS std FROM traffic GROUP BY ALL),
target_keys AS (SELECT DISTINCT m.sensor_id, p.local_date, p.local_hour FROM panel p JOIN mapping m USING (station_id))"""

_TRAFFIC_LAG_SELECT = ", ".join(
    f"ROUND(n{n}.traffic, 4) AS traffic_nearest_lag_{n}d, "
    + ", ".join(f"ROUND(c{n}.{s}, 4) AS traffic_city_{s}_lag_{n}d" for s in features.CITY_STATISTICS)
    for n in features.TRAFFIC_LAGS
)
_TRAFFIC_LAG_JOINS = "\n".join(
    f"""LEFT JOIN near n{n} ON n{n}.sensor_id = t.sensor_id AND n{n}.local_hour = t.local_hour AND n{n}.local_date = t.local_date - {n}
LEFT JOIN city c{n} ON c{n}.local_hour = t.local_hour AND c{n}.local_date = t.local_date - {n}"""
    for n in features.TRAFFIC_LAGS
)


def _traffic_at(spark: SparkSession, folder: str, mapping: DataFrame, names: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The stored traffic tables at all slots of the panel; ``names`` are kept alone, to four places."""
    keep_methods_small(spark)
    slots = materialize(dv.panel_slots(spark, folder))
    found = features.traffic_tables(materialize(dv.traffic(spark, folder)), features.slot_keys(slots, mapping))
    if names is not None:
        found = [t.select(*[c for c in t.columns if c in ("sensor_id", "local_hour", "local_date")], *[F.round(c, 4).alias(c) for c in t.columns if c in names]) for t in found]
    near, city = map(materialize, found)
    return features.sent(near), city


def _panel_traffic(spark: SparkSession, folder: str, names: Sequence[str]) -> DataFrame:
    """Columns of the traffic tables at the panel's rows.

    Values are rounded once in the tables, which the calendar bounds, not once a row.
    """
    mapping = materialize(station_mapping(spark, folder))
    placed = dv.panel_by_station(spark, folder).join(mapping, "station_id", "left")
    out = features.with_traffic(placed, *_traffic_at(spark, folder, mapping, names))
    return out.select("station_id", F.col("local_date").cast("string").alias("local_date"), "local_hour", *names)


@register(
    "traffic_lags",
    dv.with_ctes(
        *dv.PANEL_WORLD, MAPPING_SQL, NEAR_SQL,
        final=f"""SELECT p.station_id, strftime(p.local_date, '%Y-%m-%d') AS local_date, p.local_hour, {_TRAFFIC_LAG_SELECT}
FROM panel p JOIN mapping m USING (station_id) JOIN target_keys t ON t.sensor_id = m.sensor_id AND t.local_date = p.local_date AND t.local_hour = p.local_hour
{_TRAFFIC_LAG_JOINS}""",
    ),
)
def traffic_lags(spark: SparkSession, folder: str) -> DataFrame:
    return _panel_traffic(spark, folder, [
        f"traffic_{part}_lag_{n}d"
        for n in features.TRAFFIC_LAGS
        for part in ("nearest", *[f"city_{s}" for s in features.CITY_STATISTICS])
    ])


def _series_sql(source: str, keys: str, value: str, prefix: str) -> str:
    return (
        f"SELECT {keys}, local_date, "
        + ", ".join(
            f"ROUND({fn}(v) {_frame(n, keys)}, 4) AS {prefix}_{stat}_{n}d"
            for n in features.WINDOW_DAYS
            for fn, stat in (("AVG", "mean"), ("MEDIAN", "median"))
        )
        + f" FROM (SELECT {keys}, local_date, MAX({value}) AS v FROM ({source}) GROUP BY ALL)"
    )


@register(
    "traffic_windows",
    dv.with_ctes(
        *dv.PANEL_WORLD, MAPPING_SQL, NEAR_SQL,
        "near_w AS (" + _series_sql(
            "SELECT * FROM near UNION ALL SELECT sensor_id, local_date, local_hour, NULL FROM target_keys",
            "sensor_id, local_hour", "traffic", "traffic_nearest") + ")",
        "city_w AS (" + _series_sql(
            "SELECT local_date, local_hour, mean FROM city UNION ALL SELECT DISTINCT local_date, local_hour, NULL FROM target_keys",
            "local_hour", "mean", "traffic_city") + ")",
        final="""SELECT p.station_id, strftime(p.local_date, '%Y-%m-%d') AS local_date, p.local_hour,
 n.* EXCLUDE (sensor_id, local_hour, local_date), c.* EXCLUDE (local_hour, local_date)
FROM panel p JOIN mapping m USING (station_id)
LEFT JOIN near_w n ON n.sensor_id = m.sensor_id AND n.local_hour = p.local_hour AND n.local_date = p.local_date
LEFT JOIN city_w c ON c.local_hour = p.local_hour AND c.local_date = p.local_date""",
    ),
)
def traffic_windows(spark: SparkSession, folder: str) -> DataFrame:
    return _panel_traffic(spark, folder, [
        f"traffic_{part}_{s}_{n}d" for part in ("nearest", "city") for n in features.WINDOW_DAYS for s in ("mean", "median")
    ])


@register(
    "weather_features",
    dv.with_ctes(
        dv.PANEL_SQL, dv.WEATHER_SQL,
        final="""SELECT p.station_id, strftime(p.timestamp_utc, '%Y-%m-%d %H:%M:%S') AS timestamp_utc,
 ROUND(temperature, 6) AS temperature, ROUND(precipitation, 6) AS precipitation,
 CAST(temperature IS NULL AS TINYINT) AS temperature_missing, CAST(precipitation IS NULL AS TINYINT) AS precipitation_missing,
 CAST(COALESCE(precipitation, 0) > 0 AS TINYINT) AS rain_indicator
FROM panel p LEFT JOIN weather w ON w.timestamp_utc = p.timestamp_utc""",
    ),
)
def weather_features(spark: SparkSession, folder: str) -> DataFrame:
    out = features.weather_features(dv.panel(spark, folder), dv.weather(spark, folder))
    return out.select(
        "station_id", dv.text_time("timestamp_utc").alias("timestamp_utc"),
        F.round("temperature", 6).alias("temperature"), F.round("precipitation", 6).alias("precipitation"),
        "temperature_missing", "precipitation_missing", "rain_indicator",
    )


# ---- splits and folds ---------------------------------------------------------

@register(
    "date_split",
    dv.with_ctes(
        dv.PANEL_SQL,
        final="""SELECT role, strftime(MIN(local_date), '%Y-%m-%d') AS first_date, strftime(MAX(local_date), '%Y-%m-%d') AS last_date,
 COUNT(DISTINCT local_date) AS dates, COUNT(*) AS row_count, COUNT(target) AS labelled FROM (
 SELECT *, CASE WHEN local_date >= (SELECT MIN(local_date) FROM (SELECT DISTINCT local_date FROM panel ORDER BY 1 DESC LIMIT 7))
   THEN 'test' ELSE 'train' END AS role FROM panel) GROUP BY role""",
    ),
)
def date_split(spark: SparkSession, folder: str) -> DataFrame:
    split = folds.date_split(dv.panel(spark, folder))
    days = split.groupBy("role", "local_date").agg(
        F.count(F.lit(1)).alias("n"), F.count("target").alias("known")
    )
    return days.groupBy("role").agg(
        dv.text_day(F.min("local_date")).alias("first_date"), dv.text_day(F.max("local_date")).alias("last_date"),
        F.count(F.lit(1)).alias("dates"), F.sum("n").alias("row_count"), F.sum("known").alias("labelled"),
    )


@register(
    "rolling_folds",
    dv.with_ctes(
        dv.PANEL_SQL, dv.FOLDS_SQL,
        final="""SELECT fold_id, strftime(start_date, '%Y-%m-%d') AS start_date, strftime(end_date, '%Y-%m-%d') AS end_date,
 strftime(origin, '%Y-%m-%d %H:%M:%S') AS origin, CASE WHEN local_date < start_date THEN 'train' ELSE 'validation' END AS role,
 COUNT(DISTINCT local_date) AS dates, COUNT(*) AS row_count, COUNT(target) AS labelled
FROM panel JOIN folds ON local_date <= end_date GROUP BY ALL""",
    ),
)
def rolling_folds(spark: SparkSession, folder: str) -> DataFrame:
    out = folds.fold_summary(dv.panel(spark, folder), _folds(spark, folder))
    return out.withColumns(
        {"start_date": dv.text_day("start_date"), "end_date": dv.text_day("end_date"), "origin": dv.text_time("origin")}
    )


@register(
    "fold_gaps",
    dv.with_ctes(
        dv.PANEL_SQL,
        final="""SELECT 'fold_' || k AS fold_id, strftime(d, '%Y-%m-%d') AS local_date FROM (
  SELECT k, unnest(generate_series(CAST(last_day - (53 - k) * 7 + 1 AS TIMESTAMP), CAST(last_day - (53 - k) * 7 + 7 AS TIMESTAMP), INTERVAL 1 DAY)) AS d
  FROM (SELECT MAX(local_date) AS last_day FROM panel), (SELECT CAST(unnest(generate_series(1, 52)) AS INTEGER) AS k))
WHERE CAST(d AS DATE) NOT IN (SELECT local_date FROM panel WHERE target > 80)""",
    ),
)
def fold_gaps(spark: SparkSession, folder: str) -> DataFrame:
    windows = folds.FoldWindows(dv.last_day(spark, folder), dv.ZONE, count=52)
    busy = dv.panel(spark, folder).filter("target > 80")
    out = folds.missing_validation_dates(busy, windows)
    return out.withColumn("local_date", dv.text_day("local_date"))


_ASOF_LAGS = (7, 14, 21, 28, 364)


@register(
    "asof_features",
    dv.with_ctes(
        dv.PANEL_SQL, dv.FOLDS_SQL,
        """fold_panel AS (SELECT f.fold_id, p.station_id, p.local_date, p.local_hour,
  CASE WHEN p.local_date < f.start_date THEN 'train' ELSE 'validation' END AS role,
  CASE WHEN p.timestamp_utc <= f.origin THEN p.target END AS visible
  FROM panel p JOIN folds f ON p.local_date <= f.end_date)""",
        final="SELECT fold_id, role, station_id, strftime(local_date, '%Y-%m-%d') AS local_date, local_hour, "
        + ", ".join(
            f"MAX(visible) OVER (PARTITION BY fold_id, station_id, local_hour ORDER BY local_date RANGE BETWEEN INTERVAL {n} DAY PRECEDING AND INTERVAL {n} DAY PRECEDING) AS passenger_lag_{n}d"
            for n in _ASOF_LAGS)
        + ", " + _windows_sql("AVG", "visible", "passenger", "mean", "fold_id, station_id, local_hour")
        + ", " + _windows_sql("MEDIAN", "visible", "passenger", "median", "fold_id, station_id, local_hour")
        + " FROM fold_panel",
    ),
)
def asof_features(spark: SparkSession, folder: str) -> DataFrame:
    """Features of every train and validation row, each fold blind after its origin.

    The frames of a training row end a day before it and so before any origin of
    a fold that trains on it: they are computed once for all folds.  Validation
    rows see the longest lag before their fold, cut at its origin.
    """
    panel, windows = materialize(dv.panel(spark, folder)), _folds(spark, folder)

    def featured(rows: DataFrame, value: str, scope: list[str]) -> DataFrame:
        keys = [*scope, "station_id", "local_hour"]
        means = features.window_columns(value, keys, features.WINDOW_DAYS, "passenger")
        columns = features.lag_columns(value, keys, _ASOF_LAGS, "passenger") | {n: F.round(c, 6) for n, c in means.items()}
        return rows.withColumns(columns)

    train = folds.fold_rows(featured(panel, "target", []), windows).filter("role = 'train'")
    recent = folds.fold_rows(panel, windows).filter(F.col("local_date") >= F.date_sub("start_date", max(*_ASOF_LAGS, *features.WINDOW_DAYS)))
    visible = recent.withColumn("visible", F.when(F.col("timestamp_utc") <= F.col("origin"), F.col("target")))
    held = featured(visible, "visible", ["fold_id"]).filter("role = 'validation'").drop("visible")
    rows = train.unionByName(held)
    known = (*panel.columns, "fold_id", "start_date", "end_date", "origin", "role")
    return rows.select(
        "fold_id", "role", "station_id", dv.text_day("local_date").alias("local_date"), "local_hour",
        *[c for c in rows.columns if c not in known],
    )


def known_values(df: DataFrame, key: str) -> DataFrame:
    """Number of known values per column, in one pass over the table."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
    return contracts.melt(counts, [], key, "known_values")


@register(
    "schema_diff",
    dv.with_ctes(
        dv.PANEL_SQL,
        final="""SELECT v.position, left_name, left_type, right_name, right_type, known_values FROM (VALUES (2, 'local_hour', 'smallint', 'hour', 'smallint'),
  (3, 'target', 'double', 'target', 'bigint'), (4, 'timestamp_utc', 'timestamp', NULL, NULL)) AS v(position, left_name, left_type, right_name, right_type)
JOIN (SELECT 2 AS position, COUNT(local_hour) AS known_values FROM panel UNION ALL SELECT 3, COUNT(target) FROM panel UNION ALL SELECT 4, COUNT(timestamp_utc) FROM panel) k ON k.position = v.position""",
    ),
)
def schema_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Positions where two panels differ, and how many values each difference touches."""
    left = dv.panel(spark, folder)
    right = left.select("station_id", "local_date", F.col("local_hour").alias("hour"), F.col("target").cast("long"))
    diff = contracts.schema_diff(left, right)
    return diff.join(known_values(left, "left_name"), "left_name", "left").select(
        "position", "left_name", "left_type", "right_name", "right_type", "known_values"
    )


@register("feature_registry")
def feature_registry(spark: SparkSession, folder: str) -> DataFrame:
    """The ordered feature schema with lineage, hash and the known values of the whole table."""
    built = full_features(spark, folder)
    names = features.feature_names(built)
    return features.feature_registry(built).join(known_values(built.select(*names), "feature"), "feature", "left")


def full_features(spark: SparkSession, folder: str) -> DataFrame:
    """The complete feature table of the panel's own rows, one origin at the panel's end."""
    mapping = materialize(station_mapping(spark, folder))
    near, city = _traffic_at(spark, folder, mapping)
    panel = dv.panel_by_station(spark, folder)
    return features.build_features(
        panel.select("station_id", "timestamp_utc", "local_date", "local_hour", "target", F.col("target").alias("visible")),
        dv.stations(spark, folder), "visible", dv.weather(spark, folder), near, mapping, tables=(near, city),
    )


@register("feature_table")
def feature_table(spark: SparkSession, folder: str) -> DataFrame:
    return full_features(spark, folder)
