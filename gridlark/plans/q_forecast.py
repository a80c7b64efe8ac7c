"""Forecast batch, monitoring, evaluation and selection queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridlark.functions import numeric as num
from gridlark.functions.calendar import lead_hours
from gridlark.operators import batches, contracts, evaluation, monitoring, ordered
from gridlark.plans import derive as dv
from gridlark.plans.registry import register
from gridlark.session import materialize, scratch_path
from gridlark.sources import publish, tables, versions
from gridlark.sources.tables import read_shared as table

BATCH_WORLD = (dv.PANEL_SQL, dv.BATCHES_SQL)
WEEK_ORIGIN = "CAST(DATE '1995-01-02' + CAST(substr(batch_id, 2) AS INTEGER) * 7 - 1 AS TIMESTAMP) + INTERVAL 12 HOUR"


def _origin(batch: str = "batch_id"):
    monday = F.date_add(F.lit("1995-01-02").cast("date"), F.substring(batch, 2, 4).cast("int") * 7 - 1)
    return F.timestamp_seconds(F.unix_date(monday).cast("long") * 86400 + 12 * 3600)


def records(spark: SparkSession, folder: str, made: DataFrame | None = None) -> DataFrame:
    """Forecast records of all weekly batches, champion or fallback per batch.

    The verdict on a batch and its rows both read the batches (``made``, where the caller has them stored).
    """
    made = materialize(dv.batches(spark, folder)) if made is None else made
    rows = made.select(
        "batch_id", "station_id", "local_date", "local_hour", "target_timestamp",
        F.when(F.col("forecast_continuous") < 48, F.col("forecast_continuous")).alias("champion_forecast"),
        F.col("baseline_forecast").alias("fallback_forecast"),
    )
    chosen = batches.champion_or_fallback(rows).withColumn("origin", _origin())
    hashed = chosen.withColumns(
        {
            "source_hash": F.sha2(F.col("batch_id"), 256),
            "model_hash": F.sha2(F.coalesce("model_role", F.lit("")), 256),
            "config_hash": F.sha2(F.lit("config"), 256),
        }
    )
    return batches.forecast_records(hashed.filter("batch_status <> 'blocked'"))


RECORDS_SQL = f"""graded AS (SELECT *, CASE WHEN forecast_continuous < 48 THEN forecast_continuous END AS champion FROM batches),
verdict AS (SELECT batch_id, bool_and(champion IS NOT NULL) AS c, bool_and(baseline_forecast IS NOT NULL) AS f FROM graded GROUP BY 1),
records AS (SELECT batch_id, station_id, local_date, local_hour, target_timestamp, {WEEK_ORIGIN} AS origin,
  CASE WHEN c THEN 'champion' WHEN f THEN 'seasonal_naive_fallback' END AS model_role,
  CASE WHEN c THEN 'healthy' WHEN f THEN 'degraded' ELSE 'blocked' END AS batch_status,
  CASE WHEN c THEN champion WHEN f THEN baseline_forecast END AS forecast
  FROM graded JOIN verdict USING (batch_id))"""


@register(
    "forecast_records",
    dv.with_ctes(
        *BATCH_WORLD, RECORDS_SQL,
        final="""SELECT batch_id, strftime(origin, '%Y-%m-%d %H:%M:%S') AS origin, strftime(target_timestamp, '%Y-%m-%d %H:%M:%S') AS target_timestamp,
 station_id, date_diff('minute', origin, target_timestamp) / 60.0 AS lead_time_hours, forecast AS forecast_continuous,
 CAST(floor(forecast + 0.5) AS BIGINT) AS forecast_count, model_role, batch_status, sha256(batch_id) AS source_hash,
 sha256(model_role) AS model_hash, sha256('config') AS config_hash FROM records WHERE batch_status <> 'blocked'""",
    ),
)
def forecast_records(spark: SparkSession, folder: str) -> DataFrame:
    out = records(spark, folder)
    return out.withColumns({c: dv.text_time(c) for c in ("origin", "target_timestamp")})


@register(
    "row_contract",
    dv.with_ctes(
        *BATCH_WORLD, RECORDS_SQL,
        final="""SELECT rule, COUNT(*) AS broken FROM (
  SELECT 'ROUNDING_INCONSISTENT' AS rule FROM records WHERE batch_status <> 'blocked' AND local_hour = 9 AND floor(forecast) <> floor(forecast + 0.5)
  UNION ALL SELECT 'LEAD_INCONSISTENT' FROM records WHERE batch_status <> 'blocked' AND local_hour = 10
  UNION ALL SELECT 'STATUS_UNKNOWN' FROM records WHERE batch_status <> 'blocked' AND local_hour = 11
  UNION ALL SELECT 'MODEL_HASH_INVALID' FROM records WHERE batch_status <> 'blocked' AND local_hour = 12) GROUP BY 1""",
    ),
)
def row_contract(spark: SparkSession, folder: str) -> DataFrame:
    """Records tampered by service hour, one kind of damage each."""
    hour = F.hour("target_timestamp")
    damaged = records(spark, folder).withColumns(
        {
            "forecast_count": F.when(hour == 9, F.floor("forecast_continuous")).otherwise(F.col("forecast_count")),
            "lead_time_hours": F.when(hour == 10, F.col("lead_time_hours") + 1).otherwise(F.col("lead_time_hours")),
            "batch_status": F.when(hour == 11, "fine").otherwise(F.col("batch_status")),
            "model_hash": F.when(hour == 12, F.upper("model_hash")).otherwise(F.col("model_hash")),
        }
    )
    found = contracts.violations(damaged, contracts.forecast_record_rules(), ["batch_id"])
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("broken"))


@register(
    "champion_or_fallback",
    dv.with_ctes(
        *BATCH_WORLD, RECORDS_SQL,
        final="SELECT batch_id, model_role, batch_status, COUNT(*) AS row_count, ROUND(SUM(forecast), 4) AS total FROM records GROUP BY ALL",
    ),
)
def champion_or_fallback(spark: SparkSession, folder: str) -> DataFrame:
    rows = dv.batches(spark, folder).select(
        "batch_id",
        F.when(F.col("forecast_continuous") < 48, F.col("forecast_continuous")).alias("champion_forecast"),
        F.col("baseline_forecast").alias("fallback_forecast"),
    )
    return batches.champion_or_fallback(rows).groupBy("batch_id", "model_role", "batch_status").agg(
        F.count(F.lit(1)).alias("row_count"), F.round(F.sum("forecast"), 4).alias("total")
    )


@register(
    "batch_contract",
    dv.with_ctes(
        *BATCH_WORLD, RECORDS_SQL,
        """held AS (SELECT batch_id, station_id, local_date, CASE WHEN local_hour = 11 AND CAST(substr(batch_id, 2) AS INTEGER) % 5 = 0 THEN 13 ELSE local_hour END AS local_hour, origin
  FROM records WHERE batch_status <> 'blocked' AND NOT (local_hour = 8 AND model_role = 'champion')),
grid AS (SELECT batch_id, CAST(s_suppkey AS VARCHAR) AS station_id, CAST(CAST(origin AS DATE) + CAST(d AS INTEGER) AS DATE) AS local_date, h AS local_hour
  FROM (SELECT batch_id, MIN(origin) AS origin FROM held GROUP BY 1), supplier, range(1, 8) x(d), range(7, 13) y(h)),
cells AS (SELECT COALESCE(r.batch_id, g.batch_id) AS batch_id, r.batch_id IS NOT NULL AS have, g.batch_id IS NOT NULL AS want
  FROM held r FULL OUTER JOIN grid g ON r.batch_id = g.batch_id AND r.station_id = g.station_id AND r.local_date = g.local_date AND r.local_hour = g.local_hour)""",
        final="""SELECT batch_id, COUNT(*) FILTER (have) AS row_count, COUNT(*) FILTER (want) AS expected_rows,
 concat_ws(',', CASE WHEN COUNT(*) FILTER (have) <> COUNT(*) FILTER (want) THEN 'ROW_COUNT' END,
   CASE WHEN COUNT(*) FILTER (NOT have) > 0 THEN 'GRID_CELLS_MISSING' END,
   CASE WHEN COUNT(*) FILTER (NOT want) > 0 THEN 'OUTSIDE_GRID' END) AS problems,
 COUNT(*) FILTER (NOT have) = 0 AND COUNT(*) FILTER (NOT want) = 0 AND COUNT(*) FILTER (have) = COUNT(*) FILTER (want) AS publishable
FROM cells GROUP BY 1""",
    ),
)
def batch_contract(spark: SparkSession, folder: str) -> DataFrame:
    """Weekly batches against the grid of their origin; some lost an hour, some have one outside it."""
    hour = F.hour("target_timestamp")
    moved = (hour == 11) & (F.substring("batch_id", 2, 4).cast("int") % 5 == 0)
    made = records(spark, folder).withColumns(
        {"local_date": F.to_date("target_timestamp"), "local_hour": F.when(moved, 13).otherwise(hour).cast("short")}
    )
    kept = materialize(made.filter(~((hour == 8) & (F.col("model_role") == "champion"))))
    out = batches.origin_contract(kept, dv.stations(spark, folder), dv.ZONE)
    return out.select(
        "batch_id", "row_count", "expected_rows", F.array_join("problems", ",").alias("problems"), "publishable"
    )


@register(
    "serving_decision",
    """WITH states AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS batch_id, o_orderpriority AS name,
  o_orderpriority IN ('1-URGENT', '2-HIGH') AS critical, o_orderkey % 11 <> 0 AS available, o_totalprice > 30000 AS valid FROM orders),
grouped AS (SELECT batch_id, string_agg(DISTINCT CASE WHEN critical AND NOT (available AND valid) THEN name END, ',' ORDER BY CASE WHEN critical AND NOT (available AND valid) THEN name END) AS c,
  string_agg(DISTINCT CASE WHEN NOT critical AND NOT (available AND valid) THEN 'optional_source_unavailable:' || name END, ',' ORDER BY CASE WHEN NOT critical AND NOT (available AND valid) THEN 'optional_source_unavailable:' || name END) AS o
  FROM states GROUP BY 1)
SELECT batch_id, CASE WHEN c IS NOT NULL THEN NULL WHEN o IS NOT NULL THEN 'seasonal_naive_fallback' ELSE 'champion' END AS model_role,
 CASE WHEN c IS NOT NULL THEN 'blocked' WHEN o IS NOT NULL THEN 'degraded' ELSE 'healthy' END AS batch_status, COALESCE(c, o, '') AS reasons FROM grouped""",
)
def serving_decision(spark: SparkSession, folder: str) -> DataFrame:
    states = table(spark, folder, "orders").select(
        dv.text_day("o_orderdate").alias("batch_id"), F.col("o_orderpriority").alias("name"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("critical"),
        (F.col("o_orderkey") % 11 != 0).alias("available"), (F.col("o_totalprice") > 30000).alias("valid"),
    )
    return batches.serving_decision(states).withColumn("reasons", F.array_join("reasons", ","))


# ---- monitoring ---------------------------------------------------------------

# A monitored series is a station; its rolling window ends at its newest label.
SCOPED_SQL = """scoped AS (SELECT b.* FROM batches b JOIN (
  SELECT station_id, MAX(target_timestamp) FILTER (actual IS NOT NULL) AS newest FROM batches GROUP BY 1) n USING (station_id)
  WHERE target_timestamp > newest - INTERVAL 28 DAY AND actual IS NOT NULL AND forecast_continuous IS NOT NULL)"""

PERFORMANCE_SQL = """COUNT(*) AS scored, ROUND(SQRT(AVG((forecast_continuous - actual) ** 2)), 6) AS rmse,
 ROUND(AVG(forecast_continuous - actual), 6) AS bias, ROUND(SQRT(AVG((baseline_forecast - actual) ** 2)), 6) AS baseline_rmse"""


def _joined(spark: SparkSession, folder: str) -> DataFrame:
    rows = dv.batches(spark, folder)
    return rows.select("batch_id", "station_id", "target_timestamp", "actual", "forecast_continuous", "baseline_forecast")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("rmse", "bias", "baseline_rmse", "lift")})


@register(
    "monitor_overall",
    dv.with_ctes(
        *BATCH_WORLD,
        final=f"""SELECT *, CASE WHEN baseline_rmse > 0 THEN ROUND((b - r) / b, 6) END AS lift FROM (
 SELECT batch_id, {PERFORMANCE_SQL}, SQRT(AVG((forecast_continuous - actual) ** 2)) AS r, SQRT(AVG((baseline_forecast - actual) ** 2)) AS b
 FROM batches WHERE actual IS NOT NULL AND forecast_continuous IS NOT NULL GROUP BY 1)""".replace("SELECT *, CASE", "SELECT * EXCLUDE (r, b), CASE"),
    ),
)
def monitor_overall(spark: SparkSession, folder: str) -> DataFrame:
    scoped = monitoring.rolling_scope(_joined(spark, folder), ["batch_id"])
    return _rounded(monitoring.performance(scoped, ["batch_id"]))


@register(
    "monitor_station",
    dv.with_ctes(
        *BATCH_WORLD, SCOPED_SQL,
        final=f"""SELECT * EXCLUDE (r, b), CASE WHEN b > 0 THEN ROUND((b - r) / b, 6) END AS lift FROM (
 SELECT station_id, {PERFORMANCE_SQL}, SQRT(AVG((forecast_continuous - actual) ** 2)) AS r, SQRT(AVG((baseline_forecast - actual) ** 2)) AS b
 FROM scoped GROUP BY 1)""",
    ),
)
def monitor_station(spark: SparkSession, folder: str) -> DataFrame:
    scoped = monitoring.rolling_scope(_joined(spark, folder), ["station_id"])
    return _rounded(monitoring.performance(scoped, ["station_id"]))


@register(
    "label_join",
    dv.with_ctes(
        *BATCH_WORLD, RECORDS_SQL,
        final="""SELECT r.batch_id, COUNT(*) AS joined, COUNT(p.target) AS labelled, COUNT(b.baseline_forecast) AS with_baseline,
 ROUND(SUM(r.forecast - p.target), 4) AS error_sum
FROM records r JOIN panel p ON p.station_id = r.station_id AND p.timestamp_utc = r.target_timestamp
LEFT JOIN batches b ON b.station_id = r.station_id AND b.target_timestamp = r.target_timestamp AND b.local_hour <> 12
WHERE r.batch_status <> 'blocked' GROUP BY 1""",
    ),
)
def label_join(spark: SparkSession, folder: str) -> DataFrame:
    """Published records joined with labels one to one, and with a partial baseline."""
    labels = dv.panel(spark, folder).select(
        "station_id", F.col("timestamp_utc").alias("target_timestamp"), F.col("target").alias("actual")
    )
    made = materialize(dv.batches(spark, folder))
    partial = made.filter("local_hour <> 12")
    joined = monitoring.join_labels(
        records(spark, folder, made).select("batch_id", "station_id", "target_timestamp", "forecast_continuous"), labels, partial
    )
    return joined.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("joined"), F.count("actual").alias("labelled"),
        F.count("baseline_forecast").alias("with_baseline"),
        F.round(F.sum(F.col("forecast_continuous") - F.col("actual")), 4).alias("error_sum"),
    )


COMPLETE_SQL = """complete AS (SELECT batch_id, complete, LEAST(1.0, complete / 170.0) AS completeness FROM (
  SELECT batch_id, COUNT(*) FILTER (n = 1 AND ok = 1) AS complete FROM (
    SELECT batch_id, station_id, target_timestamp, COUNT(*) AS n, COUNT(*) FILTER (forecast_continuous >= 0) AS ok FROM batches GROUP BY ALL) GROUP BY 1)),
complete_s AS (SELECT *, CASE WHEN completeness < 0.99 THEN 'critical' WHEN completeness < 1 THEN 'warning' ELSE 'info' END AS severity FROM complete)"""


@register(
    "completeness",
    dv.with_ctes(
        *BATCH_WORLD, COMPLETE_SQL,
        final="SELECT batch_id, complete, ROUND(completeness, 6) AS completeness, severity FROM complete_s",
    ),
)
def completeness(spark: SparkSession, folder: str) -> DataFrame:
    out = monitoring.completeness(dv.batches(spark, folder), 170)
    return out.withColumn("completeness", F.round("completeness", 6))


FRESH_SQL = """fresh AS (SELECT user_id, event_type AS source, CASE WHEN event_type = 'signup' AND MAX(value) > 200 THEN NULL ELSE MAX(ts) END AS watermark FROM events GROUP BY user_id, event_type),
aged AS (SELECT *, CAST(CASE source WHEN 'click' THEN 24.0 WHEN 'error' THEN 6.0 WHEN 'purchase' THEN 72.0 END AS DOUBLE) AS limit_hours,
  epoch_us(TIMESTAMP '2024-01-31 00:00:00') AS now_us FROM fresh),
judged AS (SELECT user_id, source, limit_hours, (now_us - epoch_us(watermark)) / 3.6e9 AS age_hours FROM aged),
fresh_s AS (SELECT *, age_hours IS NULL OR COALESCE(age_hours > limit_hours, false) AS stale,
  CASE WHEN NOT (age_hours IS NULL OR COALESCE(age_hours > limit_hours, false)) THEN 'info' WHEN source IN ('purchase', 'signup') THEN 'critical' ELSE 'warning' END AS severity FROM judged)"""

LIMITS = {"click": 24.0, "error": 6.0, "purchase": 72.0}


def _freshness(spark: SparkSession, folder: str) -> DataFrame:
    newest = table(spark, folder, "events").groupBy("user_id", F.col("event_type").alias("source")).agg(
        F.max(F.col("ts").cast("timestamp")).alias("t"), F.max("value").alias("v")
    )
    lost = (F.col("source") == "signup") & (F.col("v") > 200)
    marks = newest.select("user_id", "source", F.when(~lost, F.col("t")).alias("watermark"))
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return monitoring.freshness(marks, monitoring.source_ages(LIMITS, spark), now, ("purchase", "signup"))


@register(
    "freshness",
    "WITH " + FRESH_SQL + " SELECT user_id, source, limit_hours, ROUND(age_hours, 6) AS age_hours, stale, severity FROM fresh_s",
)
def freshness(spark: SparkSession, folder: str) -> DataFrame:
    return _freshness(spark, folder).select(
        "user_id", "source", "limit_hours", F.round("age_hours", 6).alias("age_hours"), "stale", "severity"
    )


@register(
    "monitor_action",
    dv.with_ctes(
        *BATCH_WORLD, COMPLETE_SQL,
        """scores AS (SELECT batch_id, SQRT(AVG((forecast_continuous - actual) ** 2)) AS r, AVG(forecast_continuous - actual) AS bias, SQRT(AVG((baseline_forecast - actual) ** 2)) AS b
  FROM batches WHERE actual IS NOT NULL AND forecast_continuous IS NOT NULL GROUP BY 1),
findings AS (SELECT batch_id, 'completeness' AS metric, severity FROM complete_s WHERE severity <> 'info'
  UNION ALL SELECT batch_id, 'champion_vs_baseline_rmse', 'warning' FROM scores WHERE r >= b
  UNION ALL SELECT batch_id, 'rmse', 'warning' FROM scores WHERE r > 18
  UNION ALL SELECT batch_id, 'absolute_bias', 'warning' FROM scores WHERE ABS(bias) > 2)""",
        final="""SELECT batch_id, COUNT(*) AS findings, CASE WHEN bool_or(severity = 'critical') THEN 'critical' ELSE 'warning' END AS severity,
 CASE WHEN bool_or(metric = 'completeness' AND severity = 'critical') THEN 'block_publication' ELSE 'alert' END AS action
FROM findings GROUP BY 1""",
    ),
)
def monitor_action(spark: SparkSession, folder: str) -> DataFrame:
    rows = materialize(dv.batches(spark, folder))  # newest label, scores and completeness each read it
    by = ["batch_id"]
    scores = monitoring.performance(monitoring.rolling_scope(rows, by), by)
    findings = monitoring.completeness_findings(monitoring.completeness(rows, 170), by).unionByName(
        monitoring.performance_findings(scores, by, max_rmse=18.0, max_bias=2.0)
    )
    return monitoring.decide(findings, by)


@register(
    "freshness_action",
    "WITH " + FRESH_SQL
    + """ SELECT user_id, COUNT(*) AS findings, CASE WHEN bool_or(severity = 'critical') THEN 'critical' ELSE 'warning' END AS severity,
 CASE WHEN bool_or(severity = 'critical') THEN 'block_publication' ELSE 'fallback' END AS action FROM fresh_s WHERE stale GROUP BY 1""",
)
def freshness_action(spark: SparkSession, folder: str) -> DataFrame:
    found = monitoring.freshness_findings(_freshness(spark, folder), ["user_id"])
    return monitoring.decide(found, ["user_id"])


# ---- candidates -----------------------------------------------------------------

SUMMARY_SQL = """cells AS (SELECT model_family, candidate_id, fold_id, station_id,
  SUM((GREATEST(forecast, 0) - actual) ** 2) AS sse, COUNT(GREATEST(forecast, 0) - actual) AS n, COUNT(*) FILTER (forecast IS NULL) AS invalid
  FROM (SELECT * REPLACE (CASE WHEN forecast IS NULL THEN NULL ELSE forecast END AS forecast, CASE WHEN forecast IS NULL THEN NULL ELSE actual END AS actual) FROM predictions) GROUP BY ALL),
fold_scores AS (SELECT model_family, candidate_id, fold_id, SQRT(SUM(sse) / NULLIF(SUM(n), 0)) AS fold_rmse, SUM(invalid) AS invalid FROM cells GROUP BY ALL),
means AS (SELECT model_family, candidate_id, AVG(fold_rmse) AS mean_rmse, COUNT(*) AS folds, SUM(invalid) AS invalid, COUNT(*) FILTER (fold_rmse IS NULL) AS unscored FROM fold_scores GROUP BY ALL),
worst AS (SELECT model_family, candidate_id, MAX(r) AS worst_station_rmse FROM (
  SELECT model_family, candidate_id, station_id, SQRT(SUM(sse) / NULLIF(SUM(n), 0)) AS r FROM cells GROUP BY ALL) GROUP BY ALL),
summary AS (SELECT model_family, candidate_id, folds, CASE WHEN invalid + unscored = 0 THEN mean_rmse END AS mean_rmse,
  CASE WHEN invalid + unscored = 0 THEN worst_station_rmse END AS worst_station_rmse, invalid + unscored = 0 AS completed,
  CASE WHEN invalid > 0 THEN 'INVALID_FORECASTS' WHEN unscored > 0 THEN 'FOLD_WITHOUT_LABELS' END AS failure_reason FROM means JOIN worst USING (model_family, candidate_id)),
costs AS (SELECT model_family, candidate_id, CAST(COUNT(*) % 7 AS DOUBLE) AS inference_latency_ms, CAST(COUNT(*) * 13 AS BIGINT) AS artifact_size_bytes FROM predictions GROUP BY ALL),
candidates AS (SELECT * FROM summary JOIN costs USING (model_family, candidate_id))"""


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    rows = dv.predictions(spark, folder)
    costs = rows.groupBy("model_family", "candidate_id").agg(
        (F.count(F.lit(1)) % 7).cast("double").alias("inference_latency_ms"),
        (F.count(F.lit(1)) * 13).alias("artifact_size_bytes"),
    )
    return evaluation.candidate_summary(rows).join(costs, ["model_family", "candidate_id"])


@register(
    "candidate_summary",
    dv.with_ctes(
        dv.CANDIDATES_SQL, SUMMARY_SQL,
        final="""SELECT model_family, candidate_id, folds, ROUND(mean_rmse, 6) AS mean_rmse, ROUND(worst_station_rmse, 6) AS worst_station_rmse,
 completed, failure_reason FROM summary""",
    ),
)
def candidate_summary(spark: SparkSession, folder: str) -> DataFrame:
    out = evaluation.candidate_summary(dv.predictions(spark, folder))
    return out.withColumns({c: F.round(c, 6) for c in ("mean_rmse", "worst_station_rmse")})


_CHAMPION_SQL = """best AS (SELECT model_family, MIN(mean_rmse) AS best FROM candidates WHERE completed GROUP BY 1),
champions AS (SELECT c.* FROM candidates c JOIN best USING (model_family) WHERE completed AND mean_rmse <= best * 1.01
  QUALIFY row_number() OVER (PARTITION BY model_family ORDER BY worst_station_rmse, inference_latency_ms, artifact_size_bytes, mean_rmse, candidate_id) = 1)"""


@register(
    "select_champion",
    dv.with_ctes(
        dv.CANDIDATES_SQL, SUMMARY_SQL, _CHAMPION_SQL,
        final="SELECT model_family, candidate_id, ROUND(mean_rmse, 6) AS mean_rmse, ROUND(worst_station_rmse, 6) AS worst_station_rmse FROM champions",
    ),
)
def select_champion(spark: SparkSession, folder: str) -> DataFrame:
    """A champion per family, as one selection run each."""
    out = evaluation.select_champion(candidates(spark, folder), ["model_family"])
    return out.select(
        "model_family", "candidate_id", F.round("mean_rmse", 6).alias("mean_rmse"),
        F.round("worst_station_rmse", 6).alias("worst_station_rmse"),
    )


@register(
    "best_per_family",
    dv.with_ctes(
        dv.CANDIDATES_SQL, SUMMARY_SQL,
        """champion AS (SELECT candidate_id, model_family FROM candidates WHERE completed AND mean_rmse <= 1.01 * (SELECT MIN(mean_rmse) FROM candidates WHERE completed)
  ORDER BY worst_station_rmse, inference_latency_ms, artifact_size_bytes, mean_rmse, candidate_id LIMIT 1)""",
        final="""SELECT c.model_family, c.candidate_id, ROUND(mean_rmse, 6) AS mean_rmse, ROUND(worst_station_rmse, 6) AS worst_station_rmse,
 h.candidate_id IS NOT NULL AS selected FROM candidates c LEFT JOIN champion h ON h.candidate_id = c.candidate_id AND h.model_family = c.model_family
WHERE completed QUALIFY row_number() OVER (PARTITION BY c.model_family ORDER BY h.candidate_id IS NULL, mean_rmse, c.candidate_id) = 1""",
    ),
)
def best_per_family(spark: SparkSession, folder: str) -> DataFrame:
    pool = candidates(spark, folder)
    chosen = evaluation.best_per_family(pool, evaluation.select_champion(pool))
    return chosen.withColumns({c: F.round(c, 6) for c in ("mean_rmse", "worst_station_rmse")})


@register(
    "ablation_rank",
    dv.with_ctes(
        dv.CANDIDATES_SQL, SUMMARY_SQL,
        """runs AS (SELECT candidate_id AS feature_family, AVG(fold_rmse) AS overall_rmse FROM fold_scores GROUP BY 1)""",
        final="""SELECT feature_family, ROUND(overall_rmse, 6) AS overall_rmse, ROUND(overall_rmse - b, 6) AS delta_rmse,
 CAST(row_number() OVER (ORDER BY overall_rmse - b DESC, feature_family) AS INTEGER) AS place
FROM runs, (SELECT overall_rmse AS b FROM runs WHERE feature_family = 'Brand#1') WHERE feature_family <> 'Brand#1'""",
    ),
)
def ablation_rank(spark: SparkSession, folder: str) -> DataFrame:
    """Each brand stands for the run without one feature family, Brand#1 for the full run."""
    rows = dv.predictions(spark, folder)
    error = F.greatest(F.col("forecast"), F.lit(0.0)) - F.col("actual")
    error = F.when(F.col("forecast").isNotNull(), error)
    folds = rows.groupBy("model_family", "candidate_id", "fold_id").agg(evaluation.rmse(error).alias("r"))
    runs = folds.groupBy(F.col("candidate_id").alias("feature_family")).agg(F.avg("r").alias("overall_rmse"))
    out = evaluation.ablation_rank(runs, "Brand#1")
    return out.withColumns({c: F.round(c, 6) for c in ("overall_rmse", "delta_rmse")})


@register(
    "station_series",
    dv.with_ctes(
        *BATCH_WORLD,
        final=f"""SELECT batch_id, station_id, string_agg(strftime(target_timestamp, '%m-%d %H') || '=' || COALESCE(CAST(CAST(forecast_continuous * 2 AS BIGINT) AS VARCHAR), ''), ';' ORDER BY target_timestamp) AS series,
 COUNT(actual) AS scored, ROUND(SQRT(AVG((GREATEST(forecast_continuous, 0) - actual) ** 2)), 6) AS rmse FROM batches GROUP BY ALL HAVING COUNT(actual) > 0""",
    ),
)
def station_series(spark: SparkSession, folder: str) -> DataFrame:
    rows = dv.batches(spark, folder).withColumns(
        {"forecast": F.col("forecast_continuous"), "lead_time_hours": lead_hours(F.col("target_timestamp"), _origin())}
    )
    nested = evaluation.station_series(rows, ["batch_id"]).filter("scored > 0")
    point = lambda p: F.concat(
        F.date_format(p["target_timestamp"], "MM-dd HH"), F.lit("="),
        F.coalesce((p["forecast"] * 2).cast("long").cast("string"), F.lit("")),
    )
    return nested.select(
        "batch_id", "station_id", F.array_join(F.transform("series", point), ";").alias("series"), "scored",
        F.round("rmse", 6).alias("rmse"),
    )


@register(
    "station_reconcile",
    dv.with_ctes(
        *BATCH_WORLD,
        """results AS (SELECT batch_id, station_id, COUNT(actual) AS scored FROM batches GROUP BY ALL HAVING COUNT(actual) > 0),
wanted AS (SELECT batch_id, station_id, COUNT(*) AS scored FROM batches WHERE actual > 1 GROUP BY ALL),
off AS (SELECT batch_id, COUNT(*) FILTER (a IS DISTINCT FROM b) AS count_mismatches FROM
  (SELECT batch_id, scored, COUNT(*) AS a FROM results GROUP BY ALL) FULL OUTER JOIN (SELECT batch_id, scored, COUNT(*) AS b FROM wanted GROUP BY ALL) USING (batch_id, scored) GROUP BY 1)""",
        final="""SELECT batch_id, stations, stations AS station_rows, CAST(0 AS BIGINT) AS invalid, count_mismatches, count_mismatches = 0 AS reconciled
FROM (SELECT batch_id, COUNT(*) AS stations FROM results GROUP BY 1) FULL OUTER JOIN off USING (batch_id)""",
    ),
)
def station_reconcile(spark: SparkSession, folder: str) -> DataFrame:
    rows = materialize(dv.batches(spark, folder)).withColumnRenamed("forecast_continuous", "forecast")
    results = evaluation.score_station(rows, ["batch_id"])
    wanted = rows.filter("actual > 1").groupBy("batch_id", "station_id").agg(F.count(F.lit(1)).alias("scored"))
    return evaluation.reconcile_stations(results, wanted, ["batch_id"])


@register(
    "artifact_check",
    dv.with_ctes(
        *BATCH_WORLD,
        """doubled AS (SELECT batch_id, station_id, target_timestamp, CASE WHEN local_hour = 12 AND actual > 48 THEN -1.0 ELSE forecast_continuous END AS forecast FROM batches
  UNION ALL SELECT batch_id, station_id, target_timestamp, forecast_continuous FROM batches WHERE actual = 1)""",
        final="""SELECT batch_id, CAST(SUM(n) AS BIGINT) AS row_count, COUNT(DISTINCT station_id) AS stations, COUNT(*) FILTER (n > 1) AS repeated_keys, CAST(SUM(bad) AS BIGINT) AS invalid_values,
 COUNT(*) FILTER (n > 1) = 0 AND SUM(bad) = 0 AS acceptable FROM (
 SELECT batch_id, station_id, target_timestamp, COUNT(*) AS n, COUNT(*) FILTER (forecast IS NULL OR forecast < 0) AS bad FROM doubled GROUP BY ALL) GROUP BY 1""",
    ),
)
def artifact_check(spark: SparkSession, folder: str) -> DataFrame:
    rows = dv.batches(spark, folder)
    broken = (F.col("local_hour") == 12) & (F.col("actual") > 48)
    base = rows.select(
        "batch_id", "station_id", "target_timestamp",
        F.when(broken, F.lit(-1.0)).otherwise(F.col("forecast_continuous")).alias("forecast"),
    )
    again = rows.filter("actual = 1").select(
        "batch_id", "station_id", "target_timestamp", F.col("forecast_continuous").alias("forecast")
    )
    return evaluation.artifact_check(base.unionByName(again), ["batch_id"])


# ---- publishing -----------------------------------------------------------------

def _publishable(spark: SparkSession, folder: str) -> DataFrame:
    """Records with the year as batch, so that the sink writes a few larger partitions."""
    return records(spark, folder).withColumn("batch_id", F.date_format("target_timestamp", "'Y'yyyy"))


PUBLISH_SQL = dv.with_ctes(
    *BATCH_WORLD, RECORDS_SQL,
    final="SELECT 'Y' || year(target_timestamp) AS batch_id, COUNT(*) AS row_count, 'REPLAY' AS disposition, true AS intact FROM records WHERE batch_status <> 'blocked' GROUP BY 1",
)


@register("publish_replay", PUBLISH_SQL)
def publish_replay(spark: SparkSession, folder: str) -> DataFrame:
    """Publishes all batches, offers them again, and verifies what is stored."""
    out = scratch_path(spark, "publish")
    offered = _publishable(spark, folder)
    publish.publish_batches(offered, out)
    again = publish.publish_batches(offered, out)
    intact = publish.verify_published(spark, out).select("batch_id", "intact")
    return again.join(intact, "batch_id").select("batch_id", "row_count", "disposition", "intact")


@register(
    "current_pointer",
    dv.with_ctes(
        *BATCH_WORLD, RECORDS_SQL,
        final="SELECT MAX(batch_id) FILTER (batch_status <> 'blocked') AS batch_id FROM records",
    ),
)
def current_pointer(spark: SparkSession, folder: str) -> DataFrame:
    manifest = publish.batch_manifest(records(spark, folder)).withColumn("published_at", _origin())
    return publish.current_pointer(manifest).select("batch_id")


@register(
    "version_publish",
    """SELECT o_orderpriority, COUNT(*) AS orders, ROUND(SUM(o_totalprice), 2) AS total, 'v2' AS version FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1""",
)
def version_publish(spark: SparkSession, folder: str) -> DataFrame:
    """Orders in two versions through the sink with a commit; a reader sees the second."""
    out = scratch_path(spark, "versions")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    for version, rows in (("v1", orders), ("v2", orders.filter("o_orderstatus <> 'P'")), ("v1", orders)):
        versions.publish_version(rows, out, version, required=["o_orderkey"], finite=["o_totalprice"])
    now = versions.current(spark, out, orders.schema)
    return now.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.lit(versions.manifest(out)["version"]).alias("version")
    )
