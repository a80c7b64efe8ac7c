"""Completeness, freshness, rolling error and the action they call for."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridlark.functions.numeric import is_finite, lift
from gridlark.operators.evaluation import rmse

# Fixed values.
WARNING_COMPLETENESS = 1.0
CRITICAL_COMPLETENESS = 0.99
ROLLING_DAYS = 28
CRITICAL_SOURCES = ("station_metadata", "passenger_history")
SEVERITY_RANK = {"info": 0, "warning": 1, "critical": 2}


def join_labels(
    forecasts: DataFrame, labels: DataFrame, baseline: DataFrame | None, by: Sequence[str] = ("batch_id",)
) -> DataFrame:
    """Forecasts with their labels and, where known, the baseline.

    A station and instant has one label and one baseline; a second one that a
    forecast meets fails the job.
    """
    keys = ["station_id", "target_timestamp"]
    joined = forecasts.join(single(labels, keys, "actual"), keys)
    if baseline is None:
        return joined.withColumn("baseline_forecast", F.lit(None).cast("double"))
    return joined.join(single(baseline, keys, "baseline_forecast"), keys, "left")


def single(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys and value, a row per key; reading the value of a key that comes twice raises an error that names it.

    The count shares its shuffle with the join on the same keys that follows.
    """
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(value).alias(value))
    words = F.concat_ws(" ", F.lit(f"{value} comes more than once for"), *(F.col(k).cast("string") for k in keys))
    kind = df.schema[value].dataType
    return counted.select(*keys, F.when(F.col("_n") > 1, F.raise_error(words).cast(kind)).otherwise(F.col(value)).alias(value))


def rolling_scope(joined: DataFrame, by: Sequence[str], days: int = ROLLING_DAYS) -> DataFrame:
    """Scoreable rows whose target lies in the last days before the newest label.

    The newest label is an aggregate joined back, not a window, so a series that
    holds much of the data is never sorted in one task.
    """
    newest = F.max(F.when(F.col("actual").isNotNull(), F.col("target_timestamp")))
    limit = joined.groupBy(*by).agg((newest - F.expr(f"interval {days} days")).alias("_after"))
    recent = joined.join(limit, list(by)).filter(F.col("target_timestamp") > F.col("_after"))
    return recent.filter(F.col("actual").isNotNull() & is_finite(F.col("forecast_continuous"))).drop("_after")


def performance(scoped: DataFrame, by: Sequence[str]) -> DataFrame:
    """RMSE, bias, baseline RMSE on rows that have one, and relative lift."""
    error = F.col("forecast_continuous") - F.col("actual")
    usable = is_finite(F.col("baseline_forecast"))
    base_error = F.when(usable, F.col("baseline_forecast") - F.col("actual"))
    out = scoped.groupBy(*by).agg(
        F.count(F.lit(1)).alias("scored"),
        rmse(error).alias("rmse"),
        F.avg(error).alias("bias"),
        rmse(base_error).alias("baseline_rmse"),
    )
    return out.withColumn("lift", lift(F.col("baseline_rmse"), F.col("rmse")))


def completeness(forecasts: DataFrame, expected: Column | int, by: Sequence[str] = ("batch_id",)) -> DataFrame:
    """Valid records with an unrepeated key over expected records, capped at one."""
    valid = is_finite(F.col("forecast_continuous")) & (F.col("forecast_continuous") >= 0)
    keyed = forecasts.groupBy(*by, "station_id", "target_timestamp").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(valid).alias("ok")
    )
    wanted = expected if isinstance(expected, Column) else F.lit(expected)
    done = keyed.groupBy(*by).agg(F.count_if((F.col("n") == 1) & (F.col("ok") == 1)).alias("complete"))
    share = F.least(F.lit(1.0), F.col("complete") / wanted)
    return done.withColumns({"completeness": share}).withColumn(
        "severity",
        F.when(F.col("completeness") < CRITICAL_COMPLETENESS, "critical")
        .when(F.col("completeness") < WARNING_COMPLETENESS, "warning")
        .otherwise("info"),
    )


def freshness(
    watermarks: DataFrame, limits: DataFrame, now: Column, critical: Sequence[str] = CRITICAL_SOURCES
) -> DataFrame:
    """Age in hours per source against its limit; no watermark counts as stale."""
    age = (F.unix_micros(now) - F.unix_micros("watermark")) / F.lit(3.6e9)
    df = watermarks.join(limits, "source", "left").withColumn(
        "age_hours", F.when(F.col("watermark").isNotNull(), F.greatest(F.lit(0.0), age))
    )
    stale = F.col("age_hours").isNull() | F.coalesce(F.col("age_hours") > F.col("limit_hours"), F.lit(False))
    severity = F.when(~stale, "info").when(F.col("source").isin(*critical), "critical").otherwise("warning")
    return df.withColumns({"stale": stale, "severity": severity})


FINDING = "metric string, scope string, severity string, value double, threshold double"


def performance_findings(
    scores: DataFrame, by: Sequence[str], max_rmse: float | None = None, max_bias: float | None = None
) -> DataFrame:
    """Threshold findings of scored batches, one row each."""
    def finding(hit: Column, metric: str, value: Column, threshold: Column) -> Column:
        return F.when(
            F.coalesce(hit, F.lit(False)),
            F.struct(
                F.lit(metric).alias("metric"), F.lit("overall").alias("scope"), F.lit("warning").alias("severity"),
                value.cast("double").alias("value"), threshold.cast("double").alias("threshold"),
            ),
        )

    score, bias, base = F.col("rmse"), F.abs("bias"), F.col("baseline_rmse")
    tests = [finding(score >= base, "champion_vs_baseline_rmse", score - base, F.lit(0.0))]
    if max_rmse is not None:
        tests.append(finding(score > max_rmse, "rmse", score, F.lit(max_rmse)))
    if max_bias is not None:
        tests.append(finding(bias > max_bias, "absolute_bias", bias, F.lit(max_bias)))
    return scores.select(*by, F.explode(F.array_compact(F.array(*tests))).alias("_f")).select(*by, "_f.*")


def completeness_findings(table: DataFrame, by: Sequence[str]) -> DataFrame:
    threshold = F.when(F.col("severity") == "critical", CRITICAL_COMPLETENESS).otherwise(WARNING_COMPLETENESS)
    return table.filter("severity <> 'info'").select(
        *by, F.lit("completeness").alias("metric"), F.lit("batch").alias("scope"), "severity",
        F.col("completeness").alias("value"), threshold.alias("threshold"),
    )


def freshness_findings(table: DataFrame, by: Sequence[str]) -> DataFrame:
    return table.filter("stale").select(
        *by, F.lit("freshness_hours").alias("metric"), F.col("source").alias("scope"), "severity",
        F.col("age_hours").alias("value"), F.col("limit_hours").alias("threshold"),
    )


def decide(findings: DataFrame, by: Sequence[str]) -> DataFrame:
    """Highest severity and one action per group: block, fall back, alert or none."""
    rank = F.lit(0)
    for name, value in SEVERITY_RANK.items():
        rank = F.when(F.col("severity") == name, value).otherwise(rank)
    hard = F.col("metric").isin("freshness_hours", "completeness") & (F.col("severity") == "critical")
    soft = (F.col("metric") == "freshness_hours") & (F.col("severity") == "warning")
    out = findings.groupBy(*by).agg(
        F.max(rank).alias("_rank"), F.bool_or(hard).alias("_hard"), F.bool_or(soft).alias("_soft"),
        F.count("metric").alias("findings"),
    )
    severity = F.when(F.col("_rank") == 2, "critical").when(F.col("_rank") == 1, "warning").otherwise("info")
    action = (
        F.when(F.col("_hard"), "block_publication")
        .when(F.col("_soft"), "fallback")
        .when(F.col("_rank") == 1, "alert")
        .otherwise("none")
    )
    return out.select(*by, "findings", severity.alias("severity"), action.alias("action"))


def source_ages(limits: Mapping[str, float], session) -> DataFrame:
    """Limit table from a mapping of source names to hours."""
    return session.createDataFrame(sorted(limits.items()), "source string, limit_hours double")
