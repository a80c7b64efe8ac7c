"""Hierarchical-median and seasonal-naive baselines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gridlark.functions.numeric import at_least_zero
from gridlark.functions.quantiles import exact_median, median_by_rank
from gridlark.session import materialize

SEASON_DAYS = 7  # fixed value


def historical_median(targets: DataFrame, history: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Adds ``median_forecast``: the finest median that exists, never below zero.

    ``history`` is already cut at the origin.  With no history at all the
    forecast is NULL.  A level takes the history of those targets only that no
    finer level has served, and most find the finest.
    """
    known = history.filter(F.col("target").isNotNull()).select(
        *scope, "station_id", F.weekday("local_date").alias("weekday"), "local_hour", "target"
    )
    keys = [*scope, "station_id"]
    df = targets.withColumn("weekday", F.weekday("local_date")).withColumn("_m", F.lit(None).cast("double"))
    for level in ([*keys, "weekday", "local_hour"], [*keys, "local_hour"], keys):
        wanted = df.filter("_m is null").select(*level).distinct()
        found = known.select(*level, "target").join(wanted.hint("shuffle_hash"), level, "left_semi")
        found = median_by_rank(found, level, "target", "_next")
        df = materialize(df.join(found, level, "left").withColumn("_m", F.coalesce("_m", "_next")).drop("_next"))
        if df.filter("_m is null").isEmpty():
            break
    else:
        # Several passes look at the whole column, so it is stored once.
        overall = exact_median(known if scope else materialize(known.select("target")), scope, "target", "_m_all")
        df = df.join(F.broadcast(overall), list(scope), "left") if scope else df.withColumn("_m_all", overall.scalar())
        df = df.withColumn("_m", F.coalesce("_m", "_m_all")).drop("_m_all")
    out = df.withColumn("median_forecast", F.when(F.col("_m").isNotNull(), at_least_zero(F.col("_m")))).drop("_m")
    kept = [*targets.columns, "median_forecast"]
    return out.select(*kept)


def seasonal_naive(targets: DataFrame, history: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Adds ``seasonal_forecast`` and ``used_fallback``.

    The value seven calendar days earlier; where that row or its label is
    missing, the hierarchical median.
    """
    keys = [*scope, "station_id", "local_hour", "local_date"]
    # Only the week before the targets can match.
    first, last = (targets.agg(f(F.date_sub("local_date", SEASON_DAYS))).scalar() for f in (F.min, F.max))
    earlier = history.filter(F.col("local_date").between(first, last)).select(
        *keys[:-1],
        F.date_add("local_date", SEASON_DAYS).alias("local_date"),
        F.col("target").alias("_season"),
    )
    df = historical_median(targets, history, scope).join(earlier, keys, "left")
    value = F.coalesce(F.col("_season"), F.col("median_forecast"))
    return df.withColumns(
        {
            "seasonal_forecast": F.when(value.isNotNull(), at_least_zero(value)),
            "used_fallback": F.col("_season").isNull(),
        }
    ).drop("_season")
