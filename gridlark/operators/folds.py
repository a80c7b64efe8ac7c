"""Date splits and expanding rolling-origin folds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from gridlark.functions.calendar import HORIZON_DAYS, SERVICE_HOURS, local_instant, noon_before


def last_dates(panel: DataFrame, days: int = HORIZON_DAYS) -> DataFrame:
    """The last distinct local dates.

    The distinct dates are a calendar, a few thousand rows whatever the size of
    the panel, and the sort with limit keeps ``days`` rows per task.
    """
    return panel.select("local_date").distinct().orderBy(F.desc("local_date")).limit(days)


def date_split(panel: DataFrame, days: int = HORIZON_DAYS) -> DataFrame:
    """Adds ``role``: ``test`` on the last distinct dates, ``train`` before."""
    first_held_out = last_dates(panel, days).agg(F.min("local_date")).scalar()
    role = F.when(F.col("local_date") >= first_held_out, "test").otherwise("train")
    return panel.withColumn("role", role)


@dataclass(frozen=True)
class FoldWindows:
    """Back-to-back validation windows that end at ``last_day``, oldest first."""

    last_day: Column
    zone: str
    count: int = 3
    days: int = 7

    def expand(self, df: DataFrame) -> DataFrame:
        """One copy of each row per fold, fold columns attached.

        The fold number is generated inside the scan stage; there is no join.
        """
        numbered = df.withColumns(
            {"_last": self.last_day, "_k": F.explode(F.sequence(F.lit(1), F.lit(self.count)))}
        )
        start = F.date_sub("_last", (F.lit(self.count + 1) - F.col("_k")) * self.days - 1)
        placed = numbered.withColumns(
            {"fold_id": F.concat(F.lit("fold_"), F.col("_k").cast("string")), "start_date": start}
        )
        return placed.withColumns(
            {
                "end_date": F.date_add("start_date", self.days - 1),
                "origin": noon_before(F.col("start_date"), self.zone),
            }
        ).drop("_last", "_k")


def expand_folds(df: DataFrame, windows: FoldWindows) -> DataFrame:
    return windows.expand(df)


def fold_rows(panel: DataFrame, windows: FoldWindows) -> DataFrame:
    """Train and validation rows per fold, the training set expanding with time."""
    rows = expand_folds(panel, windows).filter(F.col("local_date") <= F.col("end_date"))
    role = F.when(F.col("local_date") < F.col("start_date"), "train").otherwise("validation")
    return rows.withColumn("role", role)


def fold_summary(panel: DataFrame, windows: FoldWindows) -> DataFrame:
    rows = fold_rows(panel, windows)
    per_date = rows.groupBy("fold_id", "start_date", "end_date", "origin", "role", "local_date").agg(
        F.count(F.lit(1)).alias("n"), F.count("target").alias("known")
    )
    return per_date.groupBy("fold_id", "start_date", "end_date", "origin", "role").agg(
        F.count(F.lit(1)).alias("dates"), F.sum("n").alias("row_count"), F.sum("known").alias("labelled")
    )


def missing_validation_dates(panel: DataFrame, windows: FoldWindows) -> DataFrame:
    """Validation dates of a fold that the panel does not hold."""
    dates = panel.select("local_date").distinct()
    wanted = windows.expand(panel.sparkSession.range(1)).select(
        "fold_id", F.explode(F.sequence("start_date", "end_date")).alias("local_date")
    )
    return wanted.join(dates, "local_date", "left_anti").select("fold_id", "local_date")


def target_grid(
    stations: DataFrame,
    origin: Column,
    zone: str,
    days: int = HORIZON_DAYS,
    hours: tuple[int, ...] = SERVICE_HOURS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Every station on each of the next local dates at each service hour; ``keep`` names columns to carry."""
    first = F.date_add(F.to_date(F.from_utc_timestamp(origin, zone)), 1)
    grid = stations.select("station_id", *keep, F.explode(F.sequence(first, F.date_add(first, days - 1))).alias("local_date"))
    grid = grid.select(
        "*", F.explode(F.array(*[F.lit(h).cast("short") for h in hours])).alias("local_hour")
    )
    return grid.withColumn(
        "target_timestamp", local_instant(F.col("local_date"), F.col("local_hour"), zone)
    )
