"""Instants, local calendar keys and calendar encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values.
SERVICE_HOURS = (7, 8, 9, 10, 11, 12)
HORIZON_DAYS = 7
DAYS_PER_YEAR = 365.2425
ORDINAL_OF_EPOCH = 719163
OFFSET_PATTERN = r"(Z|[+-]\d{2}:?\d{2})$"


def has_offset(text: Column) -> Column:
    """True where the text ends in an explicit UTC offset."""
    return F.coalesce(F.trim(text).rlike(OFFSET_PATTERN), F.lit(False))


def parse_instant(text: Column) -> Column:
    """Instant of an offset-carrying text, NULL when offset-free or malformed.

    The pattern test comes first: the parser alone would take offset-free text
    as session-local time.
    """
    colon = F.regexp_replace(F.trim(text), r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.when(has_offset(text), F.try_to_timestamp(colon))


def with_local_keys(df: DataFrame, zone: str, instant: str = "timestamp_utc") -> DataFrame:
    """Adds ``local_date`` and ``local_hour`` of the service zone (DST aware)."""
    local = F.from_utc_timestamp(F.col(instant), zone)
    return df.withColumns(
        {"local_date": F.to_date(local), "local_hour": F.hour(local).cast("short")}
    )


def local_instant(day: Column, hour: Column, zone: str) -> Column:
    """UTC instant of a local wall-clock hour."""
    wall = F.timestamp_seconds(F.unix_date(day).cast("long") * 86400 + hour.cast("long") * 3600)
    return F.to_utc_timestamp(wall, zone)


def noon_before(day: Column, zone: str) -> Column:
    """Forecast origin: 12:00 local on the day before ``day``."""
    return local_instant(F.date_sub(day, 1), F.lit(12), zone)


def lead_hours(target: Column, origin: Column) -> Column:
    return (F.unix_micros(target) - F.unix_micros(origin)) / F.lit(3.6e9)


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    angle = F.lit(2.0) * F.pi() * value / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


CALENDAR_COLUMNS = (
    "weekday",
    "is_weekend",
    "month",
    "day_of_year",
    "weekday_sin",
    "weekday_cos",
    "day_of_year_sin",
    "day_of_year_cos",
    "hour_sin",
    "hour_cos",
    "trend_index",
)


def with_calendar(df: DataFrame) -> DataFrame:
    """Calendar features of ``local_date`` and ``local_hour``."""
    day = F.col("local_date")
    weekday = F.weekday(day)
    ordinal_day = F.dayofyear(day)
    week_sin, week_cos = cyclic(weekday, 7)
    year_sin, year_cos = cyclic(ordinal_day, DAYS_PER_YEAR)
    hour_sin, hour_cos = cyclic(F.col("local_hour"), 24)
    return df.withColumns(
        {
            "weekday": weekday.cast("byte"),
            "is_weekend": weekday.isin(5, 6).cast("byte"),
            "month": F.month(day).cast("byte"),
            "day_of_year": ordinal_day.cast("short"),
            "weekday_sin": week_sin,
            "weekday_cos": week_cos,
            "day_of_year_sin": year_sin,
            "day_of_year_cos": year_cos,
            "hour_sin": hour_sin,
            "hour_cos": hour_cos,
            "trend_index": (F.unix_date(day) + ORDINAL_OF_EPOCH).cast("int"),
        }
    )
