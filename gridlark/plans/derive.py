"""How the shared tables take the roles of the engine's inputs.

Every role exists twice: as a DataFrame and as the SQL text of a common table
expression, so that a query and its oracle start from the same rows.  All rows
of the shared tables take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gridlark.functions.geo import sensor_key
from gridlark.sources.tables import read_shared as table

ZONE = "UTC"


def at_hour(day: str, hour: str) -> Column:
    """UTC instant of a date column and an hour column."""
    return F.timestamp_seconds(F.unix_date(day).cast("long") * 86400 + F.col(hour).cast("long") * 3600)


def text_time(column: str | Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def text_day(column: str | Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd")


# Hourly panel: a station is a supplier, an observation the quantity it shipped
# in one hour slot; slots that hold only returned, fulfilled lines have no label.
PANEL_SQL = """panel AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS station_id, CAST(l_shipdate AS DATE) AS local_date,
         CAST(7 + (l_linenumber - 1) % 6 AS SMALLINT) AS local_hour,
         SUM(CASE WHEN NOT (l_returnflag = 'R' AND l_linestatus = 'F') THEN l_quantity END) AS target,
         CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) + INTERVAL 1 HOUR * (7 + (l_linenumber - 1) % 6) AS timestamp_utc
  FROM lineitem GROUP BY ALL)"""


def _panel_lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("station_id"),
        F.to_date("l_shipdate").alias("local_date"),
        (F.lit(7) + (F.col("l_linenumber") - 1) % 6).cast("short").alias("local_hour"),
        F.when(~((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")), F.col("l_quantity")).alias("q"),
    )


def _panel_cells(lines: DataFrame) -> DataFrame:
    cells = lines.groupBy("station_id", "local_date", "local_hour").agg(F.sum("q").alias("target"))
    return cells.withColumn("timestamp_utc", at_hour("local_date", "local_hour"))


def panel(spark: SparkSession, folder: str) -> DataFrame:
    return _panel_cells(_panel_lines(spark, folder))


def panel_by_station(spark: SparkSession, folder: str) -> DataFrame:
    """The panel in partitions by station that are not merged: cells, windows and joins of a station share one shuffle."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return _panel_cells(_panel_lines(spark, folder).repartition(tasks, "station_id"))


def panel_slots(spark: SparkSession, folder: str) -> DataFrame:
    """Calendar hours of the panel, at most 24 a day."""
    return _panel_lines(spark, folder).select("local_date", "local_hour").distinct()


STATIONS_SQL = """stations AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS station_id, s_name AS station_name,
         -60.0 + CAST((s_suppkey * 37) % 1200 AS DOUBLE) / 10 AS latitude,
         -180.0 + CAST((s_suppkey * 53) % 3600 AS DOUBLE) / 10 AS longitude,
         CAST(20 + s_suppkey % 60 AS DOUBLE) AS station_capacity,
         s_nationkey % 2 = 0 AS interchange, s_acctbal / 1000 AS connectivity
  FROM supplier)"""


def stations(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, folder, "supplier").select(
        key.cast("string").alias("station_id"),
        F.col("s_name").alias("station_name"),
        (F.lit(-60.0) + ((key * 37) % 1200).cast("double") / 10).alias("latitude"),
        (F.lit(-180.0) + ((key * 53) % 3600).cast("double") / 10).alias("longitude"),
        (F.lit(20) + key % 60).cast("double").alias("station_capacity"),
        (F.col("s_nationkey") % 2 == 0).alias("interchange"),
        (F.col("s_acctbal") / 1000).alias("connectivity"),
    )


# Traffic: a sensor is a nation, a reading the price of an order placed from it.
SENSORS_SQL = """sensors AS (
  SELECT n_nationkey, latitude, longitude,
         'sensor_' || substr(sha256(printf('%.6f,%.6f', latitude, longitude)), 1, 12) AS sensor_id
  FROM (SELECT n_nationkey, -55.0 + CAST((n_nationkey * 29) % 110 AS DOUBLE) AS latitude,
               -175.0 + CAST((n_nationkey * 41) % 350 AS DOUBLE) AS longitude FROM nation))"""

TRAFFIC_SQL = """traffic AS (
  SELECT s.sensor_id, CAST(o_orderdate AS DATE) AS local_date,
         CAST(7 + o_orderkey % 6 AS SMALLINT) AS local_hour, floor(o_totalprice) AS traffic,
         CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 1 HOUR * (7 + o_orderkey % 6) AS timestamp_utc
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN sensors s ON c_nationkey = s.n_nationkey)"""


def sensors(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("n_nationkey")
    placed = table(spark, folder, "nation").select(
        "n_nationkey",
        (F.lit(-55.0) + ((key * 29) % 110).cast("double")).alias("latitude"),
        (F.lit(-175.0) + ((key * 41) % 350).cast("double")).alias("longitude"),
    )
    return placed.withColumn("sensor_id", sensor_key(F.col("latitude"), F.col("longitude")))


def traffic(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(
        "o_custkey",
        F.to_date("o_orderdate").alias("local_date"),
        (F.lit(7) + F.col("o_orderkey") % 6).cast("short").alias("local_hour"),
        F.floor("o_totalprice").cast("double").alias("traffic"),
    )
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    located = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(
        sensors(spark, folder), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return located.select(
        "sensor_id", "local_date", "local_hour", "traffic",
        at_hour("local_date", "local_hour").alias("timestamp_utc"),
    )


# Weather: one row per hour slot in which any order was placed.
WEATHER_SQL = """weather AS (
  SELECT CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 1 HOUR * (7 + o_orderkey % 6) AS timestamp_utc,
         AVG(CASE WHEN o_orderstatus <> 'P' THEN floor(o_totalprice / 10000) END) AS temperature,
         MAX(CASE WHEN o_orderpriority = '1-URGENT' THEN floor(o_totalprice / 100000)
                  WHEN o_orderpriority = '5-LOW' THEN 0 END) AS precipitation
  FROM orders GROUP BY 1)"""


def weather(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(
        F.to_date("o_orderdate").alias("d"),
        (F.lit(7) + F.col("o_orderkey") % 6).cast("short").alias("h"),
        F.when(F.col("o_orderstatus") != "P", F.floor(F.col("o_totalprice") / 10000).cast("double")).alias("t"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.floor(F.col("o_totalprice") / 100000).cast("double"))
        .when(F.col("o_orderpriority") == "5-LOW", F.lit(0.0))
        .alias("p"),
    )
    slots = orders.groupBy("d", "h").agg(F.avg("t").alias("temperature"), F.max("p").alias("precipitation"))
    return slots.select(at_hour("d", "h").alias("timestamp_utc"), "temperature", "precipitation")


def last_day(spark: SparkSession, folder: str) -> Column:
    """Newest ship date, as a scalar subquery."""
    newest = table(spark, folder, "lineitem").agg(F.max(F.to_date("l_shipdate")).alias("d"))
    return newest.scalar()


# Three back-to-back validation weeks that end with the panel.
FOLDS_SQL = """folds AS (
  SELECT 'fold_' || k AS fold_id, last_day - (4 - k) * 7 + 1 AS start_date,
         last_day - (4 - k) * 7 + 7 AS end_date,
         CAST(last_day - (4 - k) * 7 AS TIMESTAMP) + INTERVAL 12 HOUR AS origin
  FROM (SELECT CAST(MAX(l_shipdate) AS DATE) AS last_day FROM lineitem), (VALUES (1), (2), (3)) AS v(k))"""


# Weekly batches: the forecast is last week's value, else the station's median;
# the baseline is the station-hour median.  Each panel row is one target.
BATCHES_SQL = """batches AS (
  SELECT 'W' || lpad(CAST((p.local_date - DATE '1995-01-02') // 7 AS VARCHAR), 4, '0') AS batch_id,
         p.station_id, p.local_date, p.local_hour, p.timestamp_utc AS target_timestamp, p.target AS actual,
         COALESCE(l.target, s.m) AS forecast_continuous, h.m AS baseline_forecast
  FROM panel p
  LEFT JOIN panel l ON l.station_id = p.station_id AND l.local_hour = p.local_hour AND l.local_date = p.local_date - 7
  LEFT JOIN (SELECT station_id, MEDIAN(target) AS m FROM panel GROUP BY 1) s ON s.station_id = p.station_id
  LEFT JOIN (SELECT station_id, local_hour, MEDIAN(target) AS m FROM panel GROUP BY 1, 2) h
    ON h.station_id = p.station_id AND h.local_hour = p.local_hour)"""


def batches(spark: SparkSession, folder: str) -> DataFrame:
    """One shuffle by station serves the lag and both medians; a station has at most one row per calendar hour.

    Its partitions are not merged: what a task sorts here, and what callers
    aggregate in the same task, would grow with the input up to the advised size.
    """
    from gridlark.operators.features import lag_columns

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = panel(spark, folder).drop("timestamp_utc").repartition(tasks, "station_id")
    middle = F.percentile("target", F.lit(0.5))
    lagged = (
        base.withColumns(lag_columns("target", ["station_id", "local_hour"], [7], "t"))
        .withColumn("baseline_forecast", middle.over(Window.partitionBy("station_id", "local_hour")))
        .withColumn("_s", middle.over(Window.partitionBy("station_id")))
    )
    week = F.floor(F.datediff("local_date", F.lit("1995-01-02").cast("date")) / 7).cast("int")
    return lagged.select(
        F.concat(F.lit("W"), F.lpad(week.cast("string"), 4, "0")).alias("batch_id"),
        "station_id", "local_date", "local_hour",
        at_hour("local_date", "local_hour").alias("target_timestamp"),
        F.col("target").alias("actual"),
        F.coalesce("t_lag_7d", "_s").alias("forecast_continuous"),
        "baseline_forecast",
    )


def with_ctes(*parts: str, final: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + final


PANEL_WORLD = (PANEL_SQL, STATIONS_SQL, SENSORS_SQL, TRAFFIC_SQL, WEATHER_SQL)


# Candidate predictions: a candidate is a brand within a type, a fold is a ship year.
CANDIDATES_SQL = """predictions AS (
  SELECT p_type AS model_family, p_brand AS candidate_id, 'fold_' || year(l_shipdate) AS fold_id,
         CAST(l_suppkey AS VARCHAR) AS station_id,
         CASE WHEN l_returnflag <> 'R' THEN l_quantity END AS actual,
         CASE WHEN p_type = 'LARGE' AND p_size = 13 THEN NULL
              ELSE CAST(p_size AS DOUBLE) - 5 + CAST(l_tax * 100 AS INTEGER) % 3 END AS forecast, l_tax, l_discount
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(
        "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_returnflag", "l_tax", "l_discount"
    )
    parts = table(spark, folder, "part").select("p_partkey", "p_type", "p_brand", "p_size")
    broken = (F.col("p_type") == "LARGE") & (F.col("p_size") == 13)
    shift = (F.col("l_tax") * 100 + 0.5).cast("int") % 3
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_type").alias("model_family"),
        F.col("p_brand").alias("candidate_id"),
        F.concat(F.lit("fold_"), F.year("l_shipdate").cast("string")).alias("fold_id"),
        F.col("l_suppkey").cast("string").alias("station_id"),
        F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("actual"),
        F.when(~broken, F.col("p_size").cast("double") - 5 + shift).alias("forecast"),
        "l_tax",
        "l_discount",
    )
