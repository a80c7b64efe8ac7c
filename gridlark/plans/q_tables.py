"""Sources, sinks, table contracts, keys and orders over the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridlark.functions import numeric as num
from gridlark.functions.hashing import attachment_key
from gridlark.operators import batches, contracts, orders as order_ops, spatial
from gridlark.operators.ordered import number_rows, number_within
from gridlark.plans import derive as dv
from gridlark.plans.registry import register
from gridlark.session import scratch_path
from gridlark.sources import publish, tables
from gridlark.sources.tables import read_shared as table

# ---- scans and sinks: what is written as CSV, JSON or files comes back unchanged --------------


@register(
    "csv_scan",
    """SELECT o_orderpriority, COUNT(*) AS row_count, COUNT(DISTINCT o_custkey) AS customers, CAST(SUM(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents,
 strftime(MAX(o_orderdate), '%Y-%m-%d') AS newest FROM orders GROUP BY 1""",
)
def csv_scan(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "orders-csv")
    table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice", dv.text_day("o_orderdate").alias("day")
    ).write.option("header", True).csv(path)
    read = tables.read_csv(spark, path, "o_orderkey bigint, o_custkey bigint, o_orderpriority string, o_totalprice double, day string")
    return read.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct("o_custkey").alias("customers"),
        F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"), F.max("day").alias("newest"),
    )


@register(
    "scan_by_suffix",
    """SELECT kind, p_brand, COUNT(*) AS parts, CAST(SUM(p_size) AS BIGINT) AS sizes FROM part, (VALUES ('parquet'), ('csv')) k(kind) GROUP BY ALL""",
)
def scan_by_suffix(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "part") + ".csv"
    parts = table(spark, folder, "part").select("p_partkey", "p_brand", "p_size")
    parts.write.option("header", True).csv(path)
    stored = tables.read_by_suffix(spark, f"{folder}/part.parquet").select("p_partkey", "p_brand", "p_size")
    copied = tables.read_by_suffix(spark, path, parts.schema)
    both = stored.withColumn("kind", F.lit("parquet")).unionByName(copied.withColumn("kind", F.lit("csv")))
    return both.groupBy("kind", "p_brand").agg(F.count(F.lit(1)).alias("parts"), F.sum("p_size").cast("long").alias("sizes"))


@register(
    "guarded_csv",
    """SELECT c_mktsegment AS segment, COUNT(*) AS row_count, CAST(SUM(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS cents FROM customer GROUP BY 1""",
)
def guarded_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Published twice: the second publish replaces the first."""
    rows = table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("station_id"), F.lit("2025-01-01").alias("target_timestamp"), "c_mktsegment", "c_acctbal")
    path, count = scratch_path(spark, "guarded"), rows.count()
    publish.publish_csv(rows.withColumn("c_acctbal", F.lit(0.0)), path, count)
    read = publish.publish_csv(rows, path, count)
    return read.groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.count(F.lit(1)).alias("row_count"), F.sum(F.round(F.col("c_acctbal").cast("double") * 100).cast("long")).alias("cents"))


@register(
    "json_report",
    """SELECT event_type, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, COUNT(*) AS events, CASE WHEN COUNT(*) > 1 THEN MAX(user_id) END AS top_user FROM events GROUP BY ALL""",
)
def json_report(spark: SparkSession, folder: str) -> DataFrame:
    days = table(spark, folder, "events").groupBy("event_type", dv.text_day(F.col("ts").cast("timestamp")).alias("day")).agg(
        F.count(F.lit(1)).alias("events"), F.max("user_id").alias("u"))
    report = days.select("event_type", "day", "events", F.when(F.col("events") > 1, F.col("u")).alias("top_user"))
    path = scratch_path(spark, "report")
    publish.write_report(report, path)
    return spark.read.schema("event_type string, day string, events bigint, top_user bigint").json(path)


@register(
    "json_verdicts",
    """SELECT d.source, COUNT(*) AS texts, COUNT(v.suspicious) AS judged, COUNT(*) FILTER (v.suspicious) AS suspicious
FROM documents d LEFT JOIN (SELECT sha256(text) AS digest, bool_or(toxic = 1) AS suspicious FROM documents JOIN labels USING (doc_id) GROUP BY 1) v ON sha256(d.text) = v.digest GROUP BY 1""",
)
def json_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    texts = table(spark, folder, "documents").select("doc_id", "source", F.sha2("text", 256).alias("content_digest"))
    judged = texts.join(table(spark, folder, "labels"), "doc_id").groupBy("content_digest").agg(F.bool_or(F.col("toxic") == 1).alias("suspicious"))
    path = scratch_path(spark, "verdicts")
    judged.withColumn("reason", F.lit(None).cast("string")).write.json(path)
    joined = texts.join(tables.read_verdicts(spark, path), "content_digest", "left")
    return joined.groupBy("source").agg(
        F.count(F.lit(1)).alias("texts"), F.count("suspicious").alias("judged"), F.count_if("suspicious").alias("suspicious"))


@register(
    "binary_digest",
    """WITH files AS (SELECT o_orderkey // 4096 AS chunk, COUNT(*) AS n FROM orders GROUP BY 1)
SELECT status, COUNT(*) AS refs FROM (SELECT CASE chunk % 3 WHEN 1 THEN 'ATTACHMENT_DIGEST_MISMATCH' WHEN 2 THEN 'ATTACHMENT_SIZE_MISMATCH' ELSE 'OK' END AS status FROM files
 UNION ALL SELECT 'MISSING' FROM files) GROUP BY 1""",
)
def binary_digest(spark: SparkSession, folder: str) -> DataFrame:
    """A file of order keys for each run of 4096; references to a third are tampered in the digest, to a third in the size."""
    keys = table(spark, folder, "orders").select(F.floor(F.col("o_orderkey") / 4096).alias("chunk"), "o_orderkey")
    # At most 4096 keys in a text.
    texts = keys.groupBy("chunk").agg(F.array_join(F.array_sort(F.collect_list("o_orderkey")).cast("array<string>"), " ").alias("value"))
    texts = texts.withColumn("storage_ref", F.concat(F.lit("chunk-"), F.col("chunk").cast("string")))
    path = scratch_path(spark, "files")
    texts.select("storage_ref", "value").write.partitionBy("storage_ref").text(path)
    content = F.concat("value", F.lit("\n"))
    turn = F.col("chunk") % 3
    refs = texts.select(
        "storage_ref", F.when(turn == 1, F.sha2("value", 256)).otherwise(F.sha2(content, 256)).alias("digest"),
        (F.length(content) + F.when(turn == 2, 1).otherwise(0)).cast("long").alias("byte_size"))
    lost = refs.withColumn("storage_ref", F.concat("storage_ref", F.lit("-lost")))
    checked = tables.check_binary(tables.read_binary(spark, path, from_folder=True), refs.unionByName(lost))
    return checked.groupBy("status").agg(F.count(F.lit(1)).alias("refs"))


# ---- table contracts ----------------------------------------------------------------------------


@register(
    "passenger_contract",
    """WITH raw AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'n/a' WHEN o_orderkey % 10 = 3 THEN '-5' WHEN o_orderkey % 10 = 4 THEN '7.5' ELSE CAST(o_orderkey % 100 AS VARCHAR) END AS entries,
  o_orderkey % 7 = 2 AS bare FROM orders),
n AS (SELECT *, TRY_CAST(entries AS DOUBLE) AS target FROM raw)
SELECT 'INSTANT_MISSING' AS rule, COUNT(*) FILTER (bare) AS broken FROM n UNION ALL SELECT 'TARGET_NULL', COUNT(*) FILTER (target IS NULL) FROM n
UNION ALL SELECT 'TARGET_NEGATIVE', COUNT(*) FILTER (target < 0) FROM n UNION ALL SELECT 'TARGET_NOT_WHOLE', COUNT(*) FILTER (target <> floor(target)) FROM n""",
)
def passenger_contract(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    text = F.when(F.col("o_orderstatus") == "P", "n/a").when(key % 10 == 3, "-5").when(key % 10 == 4, "7.5").otherwise((key % 100).cast("string"))
    stamp = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.when(key % 7 == 2, "").otherwise("Z"))
    raw = table(spark, folder, "orders").select(F.col("o_custkey").alias(" Station "), stamp.alias("DateTime"), text.alias("Entries"))
    made = contracts.passengers_table(raw, "UTC")
    rules = {"INSTANT_MISSING": F.col("timestamp_utc").isNull(), "TARGET_NULL": F.col("target").isNull(), **contracts.passenger_rules()}
    return contracts.rule_counts(made, rules)


@register(
    "traffic_contract",
    """WITH n AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey END AS lat, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_custkey % 170 END AS lon, c_acctbal AS traffic FROM customer)
SELECT 'COORDINATES_NULL' AS rule, COUNT(*) FILTER (lat IS NULL OR lon IS NULL) AS broken FROM n UNION ALL SELECT 'TRAFFIC_NEGATIVE', COUNT(*) FILTER (traffic < 0) FROM n
UNION ALL SELECT 'SENSOR_MISSING', COUNT(*) FILTER (lat IS NULL OR lon IS NULL) FROM n""",
)
def traffic_contract(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    raw = table(spark, folder, "customer").select(
        F.lit("2025-01-01T07:00:00Z").alias("time"), F.when(key % 5 == 0, "none").otherwise(F.col("c_nationkey").cast("string")).alias("LAT"),
        F.when(key % 9 == 0, "nan").otherwise((key % 170).cast("string")).alias("lng"), F.col("c_acctbal").cast("string").alias("Vehicle_Count"))
    made = contracts.traffic_table(raw, "UTC")
    return contracts.rule_counts(made, {**contracts.traffic_rules(), "SENSOR_MISSING": F.col("sensor_id").isNull()})


@register(
    "weather_contract",
    """SELECT 'INSTANT_MISSING' AS rule, COUNT(*) FILTER (user_id % 8 = 1) AS broken FROM events UNION ALL SELECT 'TEMPERATURE_NULL', COUNT(*) FILTER (event_type = 'error') FROM events
UNION ALL SELECT 'PRECIPITATION_NEGATIVE', COUNT(*) FILTER (value < 5) FROM events""",
)
def weather_contract(spark: SparkSession, folder: str) -> DataFrame:
    offset = F.when(F.col("user_id") % 8 == 1, "").otherwise("+00:00")
    raw = table(spark, folder, "events").select(
        F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), offset).alias("timestamp"),
        F.when(F.col("event_type") == "error", "broken").otherwise("12.5").alias("Temp_C"), (F.col("value") - 5).cast("string").alias("rainfall"))
    made = contracts.weather_table(raw, "UTC")
    rules = {"INSTANT_MISSING": F.col("timestamp_utc").isNull(), "TEMPERATURE_NULL": F.col("temperature").isNull(), **contracts.weather_rules()}
    return contracts.rule_counts(made, rules)


@register(
    "mapping_check",
    """SELECT CAST(s_suppkey AS VARCHAR) AS station_id, CASE WHEN s_suppkey % 7 = 0 THEN 'UNMAPPED' ELSE 'REPEATED' END AS problem FROM supplier WHERE s_suppkey % 7 = 0 OR s_suppkey % 5 = 0""",
)
def mapping_check(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("s_suppkey")
    suppliers = table(spark, folder, "supplier")
    once = suppliers.select(key.cast("string").alias("station_id"), F.when(key % 7 != 0, F.concat(F.lit("sensor-"), "s_nationkey")).alias("sensor_id"))
    twice = suppliers.where((key % 5 == 0) & (key % 7 != 0)).select(key.cast("string").alias("station_id"), F.lit("sensor-x").alias("sensor_id"))
    return spatial.mapping_problems(once.unionByName(twice), once)


# ---- keys, nested lines, sets --------------------------------------------------------------------


@register(
    "nested_lines",
    """SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS line_index,
 'lines.' || (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1) AS field_path, l_partkey FROM lineitem""",
)
def nested_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with their few lines nested, and back to rows with their paths."""
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    nested = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(lines.alias("lines"))
    flat = order_ops.explode_lines(nested)
    return flat.select("l_orderkey", F.col("line_index").cast("long").alias("line_index"), "field_path", F.col("line.l_partkey").alias("l_partkey"))


@register(
    "attachment_ids",
    """SELECT doc_id, sha256(source || chr(0) || lang || chr(0) || CAST(doc_id % 9 AS VARCHAR) || chr(0) || sha256(text)) AS attachment_id FROM documents""",
)
def attachment_ids(spark: SparkSession, folder: str) -> DataFrame:
    made = attachment_key(F.col("source"), F.col("lang"), F.col("doc_id") % 9, F.sha2("text", 256))
    return table(spark, folder, "documents").select("doc_id", made.alias("attachment_id"))


@register(
    "batch_ids",
    """SELECT o_orderdate_text, COUNT(*) AS orders, COUNT(DISTINCT id) AS ids, bool_and(same) AS stable FROM (
 SELECT strftime(o_orderdate, '%Y-%m') AS o_orderdate_text, o_orderstatus AS id, true AS same FROM orders) GROUP BY 1""",
)
def batch_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Equal origin and hashes give one id, any other hash another."""
    month = F.date_trunc("month", "o_orderdate").cast("timestamp")
    source, other = F.sha2("o_orderstatus", 256), F.sha2(F.lit("config"), 256)
    one, two = (batches.batch_identity(month, source, source, other) for _ in range(2))
    rows = table(spark, folder, "orders").select(F.date_format(month, "yyyy-MM").alias("o_orderdate_text"), one.alias("id"), (one == two).alias("same"))
    return rows.groupBy("o_orderdate_text").agg(
        F.count(F.lit(1)).alias("orders"), F.count_distinct("id").alias("ids"), F.bool_and("same").alias("stable"))


@register(
    "lift_percent",
    """SELECT l_suppkey, CASE WHEN b > 0 THEN ROUND((b - m) / b * 100, 6) END AS lift_percent FROM (
 SELECT l_suppkey, SUM(l_quantity) FILTER (l_linenumber = 1) AS b, SUM(l_quantity) FILTER (l_linenumber = 2) AS m FROM lineitem GROUP BY 1)""",
)
def lift_percent(spark: SparkSession, folder: str) -> DataFrame:
    part = lambda n: F.sum(F.when(F.col("l_linenumber") == n, F.col("l_quantity")))
    sums = table(spark, folder, "lineitem").groupBy("l_suppkey").agg(part(1).alias("b"), part(2).alias("m"))
    return sums.select("l_suppkey", F.round(num.lift_percent(F.col("b"), F.col("m")), 6).alias("lift_percent"))


@register(
    "key_difference",
    """SELECT c_custkey AS key, 'left_only' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority <> '1-URGENT')
UNION ALL SELECT DISTINCT o_custkey + 1000000, 'right_only' FROM orders WHERE o_orderpriority = '1-URGENT'""",
)
def key_difference(spark: SparkSession, folder: str) -> DataFrame:
    urgent = F.col("o_orderpriority") == "1-URGENT"
    right = table(spark, folder, "orders").select(F.when(urgent, F.col("o_custkey") + 1000000).otherwise(F.col("o_custkey")).alias("key"))
    return contracts.set_difference(table(spark, folder, "customer").select(F.col("c_custkey").alias("key")), right, ["key"])


# ---- orders --------------------------------------------------------------------------------------


@register(
    "numeric_id_order",
    """SELECT station_id, row_number() OVER (ORDER BY TRY_CAST(station_id AS BIGINT) NULLS LAST, station_id) AS position FROM (
 SELECT CASE WHEN p_partkey % 50 = 0 THEN 'P' || p_partkey ELSE CAST(p_partkey AS VARCHAR) END AS station_id FROM part)""",
)
def numeric_id_order(spark: SparkSession, folder: str) -> DataFrame:
    """String ids in the order of their numbers, 2 before 10; ids that are no numbers come last."""
    key = F.col("p_partkey")
    ids = table(spark, folder, "part").select(F.when(key % 50 == 0, F.concat(F.lit("P"), key.cast("string"))).otherwise(key.cast("string")).alias("station_id"))
    number = F.col("station_id").try_cast("bigint")
    ranked = number_rows(ids.withColumns({"odd": number.isNull(), "number": F.coalesce(number, F.lit(0))}), ["odd", "number", "station_id"], "position")
    return ranked.select("station_id", "position")


@register(
    "input_order",
    """SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS position, quality FROM documents LEFT JOIN (SELECT doc_id, MAX(quality) AS quality FROM labels GROUP BY 1) USING (doc_id)""",
)
def input_order(spark: SparkSession, folder: str) -> DataFrame:
    """Rows get their position first; it travels through the join and puts the result in the order of the input again."""
    placed = number_within(
        table(spark, folder, "documents").select("doc_id", "source", (-F.col("doc_id")).alias("arrival")), ["source"], ["arrival"], "position")
    labels = table(spark, folder, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return placed.join(labels, "doc_id", "left").select("doc_id", "source", "position", "quality").sort("source", "position")
