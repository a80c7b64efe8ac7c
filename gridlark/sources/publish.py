"""Sinks: immutable batches with manifest and replay check, guarded CSV, JSON reports.

Layout below the output folder: ``records/batch_id=<id>`` (Parquet, zstd),
``csv/batch_id=<id>`` and an append-only ``manifest`` table.  The manifest row is
written last and is what makes a batch exist, so a job that dies half way leaves
no visible batch and can simply run again.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, DataFrameWriter, SparkSession, functions as F

from gridlark.functions.hashing import table_fingerprint

MANIFEST_SCHEMA = (
    "batch_id string, row_count bigint, content_sum string, model_role string, "
    "batch_status string, published_at timestamp"
)


class PublishError(RuntimeError):
    """A batch may not be published."""


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{folder}/manifest"
    if not _exists(spark, path):
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    return spark.read.schema(MANIFEST_SCHEMA).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def batch_manifest(records: DataFrame) -> DataFrame:
    """Per batch: rows, order-free content sum, role and status."""
    prints = table_fingerprint(records, ["batch_id"])
    lineage = records.groupBy("batch_id").agg(
        F.min("model_role").alias("model_role"), F.min("batch_status").alias("batch_status")
    )
    return prints.join(lineage, "batch_id")


def compare_with_manifest(candidate: DataFrame, manifest: DataFrame) -> DataFrame:
    """Disposition per batch: new, replay of the same content, or conflict."""
    known = manifest.groupBy("batch_id").agg(
        F.min_by(F.struct("row_count", "content_sum"), "published_at").alias("_known")
    )
    same = (F.col("_known.row_count") == F.col("row_count")) & (F.col("_known.content_sum") == F.col("content_sum"))
    return candidate.join(known, "batch_id", "left").withColumn(
        "disposition",
        F.when(F.col("_known").isNull(), "NEW").when(same, "REPLAY").otherwise("CONFLICT"),
    ).drop("_known")


def publish_batches(records: DataFrame, folder: str) -> DataFrame:
    """Writes the new batches and returns one disposition row per batch.

    A replay of identical content writes nothing.  Changed content under a known
    id refuses the whole call before anything is written.  New batches replace
    whatever an earlier, unfinished attempt left in their own partition.
    """
    spark = records.sparkSession
    kept = records.persist(StorageLevel.MEMORY_AND_DISK)
    log = f"{folder}/log/run-{uuid.uuid4().hex}"
    try:
        compare_with_manifest(batch_manifest(kept), read_manifest(spark, folder)).write.parquet(log)
        plan = spark.read.parquet(log)
        if not plan.filter("disposition = 'CONFLICT'").isEmpty():
            raise PublishError("a published batch id was offered again with different content")
        new = plan.filter("disposition = 'NEW'")
        if new.isEmpty():
            return plan
        fresh = kept.join(new.select("batch_id"), "batch_id", "left_semi")
        # Ranges over the full order: a large batch spreads over many sorted files.
        order = ("batch_id", "target_timestamp", "station_id")
        placed = fresh.repartitionByRange(*order).sortWithinPartitions(*order)
        _replace(placed.write.format("parquet").option("compression", "zstd"), f"{folder}/records")
        # The records just written lie in that order, so their CSV needs no second shuffle.
        stored = spark.read.schema(records.schema).parquet(f"{folder}/records").select(*records.columns)
        stored = stored.join(F.broadcast(new.select("batch_id")), "batch_id", "left_semi").sortWithinPartitions(*order)
        _replace(stored.write.format("csv").option("header", "true"), f"{folder}/csv")
        new.select(
            "batch_id", "row_count", "content_sum", "model_role", "batch_status",
            F.current_timestamp().alias("published_at"),
        ).write.mode("append").parquet(f"{folder}/manifest")
        return plan
    finally:
        kept.unpersist()


def _replace(writer: DataFrameWriter, target: str) -> None:
    """Writes whole batches in the place of what was there of them."""
    writer.partitionBy("batch_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").save(target)


def verify_published(spark: SparkSession, folder: str) -> DataFrame:
    """Re-reads every published batch and compares it with its manifest row."""
    stored = spark.read.parquet(f"{folder}/records")
    stored = stored.withColumn("batch_id", F.col("batch_id").cast("string"))
    found = batch_manifest(stored).select("batch_id", F.col("row_count").alias("_n"), F.col("content_sum").alias("_s"))
    intact = (F.col("_n") == F.col("row_count")) & (F.col("_s") == F.col("content_sum"))
    return read_manifest(spark, folder).join(found, "batch_id", "left").withColumn(
        "intact", F.coalesce(intact, F.lit(False))
    ).drop("_n", "_s")


def current_pointer(manifest: DataFrame) -> DataFrame:
    """The last batch that was published in good order."""
    good = manifest.filter(F.col("batch_status").isin("healthy", "degraded"))
    return good.agg(
        F.max_by("batch_id", F.struct("published_at", "batch_id")).alias("batch_id"),
        F.max("published_at").alias("published_at"),
    )


def publish_csv(
    records: DataFrame, path: str, expected: int, keys: Sequence[str] = ("station_id", "target_timestamp")
) -> DataFrame:
    """CSV publish that checks count and key uniqueness first, then points readers at the new version."""
    spark = records.sparkSession
    keyed = records.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    facts = keyed.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.count_if(F.col("n") > 1).alias("repeated")
    ).first()
    if facts["row_count"] != expected or facts["row_count"] == 0 or facts["repeated"]:
        raise PublishError(f"refused: {facts['row_count']} rows, {facts['repeated']} repeated keys")
    version = f"{path}/version-{uuid.uuid4().hex}"
    records.orderBy(*keys).write.option("header", True).csv(version)
    # The pointer is the last thing written: before it a reader sees the version before, never none.
    pointer = spark.createDataFrame([(version, facts["row_count"])], "version string, row_count bigint")
    pointer.withColumn("published_at", F.current_timestamp()).write.mode("append").parquet(f"{path}/pointer")
    return read_published_csv(spark, path)


def read_published_csv(spark: SparkSession, path: str) -> DataFrame:
    """The version published last."""
    newest = spark.read.parquet(f"{path}/pointer").agg(F.max_by("version", "published_at").alias("version")).first()
    return spark.read.option("header", True).csv(newest["version"])


def write_report(df: DataFrame, path: str) -> None:
    """JSON report rows, nulls kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
