"""Scans: Parquet or CSV by suffix, typed CSV, JSON verdicts, binary files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def read_shared(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One of the shared Parquet tables."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder}/{table}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header row; a missing path is an error of the reader.

    Without a schema every column stays a string, which is what the contract
    operators expect: they coerce by rule and report what does not fit.
    """
    reader = spark.read.option("header", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def read_by_suffix(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet or CSV, chosen by the suffix of the path."""
    if path.lower().rstrip("/").endswith((".parquet", ".pq")):
        return spark.read.parquet(path)
    if path.lower().rstrip("/").endswith(".csv"):
        return read_csv(spark, path, schema)
    raise ValueError(f"neither Parquet nor CSV: {path}")


VERDICT_SCHEMA = "content_digest string, suspicious boolean, reason string"


def read_verdicts(spark: SparkSession, path: str, one_array: bool = False) -> DataFrame:
    """Advisory verdicts keyed by content digest; one JSON object a line, or one array a file."""
    return spark.read.schema(VERDICT_SCHEMA).option("multiLine", one_array).json(path)


def read_binary(spark: SparkSession, path: str, glob: str = "*", from_folder: bool = False) -> DataFrame:
    """Binary files with length and content digest computed where they are read.

    A file's reference is its name, or the value of its partition folder.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    parts = F.split("path", "/")
    ref = F.regexp_extract(F.element_at(parts, -2), "=(.*)$", 1) if from_folder else F.element_at(parts, -1)
    return files.select(
        ref.alias("storage_ref"),
        "length",
        F.sha2("content", 256).alias("content_digest"),
        "content",
    )


def check_binary(files: DataFrame, refs: DataFrame) -> DataFrame:
    """Metadata rows against the files they point to: one status per reference."""
    found = files.select(
        "storage_ref", F.col("length").alias("found_size"), F.col("content_digest").alias("found_digest")
    )
    return refs.join(found, "storage_ref", "left").withColumn(
        "status",
        F.when(F.col("found_digest").isNull(), "MISSING")
        .when(F.col("found_digest") != F.col("digest"), "ATTACHMENT_DIGEST_MISMATCH")
        .when(F.col("found_size") != F.col("byte_size"), "ATTACHMENT_SIZE_MISMATCH")
        .otherwise("OK"),
    )
