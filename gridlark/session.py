"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_SCRATCH: dict[str, str] = {}
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_CLEANING = threading.Lock()
_CLEANERS = [0, None]  # callers inside store_clean, and the setting that they found


def build_session(app: str = "gridlark", **conf: str) -> SparkSession:
    """A session with the settings every operator here assumes."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def keep_methods_small(spark: SparkSession) -> None:
    """For tables of dozens of columns: the JVM never compiles a method over 8,000 bytes.

    Spark's fused loop over such rows is one method, up to 65,535 bytes by default,
    and would be interpreted; under this limit its operators run one by one, compiled.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: the cluster's checkpoint folder.

    Only a local master with no configured folder falls back to a fresh
    temporary one.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        _SCRATCH[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _SCRATCH[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/gridlark-{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """The rows as files below the shared folder: cuts the lineage and survives lost executors.

    A checkpoint would keep the plan's estimate of size. In a loop of joins that
    estimate is a product of products, whose digits soon take longer to
    multiply than the data; files are taken at the size they have.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table or model below the shared folder that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def store_clean(spark: SparkSession, work: Callable[[], object]) -> object:
    """work(), an action whose shuffle files go when it ends, not when the driver next collects garbage."""
    with _CLEANING:
        if not _CLEANERS[0]:
            _CLEANERS[1] = spark.conf.get(_CLEAN, None)
            spark.conf.set(_CLEAN, "true")
        _CLEANERS[0] += 1
    try:
        return work()
    finally:
        with _CLEANING:
            _CLEANERS[0] -= 1
            if not _CLEANERS[0]:
                spark.conf.unset(_CLEAN) if _CLEANERS[1] is None else spark.conf.set(_CLEAN, _CLEANERS[1])
