"""A version is visible as a whole or not at all."""

import os

import pytest
from pyspark.sql import functions as F

from gridlark.sources import versions


def rows(spark, n, parts=4):
    return spark.range(n).repartition(parts).select(F.col("id"), (F.col("id") * 0.5).alias("value"), F.concat(F.lit("s"), F.col("id")).alias("name"))


def files_of(folder):
    return sorted(os.path.join(d, f) for d, _, found in os.walk(folder) for f in found)


def test_versions_follow_each_other(spark, tmp_path):
    folder = str(tmp_path / "published")
    first, second = rows(spark, 100), rows(spark, 7)
    assert versions.manifest(folder) is None and versions.current(spark, folder, first.schema).count() == 0
    assert versions.publish_version(first, folder, "v1", ["id", "name"], ["value"])
    assert versions.publish_version(second, folder, "v2")
    assert sorted(versions.current(spark, folder, first.schema).collect()) == sorted(second.collect())
    assert sorted(versions.current(spark, folder, first.schema, "v1").collect()) == sorted(first.collect())
    assert versions.manifest(folder)["after"] == "v1" and versions.manifest(folder, "v1")["rows"] == 100
    before = files_of(folder)
    assert not versions.publish_version(first, folder, "v1")  # a replay writes nothing
    assert files_of(folder) == before


def test_a_failing_task_leaves_the_pointer_unmoved(spark, tmp_path):
    folder = str(tmp_path / "published")
    good = rows(spark, 50)
    versions.publish_version(good, folder, "v1")
    broken = rows(spark, 5000, 8).withColumn("value", F.when(F.col("id") == 4321, F.lit(float("nan"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="value is not a finite number"):
        versions.publish_version(broken, folder, "v2", finite=["value"])
    failing = rows(spark, 5000, 8).withColumn("name", F.when(F.col("id") == 99, F.raise_error(F.lit("task lost"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="task lost"):
        versions.publish_version(failing, folder, "v3")
    with pytest.raises(Exception, match="name is NULL"):
        versions.publish_version(good.withColumn("name", F.lit(None).cast("string")), folder, "v4", ["name"])
    assert versions.manifest(folder)["version"] == "v1" and versions.manifest(folder, "v2") is None
    assert sorted(versions.current(spark, folder, good.schema).collect()) == sorted(good.collect())
    # The same version can be published once the cause is gone.
    assert versions.publish_version(rows(spark, 9), folder, "v2", finite=["value"])
    assert versions.current(spark, folder, good.schema).count() == 9


def test_an_empty_version(spark, tmp_path):
    folder = str(tmp_path / "published")
    schema = rows(spark, 1).schema
    versions.publish_version(rows(spark, 3), folder, "v1")
    assert versions.publish_version(rows(spark, 3).filter("id < 0"), folder, "v2", ["id"], ["value"])
    assert versions.current(spark, folder, schema).count() == 0 and versions.manifest(folder)["rows"] == 0
