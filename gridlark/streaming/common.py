"""Reading a growing table as a stream and draining it."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessorHandle

#: Keyed state is kept by bucket of keys; a checkpoint holds for one number of buckets.
BUCKETS = 4096


def read_table(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """A Parquet table, one file or a folder of part files, as a stream; the schema is that of what is there."""
    schema = spark.read.parquet(path).schema
    # A pattern that matches the path alone: a plain path would have to be a folder.
    place = path.rstrip("/")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(f"{place[:-1]}[{place[-1]}]")


def append_epochs(table: str):
    """A foreachBatch function: every micro-batch replaces its own partition, so a replay is harmless."""

    def append(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("epoch").parquet(table)

    return append


def drain(writer: DataStreamWriter, checkpoint: str) -> None:
    """Runs a stream over all available input and stops."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def keep_state(spark: SparkSession) -> None:
    """Arbitrary state lives in RocksDB, which spills to disk and uploads its changes to the checkpoint folder."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def combined(rows: DataFrame, keys: list[str], sums: list[str] = (), least: list[str] = (), most: list[str] = ()) -> DataFrame:
    """Rows of one key are merged inside each Arrow batch, before the shuffle to their state.

    The result carries no watermark of its own, so the state operator after it
    sees late rows too and can account for them.
    """
    schema = T.StructType([rows.schema[c] for c in (*keys, *sums, *least, *most)])
    merges = [*((c, "sum") for c in sums), *((c, "min") for c in least), *((c, "max") for c in most)]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = pa.Table.from_batches([batch]).group_by(list(keys)).aggregate(merges)
                made = made.select([*keys, *(f"{c}_{how}" for c, how in merges)]).rename_columns([*keys, *(c for c, _ in merges)])
                yield from made.cast(pa.schema([batch.schema.field(c) for c in made.column_names])).to_batches()

    return rows.select(*schema.names).mapInArrow(merge, schema)


def bucket_of(keys: Iterable[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")


class Rows:
    """The rows that a bucket keeps, as one value of arrays.

    Every call to the state store is a message to the JVM and back, so it is
    made for a bucket of keys at a time, not for a key.
    """

    def __init__(self, handle: StatefulProcessorHandle, name: str, schema: T.StructType) -> None:
        self.value = handle.getValueState(name, T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in schema.fields]))

    def load(self) -> list[tuple]:
        held = self.value.get()
        return [] if held is None else list(zip(*held))

    def keep(self, rows: list[tuple]) -> None:
        if rows:
            self.value.update(tuple(list(c) for c in zip(*rows)))
        else:
            self.value.clear()


class Alarm:
    """The only timer of a bucket."""

    def __init__(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.at = handle, handle.getValueState("alarm", "at long")

    def set(self, at: int | None) -> None:
        held: Any = self.at.get()
        before = None if held is None else held[0]
        if before == at:
            return
        if before is not None:
            self.handle.deleteTimer(before)
        if at is None:
            self.at.clear()
        else:
            self.handle.registerTimer(at)
            self.at.update((at,))
