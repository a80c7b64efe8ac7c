"""Publishing from a stream: staged by micro-batch, published as whole batches."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gridlark.sources.publish import publish_batches
from gridlark.streaming.common import append_epochs, drain


def run(records: DataFrame, folder: str, checkpoint: str, staging: str) -> DataFrame:
    """Publishes all available records and returns one disposition row per batch.

    A batch may span files and micro-batches, so records are staged, each
    micro-batch in a partition of its own, and published once the input is
    drained. A replay stages and publishes nothing twice.
    """
    drain(records.writeStream.foreachBatch(append_epochs(staging)), checkpoint)
    return publish_batches(records.sparkSession.read.parquet(staging).drop("epoch"), folder)
