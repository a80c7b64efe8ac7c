"""Shared helpers of the corpus operators.

Every operator first narrows its input to the columns it needs, so extra
columns, whatever their names, cannot clash with its own.
"""

from __future__ import annotations

import gc
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.operators.ordered import number_rows
from gridlark.session import scratch_path

#: White space that separates words: space and \\t \\n \\v \\f \\r. bytes.split() splits at the same.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Words kept in one worker's caches.
CACHE_WORDS = 400_000


def narrow(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id long, text string) of any input."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def store(df: DataFrame, label: str) -> DataFrame:
    """Write below the shared folder and read again: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store_clean(df: DataFrame, label: str) -> DataFrame:
    """`store`, whose shuffle files go when the table is written, not when the driver next collects garbage."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        return store(df, label)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def sweep(spark: SparkSession) -> None:
    """Spark removes the shuffle files of tables that nothing refers to when the driver collects garbage; have it do so now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pieces(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `limit` bytes of the string column each, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        block = (np.cumsum(sizes) - sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:]):
            yield batch.slice(low, high - low)


_HELD: list[tuple[str, Callable[[], None]]] = []


def claim(owner: str, release: Callable[[], None]) -> None:
    """Workers outlive tasks: what one operator remembers in a worker goes when another takes the worker over."""
    if _HELD and _HELD[0][0] != owner:
        _HELD.pop()[1]()
        gc.collect()
    if not _HELD:
        _HELD.append((owner, release))


class WordHashes(dict):
    """64-bit hash of a word's UTF-8 bytes, remembered."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE_WORDS:
            self[word] = value
        return value


_HASHES = WordHashes()


def hash_words(words: list[bytes]) -> np.ndarray:
    claim("hashes", _HASHES.clear)
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of k word hashes; empty if there are fewer than k."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
    return mix(out)


def crc(ids: bytes) -> int:
    return zlib.crc32(ids)


#: Keys from here on stand for NULL ids.
NO_ID = 1 << 62


def id_key(id_col: Column, text: Column) -> Column:
    """An id for joins and order: a NULL id comes after all others and is told apart by its text."""
    return F.coalesce(id_col.cast("long"), F.xxhash64(text.cast("string")).bitwiseAND(NO_ID - 1) + F.lit(NO_ID))


def tell_apart(docs: DataFrame, key: str = "doc", text: str = "text") -> DataFrame:
    """The documents with keys of their own: where a key comes with several texts, keys become places in the order of (key, hash of the text)."""
    marks = docs.select(key, F.xxhash64(text).alias("_mark"))
    if marks.groupBy(key).agg(F.min("_mark").alias("low"), F.max("_mark").alias("high")).where("low <> high").isEmpty():
        return docs
    places = number_rows(marks.distinct(), [key, "_mark"], "_place").withColumnRenamed(key, "_key")
    joined = docs.join(places, (F.col(key) == F.col("_key")) & (F.xxhash64(text) == F.col("_mark")))
    return joined.withColumn(key, F.col("_place")).select(docs.columns)
