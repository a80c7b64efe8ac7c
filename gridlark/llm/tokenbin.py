"""Token ids in flat binary files with 64-bit document offsets.

Documents are dealt to shards by ranges of doc_id and sorted within. A task
streams its shard into `<shard>.bin` (unsigned integers, little-endian, 16 bit
if the tokenizer's ids fit, else 32) and `<shard>.idx` (64-bit: for each document
its id, then n + 1 offsets in tokens from the shard's start). A manifest row
per shard gives its counts; prefix sums over the manifest give each shard's
base, so a document's global start is base + offset. Files of lost or repeated
attempts have names of their own and are in no manifest.

NULL or empty texts hold the end id alone. NULL doc_ids come first. Equal
doc_ids are ordered by text. Every row is a document; an empty table gives no
files.
Texts are encoded whole, however long. Only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridlark.llm import files
from gridlark.llm.common import crc, narrow, parts, pieces, store
from gridlark.llm.tokens import encoder
from gridlark.session import scratch_path

BLOCK_BYTES = 8_000_000
NO_ID = np.iinfo(np.int64).min


def id_type(tokenizer_path: str, end_id: int) -> str:
    """The narrower unsigned type that holds every id."""
    ids = Tokenizer.from_file(tokenizer_path).get_vocab(with_added_tokens=True).values()
    return "<u2" if max(end_id, *ids) < 1 << 16 else "<u4"


def write(df: DataFrame, tokenizer_path: str, end_id: int, cut: str = "byte", folder: str | None = None,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents; the manifest: shard, path, dtype, docs, tokens, first_doc, first_token (both global)."""
    spark = df.sparkSession
    dtype = id_type(tokenizer_path, end_id)
    folder = folder or scratch_path(spark, "token-files")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(tokenizer_path, cut, dtype)
        end, width = made.pack([end_id]), made.dtype.itemsize
        shard = TaskContext.get().partitionId()
        path = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}"
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        with files.open_write(path + ".bin") as out:
            for block in pieces(batches, "text", BLOCK_BYTES):
                coded = made.encode(block["text"])
                out.write(b"".join(x + end for x in coded))
                sizes.append(np.fromiter((len(x) // width + 1 for x in coded), np.int64, len(coded)))
                ids.append(block["doc_id"].fill_null(int(NO_ID)).to_numpy())
        if not ids:
            return
        ends = np.cumsum(np.concatenate(sizes))
        with files.open_write(path + ".idx") as out:
            out.write(np.concatenate([*ids, [0], ends]).astype("<i8").tobytes())
        yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "dtype": [dtype], "docs": [len(ends)], "tokens": [int(ends[-1])]})

    manifest = store(
        narrow(df, id_col, text_col).repartitionByRange(parts(spark), "doc_id").sortWithinPartitions("doc_id", "text")
        .mapInArrow(run, "shard long, path string, dtype string, docs long, tokens long"),
        "token-manifest",
    )
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.select("*", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n) for c, n in (("docs", "first_doc"), ("tokens", "first_token"))))


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                index = files.read_array(row["path"] + ".idx", "<i8")
                tokens = files.read_array(row["path"] + ".bin", row["dtype"])
                n = len(index) // 2
                doc, offsets = index[:n], index[n:]
                for low in range(0, n, 10_000):
                    high = min(n, low + 10_000)
                    sums = [crc(tokens[offsets[i] : offsets[i + 1]].astype("<u4").tobytes()) for i in range(low, high)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc[low:high], pa.int64(), mask=doc[low:high] == NO_ID), pa.array(offsets[low:high] + row["first_token"]),
                         pa.array(offsets[low + 1 : high + 1] - offsets[low:high]), pa.array(sums, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    spread = manifest.select("shard", "path", "dtype", "first_token").repartition(parts(manifest.sparkSession), "shard")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
