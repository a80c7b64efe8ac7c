"""Packing of tokenized documents into fixed-length sequences, best-two-fit.

Documents are tokenized and cut into pieces of at most `size` tokens. The
pieces are dealt evenly (round robin, so no key can be hot) to groups of about
GROUP pieces; each group is packed by itself. A bin is filled greedily, always
with the largest unpacked piece that fits. If a gap remains, the bin's
smallest piece is given back for the two unpacked pieces that fill the
expanded gap best, if they fill it more tightly. A group loses at most the rest
of its last bins, a few in several thousand.

NULL or empty texts are pieces of the end id alone. Every row is a document,
also a repeated one. An empty table gives no sequences.
Texts are cut into pieces, however long. Only the id and the text are read, so other columns
cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from gridlark.llm.common import crc, narrow, pieces, store
from gridlark.llm.tokens import encoder

BLOCK_BYTES = 8_000_000
#: Pieces that one task packs: their memory is bounded, and the loss at a group's end stays below 0.1 %.
GROUP = 100_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenize(df: DataFrame, tokenizer_path: str, end_id: int, size: int, cut: str = "word",
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(tokenizer_path, cut)
        end = made.pack([end_id])
        for block in pieces(batches, "text", BLOCK_BYTES):
            rows = []
            for doc, ids in zip(block["doc_id"].to_pylist(), made.encode(block["text"])):
                ids += end
                for number, low in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[low : low + 4 * size]
                    rows.append((doc, number, low // 4, len(part) // 4, crc(part)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return narrow(df, id_col, text_col).mapInArrow(run, PIECES)


class Pool:
    """Unpacked pieces by length; lengths in stock are the set bits of one number."""

    def __init__(self, lengths: np.ndarray) -> None:
        self.stock: dict[int, list[int]] = {}
        order = np.argsort(lengths, kind="stable")[::-1]
        for i, n in zip(order.tolist(), lengths[order].tolist()):
            self.stock.setdefault(n, []).append(i)
        self.bits = sum(1 << n for n in self.stock)

    def largest(self, most: int) -> int:
        """The largest length in stock of at most `most`; -1 if none."""
        return (self.bits & ((2 << most) - 1)).bit_length() - 1 if most > 0 else -1

    def take(self, n: int) -> int:
        items = self.stock[n]
        item = items.pop()
        if not items:
            del self.stock[n]
            self.bits ^= 1 << n
        return item

    def give(self, n: int, item: int) -> None:
        if n not in self.stock:
            self.stock[n] = []
            self.bits |= 1 << n
        self.stock[n].append(item)

    def best_two(self, room: int, above: int) -> tuple[int, int] | None:
        """Lengths of two pieces that fill the room best, more than `above` in all."""
        best = None
        a = self.largest(room - 1)
        while a > 0 and 2 * a > above:
            b = self.largest(min(a, room - a))
            if b == a and len(self.stock[a]) < 2:
                b = self.largest(a - 1)
            if b > 0 and a + b > above:
                best, above = (a, b), a + b
                if above == room:
                    break
            a = self.largest(a - 1)
        return best


def best_two_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Bins of positions in `lengths`, each of at most `size` in all."""
    pool, bins = Pool(lengths), []
    while pool.bits:
        items, gap = [], size
        while (n := pool.largest(gap)) > 0:
            items.append((n, pool.take(n)))
            gap -= n
        if gap and len(items) > 1:
            n, item = items[-1]  # filled from large to small
            if two := pool.best_two(gap + n, n):
                items.pop()
                items += [(m, pool.take(m)) for m in two]
                pool.give(n, item)
        bins.append([item for _, item in items])
    return bins


def pack(cut: DataFrame, size: int) -> DataFrame:
    """The pieces with sequence_id and offset. `cut` must be a stored table: it is counted first."""
    groups = max(1, -(-cut.count() // GROUP))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        lengths = table["length"].to_numpy()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        base = TaskContext.get().partitionId() << 32
        for number, items in enumerate(best_two_fit(lengths, size)):
            sequence[items] = base + number
            offset[items] = np.cumsum(lengths[items]) - lengths[items]
        yield from table.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).combine_chunks().to_batches()

    return cut.repartition(groups).mapInArrow(run, f"{PIECES}, sequence_id long, offset long")


def pack_documents(df: DataFrame, tokenizer_path: str, end_id: int, size: int, cut: str = "word",
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return pack(store(tokenize(df, tokenizer_path, end_id, size, cut, id_col, text_col), "pieces"), size)
