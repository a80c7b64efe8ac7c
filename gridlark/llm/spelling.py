"""Spelling variants: words one edit apart, found by dense prefix-suffix tiles, and the frequent form of each word.

Words are counted in every whole text. Two words are near if they differ by
one inserted, deleted or replaced code point. For the longer length L, an edit
leaves two of the three thirds of [0, L) intact, seen from either end, so near
words meet in a bucket of (L, third, what lies before it, what lies after it).
A word has six keys: as one of length L and as the shorter one of L + 1.

Inside a bucket, padded code-point matrices of blocks of words are compared
block by block: one matrix aligned left gives the length of the common prefix
of every pair of a tile, one aligned right that of the common suffix. Prefix
plus suffix of at least L - 1 is a single edit. Small buckets of one size
class are stacked into one tile. A pair counts in the first third that brings
it. Buckets over BLOCK words are cut into blocks, and pairs of blocks go to
tasks of their own. Only near pairs leave a task.

A word's form is its near word of largest count (ties: the least in code-point
order) if that is TIMES its own count or more; the root is the end of the
chain of forms. Counts grow tenfold along a chain, so doubling the steps ends
after five rounds.

Defined cases. A NULL text has no words; a NULL id stands as an empty string
in the checksum of the damage. Rows that repeat count again. Texts are taken
whole; a word may be of any length. An empty table, or one without words that
occur twice, gives no rows. Only id and text are read, so other columns cannot
clash.
"""

from __future__ import annotations

import re
import string
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import narrow, parts, pieces, store

LEAST_LENGTH, LEAST_COUNT, TIMES, DAMAGE = 7, 2, 10, 31
THIRDS = 3
#: Words in a block of a large bucket; pairs of words in one stack of tiles.
BLOCK, TILE = 2048, 1 << 20
BLOCK_BYTES = 4_000_000
#: A greedy match from the start of a run takes the whole run, so shorter runs never match.
RUN = re.compile("[A-Za-zÀ-ÿ]{%d,}" % LEAST_LENGTH)
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def damaged(doc_id: int | None, run: str) -> str:
    """The run, less one code point where the checksum says so."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % DAMAGE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the words of all texts with their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in pieces(batches, "text", BLOCK_BYTES):
            total: Counter[str] = Counter()
            for doc_id, text in zip(block["doc_id"].to_pylist(), block["text"].to_pylist()):
                for found, n in Counter(RUN.findall(text.translate(LOWER))).items() if text else ():
                    word = damaged(doc_id, found)
                    if len(word) >= LEAST_LENGTH:
                        total[word] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    counted = narrow(df, id_col, text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


def keyed(counted: DataFrame) -> DataFrame:
    """key, size, third, word, n: each word in its six buckets; size is the longer length of the bucket's pairs."""
    length = F.length("word")
    keys = []
    for longer in (0, 1):
        size = length + longer
        for third in range(THIRDS):
            before, after = F.floor(size * third / THIRDS).cast("int"), size - F.floor(size * (third + 1) / THIRDS).cast("int")
            key = F.xxhash64(size, F.lit(third), F.substring("word", F.lit(1), before), F.right("word", after))
            keys.append(F.struct(key.alias("key"), size.alias("size"), F.lit(third).alias("third")))
    return counted.select(F.explode(F.array(*keys)).alias("k"), "word", "n").select("k.*", "word", "n")


def dealt(rows: DataFrame) -> DataFrame:
    """Adds first and second, the blocks of the tile that a row is in; rows of large buckets are in several tiles."""
    hot = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 2 * BLOCK)
    blocks = hot.select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(blocks, "key", "left")
    own = F.pmod(F.xxhash64("word"), F.coalesce("blocks", F.lit(1))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    rows = rows.withColumn("own", own).withColumn("other", other)
    return rows.select("key", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), "own", "size", "third", "word", "n")


def matrices(found: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points aligned left and right, padded with zeros, and the lengths."""
    left = np.array(found, f"S{size}").view(np.uint8).reshape(len(found), size)
    length = np.fromiter(map(len, found), np.int64, len(found))
    right = np.zeros_like(left)
    place = np.arange(size)
    right[place >= size - length[:, None]] = left[place < length[:, None]]
    return left, right, length


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal leading columns of each row of a with each row of b, tile by tile: (tiles, rows, size) twice to (tiles, rows, rows)."""
    alive = np.ones((a.shape[0], a.shape[1], b.shape[1]), bool)
    total = np.zeros(alive.shape, np.uint8 if a.shape[2] < 256 else np.int32)
    for j in range(a.shape[2]):
        alive &= a[:, :, None, j] == b[:, None, :, j]
        total += alive
    return total


def near(size: int, third: np.ndarray, a: tuple, b: tuple) -> np.ndarray:
    """Which pairs of each tile are one edit apart and belong to this third. a, b: left, right, length (0: no word), own block."""
    prefix = common(a[0], b[0])
    suffix = common(a[1][:, :, ::-1], b[1][:, :, ::-1])
    hit = prefix.astype(np.int32) + suffix >= size - 1
    hit &= (np.maximum(a[2][:, :, None], b[2][:, None, :]) == size) & (a[2][:, :, None] > 0) & (b[2][:, None, :] > 0)
    tile, row, column = np.nonzero(hit)
    owner = np.full(len(tile), THIRDS)
    for k in range(THIRDS - 1, -1, -1):
        fits = (prefix[tile, row, column] >= size * k // THIRDS) & (suffix[tile, row, column] >= size - size * (k + 1) // THIRDS)
        owner[fits] = k
    keep = owner == third[tile]
    return np.stack([tile[keep], row[keep], column[keep]])


def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs (word, n, other, other_n) in both directions, of rows sorted by key, first, second, size, third."""
    columns = ("key", "first", "second", "size", "third", "own")

    def compare(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        values = np.stack([rows[c].to_numpy().astype(np.int64) for c in columns])
        new = np.ones(rows.num_rows, bool)
        new[1:] = (values[:5, 1:] != values[:5, :-1]).any(axis=0)
        start = np.flatnonzero(new)
        count = np.diff(np.append(start, rows.num_rows))
        size, third = values[3, start], values[4, start]
        # Tiles of one length and size class are stacked.
        width = 1 << np.ceil(np.log2(np.maximum(count, 2))).astype(np.int64)
        some = np.flatnonzero(count > 1)
        order = some[np.lexsort((width[some], size[some]))]
        low = 0
        while low < len(order):
            length, wide = size[order[low]], width[order[low]]
            high = low + 1
            while high < len(order) and size[order[high]] == length and width[order[high]] == wide and (high - low + 1) * wide * wide <= TILE:
                high += 1
            chosen = order[low:high]
            low = high
            if pairs := stack(rows, values[5], start[chosen], count[chosen], int(length), third[chosen], int(wide)):
                yield pairs

    def stack(rows, own, start, count, size, third, wide):
        place = start[:, None] + np.minimum(np.arange(wide), count[:, None] - 1)
        real = np.arange(wide) < count[:, None]
        flat, where = np.unique(place, return_inverse=True)
        taken = rows["word"].take(pa.array(flat)).to_pylist()
        left, right, length = matrices([w.encode("latin-1") for w in taken], size)
        where = where.reshape(place.shape)
        lengths = np.where(real, length[where], 0)
        found = near(size, third, (left[where], right[where], lengths), (left[where], right[where], lengths))
        a, b = place[found[0], found[1]], place[found[0], found[2]]
        # Blocks that meet in a tile of two compare across only; a block meets itself in its own tile.
        first, second = rows["first"].to_numpy()[a], rows["second"].to_numpy()[a]
        keep = (a != b) & ((first == second) | (own[a] != own[b]))
        a, b = pa.array(a[keep]), pa.array(b[keep])
        if not len(a):
            return None
        return pa.RecordBatch.from_arrays([rows["word"].take(a), rows["n"].take(a), rows["word"].take(b), rows["n"].take(b)], ["word", "n", "other", "other_n"])

    rest: list[pa.RecordBatch] = []
    for batch in batches:
        rest.append(batch)
        if sum(b.num_rows for b in rest) < 100_000:
            continue
        rows = pa.concat_batches(rest)
        last = np.ones(rows.num_rows, bool)
        for c in columns[:5]:
            values = rows[c].to_numpy()
            last &= values == values[-1]
        cut = rows.num_rows - int(last.sum())  # the last bucket may go on
        yield from compare(rows.slice(0, cut))
        rest = [rows.slice(cut)]
    if rest:
        yield from compare(pa.concat_batches(rest))


def near_words(counted: DataFrame) -> DataFrame:
    """word, n, other, other_n: every pair of near words, in both directions."""
    order = ["key", "first", "second", "size", "third"]
    rows = dealt(store(keyed(counted), "spelling-keys")).repartition(parts(counted.sparkSession), *order[:3]).sortWithinPartitions(*order)
    return rows.mapInArrow(tiles, "word string, n long, other string, other_n long")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of each word that has a form (word, form)."""
    current = store(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if current.join(onward, "root", "left_semi").isEmpty():
            return current
        current = store(current.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")


def variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n, n_near, form, form_n, root of every word."""
    counted = store(words(df, id_col, text_col), "spelling-words")
    frequent = F.when(F.col("other_n") >= TIMES * F.col("n"), F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("form")))
    chosen = near_words(counted).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(frequent).alias("best"))
    chosen = store(chosen.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.minus")).alias("form_n")), "spelling-forms")
    ends = roots(chosen.where("form IS NOT NULL"))
    return (
        counted.join(chosen, "word", "left").join(ends, "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
    )
