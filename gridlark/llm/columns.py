"""Burrows-Wheeler transform and common prefixes of a collection, built column by column.

Round j inserts one symbol per sequence: the suffixes of length j take their
places among all shorter ones. Columns are kept in suffix order: the symbol
before each suffix (the transform), the length of its common prefix with the
suffix above, and its label (sequence and length). They are cut into segments,
each with the places of every symbol in it, grouped by symbol.

A round reads the segments front to back twice. The first reading puts the new
symbols in and counts, which gives the rank of each new suffix; for each
symbol it keeps the least common prefix since its last occurrence, which gives
the common prefixes that change. The second reading merges the new rows in.
Where a collection is larger than `memory` its segments are files below
`folder`, written anew by each reading, and a task holds one at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np

from gridlark.llm import files

#: UTF-8 has no such byte: it stands for the symbol that the next round brings, or for a sequence's end.
OPEN = 255
#: Labels hold the length in the low bits; common prefixes and lengths fit a byte.
LENGTH_BITS, LONGEST = 8, 254
#: Symbols, common prefixes, labels, places of the symbols, their counts.
TYPES = ("u1", "u1", "<i4", "<i4", "<i8")

Columns = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


class Segments:
    """A sequence of column segments in memory or, with a folder, in files."""

    def __init__(self, folder: str | None) -> None:
        self.folder = folder
        self.held: list[Columns | tuple[str, ...]] = []

    def append(self, columns: Columns) -> None:
        if self.folder is None:
            self.held.append(columns)
            return
        paths = tuple(f"{self.folder}/{uuid.uuid4().hex}-{i}" for i in range(len(TYPES)))
        for path, column, kind in zip(paths, columns, TYPES):
            with files.open_write(path) as out:
                out.write(column.astype(kind).tobytes())
        self.held.append(paths)

    def __iter__(self) -> Iterator[Columns]:
        for item in self.held:
            yield item if self.folder is None else tuple(np.array(files.read_array(p, k)) for p, k in zip(item, TYPES))

    def drop(self) -> None:
        if self.folder is not None:
            for item in self.held:
                for path in item:
                    files.remove(path)


def placed(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the symbols, grouped by symbol, and their counts."""
    counts = np.bincount(symbols, minlength=256)
    counts[OPEN] = 0
    return np.argsort(symbols, kind="stable")[: counts.sum()].astype(np.int32), counts


class Reading:
    """The first reading of a round: what the new suffixes and their successors get, segment by segment."""

    def __init__(self) -> None:
        self.count = np.zeros(256, np.int64)
        self.low = np.full(256, -1, np.int16)  # -1: the symbol has not occurred
        self.after_new = np.zeros(256, bool)
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, segment: Columns, own: np.ndarray, new: np.ndarray, base: int, last: bool) -> Columns:
        """The segment with symbols `new` at the places `own`; base: rows before it."""
        symbols, prefixes, labels, places, counts = segment
        symbols[own] = new
        order = np.argsort(new, kind="stable")
        own, new = own[order], new[order]
        start = np.cumsum(counts) - counts
        at = np.empty(len(own), np.int64)
        fresh, low, size = np.unique(new, return_index=True, return_counts=True)
        for c, a, n in zip(fresh.tolist(), low.tolist(), size.tolist()):
            at[a : a + n] = start[c] + np.searchsorted(places[start[c] : start[c] + counts[c]], own[a : a + n])
        at += np.arange(len(own))
        is_old = np.ones(len(places) + len(own), bool)
        is_old[at] = False
        merged = np.empty(len(is_old), np.int32)
        merged[is_old] = places
        merged[at] = own
        counts = counts + np.bincount(new, minlength=256)
        end = np.cumsum(counts)
        start = end - counts
        # New suffixes, and the rows right after them in the pile of their symbol.
        after = at[at + 1 < end[new]] + 1
        leads = start[(counts > 0) & self.after_new]
        need = np.sort(np.concatenate([at, after[is_old[after]], leads[is_old[leads]]]))
        if len(need):
            symbol = np.searchsorted(end, need, side="right")
            to, first = merged[need], need == start[symbol]
            from_ = np.where(first, 0, merged[need - 1] + 1)
            least = np.minimum.reduceat(np.append(prefixes, np.uint8(OPEN)), np.stack([from_, to + 1], axis=1).ravel())[::2].astype(np.int16)
            least[first] = np.minimum(least[first], self.low[symbol[first]])
            self.parts.append((symbol, self.count[symbol] + need - start[symbol], least + 1, ~is_old[need], to + np.int64(base)))
        self.count += counts
        if not last:
            here = np.flatnonzero(counts)
            self.after_new[here] = ~is_old[end[here] - 1]
            rest = np.append(np.minimum.accumulate(prefixes[::-1])[::-1], np.uint8(OPEN)).astype(np.int16)
            self.low = np.minimum(self.low, rest[0])
            self.low[here] = rest[merged[end[here] - 1] + 1]
        return symbols, prefixes, labels, merged, counts

    def result(self, sequences: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """In the order of their new places: new place, common prefix, whether new, old place of the symbol."""
        symbol, rank, prefix, new, place = (np.concatenate(x) for x in zip(*self.parts))
        to = sequences + (np.cumsum(self.count) - self.count)[symbol] + rank
        order = np.argsort(to, kind="stable")
        return to[order], prefix[order], new[order], place[order]


def build(sequences: list[bytes], memory: int = 1 << 25, segment: int = 1 << 22, folder: str | None = None) -> Segments:
    """The finished columns of the sequences, each of at most LONGEST bytes; label = sequence << LENGTH_BITS | length."""
    m = len(sequences)
    lengths = np.fromiter(map(len, sequences), np.int64, m)
    widest = int(lengths.max(initial=0))
    folder = folder if int(lengths.sum()) > memory else None
    backwards = np.array([s[::-1] for s in sequences], f"S{max(widest, 1)}").view(np.uint8).reshape(m, -1)
    rows = np.arange(m)
    columns = Segments(folder)
    for low in range(0, m, segment):
        part = rows[low : low + segment]
        open_ = np.full(len(part), OPEN, np.uint8)
        columns.append((open_, np.zeros(len(part), np.uint8), (part << LENGTH_BITS).astype(np.int32), *placed(open_)))
    place, who = rows, rows  # of the suffixes whose symbol comes next, in order
    for j in range(widest):
        active = lengths[who] > j
        place, who = place[active], who[active]
        columns, place, who = insert(columns, place, who, backwards[who, j], m, j + 1, segment)
    return columns


def insert(columns: Segments, place: np.ndarray, who: np.ndarray, symbols: np.ndarray, m: int, length: int, segment: int) -> tuple[Segments, np.ndarray, np.ndarray]:
    """One round: the symbols before the suffixes at `place`, and with them the suffixes that they begin."""
    reading, filled, base = Reading(), Segments(columns.folder), 0
    count = len(columns.held)
    for number, part in enumerate(columns):
        low, high = np.searchsorted(place, (base, base + len(part[0])))
        filled.append(reading.add(part, place[low:high] - base, symbols[low:high], base, number == count - 1))
        base += len(part[0])
    columns.drop()
    to, prefix_to, new, from_ = reading.result(m)
    fresh = to[new]
    who = who[np.searchsorted(place, from_[new])]
    labels = (who << LENGTH_BITS | length).astype(np.int32)
    gap = fresh - np.arange(len(fresh))  # the old place that each new row stands before
    merged, base, done = Segments(columns.folder), 0, 0
    for number, (before, prefix, label, places, counts) in enumerate(filled):
        low, start = done, base + done
        done = len(gap) if number == count - 1 else int(np.searchsorted(gap, base + len(before)))
        base += len(before)
        inside = fresh[low:done] - start
        kept = np.ones(len(before) + done - low, bool)
        kept[inside] = False
        made = [np.empty(len(kept), c.dtype) for c in (before, prefix, label)]
        for out, column in zip(made, (before, prefix, label)):
            out[kept] = column
        made[0][inside] = OPEN
        made[2][inside] = labels[low:done]
        a, b = np.searchsorted(to, (start, start + len(kept)))
        made[1][to[a:b] - start] = prefix_to[a:b]
        if len(kept) <= 2 * segment:
            merged.append((*made, np.flatnonzero(kept).astype(np.int32).take(places), counts))
            continue
        for cut in range(0, len(kept), segment):
            part = [c[cut : cut + segment].copy() for c in made]
            merged.append((*part, *placed(part[0])))
    filled.drop()
    return merged, fresh, who
