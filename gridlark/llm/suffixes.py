"""Suffix-array dedup: bytes inside a string of WINDOW bytes that also starts earlier in the corpus.

The corpus is cut by content so that each part of its suffix array can be
built by itself. Each window of WINDOW bytes picks an anchor, the run of
ANCHOR bytes with the smallest hash in it. Equal windows pick equal anchors,
so only windows of one anchor can match. Windows that follow each other with
one anchor form a passage, of at most 2 * WINDOW - ANCHOR bytes.

1. Each block of documents drops passages that it holds earlier, byte for byte
   (all their windows start earlier), and gives the anchors of the others.
2. Anchors that come once in the corpus match nothing. The passages of the
   others are cut out of their documents and dealt by anchor.
3. A task gathers whole anchors to a collection of different passages, each
   with all its places, builds its transform and its common prefixes column by
   column (`columns`), and reads the suffixes in order: runs with common
   prefixes of WINDOW or more are equal windows, and of all their places all
   but the first in the corpus start earlier elsewhere. Of an anchor whose
   passages are all the same bytes there is nothing to build: the windows of a
   passage differ from each other, so all its places but the first go. Equal
   windows have their anchor at the same place, so a passage whose bytes around
   the anchor are like those of no other passage needs no building either.

Passages are short, so a round inserts one byte of every passage and the
number of rounds is bounded, whatever the length of the documents. Anchors
with over HOT passages deal their windows by the whole window instead, so a
collection holds at most HOT passages of an anchor, or one copy of a window
from each block. Nothing is collected or forced into a broadcast.

Defined cases. Windows are judged on the input; matches never cross documents.
A NULL text is an empty one. NULL ids come after all others, told apart by
their texts; so are rows that repeat an id with another text. A row that
repeats id and text is the same document and starts nowhere earlier. Texts are
taken whole; a cut inside a character leaves its bytes out of the digest
alone, and `deduplicate` keeps only whole characters. An empty table gives no
rows. Operators read the id and text they are told to; others cannot clash.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlark.llm import columns
from gridlark.llm.common import id_key, mix, parts, pieces, store_clean
from gridlark.session import scratch_path

WINDOW, ANCHOR = 100, 24
BLOCK_BYTES = 4_000_000
#: Passages of one anchor that a collection holds; bytes of a collection.
HOT, COLLECTION = 4096, 1 << 20
#: Bytes before the anchor at which the look around it is aligned; less is stricter and takes more looks.
LOOK = 19


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of ANCHOR bytes, from 8-byte words."""
    n = len(raw) - ANCHOR + 1
    words = np.lib.stride_tricks.as_strided(raw[: len(raw) - 7].view(np.uint8), (len(raw) - 7, 8), (1, 1)) if n > 0 else None
    if words is None:
        return np.zeros(0, np.uint64)
    words = np.ascontiguousarray(words).view("<u8").ravel()
    out = np.zeros(n, np.uint64)
    for j in range(0, ANCHOR, 8):
        out = (out ^ words[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return mix(out)


def least_places(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` hashes the place of its smallest, the first of equals; only the upper 40 bits count."""
    n = len(hashes)
    low = (1 << 24) - 1
    keys = (hashes & ~np.uint64(low)) | np.arange(n, dtype=np.uint64)
    span = 1
    while span < width:
        step = min(span, width - span)
        keys = np.minimum(keys[:-step], keys[step:])
        span += step
    return (keys & np.uint64(low)).astype(np.int64)


def passages(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window and number of windows of each passage of one text."""
    data = np.frombuffer(raw, np.uint8)
    anchors, starts, sizes = [], [], []
    n = len(data) - WINDOW + 1
    # Longer texts go in parts, so that places fit their bits; the part's edge may cut a passage in two.
    for low in range(0, max(n, 0), 1 << 22):
        high = min(n, low + (1 << 22))
        grams = gram_hashes(data[low : high + WINDOW - 1])
        place = least_places(grams, WINDOW - ANCHOR + 1)
        start = np.flatnonzero(np.diff(place, prepend=-1))
        anchors.append(grams[place[start]])
        starts.append(start + low)
        sizes.append(np.diff(np.append(start, high - low)))
    if not anchors:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    return np.concatenate(anchors).view(np.int64), np.concatenate(starts), np.concatenate(sizes)


def spans_of(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of windows that overlap or touch, joined."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate((start + n)[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    at = np.flatnonzero(new)
    return start[at], np.append(end[at[1:] - 1], end[-1:]) - start[at]


def packed(start: np.ndarray, n: np.ndarray) -> bytes:
    return np.stack([start, n]).astype("<i4").tobytes()


def unpacked(raw: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(raw or b"", "<i4").reshape(2, -1).astype(np.int64)
    return both[0], both[1]


def survey(docs: DataFrame) -> DataFrame:
    """anchor, ref, spans: a row per passage that is new in its block, and per document what its block decides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in pieces(batches, "text", BLOCK_BYTES):
            doc, sub, ref = (block[c].to_numpy() for c in ("doc", "sub", "ref"))
            texts = block["text"]
            seen: dict[bytes, int] = {}
            fresh: list[np.ndarray] = []
            anchors: list[np.ndarray] = []
            decided: list[tuple[int, bytes]] = []
            at = 0
            order = np.lexsort((sub, doc))
            # Rows that repeat an id and its text are one document.
            same = np.zeros(len(order), bool)
            same[1:] = (doc[order[1:]] == doc[order[:-1]]) & (sub[order[1:]] == sub[order[:-1]])
            for row, again in zip(order.tolist(), same.tolist()):
                raw = texts[row].as_py().encode("utf-8", "replace")
                anchor, start, n = passages(b"" if again else raw)
                if not len(anchor):
                    continue
                put, ends = seen.setdefault, (start + n + WINDOW - 1).tolist()
                first = np.array([put(raw[s:e], i) for i, (s, e) in enumerate(zip(start.tolist(), ends), at)])
                new = first == np.arange(at, at + len(first))
                at += len(first)
                if not new.all():
                    decided.append((row, packed(*spans_of(start[~new], n[~new]))))
                anchors.append(anchor[new])
                fresh.append(np.full(int(new.sum()), row))
            if not at:
                continue
            rows = np.concatenate([*fresh, np.array([r for r, _ in decided], np.int64)])
            none = np.arange(len(rows)) >= len(rows) - len(decided)
            spans = [{"doc": int(doc[r]), "sub": int(sub[r]), "runs": s} for r, s in decided]
            kinds = pa.struct([("doc", pa.int64()), ("sub", pa.int64()), ("runs", pa.binary())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([*anchors, np.zeros(len(decided), np.int64)]), pa.int64(), mask=none), pa.array(ref[rows]),
                 pa.array([None] * (len(rows) - len(decided)) + spans, kinds)], ["anchor", "ref", "spans"])

    return docs.mapInArrow(run, "anchor long, ref long, spans struct<doc:long,sub:long,runs:binary>")


def cut(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the maximal runs of bytes that runs of windows cover."""
    if not len(start):
        return start, start
    start, n = spans_of(start, n + WINDOW - 1)
    return start, start + n


def kept_bytes(raw: bytes, begin: np.ndarray, end: np.ndarray) -> list[bytes]:
    return [raw[a:b] for a, b in zip([0, *end.tolist()], [*begin.tolist(), len(raw)])]


def digest(raw: bytes, begin: np.ndarray, end: np.ndarray) -> str:
    return hashlib.sha256(b"".join(kept_bytes(raw, begin, end))).hexdigest()


def kept_text(raw: bytes, begin: np.ndarray, end: np.ndarray) -> str:
    """What is left, without the bytes of characters that a cut leaves in part."""
    return "".join(part.decode("utf-8", "ignore") for part in kept_bytes(raw, begin, end))


RESULT = "n_bytes long, n_removed long, n_spans long, result string"
SPANS = "struct<doc:long,sub:long,runs:binary>"


def open_passages(docs: DataFrame) -> DataFrame:
    """key, doc, sub, start, passage of docs (doc, sub, text, marks, spans): marks are anchors that repeat, with whether they are hot; spans are decided."""

    def found(raw: bytes, marks: pa.ListScalar, start: np.ndarray, n: np.ndarray) -> tuple[list[int], list[int], list[bytes]]:
        anchor, first, size = passages(raw)
        listed, hot = (marks.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        wanted = np.isin(anchor, listed)
        if len(start):
            # What the block decides needs no collection.
            start, n = spans_of(start, n)
            span = np.searchsorted(start, first, side="right") - 1
            wanted &= (span < 0) | (first + size > (start + n)[span])
        anchor, first, size = anchor[wanted], first[wanted], size[wanted]
        if not hot.any():
            return anchor.tolist(), first.tolist(), [raw[a:b] for a, b in zip(first.tolist(), (first + size + WINDOW - 1).tolist())]
        # Windows of hot anchors are passages of their own.
        split = np.isin(anchor, listed[hot])
        count = np.where(split, size, 1)
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start = np.repeat(first, count) + step
        end = start + np.where(split, 1, size).repeat(count) + WINDOW - 1
        cuts = [raw[a:b] for a, b in zip(start.tolist(), end.tolist())]
        keys = [window_key(c) if s else a for c, s, a in zip(cuts, split.repeat(count).tolist(), anchor.repeat(count).tolist())]
        return keys, start.tolist(), cuts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in pieces(batches, "text", BLOCK_BYTES // 4):
            keys, starts, cuts, counts = [], [], [], []
            for doc, sub, text, marks, spans in zip(*(block[c].to_pylist() for c in ("doc", "sub", "text")), block["marks"], block["spans"].to_pylist()):
                done = [unpacked(s["runs"]) for s in spans if (s["doc"], s["sub"]) == (doc, sub)]
                start, n = (np.concatenate([d[i] for d in done] + [np.zeros(0, np.int64)]) for i in (0, 1))
                made = found(text.encode("utf-8", "replace"), marks, start, n)
                for held, more in zip((keys, starts, cuts), made):
                    held += more
                counts.append(len(made[0]))
            doc, sub = (np.repeat(block[c].to_numpy(), counts) for c in ("doc", "sub"))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(doc), pa.array(sub), pa.array(starts, pa.int32()), pa.array(cuts, pa.binary())],
                                             ["key", "doc", "sub", "start", "passage"])

    return docs.select("doc", "sub", "text", "marks", "spans").mapInArrow(run, "key long, doc long, sub long, start int, passage binary")


def window_key(window: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "little", signed=True)


def late_windows(key: np.ndarray, doc: np.ndarray, sub: np.ndarray, start: np.ndarray, cuts: list[bytes], folder: str | None = None, **sizes: int) -> tuple[np.ndarray, np.ndarray]:
    """Passage and offset of each window that an earlier place (doc, sub, start) holds too, of the passages `cuts`."""
    # Documents get a number in their order, so that a window's place is one number.
    order = np.lexsort((sub, doc))
    new = np.ones(len(order), bool)
    new[1:] = (doc[order[1:]] != doc[order[:-1]]) | (sub[order[1:]] != sub[order[:-1]])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) << 40
    rank += start
    numbers: dict[bytes, int] = {}
    put = numbers.setdefault
    which = np.array([put(c, len(numbers)) for c in cuts], np.int64)
    first = np.full(len(numbers), np.iinfo(np.int64).max)
    np.minimum.at(first, which, rank)
    count = np.fromiter(map(len, numbers), np.int64, len(numbers)) - WINDOW + 1
    begin = np.cumsum(count) - count
    # The first place of every window of every different passage: its own, unless a collection knows better.
    least = np.repeat(first - begin, count) + np.arange(count.sum())
    keys = np.empty(len(numbers), np.int64)
    keys[which] = key
    _, group, members = np.unique(keys, return_inverse=True, return_counts=True)
    several = np.flatnonzero(members[group] > 1)
    different = list(numbers)
    if len(several):
        several = several[alike([different[i] for i in several.tolist()], keys[several])]
    if len(several):
        sequence, offset, earliest = earliest_places([different[i] for i in several.tolist()], first[several], folder, **sizes)
        least[begin[several][sequence] + offset] = earliest
    # Every place of a passage has the windows of its sequence.
    own = count[which]
    copies = np.repeat(np.arange(len(which)), own)
    step = np.arange(len(copies)) - np.repeat(np.cumsum(own) - own, own)
    late = rank[copies] + step > least[begin[which[copies]] + step]
    return copies[late], step[late]


def alike(passages: list[bytes], keys: np.ndarray) -> np.ndarray:
    """Which of the different passages may share a window with another one of their anchor.

    A window holds l bytes before the anchor and WINDOW - ANCHOR - l after it.
    With l rounded down to a multiple of LOOK, and the bytes after it to what
    they are at least then, all windows lie around one of a few strings.
    """
    cat = b"".join(passages)
    size = np.fromiter(map(len, passages), np.int64, len(passages))
    begin = np.cumsum(size) - size
    grams = gram_hashes(np.frombuffer(cat, np.uint8)).view(np.int64)
    hit = np.flatnonzero(grams == np.repeat(keys, size)[: len(grams)])
    which, first = np.unique(np.searchsorted(begin, hit, side="right") - 1, return_index=True)
    at = hit[first]
    fits = (at - begin[which] <= WINDOW - ANCHOR) & (at + ANCHOR <= (begin + size)[which])
    which, at = which[fits], at[fits]
    out = np.ones(len(passages), bool)
    out[which] = False  # windows of hot anchors have no anchor for a key: they stay
    for before in range(0, WINDOW - ANCHOR + 1, LOOK):
        low, high = at - before, at + ANCHOR + max(0, WINDOW - ANCHOR - before - LOOK + 1)
        inside = np.flatnonzero((low >= begin[which]) & (high <= (begin + size)[which]))
        look = [cat[a:b] for a, b in zip(low[inside].tolist(), high[inside].tolist())]
        count = Counter(look)
        out[which[inside]] |= np.fromiter((count[s] > 1 for s in look), bool, len(look))
    return out


def earliest_places(sequences: list[bytes], first: np.ndarray, folder: str | None, **sizes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence, offset and the least place of all equal windows, for each window of the sequences, which start at `first`."""
    lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
    built = columns.build(sequences, folder=folder, **sizes)
    labels, groups, now = [], [], 0
    for _, prefix, label, *_ in built:
        group = now + np.cumsum(prefix < WINDOW)
        now = int(group[-1])
        full = (label & ((1 << columns.LENGTH_BITS) - 1)) >= WINDOW
        labels.append(label[full].astype(np.int64))
        groups.append(group[full])
    built.drop()
    label, group = np.concatenate(labels), np.concatenate(groups)
    sequence = label >> columns.LENGTH_BITS
    offset = lengths[sequence] - (label & ((1 << columns.LENGTH_BITS) - 1))
    new = np.ones(len(group), bool)
    new[1:] = group[1:] != group[:-1]
    return sequence, offset, np.minimum.reduceat(first[sequence] + offset, np.flatnonzero(new))[np.cumsum(new) - 1]


def match(opened: DataFrame) -> DataFrame:
    """doc, sub, spans: windows that start earlier. opened: key, doc, sub, start, passage."""
    folder = scratch_path(opened.sparkSession, "suffix-columns")

    def close(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        key, doc, sub, start = (rows.column(c).to_numpy().astype(np.int64) for c in ("key", "doc", "sub", "start"))
        copy, offset = late_windows(key, doc, sub, start, rows.column("passage").to_pylist(), folder)
        doc, sub, start = doc[copy], sub[copy], start[copy] + offset
        order = np.lexsort((start, sub, doc))
        doc, sub, start = doc[order], sub[order], start[order]
        # Runs of windows that follow each other, then the runs of each document.
        other = np.ones(len(doc), bool)
        other[1:] = (doc[1:] != doc[:-1]) | (sub[1:] != sub[:-1])
        opens = other.copy()
        opens[1:] |= start[1:] > start[:-1] + 1
        run = np.flatnonzero(opens)
        n = start[np.append(run[1:], len(start)) - 1] - start[run] + 1 if len(run) else run
        at = np.append(np.flatnonzero(other[run]), len(run))
        spans = [packed(start[run[a:b]], n[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        lead = run[at[:-1]]
        return pa.RecordBatch.from_arrays([pa.array(doc[lead]), pa.array(sub[lead]), pa.array(spans, pa.binary())], ["doc", "sub", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in (b for b in batches if b.num_rows):
            # A collection ends with an anchor, never inside one.
            key = batch["key"].to_numpy()
            total = size + np.cumsum(pc.binary_length(batch["passage"]).to_numpy())
            ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, [])
            if held and held[-1]["key"][-1].as_py() != key[0]:
                ends = np.append(0, ends)
            low, base = 0, 0
            for end in ends.astype(np.int64).tolist():
                if (total[end - 1] if end else size) - base >= COLLECTION:
                    held.append(batch.slice(low, end - low))
                    yield close(held)
                    held, low, base = [], end, int(total[end - 1] if end else size)
            held.append(batch.slice(low))
            size = int(total[-1]) - base
        if held:
            yield close(held)

    dealt = opened.repartition(parts(opened.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "doc long, sub long, spans binary")


def remove(docs: DataFrame, finish: Callable[[bytes, np.ndarray, np.ndarray], str]) -> DataFrame:
    """docs: doc, sub, text, rest. Gives rest and RESULT, where result is finish(bytes, begins, ends of removed runs)."""
    docs = docs.withColumn("ref", F.xxhash64("doc", "sub"))
    found = store_clean(survey(docs.select("doc", "sub", "ref", "text")), "suffix-survey")
    group = Window.partitionBy("anchor")
    repeats = found.where("anchor IS NOT NULL").select("anchor", "ref").withColumn("n", F.count(F.lit(1)).over(group)).where("n > 1")
    marks = repeats.select("ref", F.struct("anchor", (F.col("n") > HOT).alias("hot")).alias("mark"), F.lit(None).cast(SPANS).alias("spans"))
    decided = found.where("anchor IS NULL").select("ref", "spans")
    marked = marks.unionByName(decided, allowMissingColumns=True).groupBy("ref").agg(F.collect_set("mark").alias("marks"), F.collect_set("spans").alias("spans"))
    marked = store_clean(marked.where(F.size("marks") > 0), "suffix-marks")
    opened = open_passages(docs.select("doc", "sub", "ref", "text").join(marked, "ref"))
    late = store_clean(match(opened), "suffix-late")
    late = late.select(F.xxhash64("doc", "sub").alias("ref"), F.struct("doc", "sub", F.col("spans").alias("runs")).alias("spans"))
    gone = decided.union(late).groupBy("ref").agg(F.collect_list("spans").alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        for block in pieces(batches, "text", BLOCK_BYTES):
            rows = []
            for doc, sub, text, spans in zip(*(block[c].to_pylist() for c in ("doc", "sub", "text", "spans"))):
                own = [unpacked(s["runs"]) for s in spans or () if (s["doc"], s["sub"]) == (doc, sub)]
                start, n = (np.concatenate([d[i] for d in own] + [np.zeros(0, np.int64)]) for i in (0, 1))
                raw = text.encode("utf-8", "replace")
                begin, end = cut(start, n)
                rows.append((len(raw), int((end - begin).sum()), len(begin), finish(raw, begin, end)))
            yield pa.RecordBatch.from_arrays([block["rest"], *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))],
                                             ["rest", "n_bytes", "n_removed", "n_spans", "result"])

    schema = T.StructType([docs.schema["rest"], *T._parse_datatype_string(RESULT).fields])
    return docs.join(gone, "ref", "left").select("doc", "sub", "rest", "text", "spans").mapInArrow(run, schema)


def keyed(df: DataFrame, id_col: str, text_col: str, rest: list) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(id_key(F.col(id_col), F.col(text_col)).alias("doc"), F.xxhash64(text).alias("sub"), text.alias("text"), F.struct(*rest).alias("rest"))


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    done = remove(keyed(df, id_col, text_col, [F.col(id_col).cast("long").alias("doc_id")]), digest)
    return done.select("rest.doc_id", "n_bytes", "n_removed", "n_spans", F.col("result").alias("kept_sha256"))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows and columns with repeated bytes cut out of the texts; NULL texts stay NULL."""
    rest = [*(F.col(c) for c in df.columns if c != text_col), F.col(text_col).isNull().alias("is null")]
    done = remove(keyed(df, id_col, text_col, rest), kept_text)
    text = F.when(~F.col("rest")["is null"], F.col("result"))
    return done.select(*(text.alias(c) if c == text_col else F.col("rest")[c].alias(c) for c in df.columns))


ORACLE = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, substr(h, 2 * i + 1, {2 * WINDOW}) AS g FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - {WINDOW - 1})) AS i FROM d WHERE len(h) >= {2 * WINDOW})),
late AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
runs AS (SELECT doc_id, i, coalesce(i - lag(i) OVER w > {WINDOW}, true) AS opens FROM late WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
spans AS (SELECT doc_id, min(i) AS a, max(i) + {WINDOW} AS b FROM (SELECT doc_id, i, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM runs) GROUP BY doc_id, run),
gone AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last FROM spans GROUP BY doc_id),
before AS (SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_ FROM spans),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a) AS head FROM before JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE head || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
