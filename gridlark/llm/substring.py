"""Substring dedup: words inside a window of words that also starts earlier in the corpus.

The reference is the corpus itself, so it is cut into shards by content. Each
window of WINDOW words picks an anchor, the smallest hash among its runs of
ANCHOR words. Equal windows pick equal anchors, so an anchor's windows, and no
others, can match each other: they are a shard. Adjacent windows with one
anchor form a passage.

* Equal passages are one: a task keeps the first of each of its blocks, the
  shard keeps the first of all, and all later ones are removed whole.
* Where a shard holds different passages, a suffix automaton is built over
  them in corpus order and they are streamed through it. The matching
  statistics give, at every word, the state of the last WINDOW words, whose
  first occurrence tells whether the window starts earlier elsewhere.

An automaton lives in the task of its shard. It is not broadcast, since a
corpus has no proven size bound; only what can match it meets it. Anchors so
frequent that many passages meet in one shard (found in a sample, at most
1 / HOT_SHARE of them) are not used: their windows are shards of their own,
one for each distinct window. The result does not depend on which are.

Windows are judged on the input. NULL and short texts lose nothing. A NULL id
comes after all others, told apart by its text. A row that repeats an id and
its text is the same document and starts nowhere earlier; texts that differ
under one id are documents of their own, in the order of their hashes. Texts
are taken whole, however long; an empty table gives no rows. Only the id and
the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlark.llm.common import gram_hashes, hash_words, id_key, mix, parts, pieces, store, tell_apart

WINDOW, ANCHOR = 20, 6
BLOCK_BYTES = 4_000_000
#: Anchors with this share of all passages, and HOT_LEAST of the sample, are hot.
HOT_SHARE, HOT_LEAST, SAMPLE = 1e-4, 50, 0.02
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")

PASSAGES = "anchor long, class long, doc long, start int, n int, decided boolean"


def powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(0, n - 1), base, np.uint64))])[:n]


def passages(words: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, class (hash of the words), first window and number of windows of each passage."""
    n = len(words) - WINDOW + 1
    if n <= 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty
    grams = gram_hashes(words, ANCHOR)
    place = np.arange(n) + np.lib.stride_tricks.sliding_window_view(grams, WINDOW - ANCHOR + 1).argmin(axis=1)
    start = np.flatnonzero(np.diff(place, prepend=-1))
    size = np.diff(np.append(start, n))
    anchor = grams[place[start]]
    if len(hot):
        common = np.isin(anchor, hot)
        if common.any():
            single = start[common].repeat(size[common]) + (np.arange(size[common].sum()) - np.repeat(np.cumsum(size[common]) - size[common], size[common]))
            own = gram_hashes(words, WINDOW)[single]
            start, size = np.append(start[~common], single), np.append(size[~common], np.ones(len(single), np.int64))
            anchor = np.append(anchor[~common], own)
    total = np.concatenate([[np.uint64(0)], np.cumsum(words * powers(_BASE, len(words)))])
    made = (total[start + size + WINDOW - 1] - total[start]) * powers(_INVERSE, len(words))[start]
    return anchor.view(np.int64), mix(made + size.astype(np.uint64)).view(np.int64), start, size


def find_passages(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """PASSAGES of (doc, text): the first of each class in its block, and the windows of the others, decided."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in pieces(batches, "text", BLOCK_BYTES):
            found, docs_of = [], []
            for doc, text in zip(block["doc"].to_pylist(), block["text"].to_pylist()):
                if text:
                    made = passages(hash_words(text.encode("utf-8", "replace").split()), hot)
                    found.append(made)
                    docs_of.append(np.full(len(made[0]), doc, np.int64))
            if not found:
                continue
            anchor, cls, start, n = (np.concatenate([f[i] for f in found]) for i in range(4))
            doc = np.concatenate(docs_of)
            order = np.lexsort((start, doc, cls, anchor))
            anchor, cls, start, n, doc = anchor[order], cls[order], start[order], n[order], doc[order]
            new = np.ones(len(anchor), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (cls[1:] != cls[:-1])
            first = np.maximum.accumulate(np.where(new, np.arange(len(anchor)), 0))
            decided = (doc != doc[first]) | (start != start[first])
            d_doc, d_start, d_n = join_spans(doc[decided], start[decided], n[decided])
            keep = ~decided
            own = mix(d_doc.astype(np.uint64) * np.uint64(_BASE) + d_start.astype(np.uint64)).view(np.int64)  # any key: it only deals them out
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(anchor[keep], own)), pa.array(np.append(cls[keep], np.zeros(len(own), np.int64))), pa.array(np.append(doc[keep], d_doc)),
                 pa.array(np.append(start[keep], d_start).astype(np.int32)), pa.array(np.append(n[keep], d_n).astype(np.int32)),
                 pa.array(np.append(np.zeros(keep.sum(), bool), np.ones(len(own), bool)))],
                ["anchor", "class", "doc", "start", "n", "decided"],
            )

    return docs.mapInArrow(run, PASSAGES)


def join_spans(doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that touch, joined; no two overlap but where documents repeat."""
    if not len(doc):
        return doc, start, n
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], (start + n)[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > end[:-1])
    at = np.flatnonzero(new)
    return doc[at], start[at], np.maximum.reduceat(end, at) - start[at]


class Automaton:
    """Suffix automaton over several sequences; each state knows the first end of its strings."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [(-1, -1)]

    def state(self, length: int, first: tuple[int, int]) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.first.append(first)
        return len(self.next) - 1

    def clone(self, p: int, q: int, word: int) -> int:
        c = self.state(self.length[p] + 1, self.first[q])
        self.next[c] = dict(self.next[q])
        self.link[c], self.link[q] = self.link[q], c
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = c
            p = self.link[p]
        return c

    def add(self, sequence: list[int], number: int) -> None:
        last = 0
        for place, word in enumerate(sequence):
            p = last
            if (q := self.next[p].get(word)) is not None:
                last = q if self.length[q] == self.length[p] + 1 else self.clone(p, q, word)
                continue
            last = self.state(self.length[p] + 1, (number, place))
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = last
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[last] = q if self.length[q] == self.length[p] + 1 else self.clone(p, q, word)

    def firsts(self, sequence: list[int], length: int) -> list[tuple[int, int] | None]:
        """For each place, where the last `length` words end first; None if they are not in it."""
        out: list[tuple[int, int] | None] = []
        v = matched = 0
        for word in sequence:
            while v and word not in self.next[v]:
                v = self.link[v]
                matched = self.length[v]
            if word in self.next[v]:
                v, matched = self.next[v][word], matched + 1
            while self.length[self.link[v]] >= length:
                v = self.link[v]
                matched = self.length[v]
            out.append(self.first[v] if matched >= length else None)
        return out


def late_windows(sequences: list[list[int]], window: int = WINDOW) -> list[list[int]]:
    """Of each sequence, the windows (by start) that occur earlier in this list."""
    automaton = Automaton()
    for number, sequence in enumerate(sequences):
        automaton.add(sequence, number)
    return [
        [place - window + 1 for place, first in enumerate(automaton.firsts(sequence, window)) if first is not None and first != (number, place)]
        for number, sequence in enumerate(sequences)
    ]


def match_shards(open_rows: DataFrame) -> DataFrame:
    """doc, start, n: windows of a shard's different passages that start earlier. open_rows: anchor, doc, start, words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[tuple[int, int, list[int]]] = []
        last = None
        out: list[tuple[int, int]] = []

        def close() -> None:
            for (doc, start, _), late in zip(shard, late_windows([s[2] for s in shard])):
                out.extend((doc, start + w) for w in late)
            shard.clear()

        def made() -> pa.RecordBatch:
            rows = np.array(out, np.int64).reshape(-1, 2)
            out.clear()
            doc, start, n = join_spans(rows[:, 0], rows[:, 1], np.ones(len(rows), np.int64))
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], ["doc", "start", "n"])

        for batch in batches:
            for anchor, doc, start, words in zip(*(batch[c].to_pylist() for c in ("anchor", "doc", "start", "words"))):
                if anchor != last:
                    close()
                    last = anchor
                sequence = np.frombuffer(words, np.uint32).tolist()
                if shard and shard[-1][:2] == (doc, start):
                    continue  # the same document again
                shard.append((doc, start, sequence))
            yield made()
        close()
        yield made()

    dealt = open_rows.repartition(parts(open_rows.sparkSession), "anchor").sortWithinPartitions("anchor", "doc", "start")
    return dealt.mapInArrow(run, "doc long, start int, n int")


def word_mask(n_words: int, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Words inside the given runs of windows."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + sizes + WINDOW - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def digest(raw: bytes, gone: np.ndarray | None) -> str:
    """SHA-256 of the kept words, joined by one space."""
    words = raw.split()
    return hashlib.sha256(b" ".join(words if gone is None else [w for w, g in zip(words, gone.tolist()) if not g])).hexdigest()


def kept_text(raw: bytes, gone: np.ndarray | None) -> str:
    """The text, as it stands between kept neighbours; one space where words are missing."""
    if gone is None or not gone.any():
        return raw.decode("utf-8")
    spans = [m.span() for m in _BYTES.finditer(raw)]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], gone, [True]])))
    return b" ".join(raw[spans[a][0] : spans[b - 1][1]] for a, b in zip(edges[::2], edges[1::2])).decode("utf-8")


def remove(docs: DataFrame, finish: Callable[[bytes, np.ndarray | None], str]) -> DataFrame:
    """docs: doc, text, rest. Gives doc, rest, n_words, n_removed and result, which is finish(text, removed words); NULL for NULL."""
    spark = docs.sparkSession
    docs = tell_apart(docs)
    texts = docs.select("doc", "text")
    sample = find_passages(texts.sample(SAMPLE, seed=11), np.zeros(0, np.uint64)).where(~F.col("decided")).groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    sample = store(sample, "anchor-sample")
    total = sample.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    hot = sample.where(F.col("n") >= max(HOT_LEAST, HOT_SHARE * total)).select("anchor").collect()  # at most 1 / HOT_SHARE rows
    hot = np.array([r["anchor"] for r in hot], np.int64).view(np.uint64)

    same = Window.partitionBy("anchor", "class").orderBy("doc", "start")
    shard = Window.partitionBy("anchor")
    ranked = (
        find_passages(texts, hot).repartition(parts(spark), "anchor")
        .withColumn("first_doc", F.first("doc").over(same)).withColumn("first_start", F.first("start").over(same))
        .withColumn("low", F.min("class").over(shard)).withColumn("high", F.max("class").over(shard))
    )
    later = F.col("decided") | (F.col("doc") != F.col("first_doc")) | (F.col("start") != F.col("first_start"))
    marks = store(
        ranked.where(later | (F.col("low") != F.col("high"))).select("doc", "start", "n", F.when(~later, F.col("anchor")).alias("anchor")), "passages")
    by_doc = marks.groupBy("doc").agg(F.collect_set(F.struct("start", "n", "anchor")).alias("marks"))
    rest_type = docs.schema["rest"].dataType.simpleString()

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in pieces(batches, "text", BLOCK_BYTES):
            rows: list[tuple] = []
            for text, marked in zip(block["text"].to_pylist(), block["marks"].to_pylist()):
                raw = text.encode("utf-8", "replace") if text is not None else b""
                words = raw.split()
                gone = [(m["start"], m["n"]) for m in marked or () if m["anchor"] is None]
                still = [m for m in marked or () if m["anchor"] is not None]
                starts, sizes = (np.array([g[i] for g in gone], np.int64) for i in (0, 1))
                if still:
                    short = (hash_words(words) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                    opened = [{"anchor": m["anchor"], "start": m["start"], "words": short[m["start"] : m["start"] + m["n"] + WINDOW - 1].tobytes()} for m in still]
                    rows.append((len(words), None, text, np.stack([starts, sizes]).astype(np.int32).tobytes(), opened))
                else:
                    mask = word_mask(len(words), starts, sizes) if gone else None
                    rows.append((len(words), int(mask.sum()) if gone else 0, None if text is None else finish(raw, mask), None, None))
            opened_type = pa.list_(pa.struct([("anchor", pa.int64()), ("start", pa.int32()), ("words", pa.binary())]))
            types = (pa.int64(), pa.int64(), pa.string(), pa.binary(), opened_type)
            yield pa.RecordBatch.from_arrays(
                [block["doc"], block["rest"], *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))],
                ["doc", "rest", "n_words", "n_removed", "result", "gone", "open"],
            )

    once = store(
        docs.join(by_doc, "doc", "left").select("doc", "rest", "text", "marks").mapInArrow(
            first_pass, f"doc long, rest {rest_type}, n_words long, n_removed long, result string, gone binary, open array<struct<anchor:long,start:int,words:binary>>"),
        "first-pass",
    )
    shown = once.where("open IS NOT NULL").select("doc", F.explode("open").alias("o")).select("o.anchor", "doc", "o.start", "o.words")
    late = store(match_shards(shown), "late-windows").groupBy("doc").agg(F.collect_set(F.struct("start", "n")).alias("late"))

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in pieces(batches, "result", BLOCK_BYTES):
            removed, results = [], []
            for text, gone, spans in zip(*(block[c].to_pylist() for c in ("result", "gone", "late"))):
                raw = text.encode("utf-8", "replace")
                old = np.frombuffer(gone, np.int32).reshape(2, -1).astype(np.int64)
                new = np.array([(s["start"], s["n"]) for s in spans or ()], np.int64).reshape(-1, 2).T
                mask = word_mask(len(raw.split()), np.append(old[0], new[0]), np.append(old[1], new[1]))
                removed.append(int(mask.sum()))
                results.append(finish(raw, mask))
            yield pa.RecordBatch.from_arrays([block["doc"], block["rest"], block["n_words"], pa.array(removed, pa.int64()), pa.array(results, pa.string())],
                                             ["doc", "rest", "n_words", "n_removed", "result"])

    schema = f"doc long, rest {rest_type}, n_words long, n_removed long, result string"
    opened = once.where("open IS NOT NULL").select("doc", "rest", "n_words", "result", "gone").join(late, "doc", "left").mapInArrow(second_pass, schema)
    return once.where("open IS NULL").select("doc", "rest", "n_words", "n_removed", "result").unionByName(opened)


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(id_key(F.col(id_col), F.col(text_col)).alias("doc"), text.alias("text"), F.struct(F.col(id_col).cast("long").alias("doc_id")).alias("rest"))
    return remove(docs, digest).select("rest.doc_id", "n_words", "n_removed", F.col("result").alias("kept_sha256"))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows and columns with repeated passages cut out of the texts; rows that lose all words go."""
    docs = df.select(id_key(F.col(id_col), F.col(text_col)).alias("doc"), F.col(text_col).cast("string").alias("text"),
                     F.struct(*(c for c in df.columns if c != text_col), F.lit(0).alias("_")).alias("rest"))
    done = remove(docs, kept_text).where("n_words = 0 OR n_removed < n_words")
    return done.select(*(F.col("result").alias(c) if c == text_col else F.col("rest")[c].alias(c) for c in df.columns))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
late AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + o AS j FROM late, range(0, 20) t(o)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
kept AS (SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY j) AS text FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
