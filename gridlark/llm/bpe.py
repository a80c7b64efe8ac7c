"""BPE encoding and decoding over contiguous rank arrays.

A tokenizer file (vocabulary, merges, word-end suffix, byte-level alphabet,
NFC and lower-casing, one splitting expression) is read as data; encoding is
done here. A word's parts lie in one array and the ranks of adjacent parts in
another: the smallest rank is found by a scan, its boundary is deleted and the
two neighbouring ranks are refreshed. Words over SHORT parts, where scans
would cost the square of the length, use a heap with the same result.

Words repeat, so each worker remembers a bounded number of them. NULL and
empty texts have no ids. Every row is encoded by itself; nothing is shuffled.
Texts are coded
whole, however long; repeated rows give repeated results and an empty table none. Only the id and the text are read,
so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from gridlark.llm.common import CACHE_WORDS, claim, narrow, pieces

BLOCK_BYTES = 2_000_000
SHORT = 256
NO_RANK = 1 << 60


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(spare)) for b in range(256)]


class Coder:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.ranks[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        split = next(p["pattern"]["Regex"] for p in data["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(split, regex.V0)
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        alphabet = byte_alphabet()
        self.single = [self.vocab[c] for c in alphabet]
        self.last = [self.vocab[c + self.suffix] for c in alphabet]
        self.words: dict[str, tuple[int, ...]] = {}
        self.known: dict[bytes, tuple[int, ...]] = {}

    def merge(self, parts: list[int]) -> list[int]:
        """Scan, delete, refresh."""
        if len(parts) > SHORT:
            return self.merge_long(parts)
        get = self.ranks.get
        none = (NO_RANK, 0)
        pairs = [get(pair, none) for pair in zip(parts, parts[1:])]
        while pairs:
            least = min(pairs)
            if least is none or least[0] == NO_RANK:
                break
            i = pairs.index(least)
            parts[i] = least[1]
            del parts[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = get((parts[i], parts[i + 1]), none)
            if i:
                pairs[i - 1] = get((parts[i - 1], parts[i]), none)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same merges in the same order (rank, then place) from a heap over a linked list."""
        n, get = len(parts), self.ranks.get
        after, before, gone = [*range(1, n), -1], [*range(-1, n - 1)], [False] * n
        heap = [(r[0], i, parts[i], parts[i + 1], r[1]) for i in range(n - 1) if (r := get((parts[i], parts[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, whole = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], gone[j], after[i] = whole, True, after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if r := get((whole, parts[after[i]])):
                    heapq.heappush(heap, (r[0], i, whole, parts[after[i]], r[1]))
            if before[i] >= 0 and (r := get((parts[before[i]], whole))):
                heapq.heappush(heap, (r[0], before[i], parts[before[i]], whole, r[1]))
        return [p for p, out in zip(parts, gone) if not out]

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of one normalized word."""
        if (ids := self.words.get(word)) is None:
            raw = word.encode("utf-8")
            ids = tuple(self.merge([*map(self.single.__getitem__, raw[:-1]), self.last[raw[-1]]]))
            if len(self.words) < CACHE_WORDS and len(raw) < 64:
                self.words[word] = ids
        return ids

    def plain(self, text: str) -> list[int]:
        if not text.isascii():
            text = "".join(map(str.lower, unicodedata.normalize("NFC", text)))  # letter by letter: no final sigma
        else:
            text = text.lower()
        return [i for word in self.split.findall(text) for i in self.word(word)]

    def chunk(self, text: str) -> tuple[int, ...]:
        """Ids of a text without white space at which it could be cut."""
        if self.at_special is None or "<" not in text:
            return tuple(self.plain(text))
        return tuple(chain.from_iterable([self.special[t]] if t in self.special else self.plain(t) for t in self.at_special.split(text) if t))

    def encode_block(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, as 32-bit numbers."""
        lists = [t.encode("utf-8", "replace").split() if t else [] for t in texts]
        distinct = set(chain.from_iterable(lists))
        known = self.known
        table = {c: known[c] if c in known else self.chunk(c.decode("utf-8")) for c in distinct}
        if len(known) < CACHE_WORDS:
            known.update((c, ids) for c, ids in table.items() if len(c) < 64)
        get = table.__getitem__
        return [np.fromiter(chain.from_iterable(map(get, chunks)), "<u4") for chunks in lists]

    def decode(self, ids: np.ndarray) -> str:
        """Without a decoder in the file, tokens are joined by spaces; unknown ids are left out."""
        return " ".join([self.names[i] for i in ids.tolist() if i in self.names])


@lru_cache(maxsize=1)
def _coder(path: str) -> Coder:
    return Coder(path)


def coder(path: str) -> Coder:
    """The worker's coder, with what it remembers."""
    claim("bpe", _coder.cache_clear)
    return _coder(path)


def encode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int> of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = coder(tokenizer_path)
        for block in pieces(batches, "text", BLOCK_BYTES):
            coded = made.encode_block(block["text"].to_pylist())
            ends = np.concatenate([[0], np.cumsum([len(x) for x in coded])]).astype(np.int32)
            flat = np.concatenate(coded).astype(np.int32) if coded else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([block["doc_id"], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "ids"])

    return narrow(df, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of arrays of ids; NULL stays NULL."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = coder(tokenizer_path)
        for batch in batches:
            texts = [None if ids is None else made.decode(np.array(ids, np.int64)) for ids in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return df.select(df[id_col].cast("long").alias("doc_id"), df[ids_col].alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = coder(tokenizer_path)
        for block in pieces(batches, "text", BLOCK_BYTES):
            coded = made.encode_block(block["text"].to_pylist())
            yield pa.RecordBatch.from_arrays(
                [block["doc_id"], pa.array([len(x) for x in coded], pa.int64()),
                 pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in coded]),
                 pa.array([hashlib.sha256(made.decode(x).encode("utf-8")).hexdigest() for x in coded])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return narrow(df, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
