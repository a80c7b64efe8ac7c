"""Exact encoding with a public tokenizer file, each new piece of text encoded once.

A text is cut where the tokenizer cuts anyway, so the ids of a text are the
ids of its chunks in order. Punctuation after a letter or digit is a piece of
its own for these tokenizers, so a chunk is a core and a tail. Arrow cuts a
block of texts, numbers its different chunks and puts their ids in a row again;
Python sees the different cores of a block.

The missing cores of a block go to the library as one text, joined by a
special token, which the tokenizer always takes out before anything else; the
ids between its ids are those of the cores. Most cores are plain: letters of
ASCII and Latin-1 alone, with the space before them in byte-level files. Such a
core is one piece for these tokenizers, so it goes to the library's model as it
is, in the byte alphabet, without the normalizer and the expressions, which
take most of the library's time.

A worker remembers cores in two generations: what a block uses is moved to the
young one, and when that is full the old one goes. So frequent cores stay
whenever they first come, and memory is bounded; what is not remembered is
encoded again.
"""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import CharDelimiterSplit

from gridlark.llm.common import claim

#: Entries of one generation, each of about 200 bytes.
CORES = 400_000
#: Cores in one call of the library.
JOINED = 2_000
#: Runs of white space and the marker need the whole text at once.
_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_WHOLE = _SPACE + "{2}|\\x00"
#: Letters and digits, by byte; the other visible ASCII characters: a run of them after a letter or digit is one piece.
_ENDS = np.array([chr(c).isalnum() and c < 128 for c in range(256)])
_TAIL = "".join(chr(c) for c in range(33, 127) if not _ENDS[c])
#: UTF-8 of letters: ASCII and those of Latin-1 from U+00C0, in lower case where the tokenizer folds.
_PLAIN = {"word": re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+"), "byte": re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")}
#: What the plain path knows to take a run of letters as one piece of the byte alphabet.
_KNOWN = {"word": (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]), "byte": ([], ["ByteLevel"])}


def byte_alphabet() -> str:
    """The character of each byte in byte-level vocabularies: itself if visible, else the next one from U+0100."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return "".join(chr(b if b in visible else next(hidden)) for b in range(256))


def steps(part: dict | None) -> list[str]:
    """Kinds of a normalizer's or pre-tokenizer's steps."""
    inner = (part or {}).get("normalizers") or (part or {}).get("pretokenizers")
    return [k for p in inner for k in steps(p)] if inner else [part["type"]] if part else []


class Memory:
    """Packed ids by text, in two generations."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def missing(self, wanted: set[bytes]) -> list[bytes]:
        """The wanted texts that are not remembered; the others are young from here on."""
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        out = []
        for text in wanted.difference(young):
            if (ids := old.get(text)) is None:
                out.append(text)
            else:
                young[text] = ids
        return out

    def forget(self, texts: list[bytes]) -> None:
        """Long texts stay no longer than they are used."""
        for text in texts:
            if len(text) >= 64:
                del self.young[text]


class ChunkEncoder:
    """Texts to packed ids.

    cut: "word" for tokenizers that lower-case, drop white space and never
    look across it; "byte" for byte-level ones, whose chunks are a word with
    the one space before it, or a line break.
    """

    def __init__(self, path: str, cut: str, dtype: str = "<u4") -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.dtype = np.dtype(dtype)
        self.chunks = {"word": pc.ascii_split_whitespace, "byte": self.spaced}[cut]
        self.folds = cut == "word"
        self.cores = Memory(CORES)
        # A special token that takes no white space with it parts joined cores.
        parting = [(i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.normalized or t.single_word)]
        self.part_id, self.part = parting[0] if parting else (None, None)
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # The model alone, and a mark that parts plain cores; none for tokenizers of another make.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = CharDelimiterSplit(" ")
        made = json.loads(self.tokenizer.to_str())
        kinds = (steps(made["normalizer"]), steps(made["pre_tokenizer"]))
        mark = self.plain.encode("!").ids
        self.mark = mark[0] if kinds == _KNOWN[cut] and made["model"]["type"] == "BPE" and not made["model"].get("dropout") and len(mark) == 1 else None
        self.is_plain = _PLAIN[cut].fullmatch
        self.alphabet = byte_alphabet()

    @staticmethod
    def spaced(texts: pa.Array) -> pa.ListArray:
        """Words with the one space before them, line breaks."""
        cut = pc.replace_substring(pc.replace_substring(texts, " ", "\x00 "), "\n", "\x00\n\x00")
        return pc.split_pattern(pc.if_else(pc.match_substring_regex(texts, _WHOLE), "", cut), "\x00")

    def pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def library(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Packed ids of each piece."""
        out = self.letters([p for p in pieces if self.is_plain(p)]) if self.mark is not None else {}
        if len(out) == len(pieces):
            return out
        pieces = [p for p in pieces if p not in out] if out else pieces
        alone = [p for p in pieces if self.part is None or any(s in p for s in self.specials)]
        made = self.tokenizer.encode_batch_fast([p.decode("utf-8") for p in alone], add_special_tokens=False)
        out.update((p, self.pack(e.ids)) for p, e in zip(alone, made))
        joint = [p for p in pieces if p not in out]
        for low in range(0, len(joint), JOINED):
            group = joint[low : low + JOINED]
            out.update(self.joined(self.tokenizer, group, self.part.join([p.decode("utf-8") for p in group]), self.part_id))
        return out

    def letters(self, cores: list[bytes]) -> dict[bytes, bytes]:
        """Packed ids of plain cores, by the model alone."""
        out = {}
        for low in range(0, len(cores), JOINED):
            group = cores[low : low + JOINED]
            # The byte alphabet turns the line breaks and spaces of the joined text into visible characters.
            text = codecs.charmap_decode(b"\n!\n".join(group), "strict", self.alphabet)[0]
            out.update(self.joined(self.plain, group, text.replace(self.alphabet[10], " "), self.mark))
        return out

    def joined(self, tokenizer: Tokenizer, group: list[bytes], text: str, part_id: int) -> Iterator[tuple[bytes, bytes]]:
        """Each text of the group with the ids between two ids of the part."""
        ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
        cuts, width = np.flatnonzero(ids == part_id), self.dtype.itemsize
        raw = (ids if part_id <= np.iinfo(self.dtype).max else np.where(ids == part_id, 0, ids)).astype(self.dtype).tobytes()
        return ((p, raw[a:b]) for p, a, b in zip(group, [0, *((cuts + 1) * width).tolist()], [*(cuts * width).tolist(), len(raw)]))

    def split(self, chunks: pa.Array) -> tuple[pa.Array, list[bytes]]:
        """Cores and tails of chunks: encoded apart, they give the ids of the chunk."""
        whole = pa.array(np.zeros(len(chunks), bool))
        for special in self.specials:
            # Lower case must not make an added token of another text.
            whole = pc.or_(whole, pc.match_substring(chunks, special.decode(), ignore_case=True))
        core = pc.ascii_rtrim(chunks, _TAIL)
        raw, end = np.frombuffer(b"\0\0" + data(core), np.uint8), offsets(core)[1:]
        last, size = raw[end + 1], np.diff(offsets(core))
        # After a letter or digit of ASCII, or a letter of Latin-1.
        ends = _ENDS[last] | (raw[end] == 0xC3) & (last > 127) & (last != 0x97) & (last != 0xB7)
        core = pc.if_else(pc.and_(pa.array(ends & (size > 0)), pc.invert(whole)), core, chunks)
        rest = np.diff(offsets(chunks)) - np.diff(offsets(core))
        tails = [b""] * len(chunks)
        at = np.flatnonzero(rest)
        for i, chunk, n in zip(at.tolist(), items(chunks.take(pa.array(at))), rest[at].tolist()):
            tails[i] = chunk[-n:]
        if self.folds:
            # Below U+0100 lower case is that of each character by itself, in any form.
            core = pc.if_else(pc.or_(whole, pc.match_substring_regex(core, r"[^\x00-\x{ff}]")), core, pc.utf8_lower(core))
        return core, tails

    def ids(self, chunks: pa.Array) -> pa.Array:
        """Packed ids of different chunks."""
        core, tail = self.split(chunks)
        core, tail = core.cast(pa.binary()).dictionary_encode(), pa.array(tail, pa.binary()).dictionary_encode()
        cores, tails = items(core.dictionary), items(tail.dictionary)
        missing = self.cores.missing({*cores, *tails})
        known = self.cores.young
        if missing:
            known.update(self.library(missing))
        get = known.__getitem__
        made = [pa.array(list(map(get, d)), pa.large_binary()).take(i) for d, i in ((cores, core.indices), (tails, tail.indices))]
        self.cores.forget(missing)
        return pc.binary_join_element_wise(*made, pa.scalar(b"", pa.large_binary()))

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """Ids of each text, little-endian; none for NULL."""
        if not isinstance(texts, pa.Array):
            texts = pa.array([t and t.encode("utf-8", "replace").decode() for t in texts], pa.string())
        texts = pc.fill_null(texts, "")
        lists = self.chunks(texts)
        flat = lists.flatten().dictionary_encode()
        made = self.ids(flat.dictionary).take(flat.indices)
        edge = offsets(made)[offsets(lists) - lists.offsets[0].as_py()].tolist()
        raw = data(made)
        out = [raw[a:b] for a, b in zip(edge, edge[1:])]
        if self.chunks == self.spaced:
            for i in np.flatnonzero(pc.match_substring_regex(texts, _WHOLE).to_numpy(zero_copy_only=False)).tolist():
                text = texts[i].as_py().encode()
                out[i] = self.library([text])[text]
        return out


def offsets(array: pa.Array) -> np.ndarray:
    """Edges of the items in an array's data, as it came from a computation or was cut out."""
    kind = np.int64 if pa.types.is_large_binary(array.type) else np.int32
    return np.frombuffer(array.buffers()[1], kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)


def data(array: pa.Array) -> bytes:
    return array.buffers()[2].to_pybytes() if array.buffers()[2] else b""


def items(array: pa.Array) -> list[bytes]:
    raw, edge = data(array), offsets(array).tolist()
    return [raw[a:b] for a, b in zip(edge, edge[1:])]


@lru_cache(maxsize=1)
def _encoder(path: str, cut: str, dtype: str) -> ChunkEncoder:
    return ChunkEncoder(path, cut, dtype)


def encoder(path: str, cut: str, dtype: str = "<u4") -> ChunkEncoder:
    """The worker's encoder, with what it remembers."""
    claim("tokens", _encoder.cache_clear)
    return _encoder(path, cut, dtype)
