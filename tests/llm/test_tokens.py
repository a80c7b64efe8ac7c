"""Encoding by chunks against the library, text by text."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from gridlark.llm import tokens
from gridlark.llm.tokens import ChunkEncoder

FILES = [(public_tokenizers.path("word_bpe_49k.json"), "word"), (public_tokenizers.path("byte_bpe_50k.json"), "byte")]


def library(path, texts):
    tokenizer = Tokenizer.from_file(path)
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def ids(coded):
    return [np.frombuffer(x, "<u4").tolist() for x in coded]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    parts = ["the", "École", "ÀÞ", "naïve", "straße", "ÿ×÷", "don't", "x's", "'ll", "a1b2", "42", "É", "İstanbul", "T̈a", "ẗa", "Œuvre", "中文", "ΣΑΣ", "µª", "😀", "KK",
             "<|endoftext|>", "<|ENDOFTEXT|>", "a<|startoftext|>b.", "a b", "x\x1cy", "a\u0085b", " ", "q\tr", "", "$$$", "...", "'", "Ġ!", "!", "\x00", "\r", "été."]
    tails = ["", "", ",", ".", "$$$", "***", "'", "',", ".)", "!?", "'s.", "|>", "é,", " ", "-"]
    gaps = [" ", " ", " ", "\n", "  ", "\t"]
    made = ["".join(rng.choice(parts) + rng.choice(tails) + rng.choice(gaps[: rng.choice([3, 4, 6])]) for _ in range(rng.randint(1, 25))) for _ in range(800)]
    plain = [" ".join("".join(rng.choices("abcdeABéÉñß", k=rng.randint(1, 80))) + rng.choice(tails[:10]) for _ in range(60)) for _ in range(60)]
    return [None, "", " ", "\n", *made, *plain, None]


@pytest.mark.parametrize("path, cut", FILES)
def test_odd_chunks_encode_like_the_library(texts, path, cut, monkeypatch):
    monkeypatch.setattr(tokens, "CORES", 50)
    made, want = ChunkEncoder(path, cut), library(path, texts)
    for low in range(0, len(texts), 100):
        block = texts[low : low + 100]
        assert ids(made.encode(block)) == want[low : low + 100]
        # A slice of a larger column, as Spark's batches are cut.
        assert ids(made.encode(pa.array(["left out", *block, "too"], pa.string()).slice(1, len(block)))) == want[low : low + 100]
        assert all(len(k) < 64 for k in made.cores.young)


@pytest.mark.parametrize("path, cut", FILES)
def test_runs_of_letters_need_the_model_alone(path, cut):
    made, seen = ChunkEncoder(path, cut), []
    text = "Die Straße, été... naïve whetherorthonon$$$"
    whole = made.tokenizer

    class Full:
        @staticmethod
        def encode_batch_fast(texts, add_special_tokens):
            seen.extend(p for t in texts for p in t.split(made.part))
            return whole.encode_batch_fast(texts, add_special_tokens=add_special_tokens)

    made.tokenizer = Full
    assert ids(made.encode([text])) == library(path, [text])
    assert sorted(s for s in seen if s) == ["$$$", ",", "..."]
