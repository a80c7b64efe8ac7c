"""Spelling variants against a plain count and deletion neighbourhoods."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gridlark.llm import queries, spelling

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def counts(table):
    total = Counter()
    for doc, text in table:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{low}".encode())
            if h % 31 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            if len(low) >= 7:
                total[low] += 1
    return {w: n for w, n in total.items() if n >= 2}


def expected(table):
    n = counts(table)
    marks = defaultdict(set)
    for word in n:
        for i in range(len(word)):
            marks[word[:i] + "*" + word[i + 1 :]].add(word)  # replaced
            marks[word[:i] + word[i + 1 :]].add(word)  # deleted
        marks[word].add(word)
    close = defaultdict(set)
    for group in marks.values():
        for a in group:
            close[a] |= {b for b in group if b != a and b not in close[a] and one_edit(a, b)}
    form = {}
    for word in n:
        if close[word]:
            best = min(close[word], key=lambda w: (-n[w], w))
            if n[best] >= 10 * n[word]:
                form[word] = best
    out = {}
    for word in n:
        root = word
        while root in form:
            root = form[root]
        out[word] = (form.get(word), root, n[word], len(close[word]), n[form[word]] if word in form else None)
    return out


def check(found, table):
    rows = found.collect()
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows} == expected(table)
    assert len(rows) == len({r["word"] for r in rows})


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(2)
    stem = ["encyclop", "translat", "aaaaaaa", "étéétéé", "banana" * 3, "x" * 300]
    vocabulary = set(stem)
    for word in stem:
        for _ in range(25):
            i, kind = rng.randrange(len(word) + 1), rng.randrange(3)
            c = rng.choice("abxé")
            vocabulary.add(word[:i] + c + word[i + (kind == 0) :] if kind else word[:i] + word[i + 1 :])
    vocabulary = sorted(vocabulary)
    rows = [(None, None), (0, ""), (1, " \n"), (2, "short words do"), (None, " ".join(vocabulary)), (None, " ".join(vocabulary))]
    rows += [(i, "; ".join(rng.choices(vocabulary, k=40)).title() + " ×÷×÷×÷× naïveté中word") for i in range(3, 60)]
    rows += [(100, "encyclop " * 5000), (101, "encyclopa " * 400 + "encyclopab " * 30 + "encyclopabc " * 3)]
    return rows + rows[10:14]


def test_variants_of_odd_rows(spark, odd_rows):
    df = spark.createDataFrame(odd_rows, SCHEMA)
    for name in ("word", "n", "key", "other", "form", "root"):
        df = df.withColumn(name, F.lit("clash"))
    check(spelling.variants(df), odd_rows)


@pytest.mark.parametrize("block, tile", [(3, 16), (16, 1 << 20)])
def test_large_buckets_are_cut_into_blocks(spark, odd_rows, monkeypatch, block, tile):
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling, "TILE", tile)
    check(spelling.variants(spark.createDataFrame(odd_rows, SCHEMA)), odd_rows)


def test_near_pairs_equal_the_definition(spark):
    rng = random.Random(9)
    words = sorted({"".join(rng.choices("ab", k=rng.randint(7, 10))) for _ in range(500)})
    counted = spark.createDataFrame([(w, i + 2) for i, w in enumerate(words)], "word string, n long")
    found = [(r["word"], r["other"]) for r in spelling.near_words(counted).collect()]
    assert sorted(found) == sorted((a, b) for a in words for b in words if a != b and one_edit(a, b))


def test_empty_tables(spark):
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, "onceonly")], SCHEMA)).count() == 0


def test_query(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    check(queries.QUERIES["op12_spelling_variants"](spark, SMALL), table)
