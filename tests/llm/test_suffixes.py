"""Suffix-array dedup against sorted suffixes and against a dictionary of windows."""

from __future__ import annotations

import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlark.llm import columns, queries, suffixes

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"
WINDOW = suffixes.WINDOW


def sorted_suffixes(sequences):
    """Transform, common prefixes and labels of all suffixes, the empty ones first."""
    order = sorted((s[i:], n, len(s) - i) for n, s in enumerate(sequences) for i in range(len(s) + 1))
    before = [sequences[n][len(sequences[n]) - k - 1] if k < len(sequences[n]) else columns.OPEN for _, n, k in order]
    prefix = [0]
    for (a, *_), (b, *_) in zip(order, order[1:]):
        k = 0
        while k < min(len(a), len(b)) and a[k] == b[k]:
            k += 1
        prefix.append(k)
    return before, prefix, [n << columns.LENGTH_BITS | k for _, n, k in order]


@pytest.mark.parametrize("sizes", [{}, {"segment": 3}, {"segment": 2, "memory": 0}])
def test_columns_equal_sorted_suffixes(tmp_path, sizes):
    rng = random.Random(1)
    for alphabet in (b"a", b"ab", b"abc\x00\xc3\xf4"):
        for _ in range(8):
            sequences = [bytes(rng.choices(alphabet, k=rng.randint(0, 14))) for _ in range(rng.randint(1, 12))]
            built = columns.build(sequences, folder=str(tmp_path / "columns"), **sizes)
            assert tuple(np.concatenate(c).tolist() for c in list(zip(*built))[:3]) == sorted_suffixes(sequences)
            built.drop()
    assert not any((tmp_path / "columns").glob("*")) if (tmp_path / "columns").exists() else "memory" not in sizes


def test_passages_share_anchors_wherever_windows_are_equal():
    rng = random.Random(2)
    common = bytes(rng.choices(b"abcdef ", k=700))
    seen = {}
    for edge in (b"", b"x" * 60, b"yz" * 400):
        raw = edge + common + edge[::-1]
        anchor, start, n = suffixes.passages(raw)
        assert n.sum() == len(raw) - WINDOW + 1 and (start[1:] == (start + n)[:-1]).all() and (n <= WINDOW - suffixes.ANCHOR + 1).all()
        for a, s, k in zip(anchor, start, n):
            for at in range(s, s + k):
                assert seen.setdefault(raw[at : at + WINDOW], a) == a


def plain(rows):
    """Removed spans of each row: windows in corpus order, the first place of each stays."""
    ordered = sorted({(d is None, d or 0, t or "") for d, t in rows}, key=lambda r: (r[0], r[1]))
    first, spans = {}, {}
    for number, (none, doc, text) in enumerate(ordered):
        raw, gone = text.encode(), np.zeros(len(text.encode()), bool)
        for at in range(len(raw) - WINDOW + 1):
            if first.setdefault(raw[at : at + WINDOW], (number, at)) != (number, at):
                gone[at : at + WINDOW] = True
        kept = bytes(b for b, g in zip(raw, gone.tolist()) if not g)
        runs = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        spans[none, doc, text] = (len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return [(d, *spans[d is None, d or 0, t or ""]) for d, t in rows]


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(3)

    def prose(n):
        return "".join(rng.choices("abcdeé 中\n", k=n))

    a, b = prose(400), prose(130)
    rows = [(None, None), (0, ""), (1, "short"), (2, a), (3, a), (4, prose(50) + a[37:250] + prose(9)), (5, b + b + b), (6, "z" * 900), (7, prose(80) + "z" * 300)]
    rows += [(8, prose(20_000) + a[:110]), (9, a[:99]), (10, a[5:105] + "\U0001f600" + a[200:301]), (11, "中" * 40), (12, "x" + "中" * 40), (13, "\x00" * 150), (14, "\x00" * 120)]
    rows += [(i, prose(rng.randint(0, 300)) + rng.choice([b, a[100:260], a[-140:]]) + prose(rng.randint(0, 60))) for i in range(20, 70)]
    return rows + [rows[3], rows[6], rows[20]]


def check(found, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(want, key=key)


def clashing(df):
    for name in ("doc", "sub", "rest", "anchor", "spans", "open", "result", "n_bytes"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def test_digests_of_odd_rows(spark, odd_rows):
    rows = odd_rows + [(None, odd_rows[3][1])]
    check(suffixes.digests(clashing(spark.createDataFrame(rows, SCHEMA))), plain(rows))


@pytest.mark.parametrize("settings", [{"HOT": 1}, {"BLOCK_BYTES": 1000, "HOT": 3}, {"COLLECTION": 1}])
def test_hot_anchors_blocks_and_collections_do_not_change_results(spark, odd_rows, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(suffixes, name, value)
    check(suffixes.digests(spark.createDataFrame(odd_rows, SCHEMA)), plain(odd_rows))


def test_one_id_with_two_texts_is_two_documents(spark):
    rng = random.Random(4)
    shared = "".join(rng.choices("abcdef", k=150))
    rows = [(2, "left " + shared), (2, shared + "".join(rng.choices("ghijkl", k=240))), (3, shared)]
    found = {r["n_bytes"]: r["n_removed"] for r in suffixes.digests(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[150] == 150 and sorted([found[155], found[390]]) == [0, 150]


def test_late_windows_through_files(tmp_path):
    rng = random.Random(5)
    text = bytes(rng.choices(b"abcdef", k=600))
    starts = sorted(rng.sample(range(430), 25))
    sequences = [text[s : s + rng.randint(100, 170)] for s in starts]
    same = np.zeros(len(sequences), np.int64)
    places = (same + 5, np.arange(len(sequences)), same, same + 7)
    plainly = suffixes.late_windows(*places, sequences)
    filed = suffixes.late_windows(*places, sequences, str(tmp_path), memory=0, segment=500)
    assert sorted(zip(*(x.tolist() for x in plainly))) == sorted(zip(*(x.tolist() for x in filed)))
    first, want = {}, []
    for n, s in enumerate(sequences):
        want += [(n, i) for i in range(len(s) - WINDOW + 1) if first.setdefault(s[i : i + WINDOW], (n, i)) != (n, i)]
    assert sorted(zip(*(x.tolist() for x in plainly))) == want


def test_deduplicate_keeps_columns_and_whole_characters(spark, odd_rows):
    df = clashing(spark.createDataFrame(odd_rows, SCHEMA))
    done = suffixes.deduplicate(df)
    assert done.columns == df.columns and done.count() == len(odd_rows)
    texts = {r["doc_id"]: r["text"] for r in done.collect() if r["doc_id"] is not None}
    assert texts[3] == "" and texts[2] == odd_rows[3][1] and texts[12].count("中") < 40
    assert done.where("doc_id IS NULL").first()["text"] is None


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert suffixes.digests(none).count() == 0 and suffixes.deduplicate(none).count() == 0


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
    cursor = con.execute(queries.ORACLES["op13_suffix_dedup"])
    names = [d[0] for d in cursor.description]
    found = queries.QUERIES["op13_suffix_dedup"](spark, SMALL).select(*names).collect()
    assert sorted(tuple(r) for r in found) == sorted(cursor.fetchall())
