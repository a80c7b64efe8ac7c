"""What keeps passages out of the collections, and shuffle files from staying."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlark.llm import suffixes
from gridlark.llm.common import store_clean

WINDOW = suffixes.WINDOW


@pytest.fixture(scope="module")
def groups():
    """Different passages by anchor, of texts that share strings of all lengths, also periodic ones."""
    rng = random.Random(11)
    prose = lambda n: bytes(rng.choices(b"abcdefgh ", k=n))
    common = prose(3000)
    texts = [common, b"ab" * 300, b"x" * 40 + b"ab" * 120 + prose(70), b"z" * 400, prose(50) + b"z" * 250]
    for _ in range(400):
        low, n = rng.randrange(2800), rng.randint(24, 180)
        texts.append(prose(rng.randint(0, 120)) + common[low : low + n] + prose(rng.randint(0, 120)))
    found = {}
    for raw in texts:
        for a, s, n in zip(*suffixes.passages(raw)):
            found.setdefault(int(a), {})[raw[s : s + n + WINDOW - 1]] = None
    return {a: list(p) for a, p in found.items() if len(p) > 1}


@pytest.mark.parametrize("look", [1, 10, 19, 38, 76])
def test_passages_that_share_a_window_are_alike(groups, monkeypatch, look):
    monkeypatch.setattr(suffixes, "LOOK", look)
    passages = [p for some in groups.values() for p in some]
    keys = np.array([a for a, some in groups.items() for _ in some], np.int64)
    alike = suffixes.alike(passages, keys)
    windows, share = {}, np.zeros(len(passages), bool)
    for i, p in enumerate(passages):
        for at in range(len(p) - WINDOW + 1):
            windows.setdefault(p[at : at + WINDOW], set()).add(i)
    for holders in windows.values():
        share[list(holders)] |= len(holders) > 1
    assert share.any() and not (share & ~alike).any()
    assert look > 38 or (~alike).sum() > 50  # anchors alone are alike by chance
    if look == 1:
        assert (alike == share).all()


def test_windows_of_hot_anchors_stay():
    windows = [bytes([97 + i]) * WINDOW for i in range(3)]
    assert suffixes.alike(windows, np.array([5, 5, 5])).all()


def test_collections_hold_alike_passages_only(groups, monkeypatch):
    seen, build = [], suffixes.columns.build
    monkeypatch.setattr(suffixes.columns, "build", lambda sequences, **rest: seen.extend(sequences) or build(sequences, **rest))
    passages = [p for some in groups.values() for p in some]
    key = np.array([a for a, some in groups.items() for _ in some], np.int64)
    doc = np.arange(len(passages))
    copies, step = suffixes.late_windows(key, doc, 0 * doc, 0 * doc, passages)
    first, want = {}, []
    for i, p in enumerate(passages):
        want += [(i, at) for at in range(len(p) - WINDOW + 1) if first.setdefault(p[at : at + WINDOW], (i, at)) != (i, at)]
    assert sorted(zip(copies.tolist(), step.tolist())) == want
    assert 0 < len(seen) < len(passages) - 50


def test_shuffle_files_go_when_a_table_is_stored(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {f.getName() for f in (manager.getAllFiles().apply(i) for i in range(manager.getAllFiles().size())) if f.getName().startswith("shuffle")}
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffles(), spark.conf.get(key, None)
    stored = store_clean(spark.range(5000).withColumn("k", F.col("id") % 7).repartition(4, "k").groupBy("k").count(), "clean")
    assert stored.count() == 7 and spark.conf.get(key, None) == setting
    spark.range(10).repartition(3).collect()
    assert len({f.split("_")[1] for f in shuffles() - before}) <= 2  # of the two queries after the store
