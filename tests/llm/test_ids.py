"""Ids that come with several texts."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from gridlark.llm import neardup, substring
from gridlark.llm.common import tell_apart


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(3, 9))) for _ in range(n))


def test_substrings_of_one_id_with_two_texts(spark):
    rng = random.Random(1)
    shared, long, short = prose(rng, 40), prose(rng, 300), prose(rng, 3)
    rows = [(1, shared), (2, long + " " + shared), (2, short), (2, shared + " " + long), (3, long), (3, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {}
    for r in substring.digests(df).collect():
        found.setdefault((r["doc_id"], r["n_words"]), []).append(r["n_removed"])
    assert found[1, 40] == [0] and found[2, 3] == [0] and found[3, 300] == [300, 300]
    # Of the two long texts of id 2 the later one, by its hash, loses the shared words and the long ones too.
    assert sorted(found[2, 340]) == [40, 340]
    kept = [r["text"] for r in substring.deduplicate(df).collect()]
    assert sorted(len(t.split()) for t in kept) == [3, 40, 300]


def test_near_duplicates_keep_texts_of_one_id(spark):
    rng = random.Random(2)
    one, two = prose(rng, 80), prose(rng, 80)
    rows = [(5, one), (5, two), (6, one + " end"), (7, two), (5, one)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("doc", F.lit("clash"))
    kept = neardup.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted([(5, one), (5, two)])


def test_keys_change_only_where_ids_repeat(spark):
    df = spark.createDataFrame([(1, "a", 0), (2, "b", 1), (2, "b", 2)], "doc long, text string, n int")
    assert tell_apart(df) is df
    more = tell_apart(df.union(spark.createDataFrame([(2, "c", 3), (9, "z", 4)], df.schema)))
    keys = {r["n"]: r["doc"] for r in more.collect()}
    assert keys[0] < min(keys[1], keys[3]) and keys[1] == keys[2] != keys[3] and keys[4] > max(keys[1], keys[3])
