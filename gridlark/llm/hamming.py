"""Exact top-k search over binary codes by incremental multi-index hashing.

An embedding's code has one bit for the sign of each of its first 64
components. Codes are cut into four segments of 16 bits. If two codes differ
in at most 4 * (r + 1) - 1 bits, some segment differs in at most r. So radius
r is grown from 0: the segment values of the open queries are probed with all
masks of exactly r bits, the codes that hold such a value are candidates, and
these are verified by their full distance. A query is closed once its k-th
best row lies within the distance that radius r provably covers. This holds
for every size of the table; there is no other path.

The index is dealt in blocks of bounded size, each with one table for every
segment, and a fixed number of groups of queries meet each; candidates are verified where they
are found and never become rows. A pair counts in the first segment of the
smallest difference, so it comes once in all rounds; a block gives at most k
codes for a query and round, and a query keeps its k best between rounds.
Nothing is broadcast.

Equal codes are one entry with a count and its k smallest ids, so a vector
that a third of all rows share is one candidate and one query. Rounds are
stored tables below the shared folder. Ties are broken by the smaller id.

NULL embeddings are not indexed and find nothing; missing or NULL components
count as not positive. With fewer than k rows all are returned. Repeated ids
are rows of their own. An empty table gives an empty result. Only the id and
the vector are read, so other columns cannot clash; there are no texts.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark.llm.common import store

BITS, SEGMENTS = 64, 4
WIDTH = BITS // SEGMENTS
#: Codes of a block; groups of queries that meet each block; probes that a task makes at once.
BLOCK, GROUPS, PROBES = 200_000, 16, 1 << 19


def code_of(embedding: Column) -> Column:
    """64-bit code: bit j is set if component j is positive."""
    bits = [F.shiftleft(F.coalesce(F.get(embedding, F.lit(j)) > 0, F.lit(False)).cast("long"), j) for j in range(BITS)]
    code = bits[0]
    for bit in bits[1:]:
        code = code.bitwiseOR(bit)
    return code


def masks(radius: int) -> list[int]:
    """All segment values with exactly `radius` bits."""
    return [sum(1 << i for i in chosen) for chosen in combinations(range(WIDTH), radius)]


def smallest_ids(rows: DataFrame, k: int) -> DataFrame:
    """code, n, ids: the k smallest ids of each code, ascending; Spark cuts each task's share to k first."""
    first = rows.withColumn("at", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("at") <= k)
    counted = rows.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return first.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")).join(counted, "code")


def closest(query: np.ndarray, code: np.ndarray, least_id: np.ndarray, radius: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of query and code and their distance: for each query the k best codes whose closest segment differs in exactly `radius` bits."""
    flips = np.array(masks(radius), np.uint64)
    low = np.uint64((1 << WIDTH) - 1)
    tables = []
    for s in range(SEGMENTS):
        value = (code >> np.uint64(WIDTH * s) & low).astype(np.int64)
        tables.append((np.argsort(value, kind="stable"), np.append(0, np.cumsum(np.bincount(value, minlength=1 << WIDTH)))))
    best: list[tuple[np.ndarray, ...]] = []
    width = max(1, PROBES // len(flips))
    for begin in range(0, len(query), width):
        asked = query[begin : begin + width]
        found = []
        for s, (order, start) in enumerate(tables):
            tried = ((asked >> np.uint64(WIDTH * s) & low)[:, None] ^ flips).astype(np.int64)
            count = start[tried + 1] - start[tried]
            who = np.repeat(np.arange(len(asked)), count.sum(axis=1))
            count, first = count.ravel(), start[tried].ravel()
            at = order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)]
            apart = asked[who] ^ code[at]
            new = np.ones(len(at), bool)
            for t in range(SEGMENTS):
                bits = np.bitwise_count(apart >> np.uint64(WIDTH * t) & low)
                new &= bits > radius if t < s else bits >= radius
            found.append((who[new] + begin, at[new], np.bitwise_count(apart[new])))
        who, at, apart = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((least_id[at], apart, who))
        who, at, apart = who[order], at[order], apart[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        best.append((who[rank < k], at[rank < k], apart[rank < k]))
    return tuple(np.concatenate(x) for x in zip(*best))


def probe(open_: DataFrame, index: DataFrame, radius: int, k: int, codes: int) -> DataFrame:
    """query, code, distance, n, ids: the k best of each block for each open query, of pairs whose closest segment differs in exactly `radius` bits."""
    blocks = -(-codes // BLOCK)
    entries = index.select("*", F.pmod(F.xxhash64("code"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(GROUPS - 1))).alias("part"))
    asked = open_.select(F.col("code").alias("query"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
                         F.pmod(F.xxhash64("code"), F.lit(GROUPS)).cast("int").alias("part"))

    pairs = pa.schema([("query", pa.int64()), ("code", pa.int64()), ("distance", pa.int32()), ("n", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pairs.empty_table()
        code, query = (t.column(c).to_numpy().view(np.uint64) for t, c in ((left, "code"), (right, "query")))
        least = pc.list_element(left.column("ids"), 0).to_numpy()
        who, at, apart = closest(query, code, least, radius, k)
        rows = left.select(["code", "n", "ids"]).take(pa.array(at))
        return pa.table({"query": right.column("query").take(pa.array(who)), "code": rows["code"], "distance": pa.array(apart, pa.int32()), "n": rows["n"], "ids": rows["ids"]}).cast(pairs)

    grouped = entries.groupBy("block", "part").cogroup(asked.groupBy("block", "part"))
    return grouped.applyInArrow(meet, "query long, code long, distance int, n long, ids array<long>")


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, distance: for each query the k nearest rows, itself included."""

    def coded(df: DataFrame) -> DataFrame:
        narrow = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("e"))
        return narrow.where("e IS NOT NULL").select("id", code_of(F.col("e")).alias("code"))

    index = store(smallest_ids(coded(vectors), k), "codes")
    asked = store(coded(queries), "queries")
    size = index.agg(F.count(F.lit(1)).alias("codes"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    wanted = min(k, size["rows"])
    open_ = store(asked.select("code").distinct(), "open-queries")
    nearest = Window.partitionBy("query").orderBy("distance", F.get("ids", F.lit(0)))
    held = None
    done = []
    for radius in range(WIDTH + 1):
        if not wanted or open_.isEmpty():
            break
        found = probe(open_, index, radius, k, size["codes"])
        if held is not None:
            found = found.unionByName(held.join(open_.select(F.col("code").alias("query")).hint("merge"), "query", "left_semi"))
        held = store(found.withColumn("at", F.row_number().over(nearest)).where(F.col("at") <= k).drop("at"), f"near-{radius}")
        covered = held.where(F.col("distance") < SEGMENTS * (radius + 1)).groupBy("query").agg(F.sum("n").alias("rows"))
        closed = store(covered.where(F.col("rows") >= wanted).select("query"), f"closed-{radius}")
        done.append(held.join(closed.hint("merge"), "query", "left_semi"))
        open_ = store(open_.join(closed.hint("merge"), open_["code"] == closed["query"], "left_anti"), f"open-{radius}")
    if not done:
        return asked.limit(0).select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0).alias("distance"))
    all_near = done[0]
    for more in done[1:]:
        all_near = all_near.unionByName(more)
    order = Window.partitionBy("query").orderBy("distance", "id")
    best = (
        all_near.select("query", "distance", F.explode("ids").alias("id"))
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    )
    return (
        asked.select(F.col("id").alias("query_id"), F.col("code").alias("query")).join(best.hint("merge"), "query")
        .select("query_id", "rank", F.col("id").alias("vec_id"), "distance")
    )


ORACLE = f"""
WITH c AS (SELECT vec_id, list_sum([CASE WHEN embedding[j + 1] > 0 THEN 1::HUGEINT << j ELSE 0 END FOR j IN range({BITS})])::HUGEINT AS code FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT q.vec_id AS query_id, x.vec_id, bit_count(xor(q.code, x.code))::INT AS distance FROM c q, c x WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank, vec_id, distance FROM p
QUALIFY rank <= 10
"""
