"""Exact medians, also of groups too large for one task."""

from __future__ import annotations

import bisect
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

_ACCURACY = 10_000
_LOW, _HIGH = 0.4995, 0.5005


def median_by_rank(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Median per group from the middle ranks; each group must stay small.

    Sorting beats a per-group value map when groups are many and small, and rows
    that are already clustered by a part of the keys are not shuffled again.
    """
    group = Window.partitionBy(*keys)
    ranked = df.select(
        *keys, value, F.row_number().over(group.orderBy(value)).alias("_r"), F.count(value).over(group).alias("_n")
    )
    middle = (F.col("_r") == F.floor((F.col("_n") + 1) / 2)) | (F.col("_r") == F.ceil((F.col("_n") + 1) / 2))
    return ranked.filter(middle).groupBy(*keys).agg(F.avg(value).alias(name))


#: Sub-ranges of a pass, and distinct values that are few enough to look at.
_SPLITS, _FEW = 500, 2_000


def nth_values(df: DataFrame, value: str, ranks: Sequence[int]) -> list[float]:
    """The values of the given ranks (from 1, ascending) of a column without NULLs, by refining ranges.

    A pass cuts the range that holds the ranks at sketched quantiles and counts
    the sub-ranges exactly; the next pass looks only into those that hold a
    rank. Each pass leaves about one in _SPLITS of the distinct values, so a few
    passes do for any number of rows, and no group, window or task holds more
    than its own partial counts. At most _FEW numbers come back from a pass.
    """
    known = df.select(F.col(value).cast("double").alias("v"))

    def find(low: float | None, high: float | None, skipped: int, wanted: list[int]) -> dict[int, float]:
        """Values of the wanted ranks, all of which lie in (low, high]; `skipped` rows lie at or below low."""
        inside = known if low is None else known.filter((F.col("v") > low) & (F.col("v") <= high))
        few = inside.groupBy("v").agg(F.count(F.lit(1)).alias("n")).limit(_FEW + 1).collect()
        if len(few) <= _FEW:
            out, seen = {}, skipped
            for v, n in sorted((r["v"], r["n"]) for r in few):
                out.update((rank, v) for rank in wanted if seen < rank <= seen + n)
                seen += n
            return out
        shares = [i / _SPLITS for i in range(_SPLITS + 1)]
        edges = sorted(set(inside.agg(F.percentile_approx("v", shares, 10 * _SPLITS)).first()[0]))
        # The sub-range of a value is the first edge not below it; the last edge is the greatest value.
        array = F.array(*map(F.lit, edges))
        place = F.size(F.filter(array, lambda e: e < F.col("v")))
        counts = {r["place"]: r["n"] for r in inside.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n")).collect()}
        ends, seen = [], skipped
        for i in range(len(edges) + 1):
            seen += counts.get(i, 0)
            ends.append(seen)
        out: dict[int, float] = {}
        groups: dict[int, list[int]] = {}
        for rank in wanted:
            groups.setdefault(bisect.bisect_left(ends, rank), []).append(rank)
        for i, inner in groups.items():
            below = edges[i - 1] if i else (low if low is not None else float("-inf"))
            above = edges[i] if i < len(edges) else (high if high is not None else float("inf"))
            out |= find(below, above, ends[i - 1] if i else skipped, inner)
        return out

    found = find(None, None, 0, sorted(set(ranks)))
    return [found[r] for r in ranks]


def whole_median(df: DataFrame, value: str) -> float | None:
    """Exact median of a whole column, NULLs aside; None if there is nothing."""
    known = df.select(value).filter(F.col(value).isNotNull())
    n = known.count()
    if not n:
        return None
    low, high = nth_values(known, value, [(n + 1) // 2, n // 2 + 1])
    return (low + high) / 2


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Exact median per group without holding any group in one place; of the whole column by :func:`whole_median`.

    A mergeable sketch with a proven rank error brackets the median; then only
    the counts below the bracket and the few distinct values inside it matter.
    """
    if not keys:
        return df.sparkSession.createDataFrame([(whole_median(df, value),)], f"`{name}` double")
    known = df.select(*keys, value).filter(F.col(value).isNotNull())
    bracket = known.groupBy(*keys).agg(
        F.percentile_approx(value, [_LOW, _HIGH], _ACCURACY).alias("_b"),
        F.count(F.lit(1)).alias("_n"),
    )
    low, high = F.col("_b")[0], F.col("_b")[1]
    placed = known.join(bracket, list(keys))
    below = F.sum(F.when(F.col(value) < low, 1).otherwise(0)).alias("_below")
    under = placed.groupBy(*keys, "_n").agg(below)
    inside = (
        placed.filter(F.col(value).between(low, high))
        .groupBy(*keys, "_n", value)
        .agg(F.count(F.lit(1)).alias("_c"))
        .join(under, [*keys, "_n"])
    )
    order = Window.partitionBy(*keys, "_n").orderBy(value)
    last = F.col("_below") + F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ranked = inside.withColumn("_last", last).withColumn("_first", F.col("_last") - F.col("_c") + 1)
    left_rank = F.floor((F.col("_n") + 1) / 2)
    right_rank = F.ceil((F.col("_n") + 1) / 2)
    holds = lambda rank: (F.col("_first") <= rank) & (rank <= F.col("_last"))
    return ranked.groupBy(*keys, "_n").agg(
        (
            (F.max(F.when(holds(left_rank), F.col(value))) + F.max(F.when(holds(right_rank), F.col(value)))) / 2
        ).alias(name)
    ).drop("_n")
