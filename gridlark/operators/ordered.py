"""Order-dependent work without gathering a group: numbering and running totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from gridlark.session import materialize

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def number_rows(df: DataFrame, order: Sequence[str], name: str = "row_number") -> DataFrame:
    """Global 1-based position in a total order, in parallel.

    Rows are range-partitioned by the full order, so even many equal leading
    keys spread out.  After a reliable checkpoint the partition layout is fixed;
    offsets then come from one count per partition.
    """
    placed = materialize(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_id", _ROW_BITS))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition of the shuffle: small whatever the size of the data.
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + inside + 1)
        .drop("_id", "_part", "_offset")
    )


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    values: dict[str, str],
    block: int = 4096,
) -> DataFrame:
    """Exact inclusive running sums per key, with no large window group.

    ``position`` is an integer order unique within a key.  Rows are summed
    inside blocks of positions, block sums inside blocks of blocks, and the
    three levels are added up.  A window group then holds at most ``block``
    positions, and the top level one row per ``block`` squared positions.
    ``values`` maps new column names to summed columns.
    """
    keys = list(keys)
    low = F.floor(F.col(position) / block).cast("long")
    placed = df.withColumns({"_b1": low, "_b2": F.floor(low / block).cast("long")})
    inner = Window.partitionBy(*keys, "_b1").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    first = placed.withColumns({f"_i_{n}": F.sum(v).over(inner) for n, v in values.items()})

    sums = placed.groupBy(*keys, "_b2", "_b1").agg(*[F.sum(v).alias(f"_s_{n}") for n, v in values.items()])
    earlier = Window.partitionBy(*keys, "_b2").orderBy("_b1").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sums.select(
        *keys, "_b2", "_b1", *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_m_{n}") for n in values]
    )
    tops = sums.groupBy(*keys, "_b2").agg(*[F.sum(f"_s_{n}").alias(f"_t_{n}") for n in values])
    above = Window.partitionBy(*keys).orderBy("_b2").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(
        *keys, "_b2", *[F.coalesce(F.sum(f"_t_{n}").over(above), F.lit(0)).alias(f"_u_{n}") for n in values]
    )
    offsets = blocks.join(tops, [*keys, "_b2"]).select(
        *keys, "_b1", *[(F.col(f"_m_{n}") + F.col(f"_u_{n}")).alias(f"_o_{n}") for n in values]
    )
    out = first.join(offsets, [*keys, "_b1"])
    out = out.withColumns({n: F.col(f"_i_{n}") + F.col(f"_o_{n}") for n in values})
    return out.drop("_b1", "_b2", *[f"_i_{n}" for n in values], *[f"_o_{n}" for n in values])


def number_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """1-based position inside each key, however many rows one key holds.

    Rows are numbered globally by (keys, order); subtracting the first number of
    the key leaves the position inside it.
    """
    keys = list(keys)
    numbered = number_rows(df, [*keys, *order], "_n")
    first = numbered.groupBy(*keys).agg(F.min("_n").alias("_first"))
    return numbered.join(first, keys).withColumn(name, F.col("_n") - F.col("_first") + 1).drop("_n", "_first")
