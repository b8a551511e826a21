"""Exact row numbers over big or skewed groups, without a single-task window.

A window over a hot group (or over the whole table) sorts that group in one task. Here the rows
are range-partitioned on group and order together, so a hot group spreads over many tasks; a row's
number is its place in its own slice plus the sizes of the earlier slices of its group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from pressroom.session import settle

# Slice offsets are broadcast up to this many rows, a few megabytes; they are counted first.
BROADCAST_OFFSETS = 100_000
_ROW_BITS = (1 << 33) - 1  # monotonically_increasing_id keeps the row number in its low 33 bits


def with_rank(
    df: DataFrame, order: Sequence[Column | str], name: str = "rank", within: Sequence[str] = ()
) -> DataFrame:
    """Add the 1-based row number over ``order`` inside each ``within`` group.

    ``order`` must end in a unique key. Pass few columns or a settled table: the range borders are
    sampled by reading the input once more. The ranged rows are settled once, because slice borders
    come from sampling and must not change between counting the slices and numbering the rows.
    """
    keys = [F.col(column) for column in within]
    keys += [F.col(item) if isinstance(item, str) else item for item in order]
    ranged = settle(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_slice", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(_ROW_BITS)),
        f"rank-{name}",
    )
    # One row per slice and group in it: a group has at most as many rows here as there are slices.
    # Joined by shuffle they would drag the wide rows along, so a small result is broadcast.
    slices = ranged.groupBy(*within, "_slice").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_first")
    )
    earlier = Window.partitionBy(*within).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = slices.select(
        *[F.col(column).alias(f"_g{i}") for i, column in enumerate(within)],
        F.col("_slice").alias("_s"),
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
    )
    if offsets.count() <= BROADCAST_OFFSETS:
        offsets = F.broadcast(offsets)
    same = [F.col(column).eqNullSafe(F.col(f"_g{i}")) for i, column in enumerate(within)]
    return (
        ranged.join(offsets, reduce(and_, same, F.col("_slice") == F.col("_s")))
        .withColumn(name, (F.col("_place") + F.col("_shift")).cast("bigint"))
        .select(*df.columns, name)
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row of each key. The row limit is applied before the shuffle, so one task never
    receives more than one row per key and map task."""
    return first_n_per_key(df, keys, order, 1)


def first_n_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int
) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") <= n).drop("_rn")
    )
