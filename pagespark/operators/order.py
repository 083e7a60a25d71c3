"""Dense ids, running totals, shards and positional splits without one big sort.

A global ``row_number`` would put every row in one task. Here rows are range
partitioned, written once with their partition number and place in it, and the
partition counts (one row per partition) give each partition its offset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagespark.operators.joins import GROWING, met
from pagespark.session import written

PLACE_MASK = (1 << 33) - 1  # low bits of monotonically_increasing_id: place in partition


def range_placed(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows in range partitions with ``_part`` and ``_place``, written to durable files.
    ``order`` must be a total order, so that a re-run task writes the same places."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(
        placed.withColumn("_part", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit(PLACE_MASK))),
        "placed",
    )


def _before_parts(sums: DataFrame, value: str) -> DataFrame:
    """Exclusive running total over partition numbers: one row per partition."""
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("_part", F.coalesce(F.sum(value).over(earlier), F.lit(0)).alias("_before"))


def numbered(df: DataFrame, order: Sequence[str], column: str = "id", start: int = 0) -> DataFrame:
    """Dense ids in a total order."""
    placed = range_placed(df, order)
    offsets = _before_parts(placed.groupBy("_part").agg(F.count("*").alias("_n")), "_n")
    dense = (F.col("_before") + F.col("_place") + start).cast("bigint")
    return placed.join(F.broadcast(offsets), "_part").withColumn(column, dense).drop("_part", "_place", "_before")


def running_total(df: DataFrame, order: Sequence[str], value: str, column: str = "before") -> DataFrame:
    """Exclusive running sum of ``value`` in a total order."""
    placed = range_placed(df, order)
    offsets = _before_parts(placed.groupBy("_part").agg(F.sum(value).alias("_n")), "_n")
    inside = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    total = F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0))
    return (
        placed.join(F.broadcast(offsets), "_part").withColumn(column, total.cast("bigint"))
        .drop("_part", "_place", "_before")
    )


def global_ids(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], column: str = "id",
               start: int = 0, known: DataFrame | None = None) -> DataFrame:
    """Dense ids over bounded groups (pages): group counts are summed up in group
    order, and each row adds its place inside its own group. ``known`` has one row for a group, whose columns its
    rows get, too; rows of groups that are not known go, after they were numbered."""
    starts = running_total(df.groupBy(*group).agg(F.count("*").alias("_count")), group, "_count", "_first").drop("_count")
    if known is not None:
        starts = starts.join(known.hint(GROWING), list(group))
    inside = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    rows = met(df, starts, group)
    return rows.withColumn(column, (F.col("_first") + inside + start).cast("bigint")).drop("_first")


def numbered_in(df: DataFrame, group: Sequence[str], order: Sequence[str], column: str = "pos") -> DataFrame:
    """Dense ids that restart in each group; a group may be of any size, since its rows
    lie in consecutive range partitions and meet their group's first id by partition."""
    placed = range_placed(df, [*group, *order])
    parts = placed.groupBy(*group, "_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_least"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_least")
    offsets = parts.select(*group, "_part", before.alias("_before"))
    return (
        placed.join(offsets, [*group, "_part"])
        .withColumn(column, (F.col("_before") + F.col("_place")).cast("bigint")).drop("_part", "_place", "_before")
    )


def running_best(df: DataFrame, group: Sequence[str], order: Sequence[str], metric: str, mode: str = "min",
                 column: str = "best") -> DataFrame:
    """Inclusive running min or max per group of any size: best of the earlier range
    partitions of the group, then a window inside (group, partition)."""
    best = F.min if mode == "min" else F.max
    join = F.least if mode == "min" else F.greatest
    placed = range_placed(df, [*group, *order])
    parts = placed.groupBy(*group, "_part").agg(best(metric).alias("_best"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*group, "_part", best("_best").over(earlier).alias("_earlier"))
    inside = Window.partitionBy(*group, "_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    here = best(metric).over(inside)
    return (
        placed.join(parts, [*group, "_part"])
        .withColumn(column, join(here, F.coalesce("_earlier", here))).drop("_part", "_place", "_earlier")
    )


def row_total(df: DataFrame) -> Column:
    """Row count as a scalar subquery."""
    return df.agg(F.count("*").alias("n")).scalar()


def shard_number(position: Column, total: Column | None = None, parts: int | None = None,
                 size: int | None = None) -> Column:
    """``position div size``, or with ``parts`` the size is ``ceil(total / parts)``."""
    if (parts is None) == (size is None):
        raise ValueError("give either parts or size")
    if size is not None:
        per_shard = F.lit(size)
    elif total is None:
        raise ValueError("parts needs the total")
    else:
        per_shard = F.ceil(total / F.lit(float(parts)))
    return F.floor(position / per_shard).cast("bigint")


def positional_split(position: Column, total: Column, train: float = 0.85, until_val: float = 0.95) -> Column:
    """train / val / test by position, cut at whole rows."""
    return (
        F.when(position < F.floor(F.lit(train) * total), "train")
        .when(position < F.floor(F.lit(until_val) * total), "val")
        .otherwise("test")
    )


def keep_first(df: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """One row per key, the first in order; combines before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    first = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row"))
    return first.select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def reading_order(df: DataFrame, page: Sequence[str], order: Sequence[str | Column], column: str = "reading_order") -> DataFrame:
    """Place of each word on its page, from 0."""
    return df.withColumn(column, (F.row_number().over(Window.partitionBy(*page).orderBy(*order)) - 1).cast("bigint"))


def batch_padding(df: DataFrame, batch: Sequence[str], width: str, column: str = "pad") -> DataFrame:
    """How much each sample is padded to the widest of its batch."""
    widest = df.groupBy(*batch).agg(F.max(width).alias("_widest"))
    return df.join(widest.hint(GROWING), list(batch)).withColumn(column, F.col("_widest") - F.col(width)).drop("_widest")
