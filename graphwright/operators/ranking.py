"""Places in an order without one task for a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphwright.plans.checkpoints import cut


def ranked(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """rows with place, from 1, in the order of their group; order must be total.

    Rows are parted by ranges of group and order and sorted there; a group of any size spans many
    ranges. Each range's piece of a group then starts at the sum of the pieces before it, a window over
    as many rows as there are ranges.
    """
    keys = [F.col(g) for g in group]
    sorted_ = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order) if keys else rows.repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_ = cut(sorted_.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))
    pieces = sorted_.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = pieces.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_part").alias("_p"), (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return sorted_.join(shifts, same).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("place"))
