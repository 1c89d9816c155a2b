"""Row numbers inside groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftgate.session import durable


def number_rows(df: DataFrame, group: tuple[str, ...], order: tuple[str, ...], name: str) -> DataFrame:
    """Number the rows of each group from 1 in the given order, without gathering a group in one task.

    Rows are range-partitioned and sorted, so a large group spreads over several partitions. What a
    partition adds to its own positions is the size of the group in the partitions before it; that window
    sees one row per partition, not per row. The sorted rows are written first, because both steps must
    see the same partitions.
    """
    placed = durable(
        df.repartitionByRange(*group, *order)
        .sortWithinPartitions(*group, *order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id())
    )
    pieces = placed.groupBy(*group, "_part").agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_size")
    )
    earlier = (
        Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    shifts = pieces.select(
        *group,
        "_part",
        (F.coalesce(F.sum("_size").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
    )
    return placed.join(shifts, [*group, "_part"]).select(
        *df.columns, (F.col("_at") + F.col("_shift")).alias(name)
    )
