"""Serial numbers over whole tables: ``row_number`` without a task per group.

Rows are range-partitioned by group and order, so a large group spreads over tasks; each row is numbered within its partition and stored with that number;
the rows of each (group, partition) are counted, and the counts of a group's earlier partitions are what its rows of a partition start from.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depotlens.functions.groups import attach_group
from depotlens.functions.stored import stored

#: Bits of ``monotonically_increasing_id`` that count rows; those above them are the partition.
_ROW_BITS = 33


def serial_numbers(df: DataFrame, by: list[str], order_by: list[str], name: str = "serial_no", partitions: int | None = None) -> DataFrame:
    """``df`` with ``name``: 1, 2, ... per group of ``by`` in the order of ``order_by`` (ties in any order, as ``row_number`` has them)."""
    by, order = list(by), [F.col(c) for c in (*by, *order_by)]
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    placed = stored(ranged.sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_id", _ROW_BITS))
    runs = placed.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition that holds the group
    starts = runs.select(*by, "_part", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    numbered = attach_group(placed, starts, [*by, "_part"])
    return numbered.withColumn(name, F.col("_before") + F.col("_id") - F.col("_first") + 1).drop("_id", "_part", "_first", "_before")
