"""Dense numbers for the rows of a table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lodestream.scratch import materialize


def numbered(rows: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """``rows`` with their place in an order, from 0 on; rows that are equal in it follow each other in any order.

    The rows are range-partitioned and written; a row's place is its place in its partition and the
    rows of the partitions before. No partition holds all rows, and only one row a partition is summed up.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(dealt.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    place = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__before")
    return placed.withColumn("__part", part).join(F.broadcast(starts), "__part").withColumn(name, place).drop("__at", "__part", "__before")  # a row a partition
