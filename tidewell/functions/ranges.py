"""Positions and running sums in a global order without one task that holds it: rows are written in ranges of the order, and only a row a range is put in line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.written import written


def in_ranges(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """df written in ascending order (nulls first), with `_at` ascending in it and `_part`, its range."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return written(dealt, name, few=False).withColumn("_part", F.shiftright("_at", 33))


def running(df: DataFrame, order: str, sums: Sequence[str], name: str = "running") -> DataFrame:
    """df with <c>_below for each of sums, what all rows before a row add up to, and `prev`, the value of `order` right before it (null at the first). Values of `order` are distinct."""
    rows = in_ranges(df, [order], name)
    totals = rows.groupBy("_part").agg(*(F.sum(c).alias(f"_{c}") for c in sums), F.max(order).alias("_last"))
    line = Window.orderBy("_part")  # a row a range
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    ahead = totals.select("_part", *(F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}_ahead") for c in sums), F.lag("_last").over(line).alias("_prev"))
    own = Window.partitionBy("_part").orderBy("_at")
    inside = own.rowsBetween(Window.unboundedPreceding, -1)
    met = rows.join(ahead, "_part")
    out = met.withColumns({**{f"{c}_below": F.col(f"_{c}_ahead") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums}, "prev": F.coalesce(F.lag(order).over(own), F.col("_prev"))})
    return out.select(*df.columns, *(f"{c}_below" for c in sums), "prev")


def positions(df: DataFrame, group: str, order: str, name: str = "positions") -> DataFrame:
    """df with `position`, from 1, in ascending `order` within its (non-null) group; distinct values of order get distinct positions."""
    rows = in_ranges(df, [group, order], name)
    parts = rows.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = parts.select(F.col(group).alias("_group"), F.col("_part").alias("_p"), "_first", before.alias("_before"))
    met = rows.join(ahead, (F.col(group) == F.col("_group")) & (F.col("_part") == F.col("_p")))
    return met.select(*df.columns, (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("position"))
