"""Positions in a global order without a global sort: ranges of the key, their sums, and running sums within each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_start(df: DataFrame, order: str, size: str, out: str, rows_per_range: int = 100_000, tie: str | None = None) -> DataFrame:
    """df with column `out`: the sum of `size` over all rows before it in ascending `order` (then `tie`).

    The key's values are cut into ranges at approximate quantiles, a bounded list; each range is summed (a row a range), and rows are
    added up within their range only. A value of `order` with very many rows keeps them in one range.
    """
    n = df.count()
    cuts = max(1, min(4096, n // rows_per_range))
    edges = sorted(set(df.approxQuantile(order, [i / cuts for i in range(1, cuts)], 0.25 / cuts))) if cuts > 1 else []
    at = F.lit(0)
    if edges:
        column = F.array(*(F.lit(float(e)) for e in edges))
        at = F.size(F.filter(column, lambda e: e <= F.col(order)))
    ranged = df.withColumn("_range", at)
    sums = ranged.groupBy("_range").agg(F.sum(size).alias("_sum"))
    before = sums.select("_range", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(*[c for c in (order, tie) if c]).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(F.broadcast(before), "_range")  # at most 4096 rows
    return placed.withColumn(out, F.col("_before") + F.coalesce(F.sum(size).over(inside), F.lit(0))).drop("_range", "_before")
