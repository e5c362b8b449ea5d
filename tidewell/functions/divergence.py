"""Divergences of two histograms given as long rows of counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _term(p: Column, q: Column) -> Column:
    """p * log2(2 p / (p + q)), 0 at p = 0."""
    return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(F.lit(0.0))


def jsd_terms(p: Column, q: Column) -> Column:
    """What one bin adds to the Jensen-Shannon divergence, base 2."""
    return 0.5 * (_term(p, q) + _term(q, p))


def divergences(histogram: DataFrame, keys: Sequence[str], ref: str = "n_ref", cur: str = "n_cur") -> DataFrame:
    """keys with js (Jensen-Shannon divergence, 0 to 1), l_inf (largest difference of shares), ref_n, cur_n.

    histogram: a row for each key and bin with counts. An empty side makes both 0. One shuffle by the keys serves the totals and the sums.
    """
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    rows = histogram.withColumn("_r", F.sum(ref).over(whole)).withColumn("_c", F.sum(cur).over(whole))
    p, q = F.try_divide(F.col(ref), F.col("_r")), F.try_divide(F.col(cur), F.col("_c"))
    return rows.groupBy(*keys).agg(
        F.coalesce(F.sum(jsd_terms(p, q)), F.lit(0.0)).alias("js"),
        F.coalesce(F.max(F.abs(p - q)), F.lit(0.0)).alias("l_inf"),
        F.coalesce(F.max("_r"), F.lit(0)).cast("long").alias("ref_n"),
        F.coalesce(F.max("_c"), F.lit(0)).cast("long").alias("cur_n"),
    )
