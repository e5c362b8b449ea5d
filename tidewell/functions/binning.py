"""Adaptive bin edges, and bins as code-generated expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import LARGE_BYTES, by_ranges, leaf_bytes

#: Number of bins, largest cap of the integer path, and the tolerances of "integer-like".
N_BINS, INTEGER_CAP, ABS_TOL, REL_TOL = 20, 20, 1e-6, 1e-5
#: Interior edges that any list of edges can have: 0 to cap + 1, with an overflow edge.
MOST_INTERIOR = INTEGER_CAP + 1
#: Quantile edges are rounded to this many decimals, where engines differ in the last bits.
DECIMALS = 6


def integer_like(x: Column) -> Column:
    whole = F.rint(x)
    return F.abs(x - whole) <= ABS_TOL + REL_TOL * F.abs(whole)


def adaptive_edges(df: DataFrame, value: str, keys: Sequence[str] = (), n_bins: int = N_BINS, ranked: bool | None = None, weight: str | None = None) -> DataFrame:
    """keys with `edges` (ascending array) of the non-null values: a row a key, so small whatever the rows.

    Integer-like values of a small range get unit bins from 0 to a cap at the 99th percentile, and one for what is beyond; others get
    quantile bins. Fewer than two edges become [lowest, highest + 1]; no values [0, 1]. Quantiles are exact, by ranks where the input
    is large (or `ranked` says so). weight: a column that says how many values a row stands for.
    """
    x = F.col(value)
    marks = [*(i / n_bins for i in range(n_bins + 1)), 0.99]
    if ranked if ranked is not None else leaf_bytes(df) > LARGE_BYTES:
        stats = by_ranges(df, value, marks, keys, weight, integer_like(x))
    else:
        q = F.percentile(x, F.array(*map(F.lit, marks)), F.col(weight) if weight else 1)
        stats = df.groupBy(*keys).agg(q.alias("q"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.bool_and(integer_like(x)).alias("whole"))
    cap = F.greatest(F.lit(1), F.floor(F.element_at("q", n_bins + 2)).cast("int"))
    unit = F.transform(F.sequence(F.lit(0), cap + 1), lambda e: e.cast("double"))
    unit = F.concat(unit, F.when(F.col("hi") > cap + 1, F.array(F.col("hi").cast("double") + 1)).otherwise(F.array().cast("array<double>")))
    quantile = F.array_sort(F.array_distinct(F.transform(F.slice("q", 1, n_bins + 1), lambda e: F.round(e, DECIMALS))))
    chosen = F.when(F.col("whole") & (cap <= INTEGER_CAP), unit).otherwise(quantile)
    edges = F.when(F.col("lo").isNull(), F.array(F.lit(0.0), F.lit(1.0))).when(F.size(chosen) < 2, F.array(F.col("lo").cast("double"), F.col("hi").cast("double") + 1)).otherwise(chosen)
    return stats.select(*keys, edges.alias("edges"))


def bin_of(x: Column, edges: Column, drop_outside: bool) -> Column:
    """The bin of x: how many interior edges are at or below it. Outside the edges: null if drop_outside, else the end bin.

    A sum of comparisons rather than a lambda over the array, so that it stays in generated code.
    """
    last = F.size(edges) - 1
    steps = [F.coalesce(((F.lit(i) < last) & (x >= F.get(edges, F.lit(i)))).cast("int"), F.lit(0)) for i in range(1, MOST_INTERIOR + 1)]
    at = sum(steps[1:], steps[0])
    inside = (x >= F.get(edges, F.lit(0))) & (x <= F.get(edges, last)) if drop_outside else x.isNotNull()
    return F.when(inside, at)


def equal_width_edges(df: DataFrame, value: str, n_bins: int = N_BINS) -> DataFrame:
    """One row `edges`: n_bins equal bins between the smallest and largest value."""
    lo, hi = F.min(value), F.max(value)
    return df.agg(F.transform(F.sequence(F.lit(0), F.lit(n_bins)), lambda i: F.lit(0.0) + i).alias("k"), lo.alias("lo"), hi.alias("hi")).select(
        F.transform("k", lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / n_bins).alias("edges")
    )
