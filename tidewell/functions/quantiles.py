"""Exact quantiles of groups of any size.

Spark's `percentile` keeps every distinct value of a group in one task. Beyond LARGE_BYTES of input the same numbers come from ranks: rows are
counted by ranges of the value (map-side, so little is shuffled), a running sum over the ranges tells which of them hold the wanted ranks, and
only those are looked into, by parts while they are large, then by value. No values are sorted but the few of such ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.written import written

#: Input beyond which groups are ranked rather than kept in a task.
LARGE_BYTES = 1 << 26
#: Ranges from one power of two to the next, parts of a range that is looked into, and rows of a range that are counted by value.
OCTAVE, PARTS, MOST_ROWS = 1024, 4096, 1 << 20


def leaf_bytes(df: DataFrame) -> int:
    """Bytes of the relations that a plan reads, by Spark's statistics; those without any count nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return sum(s for s in sizes if s < 1 << 60)


def quantiles(df: DataFrame, value: str, probabilities: Sequence[float], keys: Sequence[str] = (), ranked: bool | None = None, weight: str | None = None) -> DataFrame:
    """keys, q (array, linearly interpolated) of the non-null values; groups without any have none when ranked, null entries otherwise. weight: a column that says how many values a row stands for."""
    if ranked if ranked is not None else leaf_bytes(df) > LARGE_BYTES:
        return by_ranges(df, value, probabilities, keys, weight).where("q is not null").select(*keys, "q")
    return df.groupBy(*keys).agg(F.percentile(value, F.array(*(F.lit(p) for p in probabilities)), F.col(weight) if weight else 1).alias("q"))


def _range(x: Column) -> Column:
    """A whole number that never falls as x (a double) rises, OCTAVE of them from one power of two to the next; null for null.

    Exact where the logarithm is not: an exponent that is one too high or too low at a power of two gives the same number.
    """
    size = F.abs(x)
    power = F.least(F.floor(F.log2(size)), F.lit(1023))
    at = (power + 1100) * OCTAVE + F.floor(size / F.pow(F.lit(2.0), power) * OCTAVE)
    end = F.lit(1 << 40)
    return F.when(F.isnan(x), end + 1).when(size == float("inf"), F.when(x < 0, -end).otherwise(end)).when(size == 0, F.lit(0)).otherwise(F.when(x < 0, -at).otherwise(at))


def by_ranges(df: DataFrame, value: str, probabilities: Sequence[float], keys: Sequence[str] = (), weight: str | None = None, holds: Column | None = None) -> DataFrame:
    """keys, lo, hi, whole (whether `holds` holds for all non-null values), q: a row a key, null where a key has no values; without keys always one row.

    The first pass counts rows by range and keeps the ends of each; the next ones look only into ranges that hold a wanted rank and more than one value.
    """
    key = F.struct(*(F.col(k) for k in keys)) if keys else F.lit(1)
    # Adding zero makes -0.0 and 0.0 one value.
    rows = df.select(*keys, (F.col(value).cast("double") + F.lit(0.0)).alias("_x"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("_w"), (F.lit(True) if holds is None else holds).alias("_h"))
    rows = rows.withColumn("_range", _range(F.col("_x")))
    sums = [F.sum("_w").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")]
    found = written(rows.groupBy(*keys, "_range").agg(*sums, F.bool_and(F.when(F.col("_x").isNotNull(), F.col("_h"))).alias("_h")).select(key.alias("_k"), "_range", "_n", "_lo", "_hi", "_h"), "ranges", few=False)
    groups = found.groupBy(*(["_k"] if keys else [])).agg(F.sum(F.when(F.col("_range").isNotNull(), F.col("_n"))).alias("_all"), F.min("_lo").alias("lo"), F.max("_hi").alias("hi"), F.bool_and("_h").alias("whole"))
    groups = groups if keys else groups.withColumn("_k", F.lit(1))
    wanted = F.array(*(F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("_all") - 1)).alias("r")) for i, p in enumerate(probabilities)))

    def placed(ranges: DataFrame, within: Sequence[str], order: str) -> DataFrame:
        """The ranges that hold a wanted rank, a bounded number a key, with the ranks: `_base` values of the key are below those of `within`."""
        start = F.col("_base") + F.coalesce(F.sum("_n").over(Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        low, high = (lambda t, end=end: end(t["r"]).between(F.col("_start"), F.col("_start") + F.col("_n") - 1) for end in (F.floor, F.ceil))
        ranks = F.transform(F.filter(wanted, lambda t: low(t) | high(t)), lambda t: F.struct(t["i"].alias("i"), t["r"].alias("r"), low(t).alias("lo"), high(t).alias("hi")))
        out = ranges.withColumn("_start", start).withColumn("_t", ranks).where(F.size("_t") > 0)
        return written(out.select("_k", "_range", "_all", "_n", "_lo", "_hi", "_start", "_t"), "ranks", few=False)

    held = placed(found.where("_range is not null").join(F.broadcast(groups.select("_k", "_all")), "_k").withColumn("_base", F.lit(0)), ["_k"], "_range")  # a row a key
    settled = held.where("_lo >= _hi")
    while most := held.where("_lo < _hi").agg(F.max("_n")).first()[0]:
        inside = held.where("_lo < _hi").select("_k", "_range", "_all", F.col("_lo").alias("_from"), F.col("_hi").alias("_to"), F.col("_start").alias("_base"))
        met = rows.select(key.alias("_k"), "_range", "_x", "_w").join(F.broadcast(inside), ["_k", "_range"]).where("_x between _from and _to")  # a few rows a key
        part = F.col("_x") if most <= MOST_ROWS else F.floor((F.col("_x") - F.col("_from")) / (F.col("_to") - F.col("_from")) * PARTS)
        held = placed(met.groupBy("_k", "_range", "_all", "_from", "_base", part.alias("_part")).agg(*sums), ["_k", "_range", "_from"], "_part")
        settled = settled.unionByName(held.where("_lo >= _hi"))
    hits = settled.select("_k", F.col("_lo").alias("_x"), F.explode("_t").alias("t"))
    ends = hits.groupBy("_k", "t.i").agg(F.max("t.r").alias("r"), F.max(F.when(F.col("t.lo"), F.col("_x"))).alias("lo"), F.max(F.when(F.col("t.hi"), F.col("_x"))).alias("hi"))
    at = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("r") - F.floor("r")))
    q = ends.groupBy("_k").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", at.alias("v")))), lambda s: s["v"]).alias("q"))
    return groups.join(F.broadcast(q), "_k", "left").select(*(F.col(f"_k.{k}").alias(k) for k in keys), "lo", "hi", "whole", "q")  # a row a key
