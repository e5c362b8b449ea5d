"""Evaluation: rates with intervals, paired tests, classification scores, threshold fits, grids."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import DIGITS, PIECES, hash_of, poisson_of
from ..functions.ranges import running
from ..functions.stats import mcnemar, mean_interval, wilson


#: Combinations of a grid search that one aggregation counts.
AT_ONCE = 64


def rate_table(df: DataFrame, by: str, hit: str, pooled: str = "ALL") -> DataFrame:
    """by, k, n, rate, lo, hi: a row a group and one for all, in one aggregation."""
    g = df.rollup(by).agg(F.count_if(hit).alias("k"), F.count("*").alias("n"))
    lo, hi = wilson(F.col("k"), F.col("n"))
    return g.select(F.coalesce(by, F.lit(pooled)).alias(by), "k", "n", (F.col("k") / F.col("n")).alias("rate"), lo.alias("lo"), hi.alias("hi"))


def mean_table(df: DataFrame, by: str, x: str) -> DataFrame:
    mean, lo, hi = mean_interval(F.col(x))
    return df.groupBy(by).agg(F.count(x).alias("n"), mean.alias("mean"), lo.alias("lo"), hi.alias("hi"))


def paired_test(df: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """by, b, c (pairs that only one of the two gets right), p by the exact McNemar test."""
    g = df.groupBy(by).agg(F.count_if(F.col(a) & ~F.col(b)).alias("b"), F.count_if(F.col(b) & ~F.col(a)).alias("c"))
    return g.withColumn("p", mcnemar(F.col("b"), F.col("c")))


def confusion(df: DataFrame, by: Sequence[str], predicted: Column, actual: Column) -> DataFrame:
    """by, tp, fp, fn, tn and what follows: recall, specificity, precision, balanced accuracy."""
    g = df.groupBy(*by).agg(F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & actual).alias("fn"), F.count_if(~predicted & ~actual).alias("tn"))
    recall, spec = F.try_divide("tp", F.col("tp") + F.col("fn")), F.try_divide("tn", F.col("tn") + F.col("fp"))
    return g.withColumns({"recall": recall, "specificity": spec, "precision": F.try_divide("tp", F.col("tp") + F.col("fp")), "balanced": (recall + spec) / 2})


def threshold_fit(df: DataFrame, x: str, label: str) -> DataFrame:
    """One row: the threshold of largest balanced accuracy for "x >= t". Candidates lie midway between neighbouring values and beyond the ends; of equally good ones the median.

    Distinct values in order and running counts replace trying each candidate on all rows; the order is spread over ranges, and nowhere in one task.
    """
    v = df.groupBy(x).agg(F.count_if(label).alias("pos"), F.count_if(~F.col(label)).alias("neg"))
    c = running(v.where(F.col(x).isNotNull()), x, ("pos", "neg"), "thresholds")
    n = c.agg(F.sum("pos").alias("P"), F.sum("neg").alias("Q"))
    at = c.select(F.coalesce((F.col("prev") + F.col(x)) / 2, F.col(x) - 1).alias("t"), "pos_below", "neg_below")
    end = c.agg((F.max(x) + 1).alias("t")).crossJoin(n).select("t", F.col("P").alias("pos_below"), F.col("Q").alias("neg_below"))
    scored = at.unionByName(end).crossJoin(F.broadcast(n)).withColumn("balanced", (F.try_divide(F.col("P") - F.col("pos_below"), F.col("P")) + F.try_divide("neg_below", F.col("Q"))) / 2)
    best = scored.agg(F.max("balanced").alias("best"))
    return scored.crossJoin(F.broadcast(best)).where(F.abs(F.col("balanced") - F.col("best")) < 1e-12).agg(F.median("t").alias("threshold"), F.max("balanced").alias("balanced"))


def grid_search(df: DataFrame, thresholds: dict[str, Sequence[float]], predict, label: str) -> DataFrame:
    """A row a combination with its balanced accuracy and how many predictions differ from the first combination's; best first, then fewest changes.

    Counts of AT_ONCE combinations are one aggregation: a scan each, and no row is copied.
    """
    names = list(thresholds)
    combos = list(product(*thresholds.values()))
    of = lambda combo: predict(dict(zip(names, map(F.lit, combo), strict=True)))
    first, y, parts = of(combos[0]), F.col(label), []
    for i in range(0, len(combos), AT_ONCE):
        tests = [(c, of(c)) for c in combos[i : i + AT_ONCE]]
        counts = lambda p: [F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"), F.count_if(p != first).alias("n_changed")]
        each = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, c, strict=True)), *counts(p)) for c, p in tests))
        parts.append(df.agg(each.alias("g")).select(F.explode("g").alias("g")).select("g.*"))
    g = reduce(DataFrame.unionByName, parts)
    recall, spec = F.try_divide("tp", F.col("tp") + F.col("fn")), F.try_divide("tn", F.col("tn") + F.col("fp"))
    out = g.select(*names, ((recall + spec) / 2).alias("balanced"), "n_changed")
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("balanced"), "n_changed", *names)))  # a row a combination


def resamples(df: DataFrame, key: str, label: str, predicted: str, n: int, seed: int) -> DataFrame:
    """resample (0 to n - 1), tp, fp, fn, tn: how often rows of each kind are in it.

    How often a row is in a resample is a Poisson variable of mean 1, drawn from the hash of seed, resample and key; a hash serves four resamples. Rows meet their draws where
    they are and are added up by hash and kind before anything moves: a row is copied once a hash, and a hash is four kinds a task in the shuffle.
    """
    rows = df.select(F.col(key).cast("string").alias("_key"), F.col(label).alias("_y"), F.col(predicted).alias("_p"))
    rows = rows.repartition("_key")  # hashing takes the time, and a scan of few columns has few tasks
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // PIECES))).alias("_block"))
    rows = rows.select("_y", "_p", "_block", hash_of(F.lit(seed), F.col("_block"), F.col("_key")).alias("_h"))
    rows = rows.select("_y", "_p", "_block", *(F.substring("_h", 1 + DIGITS * i, DIGITS).alias(f"_d{i}") for i in range(PIECES)))
    kinds = rows.groupBy("_block", "_y", "_p").agg(*(F.sum(poisson_of(F.col(f"_d{i}"))).alias(f"_t{i}") for i in range(PIECES)))
    kinds = kinds.select("_y", "_p", "_block", F.posexplode(F.array(*(f"_t{i}" for i in range(PIECES)))).alias("_piece", "_times"))
    y, p = F.col("_y"), F.col("_p")
    of = lambda test: F.coalesce(F.sum(F.when(test, F.col("_times"))), F.lit(0)).alias
    kinds = kinds.select((F.col("_block") * PIECES + F.col("_piece")).alias("resample"), "_y", "_p", "_times").where((F.col("resample") < n) & (F.col("_times") > 0))
    return kinds.groupBy("resample").agg(of(p & y)("tp"), of(p & ~y)("fp"), of(~p & y)("fn"), of(~p & ~y)("tn"))


def bootstrap(df: DataFrame, label: str, predicted: str, n: int = 2000, seed: int = 0, key: str = "id") -> DataFrame:
    """lo, hi (2.5 and 97.5 %) of the balanced accuracy over n bootstrap resamples of the rows, key naming a row; a resample without one of the two classes has none and is left out."""
    g = resamples(df, key, label, predicted, n, seed)
    balanced = (F.try_divide("tp", F.col("tp") + F.col("fn")) + F.try_divide("tn", F.col("tn") + F.col("fp"))) / 2
    return g.agg(F.percentile(balanced, F.array(F.lit(0.025), F.lit(0.975))).alias("q")).select(F.get("q", F.lit(0)).alias("lo"), F.get("q", F.lit(1)).alias("hi"))
