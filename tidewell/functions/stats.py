"""Intervals and tests as column expressions (normal, t and binomial values without SciPy)."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = NormalDist().inv_cdf(0.975)
#: Two-sided 95 % quantiles of Student's t for 1 to 30 degrees of freedom.
T95 = (12.706205, 4.302653, 3.182446, 2.776445, 2.570582, 2.446912, 2.364624, 2.306004, 2.262157, 2.228139, 2.200985, 2.178813, 2.160369, 2.144787, 2.131450, 2.119905, 2.109816, 2.100922, 2.093024, 2.085963, 2.079614, 2.073873, 2.068658, 2.063899, 2.059539, 2.055529, 2.051831, 2.048407, 2.045230, 2.042272)


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval, within 0 and 1; null if n is 0."""
    n = F.when(n > 0, n.cast("double"))
    p = k / n
    width = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    return F.greatest(F.lit(0.0), middle - width), F.least(F.lit(1.0), middle + width)


def t_quantile(n: Column) -> Column:
    """95 % t quantile for a sample of n: tabled to 31, the normal one beyond with the usual second-order term."""
    df = (n - 1).cast("int")
    far = Z95 + (Z95**3 + Z95) / (4 * df.cast("double"))
    return F.when(df <= 30, F.element_at(F.array(*(F.lit(t) for t in T95)), F.greatest(df, F.lit(1)))).otherwise(far)


def mean_interval(x: Column) -> tuple[Column, Column, Column]:
    """Mean and bounds of its 95 % t interval over a group; the mean itself for one value."""
    n, mean = F.count(x), F.avg(x)
    half = F.when(n > 1, t_quantile(n) * F.stddev_samp(x) / F.sqrt(n.cast("double"))).otherwise(F.lit(0.0))
    return mean, mean - half, mean + half


#: Power of two by which mcnemar() scales its terms.
_SCALE = 512


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided McNemar test: min(1, 2 P(X <= min(b, c))) for X binomial(b + c, 1/2); 1 if nothing is discordant."""
    n, k = (b + c).cast("int"), F.least(b, c).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"), F.lit(0).alias("scaled"))
    # Terms C(n, i) by recurrence; terms and sum are brought down by 2 ** -_SCALE whenever a term passes that, so neither they nor 2 ** -n leave the range of a double.
    steps = F.when(k >= 1, F.sequence(F.lit(1), F.greatest(k, F.lit(1)))).otherwise(F.array().cast("array<int>"))

    def step(a: Column, i: Column) -> Column:
        over = a["term"] > 2.0**_SCALE
        by = F.when(over, 2.0**-_SCALE).otherwise(1.0)
        term = a["term"] * by * (n - i + 1) / i
        return F.struct(term.alias("term"), (a["sum"] * by + term).alias("sum"), (a["scaled"] + over.cast("int")).alias("scaled"))

    tail = F.aggregate(steps, start, step, lambda a: F.exp(F.log(a["sum"]) + (a["scaled"] * _SCALE - n + 1) * math.log(2)))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), tail))


def is_close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= 1e-8 + 1e-5 * F.abs(b)


def seed_of(name: Column) -> Column:
    """crc32 of a name, modulo 1000: the part of a seed that a drift type adds."""
    return F.crc32(name.cast("binary")) % 1000
