"""Controlled drift and data faults as pure transformations of a panel: df.transform(injector, ...)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.panel import within

#: Fixed values of the injectors.
SUDDEN, SUDDEN_DAY, GRADUAL, SPIKE, SPIKES, SPIKE_DAYS = 0.6, 10, 0.7, 3.0, 4, 2


@dataclass(frozen=True)
class Injection:
    """What was done where: the ground truth of a trial."""

    kind: str
    slice_col: str
    slice_val: str
    start: str
    end: str
    magnitude: float = 0.0
    spikes: tuple[str, ...] = ()
    extra: dict = field(default_factory=dict)


def _mask(i: Injection) -> Column:
    return (F.col(i.slice_col).cast("string") == i.slice_val) & within(i.start, i.end)


def _update(df: DataFrame, mask: Column, **new: Column) -> DataFrame:
    return df.withColumns({c: F.when(mask, x).otherwise(F.col(c)) for c, x in new.items()})


def sudden(df: DataFrame, i: Injection, target: str = "sales") -> DataFrame:
    """From day 10 of the window on: x (1 + m). Revenue stays."""
    begin = F.date_add(F.lit(i.start).cast("date"), SUDDEN_DAY)
    return _update(df, _mask(i) & (F.col("date") >= begin), **{target: F.col(target).cast("double") * (1 + i.magnitude)})


def gradual(df: DataFrame, i: Injection, target: str = "sales") -> DataFrame:
    """x (1 + m * days in / days of the window). Revenue stays."""
    start, end = F.lit(i.start).cast("date"), F.lit(i.end).cast("date")
    share = F.datediff("date", start) / F.greatest(F.datediff(end, start), F.lit(1))
    return _update(df, _mask(i), **{target: F.col(target).cast("double") * (1 + i.magnitude * share)})


def intermittent(df: DataFrame, i: Injection, target: str = "sales", days: int = SPIKE_DAYS) -> DataFrame:
    """In each spike's half-open window of `days`: x (1 + m) + m, once more for every spike that overlaps. With c of them: x g^c + (g^c - 1), g = 1 + m."""
    overlap = sum(((F.col("date") >= F.lit(s).cast("date")) & (F.col("date") < F.date_add(F.lit(s).cast("date"), days))).cast("int") for s in i.spikes) if i.spikes else F.lit(0)
    g = F.pow(F.lit(1.0 + i.magnitude), overlap)
    return _update(df, (F.col(i.slice_col).cast("string") == i.slice_val) & (overlap > 0), **{target: F.col(target).cast("double") * g + (g - 1)})


def price_shift(df: DataFrame, i: Injection) -> DataFrame:
    """Price (1 + m), sales as they were, revenue anew."""
    price = F.col("sell_price") * (1 + i.magnitude)
    return _update(df, _mask(i), sell_price=price, revenue=F.col("sales") * price)


def intersection(df: DataFrame, i: Injection) -> DataFrame:
    """Two conditions: x (1 + m) + 1 where both hold."""
    return _update(df, _mask(i) & (F.col(i.extra["col"]).cast("string") == i.extra["val"]), sales=F.col("sales").cast("double") * (1 + i.magnitude) + 1)


def stale_feed(df: DataFrame, i: Injection) -> DataFrame:
    """From the start on each series repeats its last value before it (0 if none); revenue anew."""
    before = df.where((F.col(i.slice_col).cast("string") == i.slice_val) & (F.col("date") < F.lit(i.start).cast("date"))).groupBy("id").agg(F.max_by("sales", F.struct("date", "sales")).alias("_last"))
    out = df.join(before, "id", "left")
    last = F.coalesce("_last", F.lit(0.0))
    return _update(out, _mask(i), sales=last, revenue=last * F.col("sell_price")).select(df.columns)


def zero_fill(df: DataFrame, i: Injection) -> DataFrame:
    return _update(df, _mask(i), sales=F.lit(0.0), revenue=F.lit(0.0))


def duplicated_rows(df: DataFrame, i: Injection) -> DataFrame:
    return df.unionByName(df.where(_mask(i)))


def unit_change(df: DataFrame, i: Injection) -> DataFrame:
    """Sales in dozens (times 12) or prices in cents (times 100); revenue anew."""
    if i.extra.get("column", "sales") == "sales":
        return _update(df, _mask(i), sales=F.col("sales") * 12.0, revenue=F.col("sales") * 12.0 * F.col("sell_price"))
    return _update(df, _mask(i), sell_price=F.col("sell_price") * 100.0, revenue=F.col("sales") * F.col("sell_price") * 100.0)


def mislabelled_category(df: DataFrame, i: Injection) -> DataFrame:
    """The rows' label becomes another one: the column and value are in extra."""
    return _update(df, _mask(i), **{i.extra["label_col"]: F.lit(i.extra["wrong_label"])})


DRIFTS: dict[str, Callable[..., DataFrame]] = {"sudden": sudden, "gradual": gradual, "intermittent": intermittent, "price_shift": price_shift, "intersection": intersection}
FAULTS: dict[str, Callable[..., DataFrame]] = {"stale_feed": stale_feed, "zero_fill": zero_fill, "duplicated_rows": duplicated_rows, "unit_change": unit_change, "mislabelled_category": mislabelled_category}


def inject(df: DataFrame, i: Injection) -> DataFrame:
    """The injection by the name of its kind."""
    return {**DRIFTS, **FAULTS}[i.kind](df, i)


def with_trials(panel: DataFrame, trials: Sequence[tuple[str, Injection | None]]) -> DataFrame:
    """The panel once for every trial, injected, under trial_id: all trials then run in one job."""
    out = None
    for name, i in trials:
        one = (inject(panel, i) if i else panel).withColumn("trial_id", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out
