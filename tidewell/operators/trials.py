"""Tables of windows and trials, and what is scored under their ids."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import date, timedelta
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draws import hash_of, hash_text, number
from ..functions.stats import wilson
from ..sources.panel import COARSE_COLUMNS, Windows, tag
from ..sources.written import written
from .boosting import Model, contributions
from .detect import JS_THRESHOLD, global_scan
from .inject import GRADUAL, SPIKE, SPIKES, SUDDEN, Injection, inject
from .localise import rank_within_slices, top_k
from .model import mean_shift

#: Fixed values, in days: length of the pool, the reference, and the current window.
POOL_DAYS, REF_DAYS, WINDOW_DAYS = 200, 60, 30


def rolling_windows(cur_start: date, ref_days: int = REF_DAYS, days: int = WINDOW_DAYS) -> Windows:
    """A current window (both ends in it, so days + 1 dates) and the reference right before it."""
    return Windows(*(d.isoformat() for d in (cur_start - timedelta(ref_days), cur_start - timedelta(1), cur_start, cur_start + timedelta(days))))


def spaced_offsets(pool_days: int, n: int, days: int = WINDOW_DAYS) -> list[int]:
    """n evenly spaced offsets into a pool, cut to whole days, without repeats."""
    return sorted({int(x) for x in np.linspace(0, pool_days - days, n)})


def assign_windows(panel: DataFrame, windows: Sequence[tuple[str, Windows]]) -> DataFrame:
    """Rows of every window they lie in, with window_id and win. The windows are a short list, so each row is handed on by a filter over an array: no range join."""
    lit = lambda x: F.lit(x).cast("date")
    each = F.array(*(F.struct(F.lit(n).alias("window_id"), lit(w.ref_start).alias("a"), lit(w.ref_end).alias("b"), lit(w.cur_start).alias("c"), lit(w.cur_end).alias("d")) for n, w in windows))
    day = F.col("date")
    hit = F.filter(each, lambda w: day.between(w["a"], w["b"]) | day.between(w["c"], w["d"]))
    first, last = min(w.ref_start for _, w in windows), max(w.cur_end for _, w in windows)
    rows = panel.where(day.between(lit(first), lit(last))).select("*", F.explode(hit).alias("_w"))
    return rows.select(*panel.columns, F.col("_w.window_id").alias("window_id"), F.when(day.between(F.col("_w.c"), F.col("_w.d")), "cur").otherwise("ref").alias("win"))


def false_alarm_sweep(panel: DataFrame, windows: Sequence[tuple[str, Windows]], numeric: Sequence[str] = ("sales", "revenue"), categorical: Sequence[str] = ("cat_id", "state_id")) -> DataFrame:
    """window_id, feature, js, l_inf, is_drift on clean windows, all of them in one job."""
    w = windows[0][1]
    return global_scan(assign_windows(panel, windows), w, numeric, categorical, keys=("window_id",))


def firing_rates(sweep: DataFrame) -> DataFrame:
    """feature, fired, n, rate and its Wilson bounds."""
    out = sweep.groupBy("feature").agg(F.count_if("is_drift").alias("fired"), F.count("*").alias("n"))
    lo, hi = wilson(F.col("fired"), F.col("n"))
    return out.select("feature", "fired", "n", (F.col("fired") / F.col("n")).alias("rate"), lo.alias("lo"), hi.alias("hi"))


def localise_trials(panel: DataFrame, feature: str, columns: Sequence[str], k: int = 5, min_slice_size: int = 20) -> DataFrame:
    """trial_id (or window_id), rank, slice: the best k of every trial of a tagged panel, in one job."""
    key = "trial_id" if "trial_id" in panel.columns else "window_id"
    return top_k(rank_within_slices(panel, feature, None, columns, min_slice_size, keys=(key,)), k, keys=(key,))


#: The drift types of a trial series, the column that each falls into, and its size.
SERIES = (("sudden", "dept_id", SUDDEN), ("gradual", "store_id", GRADUAL), ("intermittent", "item_id", SPIKE))


def trial_ids(seed: int, n: int, series: Sequence[tuple[str, str, float]] = SERIES) -> list[tuple[str, str, str, float]]:
    """(trial_id, drift type, column, size) of n trials of each type."""
    return [(f"{seed}-{kind}-{i}", kind, column, size) for kind, column, size in series for i in range(n)]


def _trial(trial: str, kind: str, column: str, size: float, val: str, pool_start: date, pool_days: int) -> tuple[str, Windows, Injection]:
    start = pool_start + timedelta(number(trial, "offset") % (pool_days - WINDOW_DAYS))
    w = rolling_windows(start)
    days = sorted(sorted(range(WINDOW_DAYS - 1), key=lambda d: (hash_text(trial, "spike", d), d))[:SPIKES]) if kind == "intermittent" else ()
    return trial, w, Injection(kind, column, val, w.cur_start, w.cur_end, size, tuple((start + timedelta(d)).isoformat() for d in days))


def draw_trials(values: dict[str, Sequence[str]], pool_start: date, seed: int, n: int, pool_days: int = POOL_DAYS) -> Iterator[tuple[str, Windows, Injection]]:
    """n trials of each drift type: a window of the pool and an injection into a slice, the value whose hash with the trial's name is smallest. values: of the slice columns."""
    for trial, kind, column, size in trial_ids(seed, n):
        yield _trial(trial, kind, column, size, min(map(str, values[column]), key=lambda v, t=trial: (hash_text(t, v), v)), pool_start, pool_days)


def drawn_values(panel: DataFrame, ids: Sequence[tuple[str, str, str, float]]) -> DataFrame:
    """trial_id, slice_col, slice_val: the value of each trial's column whose hash with the trial's name is smallest, among all values that occur; one job for all trials."""
    columns = list(dict.fromkeys(c for _, _, c, _ in ids))
    each = F.array(*(F.struct(F.lit(c).alias("slice_col"), F.col(c).cast("string").alias("slice_val")) for c in columns))
    values = panel.select(F.explode(each).alias("s")).select("s.*").where("slice_val is not null").distinct()
    wanted = F.filter(F.array(*(F.struct(F.lit(t).alias("trial_id"), F.lit(c).alias("c")) for t, _, c, _ in ids)), lambda x: x["c"] == F.col("slice_col"))
    rows = values.select("slice_col", "slice_val", F.explode(wanted).alias("t"))
    return rows.groupBy(F.col("t.trial_id").alias("trial_id"), "slice_col").agg(F.min_by("slice_val", F.struct(hash_of(F.col("t.trial_id"), F.col("slice_val")), "slice_val")).alias("slice_val"))


def draw_trials_of(panel: DataFrame, pool_start: date, seed: int, n: int, pool_days: int = POOL_DAYS, series: Sequence[tuple[str, str, float]] = SERIES) -> list[tuple[str, Windows, Injection]]:
    """draw_trials() over all values of the panel; a row a trial comes to the driver. Trials of a column without values are left out."""
    ids = trial_ids(seed, n, series)
    found = {r["trial_id"]: r["slice_val"] for r in drawn_values(panel, ids).collect()}
    return [_trial(*t, found[t[0]], pool_start, pool_days) for t in ids if t[0] in found]


def windowed_trials(panel: DataFrame, drawn: Sequence[tuple[str, Windows, Injection]]) -> DataFrame:
    """Every trial's windows of the panel, tagged, injected, under trial_id: one job for all of them, which reads those days only."""
    parts = [inject(tag(panel, w), i).withColumn("trial_id", F.lit(name)) for name, w, i in drawn]
    return reduce(DataFrame.unionByName, parts)


def detected_trials(rows: DataFrame, feature: str, ranked: DataFrame) -> DataFrame:
    """trial_id, detected: whether the feature drifts as a whole, or a slice of the ranking (trial_id, score) does by itself."""
    whole = global_scan(rows, None, (feature,), (), keys=("trial_id",)).select("trial_id", F.col("is_drift").alias("fired"))
    inside = ranked.groupBy("trial_id").agg((F.max("score") > JS_THRESHOLD).alias("inside"))
    every = rows.select("trial_id").distinct()
    return every.join(whole, "trial_id", "left").join(inside, "trial_id", "left").select("trial_id", (F.coalesce("fired", F.lit(False)) | F.coalesce("inside", F.lit(False))).alias("detected"))


def head_to_head(panel: DataFrame, drawn: Sequence[tuple[str, Windows, Injection]], m: Model, ancestors: DataFrame, feature: str = "sales", contribution: str = "sell_price", columns: Sequence[str] = COARSE_COLUMNS, k: int = 5, min_slice_size: int = 20) -> DataFrame:
    """trial_id, drift_type, arm, detected, strict and hierarchical hits at 1 and 3, true_rank: ranking within slices against the shift of a model's contributions.

    Both arms are ranked over the same injected windows and scored in one plan under (trial_id, arm). The model is one that was trained before and is not fitted again. A trial in which
    an arm finds no slice is a miss of that arm.
    """
    rows = written(windowed_trials(panel, drawn), "trials", few=False)
    ranked = localise_trials(rows, feature, columns, k, min_slice_size)
    phi = contributions(m, rows, ["trial_id", "win", "date", *columns])
    shifted = mean_shift(phi, f"phi_{contribution}", None, columns, k, keys=("trial_id",))
    both = written(ranked.select(F.lit("ranking").alias("arm"), "trial_id", "rank", "slice_col", "slice_val", "score").unionByName(shifted.select(F.lit("contributions").alias("arm"), "trial_id", "rank", "slice_col", "slice_val", "score")), "arms")
    spark = panel.sparkSession
    truth = spark.createDataFrame([(n, i.kind, arm, i.slice_col, i.slice_val) for n, _, i in drawn for arm in ("ranking", "contributions")], "trial_id string, drift_type string, arm string, true_col string, true_val string")
    scored = score_rankings(both, truth, ancestors, by=("trial_id", "arm"))
    return truth.select("trial_id", "drift_type", "arm").join(scored, ["trial_id", "arm"]).join(detected_trials(rows, feature, both.where("arm = 'ranking'")), "trial_id")


HITS = ("strict_top1", "hier_top1", "strict_topk", "hier_topk")


def arm_rates(trials: DataFrame) -> DataFrame:
    """drift_type (ALL: all types), arm, n_detected, n, and of each kind of hit its rate among the detected trials with Wilson bounds; null without any."""
    g = trials.rollup("arm", "drift_type").agg(F.count("*").alias("n"), F.count_if("detected").alias("n_detected"), *(F.count_if(F.col(h) & F.col("detected")).alias(f"_{h}") for h in HITS)).where("arm is not null")
    columns = []
    for h in HITS:
        lo, hi = wilson(F.col(f"_{h}"), F.col("n_detected"))
        columns += [F.try_divide(f"_{h}", "n_detected").alias(h), lo.alias(f"{h}_lo"), hi.alias(f"{h}_hi")]
    return g.select("arm", F.coalesce("drift_type", F.lit("ALL")).alias("drift_type"), "n", "n_detected", *columns)


def score_rankings(rankings: DataFrame, truth: DataFrame, ancestors: DataFrame, k: int = 3, by: Sequence[str] = ("trial_id",)) -> DataFrame:
    """trial_id, strict and hierarchical hits at 1 and k, true_rank. rankings: trial_id, rank, slice_col, slice_val; truth: trial_id, true_col, true_val. by: what names a ranking.

    A slice is a hierarchical hit if it is the true one, above it or below it.
    """
    x = ancestors.select("col", "val", "ancestor_col", "ancestor_val").distinct()
    down = x.toDF("slice_col", "slice_val", "true_col", "true_val").withColumn("_d", F.lit(True))
    rise = x.toDF("true_col", "true_val", "slice_col", "slice_val").withColumn("_u", F.lit(True))
    keys = ["slice_col", "slice_val", "true_col", "true_val"]
    j = truth.join(rankings, list(by), "left").join(down, keys, "left").join(rise, keys, "left")
    strict = (F.col("slice_col") == F.col("true_col")) & (F.col("slice_val") == F.col("true_val"))
    hier = strict | F.col("_d").isNotNull() | F.col("_u").isNotNull()
    hit = lambda x, n: F.coalesce(F.bool_or(x & (F.col("rank") <= n)), F.lit(False))
    return j.groupBy(*by).agg(hit(strict, 1).alias("strict_top1"), hit(strict, k).alias("strict_topk"), hit(hier, 1).alias("hier_top1"), hit(hier, k).alias("hier_topk"), F.min(F.when(strict, F.col("rank"))).alias("true_rank"))
