"""The data-quality checker: which fault is in a window, and where."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.panel import SLICE_COLUMNS, Windows, unpivot_slices, within
from ..sources.written import written
from .tools import trailing_runs

#: The fitted thresholds, and the grid they were fitted on.
K_ZERO, M_REF, K_STALE, N_MIN = 10, 2.0, 4, 15
GRID = {"k_zero": (3, 5, 7, 10, 14), "m_ref": (0.5, 1.0, 2.0), "k_stale": (3, 4, 5, 7), "n_min": (5, 10, 15)}


def series_stats(panel: DataFrame, w: Windows) -> DataFrame:
    """id, trail_run, trail_value, ref_mean, duplicated, and the slice columns, of every series of the current window."""
    cur = panel.where(within(w.cur_start, w.cur_end))
    per_day = cur.groupBy("id", "date").agg(F.count("*").alias("n"), *(F.min(c).alias(c) for c in SLICE_COLUMNS))
    meta = per_day.groupBy("id").agg((F.max("n") > 1).alias("duplicated"), *(F.min(c).alias(c) for c in SLICE_COLUMNS))
    return trailing_runs(panel, w).join(meta, "id")


def flags(stats: DataFrame, k_zero: int = K_ZERO, m_ref: float = M_REF, k_stale: int = K_STALE) -> DataFrame:
    zero = (F.col("trail_value") == 0) & (F.col("trail_run") >= k_zero) & (F.col("ref_mean") >= m_ref)
    stale = (F.col("trail_value") != 0) & (F.col("trail_run") >= k_stale)
    return stats.withColumns({"is_zero": F.coalesce(zero, F.lit(False)), "is_stale": F.coalesce(stale, F.lit(False))})


def decide(flagged: DataFrame, n_min: int = N_MIN) -> DataFrame:
    """One row: fault, n_duplicated, n_zero, n_stale. Duplicates come first; of zero and stale runs the larger set, zero on a tie."""
    n = flagged.agg(*(F.count_if(c).alias(f"n_{c.removeprefix('is_')}") for c in ("duplicated", "is_zero", "is_stale")))
    zero, stale = F.col("n_zero") >= n_min, F.col("n_stale") >= n_min
    fault = F.when(F.col("n_duplicated") > 0, "duplicated_rows").when(zero & (~stale | (F.col("n_zero") >= F.col("n_stale"))), "zero_fill").when(stale, "stale_feed").otherwise("none")
    return n.withColumn("fault", fault)


def locate(flagged: DataFrame, flag: str) -> DataFrame:
    """slice_col, slice_val, f1, place: how well each slice's series match the flagged ones, best first; ties by slice column, then value."""
    total = flagged.agg(F.count_if(flag).alias("n_flagged"))
    rows = unpivot_slices(flagged, SLICE_COLUMNS, [flag])
    g = rows.groupBy("slice_col", "slice_ord", "slice_val").agg(F.count_if(flag).alias("tp"), F.count("*").alias("n")).where("tp > 0").crossJoin(F.broadcast(total))
    return g.select("slice_col", "slice_ord", "slice_val", (2 * F.col("tp") / (F.col("n") + F.col("n_flagged"))).alias("f1"))


def grid_counts(stats: DataFrame) -> DataFrame:
    """k_zero, m_ref, k_stale, n_zero, n_stale of every combination, from one pass: each series is handed to the combinations that flag it."""
    combos = F.array(*(F.struct(F.lit(z).alias("k_zero"), F.lit(m).alias("m_ref"), F.lit(s).alias("k_stale")) for z, m, s in product(GRID["k_zero"], GRID["m_ref"], GRID["k_stale"])))
    v, run, mean = F.col("trail_value"), F.col("trail_run"), F.col("ref_mean")
    zero = lambda c: (v == 0) & (run >= c["k_zero"]) & (mean >= c["m_ref"])
    stale = lambda c: (v != 0) & (run >= c["k_stale"])
    small = stats.select("trail_value", "trail_run", "ref_mean").groupBy("trail_value", "trail_run", "ref_mean").agg(F.count("*").alias("n"))
    each = small.select("n", F.explode(F.transform(combos, lambda c: F.struct(c["k_zero"].alias("k_zero"), c["m_ref"].alias("m_ref"), c["k_stale"].alias("k_stale"), F.coalesce(zero(c), F.lit(False)).alias("z"), F.coalesce(stale(c), F.lit(False)).alias("s")))).alias("c"))
    return each.groupBy("c.k_zero", "c.m_ref", "c.k_stale").agg(F.sum(F.when(F.col("c.z"), F.col("n")).otherwise(0)).alias("n_zero"), F.sum(F.when(F.col("c.s"), F.col("n")).otherwise(0)).alias("n_stale"))


# ---- the fit of the thresholds

#: The grid of the full fit, and the kinds of trials whose accuracies it averages.
FIT_GRID: Mapping[str, Sequence[float]] = {"k_zero": (5, 7, 10, 14, 17, 21), "m_ref": (0.2, 0.5, 1.0, 2.0, 3.0, 5.0), "k_stale": (4, 5, 7, 10, 14), "n_min": (1, 3, 5, 8, 10, 15)}
FIT_KINDS = ("stale_feed", "zero_fill", "duplicated_rows", "clean")


def trial_stats(trials: DataFrame, w: Windows) -> DataFrame:
    """series_stats() of a panel that holds trials under trial_id (a name without "/"), all in the same windows."""
    stats = series_stats(trials.withColumn("id", F.concat_ws("/", "trial_id", "id")), w)
    return stats.withColumn("trial_id", F.substring_index("id", "/", 1))


def located_counts(stats: DataFrame, grid: Mapping[str, Sequence[float]] = FIT_GRID) -> DataFrame:
    """trial_id, rule, i, n, loc_col, loc_val: of every trial and setting of each rule how many series it flags, and the slice that matches them best.

    rule zero: setting i of (k_zero, m_ref); stale: of k_stale; duplicated: 0. One aggregation by trial and slice has the counts of all settings, as sums over the series
    beyond each corner of the grid; combinations of rules are never tried on series.
    """
    value, run = F.col("trail_value"), F.col("trail_run")
    zero = [(value == 0) & (run >= k) & (F.col("ref_mean") >= m) for k, m in product(grid["k_zero"], grid["m_ref"])]
    stale = [(value != 0) & (run >= k) for k in grid["k_stale"]]
    flagged = lambda tests: F.array(*(F.count_if(F.coalesce(t, F.lit(False))) for t in tests))
    rows = unpivot_slices(stats.withColumn(EVERY, F.lit(EVERY)), [*SLICE_COLUMNS, EVERY], ["trial_id", "trail_value", "trail_run", "ref_mean", "duplicated"])
    cube = rows.groupBy("trial_id", "slice_col", "slice_ord", "slice_val").agg(F.count("*").alias("size"), flagged(zero).alias("zero"), flagged(stale).alias("stale"), flagged([F.col("duplicated")]).alias("duplicated"))
    each = F.explode(F.create_map(*(x for r in ("zero", "stale", "duplicated") for x in (F.lit(r), F.col(r)))))
    long = cube.select("trial_id", "slice_col", "slice_ord", "slice_val", "size", each.alias("rule", "counts")).select("*", F.posexplode("counts").alias("i", "tp"))
    long = written(long.drop("counts"), "fit-counts", few=False)
    total = long.where(F.col("slice_col") == EVERY).select("trial_id", "rule", "i", F.col("tp").alias("n"))
    f1 = F.round(2 * F.col("tp") / (F.col("size") + F.col("n")), 12)
    best = long.where((F.col("slice_col") != EVERY) & (F.col("tp") > 0)).join(total, ["trial_id", "rule", "i"])
    best = best.groupBy("trial_id", "rule", "i").agg(F.min(F.struct((-f1).alias("f"), "slice_ord", "slice_val", "slice_col")).alias("b"))
    return total.join(best, ["trial_id", "rule", "i"], "left").select("trial_id", "rule", "i", "n", F.col("b.slice_col").alias("loc_col"), F.col("b.slice_val").alias("loc_val"))


#: The slice that holds all series of a trial.
EVERY = "_every_"


def fit_thresholds(stats: DataFrame, truth: DataFrame, grid: Mapping[str, Sequence[float]] = FIT_GRID) -> DataFrame:
    """place, k_zero, m_ref, k_stale, n_min, acc_<kind>, score, picked: every combination in grid order. stats: trial_stats(); truth: trial_id, kind (FIT_KINDS; others are left out), true_col, true_val.

    A fault is right if its type and place are, a clean trial if nothing is found. The score is the mean of the kinds' accuracies (of those that have trials; acc_ is null for others); the first
    of equally good combinations is picked. Settings meet by trial, so rows are trials times combinations, whatever the series.
    """
    found = written(located_counts(stats, grid), "fit-located", few=False)
    of = lambda rule, name: found.where(F.col("rule") == rule).select("trial_id", F.col("i").alias(f"i_{name}"), F.col("n").alias(f"n_{name}"), F.struct("loc_col", "loc_val").alias(f"at_{name}"))
    rows = truth.where(F.col("kind").isin(*FIT_KINDS)).join(of("zero", "z"), "trial_id", "left").join(of("stale", "s"), "trial_id", "left").join(of("duplicated", "d"), "trial_id", "left")
    rows = rows.select("*", F.posexplode(F.array(*map(F.lit, grid["n_min"]))).alias("i_n", "n_min"))
    rows = rows.withColumns({f"n_{x}": F.coalesce(f"n_{x}", F.lit(0)) for x in "zsd"})
    z, s = F.col("n_z") >= F.col("n_min"), F.col("n_s") >= F.col("n_min")
    choice = F.when(F.col("n_d") > 0, _verdict("duplicated_rows", "at_d")).when(z & (~s | (F.col("n_z") >= F.col("n_s"))), _verdict("zero_fill", "at_z")).when(s, _verdict("stale_feed", "at_s")).otherwise(_verdict("none", None))
    rows = rows.withColumn("said", choice)
    place = (F.col("said.at.loc_col") == F.col("true_col")) & (F.col("said.at.loc_val") == F.col("true_val"))
    right = F.when(F.col("kind") == "clean", F.col("said.fault") == "none").otherwise(F.coalesce((F.col("said.fault") == F.col("kind")) & place, F.lit(False)))
    # A trial without series has no settings: it counts in all of them.
    n_z, n_s = len(grid["k_zero"]) * len(grid["m_ref"]), len(grid["k_stale"])
    every = lambda c, n: F.explode(F.when(F.col(c).isNull(), F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(c)))
    rows = rows.withColumn("right", right.cast("double")).withColumn("i_z", every("i_z", n_z)).withColumn("i_s", every("i_s", n_s))
    g = rows.groupBy("i_z", "i_s", "i_n").agg(*(F.avg(F.when(F.col("kind") == k, F.col("right"))).alias(f"acc_{k}") for k in FIT_KINDS))
    accs = F.array_compact(F.array(*(f"acc_{k}" for k in FIT_KINDS)))
    score = F.aggregate(accs, F.lit(0.0), lambda a, x: a + x) / F.size(accs)
    m = len(grid["m_ref"])
    pick = lambda name, at: F.get(F.array(*map(F.lit, grid[name])), at.cast("int"))
    out = g.select(
        ((F.col("i_z") * n_s + F.col("i_s")) * len(grid["n_min"]) + F.col("i_n")).cast("int").alias("place"), pick("k_zero", F.floor(F.col("i_z") / m)).alias("k_zero"), pick("m_ref", F.col("i_z") % m).alias("m_ref"), pick("k_stale", F.col("i_s")).alias("k_stale"), pick("n_min", F.col("i_n")).alias("n_min"),
        *(f"acc_{k}" for k in FIT_KINDS), score.alias("score"),
    )
    first = F.row_number().over(Window.orderBy(F.desc(F.round("score", 12)), "place")) == 1  # a row a combination
    return out.withColumn("picked", first)


def _verdict(fault: str, at: str | None) -> Column:
    where = F.col(at) if at else F.lit(None).cast("struct<loc_col:string,loc_val:string>")
    return F.struct(F.lit(fault).alias("fault"), where.alias("at"))
