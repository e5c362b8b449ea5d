"""Deterministic statistics that an analyst, or an agent, asks for by name: histories, comparisons, spikes, faults of the data."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import is_close
from ..sources.panel import SLICE_COLUMNS, Windows, tag, within
from .localise import rank_within_slices

#: Rows of a screen and of a breakdown, days of history, and what keeps ratios finite.
SCREEN, BREAKDOWN, HISTORY_DAYS, PCT_EPS, RATIO_EPS = 8, 5, 364, 0.05, 1e-9


def daily(panel: DataFrame, col: str) -> DataFrame:
    """slice_val, date, total, rows, mean of sales: what every history tool starts from."""
    out = panel.groupBy(F.col(col).cast("string").alias("slice_val"), "date").agg(F.sum("sales").alias("total"), F.count("*").alias("rows"))
    return out.withColumn("mean", F.col("total") / F.col("rows"))


def past_windows(w: Windows, earliest: Column) -> Column:
    """An array of (k, ref start, ref end, start, end): windows of 30 days with a 60-day reference, a week apart going back, all before the current one."""
    cur = F.lit(w.cur_start).cast("date")
    each = F.transform(
        F.sequence(F.lit(1), F.lit(HISTORY_DAYS // 7 - 13)),
        lambda k: F.struct(k.alias("k"), F.date_sub(cur, 7 * k + 90).alias("a"), F.date_sub(cur, 7 * k + 31).alias("b"), F.date_sub(cur, 7 * k + 30).alias("c"), F.date_sub(cur, 7 * k + 1).alias("d")),
    )
    return F.filter(each, lambda x: x["a"] >= earliest)


def _pct(ref: Column, cur: Column) -> Column:
    return (cur - ref) / (ref + PCT_EPS)


def history(panel: DataFrame, col: str, w: Windows) -> DataFrame:
    """slice_val, ref_mean, cur_mean, pct_change, own_p90, change_vs_own_p90, percentile, n_past: each value's change beside its own past changes.

    Means are of daily means. Days are handed to the past windows they lie in (at most 39), so no range join.
    """
    d = daily(panel, col)
    now = d.groupBy("slice_val").agg(F.avg(F.when(within(w.ref_start, w.ref_end), F.col("mean"))).alias("ref_mean"), F.avg(F.when(within(w.cur_start, w.cur_end), F.col("mean"))).alias("cur_mean"))
    now = now.withColumn("pct_change", _pct(F.col("ref_mean"), F.col("cur_mean")))
    before = d.where(F.col("date") < F.lit(w.cur_start).cast("date"))
    earliest = before.agg(F.min("date").alias("_first"))
    day = F.col("date")
    hit = F.filter(past_windows(w, F.col("_first")), lambda x: day.between(x["a"], x["d"]))
    rows = before.crossJoin(F.broadcast(earliest)).select("slice_val", "mean", "date", F.explode(hit).alias("x"))  # one row
    past = rows.groupBy("slice_val", F.col("x.k").alias("k")).agg(F.avg(F.when(F.col("date") <= F.col("x.b"), F.col("mean"))).alias("r"), F.avg(F.when(F.col("date") > F.col("x.b"), F.col("mean"))).alias("c"))
    past = past.select("slice_val", F.abs(_pct(F.col("r"), F.col("c"))).alias("change")).where("change is not null")
    own = past.join(now.select("slice_val", F.abs("pct_change").alias("_now")), "slice_val").groupBy("slice_val").agg(F.percentile("change", 0.9).alias("own_p90"), (F.avg((F.col("change") <= F.col("_now")).cast("int")) * 100).alias("percentile"), F.count("*").alias("n_past"))
    out = now.join(own, "slice_val", "left")
    return out.withColumn("change_vs_own_p90", F.abs("pct_change") / (F.col("own_p90") + RATIO_EPS))


def screen(rows: DataFrame, score: str, n: int = SCREEN) -> DataFrame:
    return rows.orderBy(F.desc_nulls_last(score), "slice_val").limit(n)


def window_change(panel: DataFrame, by: Sequence[str], w: Windows) -> DataFrame:
    """by..., ref_total, cur_total (mean daily totals), ref_row, cur_row (means by row), delta, pct."""
    rows = tag(panel.select(*by, "date", "sales"), w)
    of = lambda win, x: F.when(F.col("win") == win, x)
    sums = rows.groupBy(*by).agg(
        *(F.coalesce(F.sum(of(k, F.col("sales"))), F.lit(0.0)).alias(f"{k}_sum") for k in ("ref", "cur")), *(F.greatest(F.count_distinct(of(k, F.col("date"))), F.lit(1)).alias(f"{k}_days") for k in ("ref", "cur")), *(F.coalesce(F.avg(of(k, F.col("sales"))), F.lit(0.0)).alias(f"{k}_row") for k in ("ref", "cur"))
    )
    out = sums.select(*by, *((F.col(f"{k}_sum") / F.col(f"{k}_days")).alias(f"{k}_total") for k in ("ref", "cur")), "ref_row", "cur_row")
    return out.withColumns({"delta": F.col("cur_total") - F.col("ref_total"), "pct": _pct(F.col("ref_row"), F.col("cur_row"))})


def breakdown(panel: DataFrame, col: str, by: str, w: Windows) -> DataFrame:
    """slice_val, group, pct, share of the slice's change, whether it moves with the slice (half its change at least), for all slices of col at once."""
    groups = window_change(panel, [col, by], w).select(F.col(col).alias("slice_val"), F.col(by).alias("group"), "pct", "delta")
    whole = window_change(panel, [col], w).select(F.col(col).alias("slice_val"), F.col("delta").alias("whole"), F.col("pct").alias("slice_pct"))
    half = F.col("slice_pct") / 2
    follows = F.when(F.col("slice_pct") >= 0, F.col("pct") >= half).otherwise(F.col("pct") <= half)
    return groups.join(whole, "slice_val").select("slice_val", "group", "pct", F.when(F.abs("whole") > 1e-9, F.col("delta") / F.col("whole")).alias("share"), follows.alias("follows"))


MONTHS, MONTH_DAYS, BLOCKS = 12, 30, 6


def slice_detail(panel: DataFrame, col: str, w: Windows, by: str | None = None) -> DataFrame:
    """All that is known of the history of each value of col, in one answer: what history() has, months (means of the 12 stretches of 30 days before the window, oldest first), blocks (means of
    6 near-equal blocks of the window's days), ref_max and cur_max (largest daily mean over the reference's mean), and with `by` where the change lives (the BREAKDOWN groups with the largest shares).

    A day counts in a block if any slice has a row on it; a stretch without rows of the slice is null. For one value filter the panel by it, but then blocks are of that slice's days.
    """
    d = daily(panel, col)
    start = F.lit(w.cur_start).cast("date")
    month = F.ceil(F.datediff(start, F.col("date")) / MONTH_DAYS)
    days = d.where(within(w.cur_start, w.cur_end)).select("date").distinct()
    days = days.select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("_i"), F.count("*").over(Window.partitionBy()).alias("_n"))  # a row a day of the window
    q, r = F.floor(F.col("_n") / BLOCKS), F.col("_n") % BLOCKS
    block = F.when(F.col("_i") < r * (q + 1), F.floor(F.col("_i") / (q + 1))).otherwise(r + F.floor(F.try_divide(F.col("_i") - r * (q + 1), q)))
    rows = d.join(days.select("date", block.alias("_block")), "date", "left").withColumns({"_month": month, "_ref": within(w.ref_start, w.ref_end), "_cur": within(w.cur_start, w.cur_end)})
    mean = lambda test: F.avg(F.when(test, F.col("mean")))
    top = lambda test: F.max(F.when(test, F.col("mean"))) / (mean(F.col("_ref")) + RATIO_EPS)
    g = rows.groupBy("slice_val").agg(
        F.array(*(mean(F.col("_month") == k) for k in range(MONTHS, 0, -1))).alias("months"), F.array(*(mean(F.col("_cur") & (F.col("_block") == b)) for b in range(BLOCKS))).alias("blocks"), top(F.col("_ref")).alias("ref_max"), top(F.col("_cur")).alias("cur_max")
    )
    out = history(panel, col, w).join(g, "slice_val")
    if by is None:
        return out
    parts = breakdown(panel, col, by, w).withColumn("_k", F.row_number().over(Window.partitionBy("slice_val").orderBy(F.desc_nulls_last(F.round(F.abs("share"), 12)), "group"))).where(F.col("_k") <= BREAKDOWN)
    lives = parts.groupBy(F.col("slice_val").cast("string").alias("slice_val")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "group", "share", "pct", "follows"))), lambda x: F.struct(x["group"].alias("group"), x["share"].alias("share"), x["pct"].alias("pct"), x["follows"].alias("follows"))).alias("where_it_lives"))
    return out.join(lives, "slice_val", "left")


def compare_windows(panel: DataFrame, col: str, w: Windows, min_slice_size: int = 20) -> DataFrame:
    """slice_val, js, place, of_n, column_median_js, coverage, means and zero shares of both windows."""
    js = rank_within_slices(panel, "sales", w, (col,), min_slice_size).select("slice_val", F.col("score").alias("js"), "coverage")
    rows = tag(panel.select(col, "date", "sales"), w)
    of = lambda win, x: F.when(F.col("win") == win, x)
    stats = rows.groupBy(F.col(col).cast("string").alias("slice_val")).agg(*(F.avg(of(k, (F.col("sales") == 0).cast("int"))).alias(f"{k}_zero") for k in ("ref", "cur")))
    mid = js.agg(F.median("js").alias("column_median_js"), F.count("*").alias("of_n"))
    place = F.row_number().over(Window.orderBy(F.desc(F.round("js", 12)), "slice_val"))  # a row a value of one column
    return js.withColumn("place", place).crossJoin(F.broadcast(mid)).join(stats, "slice_val")


def days_above(panel: DataFrame, col: str, w: Windows) -> DataFrame:
    """slice_val, n_days: current days whose mean is above every reference day's."""
    d = daily(panel, col)
    top = d.where(within(w.ref_start, w.ref_end)).groupBy("slice_val").agg(F.max("mean").alias("top"))
    return d.where(within(w.cur_start, w.cur_end)).join(top, "slice_val").groupBy("slice_val").agg(F.count_if(F.col("mean") > F.col("top")).alias("n_days"))


def peaks(panel: DataFrame, col: str, w: Windows, n: int = 3, spike_days: int = 2) -> DataFrame:
    """slice_val, end_date, level: the n highest rolling means at least spike_days apart, taken greedily (a fold over each slice's days, which are few)."""
    d = daily(panel, col)
    base = d.where(within(w.ref_start, w.ref_end)).groupBy("slice_val").agg((F.avg("mean") + RATIO_EPS).alias("base"))
    frame = Window.partitionBy("slice_val").orderBy("date").rowsBetween(1 - spike_days, 0)
    roll = d.where(within(w.cur_start, w.cur_end)).select("slice_val", "date", F.when(F.count("*").over(frame) == spike_days, F.avg("mean").over(frame)).alias("x")).where("x is not null")
    days = roll.groupBy("slice_val").agg(F.array_sort(F.collect_list(F.struct((-F.col("x")).alias("neg"), F.col("date").alias("date")))).alias("days"))
    empty = F.array().cast("array<struct<neg:double,date:date>>")
    far = lambda acc, x: ~F.exists(acc, lambda t: F.abs(F.datediff(t["date"], x["date"])) < spike_days)
    taken = F.aggregate("days", empty, lambda acc, x: F.when((F.size(acc) < n) & far(acc, x), F.array_append(acc, x)).otherwise(acc))
    out = days.select("slice_val", F.explode(taken).alias("p")).join(base, "slice_val")
    return out.select("slice_val", F.col("p.date").alias("end_date"), (-F.col("p.neg") / F.col("base")).alias("level"))


def trailing_runs(panel: DataFrame, w: Windows, keys: Sequence[str] = ("id",), value: str = "sales") -> DataFrame:
    """keys..., trail_run, trail_value, ref_mean: how long each series has stood at its newest value, by days on which any series has one; a series without the newest day has run 0.

    One row a key and day is kept; the run ends before the first day, newest first, whose value is another or missing.
    """
    cur = panel.where(within(w.cur_start, w.cur_end)).groupBy(*keys, "date").agg(F.min(value).alias("x"))
    days = cur.select("date").distinct().withColumn("day", F.row_number().over(Window.orderBy(F.desc("date"))))  # days of one window
    n = days.agg(F.count("*").alias("n_days"))
    placed = cur.join(F.broadcast(days), "date")
    newest = placed.groupBy(*keys).agg(F.max(F.when(F.col("day") == 1, F.col("x"))).alias("trail_value"))
    same = placed.join(newest, list(keys)).where(F.col("trail_value").isNotNull() & is_close(F.col("x"), F.col("trail_value")))
    runs = same.withColumn("seq", F.row_number().over(Window.partitionBy(*keys).orderBy("day"))).where("seq = day").groupBy(*keys).agg(F.max("day").alias("trail_run"))
    ref = panel.where(within(w.ref_start, w.ref_end)).groupBy(*keys).agg(F.avg(value).alias("ref_mean"))
    out = newest.join(runs, list(keys), "left").join(ref, list(keys), "left").crossJoin(F.broadcast(n))
    return out.select(*keys, F.coalesce("trail_run", F.lit(0)).alias("trail_run"), "trail_value", F.coalesce("ref_mean", F.lit(0.0)).alias("ref_mean"))


def compare_means(panel: DataFrame, col: str, w: Windows, n: int = 12) -> DataFrame:
    """slice_val, ref_mean, cur_mean, mean_ratio, rows_ratio, change, ranked by |ln mean_ratio| + |ln rows_ratio|; either side may be missing."""
    rows = tag(panel.select(col, "date", "sales"), w)
    of = lambda win, x: F.when(F.col("win") == win, x)
    days = rows.agg(*(F.count_distinct(of(k, F.col("date"))).alias(f"{k}_days") for k in ("ref", "cur")))
    g = rows.groupBy(F.col(col).cast("string").alias("slice_val")).agg(*(F.avg(of(k, F.col("sales"))).alias(f"{k}_mean") for k in ("ref", "cur")), *(F.count(of(k, F.lit(1))).alias(f"{k}_n") for k in ("ref", "cur")))
    g = g.crossJoin(F.broadcast(days))
    mean_ratio = F.when(F.col("ref_mean") != 0, F.col("cur_mean") / F.col("ref_mean"))
    rows_ratio = F.try_divide(F.try_divide("cur_n", "cur_days"), F.nullif(F.try_divide("ref_n", "ref_days"), F.lit(0.0)))
    change = F.abs(F.log(F.greatest(F.coalesce(mean_ratio, F.lit(1.0)), F.lit(1e-6)))) + F.abs(F.log(F.greatest(F.coalesce(rows_ratio, F.lit(1.0)), F.lit(1e-6))))
    return g.select("slice_val", "ref_mean", "cur_mean", mean_ratio.alias("mean_ratio"), rows_ratio.alias("rows_ratio"), change.alias("change")).orderBy(F.desc("change"), "slice_val").limit(n)


def duplicate_check(df: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """by, n_rows, n_duplicated: rows whose key occurs again, all copies counted."""
    n = df.groupBy(*keys, by).agg(F.count("*").alias("_n"))
    whole = n.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    return n.join(whole, list(keys)).groupBy(by).agg(F.sum("_n").alias("n_rows"), F.sum(F.when(F.col("_all") > 1, F.col("_n")).otherwise(0)).alias("n_duplicated"))


def label_consistency(df: DataFrame, a: str, b: str) -> DataFrame:
    """a-values with several b-values, each with its dates."""
    g = df.groupBy(a, b).agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.count("*").alias("n"))
    several = g.groupBy(a).agg(F.count("*").alias("n_labels")).where("n_labels > 1")
    return g.join(several, a)


def validate(panel: DataFrame, col: str, val: str | None = None) -> str | None:
    """What is wrong with an argument, or None."""
    if col not in SLICE_COLUMNS:
        return f"unknown col {col!r}; must be one of {list(SLICE_COLUMNS)}"
    if val is not None and not panel.where(F.col(col).cast("string") == str(val)).limit(1).count():
        return f"unknown value {val!r} for {col}"
    return None


#: By name, for dispatch.
TOOLS: dict[str, Callable[..., DataFrame]] = {"get_slice_history": history, "compare_windows": compare_windows, "check_spikes": days_above, "duplicate_check": duplicate_check, "label_consistency": label_consistency, "constant_run_check": trailing_runs}
