"""Drift detection: does a feature's distribution differ between two windows, over all rows, within slices, or in a growing window?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binning import adaptive_edges, bin_of
from ..functions.divergence import divergences
from ..sources.panel import Windows, tag
from ..sources.written import written

#: Thresholds (either fires), monitored features, and the least rows of a slice in each window.
JS_THRESHOLD, L_INF_THRESHOLD, MIN_SLICE_SIZE = 0.015, 0.06, 20
NUMERIC, CATEGORICAL = ("sales", "sell_price", "revenue"), ("cat_id", "state_id")


def is_drift(js: Column, l_inf: Column) -> Column:
    return (js > JS_THRESHOLD) | (l_inf > L_INF_THRESHOLD)


def count_by_window(rows: DataFrame, keys: Sequence[str], bin_col: str = "bin") -> DataFrame:
    """keys, bin, n_ref, n_cur: both windows counted in one aggregation."""
    return rows.groupBy(*keys, bin_col).agg(F.count_if(F.col("win") == "ref").alias("n_ref"), F.count_if(F.col("win") == "cur").alias("n_cur"))


def global_scan(panel: DataFrame, w: Windows, numeric: Sequence[str] = NUMERIC, categorical: Sequence[str] = CATEGORICAL, keys: Sequence[str] = ()) -> DataFrame:
    """feature_ord, feature, js, l_inf, is_drift for every monitored feature the panel has. Values outside the edges don't count.

    keys: further columns (a trial or window id) under which everything is done separately, in the same job.
    """
    rows = tag(panel, w) if "win" not in panel.columns else panel
    numeric, categorical = ([c for c in cs if c in panel.columns] for cs in (numeric, categorical))
    by, counted = [*keys, "feature_ord", "feature"], []
    if numeric:
        each = F.array(*(F.struct(F.lit(i).alias("feature_ord"), F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for i, c in enumerate(numeric)))
        long = rows.select(*keys, "win", F.explode(each).alias("f")).select(*keys, "win", "f.*").where("x is not null")
        # Equal values are counted once, for edges and bins alike: rows are read once, and neither sorted nor binned one by one.
        values = written(count_by_window(long, by, "x"), "values", few=False).withColumn("_n", F.col("n_ref") + F.col("n_cur"))
        edges = adaptive_edges(values, "x", [*keys, "feature"], weight="_n")
        binned = values.join(F.broadcast(edges), [*keys, "feature"])  # a row a feature and key (trial or window)
        binned = binned.select(*by, bin_of(F.col("x"), F.col("edges"), True).cast("string").alias("bin"), "n_ref", "n_cur").where("bin is not null")
        counted.append(binned.groupBy(*by, "bin").agg(F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur")))
    if categorical:
        each = F.array(*(F.struct(F.lit(len(numeric) + i).alias("feature_ord"), F.lit(c).alias("feature"), F.col(c).cast("string").alias("bin")) for i, c in enumerate(categorical)))
        counted.append(count_by_window(rows.select(*keys, "win", F.explode(each).alias("f")).select(*keys, "win", "f.*").where("bin is not null"), by))
    both = counted[0] if len(counted) == 1 else counted[0].unionByName(counted[1])
    out = divergences(both, [*keys, "feature_ord", "feature"])
    return out.select(*keys, "feature_ord", "feature", "js", "l_inf", is_drift(F.col("js"), F.col("l_inf")).alias("is_drift"))


def scan_within_slices(panel: DataFrame, feature: str, slice_col: str, w: Windows, min_slice_size: int = MIN_SLICE_SIZE) -> DataFrame:
    """slice_val, js, l_inf of the slices that drift, against edges of the whole panel's values; both windows need min_slice_size rows."""
    edges = adaptive_edges(panel.select(feature), feature)
    rows = tag(panel.select(feature, slice_col, "date"), w).crossJoin(F.broadcast(edges))  # one row
    binned = rows.select(F.col(slice_col).cast("string").alias("slice_val"), "win", bin_of(F.col(feature), F.col("edges"), True).alias("bin"), F.lit(1).alias("one"))
    size = binned.groupBy("slice_val", "bin").agg(F.count_if(F.col("win") == "ref").alias("n_ref"), F.count_if(F.col("win") == "cur").alias("n_cur"))
    # A null bin (no value, or outside the edges) counts for the size of a slice, not for its histogram.
    rows_of = size.groupBy("slice_val").agg(F.sum("n_ref").alias("all_ref"), F.sum("n_cur").alias("all_cur"))
    out = divergences(size.where("bin is not null"), ["slice_val"]).join(rows_of, "slice_val")
    return out.where((F.col("all_ref") >= min_slice_size) & (F.col("all_cur") >= min_slice_size) & is_drift(F.col("js"), F.col("l_inf"))).select("slice_val", "js", "l_inf")


def scan_adaptive(panel: DataFrame, feature: str, start: str, min_days: int = 7, max_days: int = 90, step_days: int = 7, threshold: float = JS_THRESHOLD, least_rows: int = 20) -> DataFrame:
    """window_days, change_point, js of every growing window whose halves differ; the first is the detection (`first_change`).

    The windows are few (a bounded list), so each row is handed to those that hold its day, and all are scored in one job with edges of their own.
    """
    begin = F.lit(start).cast("date")
    sizes = F.array(*(F.lit(d) for d in range(min_days, max_days + 1, step_days)))
    day = F.datediff("date", begin)
    rows = panel.where((F.col("date") >= begin) & (day < max_days)).select(F.explode(F.filter(sizes, lambda d: d > day)).alias("window_days"), F.col(feature).cast("double").alias("x"), day.alias("day"))
    rows = rows.withColumn("win", F.when(F.col("day") < F.floor(F.col("window_days") / 2), "ref").otherwise("cur"))
    big = rows.groupBy("window_days").agg(F.count_if(F.col("win") == "ref").alias("a"), F.count_if(F.col("win") == "cur").alias("b")).where((F.col("a") >= least_rows) & (F.col("b") >= least_rows))
    binned = rows.where("x is not null").join(F.broadcast(adaptive_edges(rows, "x", ["window_days"])), "window_days")  # a row a window size
    counted = count_by_window(binned.select("window_days", "win", bin_of(F.col("x"), F.col("edges"), True).alias("bin")).where("bin is not null"), ["window_days"])
    out = divergences(counted, ["window_days"]).join(F.broadcast(big), "window_days").where(F.col("js") > threshold)
    return out.select("window_days", F.date_add(begin, F.floor(F.col("window_days") / 2).cast("int")).alias("change_point"), "js")


def first_change(scan: DataFrame) -> DataFrame:
    return scan.orderBy("window_days").limit(1)
