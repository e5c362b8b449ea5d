"""Reports: what drifted, where, and what to do about it, as columns."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binning import adaptive_edges, bin_of
from ..functions.divergence import divergences
from ..sources.panel import COARSE_COLUMNS, Windows, tag, unpivot_slices, within
from ..sources.written import written
from .detect import CATEGORICAL, MIN_SLICE_SIZE, NUMERIC, count_by_window, global_scan, is_drift
from .localise import top_k

#: Sentences about an alert, by what is known of it.
SHIFTED = "%s no longer follows its reference distribution: divergence %.4f, largest change of a bin's share %.4f."
FOUND = " It shows most in %s (score %.4f), which makes up %.1f%% of the rows compared."
SPREAD = " No single slice stands out, so the whole panel seems to have moved."
PLANNED = " %s falls into these days, so look at demand before data."
UNPLANNED = " Nothing on the calendar falls into these days, so look at data before demand."
#: What to do next, in this order.
LOOK_AT_FEED, LOOK_AT_CALENDAR = "Read the load logs of %s for these days.", "Hold %s against the campaign plan."
SECOND_VIEW = "Rank the slices of %s by model contributions as well and compare."
RUNNER_UP = "Exclude %s, next in the ranking with %.4f, before closing."
WHOLE_PANEL = ("Compare schema and load times of all feeds before and after the change.", "Ask whether something happened on all sites at once in these days.")


def narrate(alerts: DataFrame, promo: str | None = None, pipeline_issue: bool = False) -> DataFrame:
    """alerts (feature, js, l_inf, is_drift, slices: array of structs, best first) with narrative and recommended_actions."""
    said = lambda text, *values: F.format_string(text, *values)
    name = lambda s: F.concat_ws(" ", s["slice_col"], s["slice_val"])
    best, next_best, many = F.get("slices", F.lit(0)), F.get("slices", F.lit(1)), F.size("slices")
    cause = PLANNED % promo if promo else UNPLANNED if pipeline_issue else ""
    where = F.when(many == 0, F.lit(SPREAD)).otherwise(F.concat(said(FOUND, name(best), best["score"], best["coverage"] * 100), F.lit(cause)))
    steps: list[Column] = [said(LOOK_AT_CALENDAR if promo else LOOK_AT_FEED, name(best)), said(SECOND_VIEW, F.col("feature"))]
    steps.append(F.when(many > 1, said(RUNNER_UP, name(next_best), next_best["score"])))
    actions = F.when(many == 0, F.array(*map(F.lit, WHOLE_PANEL))).otherwise(F.array_compact(F.array(*steps)))
    return alerts.withColumns({"narrative": F.concat(said(SHIFTED, F.col("feature"), F.col("js"), F.col("l_inf")), where), "recommended_actions": actions})


def with_fallback(synthesizer: Callable[[DataFrame], DataFrame], fallback: Callable[[DataFrame], DataFrame] = narrate) -> Callable[[DataFrame], DataFrame]:
    """A synthesizer that a model stands behind, made safe: if it fails, or its reports lack a column, the fallback's are taken; `synthesized_by` says whose."""

    def run(alerts: DataFrame) -> DataFrame:
        try:
            made = synthesizer(alerts)
            if {"narrative", "recommended_actions"} <= set(made.columns):
                return made.withColumn("synthesized_by", F.lit("model"))
        except Exception as error:  # noqa: BLE001  (whatever the model's client raises)
            warnings.warn(f"reports by rules, since the synthesizer failed: {error}", stacklevel=2)
        return fallback(alerts).withColumn("synthesized_by", F.lit("rules"))

    return run


#: Slice columns that are looked into, in this order, for a feature that does not drift as a whole.
FALLBACK_COLUMNS = ("cat_id", "item_id")
_BY = ["feature", "slice_col", "slice_ord", "slice_val"]


def _slice_bins(panel: DataFrame, w: Windows, numeric: Sequence[str], categorical: Sequence[str], columns: Sequence[str], drop_outside: bool) -> DataFrame:
    """feature, slice_col, slice_ord, slice_val, bin, n_ref, n_cur of all features at once; a feature is no slice of itself. bin is null beyond the edges if drop_outside, and where there is no value."""
    rows = tag(panel.select(*dict.fromkeys([*numeric, *categorical, *columns, "date"])), w)
    parts = []
    if numeric:
        each = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in numeric))
        long = rows.select("win", *columns, F.explode(each).alias("f")).select("win", *columns, "f.*")
        edges = adaptive_edges(long.where("x is not null"), "x", ["feature"])
        parts.append(long.join(F.broadcast(edges), "feature").select("win", *columns, "feature", bin_of(F.col("x"), F.col("edges"), drop_outside).cast("string").alias("bin")))  # a row a feature
    if categorical:
        each = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("bin")) for c in categorical))
        parts.append(rows.select("win", *columns, F.explode(each).alias("f")).select("win", *columns, "f.*"))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return count_by_window(unpivot_slices(both, columns, ["feature", "win", "bin"]).where("slice_col <> feature"), _BY)


def localised_alerts(panel: DataFrame, w: Windows, numeric: Sequence[str], categorical: Sequence[str], k: int = 5, min_slice_size: int = MIN_SLICE_SIZE) -> DataFrame:
    """feature, rank, slice_col, slice_val, score, coverage: the k slices of each feature, numeric or categorical, whose own histograms moved most; all features in one job."""
    counts = _slice_bins(panel, w, numeric, categorical, COARSE_COLUMNS, False).where("bin is not null")
    total = panel.where(within(w.cur_start, w.cur_end)).agg(F.count("*").alias("total"))
    ranked = divergences(counts, _BY).where((F.col("ref_n") >= min_slice_size) & (F.col("cur_n") >= min_slice_size)).crossJoin(F.broadcast(total))  # one row
    return top_k(ranked.select(*_BY, F.col("js").alias("score"), (F.col("cur_n") / F.col("total")).alias("coverage")), k, ("feature",))


def fallback_alerts(panel: DataFrame, w: Windows, features: Sequence[str], columns: Sequence[str] = FALLBACK_COLUMNS, min_slice_size: int = MIN_SLICE_SIZE) -> DataFrame:
    """feature, js, l_inf, found_in: of each feature the most diverging slice of the first of `columns` that has a drifting one; features without any are left out. One job for all."""
    counts = _slice_bins(panel, w, features, (), columns, True)
    size = counts.groupBy(*_BY).agg(F.sum("n_ref").alias("_r"), F.sum("n_cur").alias("_c"))
    found = divergences(counts.where("bin is not null"), _BY).join(size, _BY).where((F.col("_r") >= min_slice_size) & (F.col("_c") >= min_slice_size) & is_drift(F.col("js"), F.col("l_inf")))
    order = F.struct(F.array_position(F.array(*map(F.lit, columns)), F.col("slice_col")).alias("at"), (-F.round("js", 12)).alias("js"), "slice_val")
    best = F.min_by(F.struct("js", "l_inf", F.concat_ws("=", "slice_col", "slice_val").alias("found_in")), order)
    return found.groupBy("feature").agg(best.alias("b")).select("feature", "b.*")


def reports(panel: DataFrame, w: Windows, k: int = 5, synthesizer: Callable[[DataFrame], DataFrame] = narrate, fallback: bool = True) -> DataFrame:
    """feature, js, l_inf, is_drift, found_in, slices, narrative, recommended_actions of every monitored feature, those without drift without slices.

    A numeric feature that does not drift as a whole may do so within a slice (`fallback`): its numbers are then the slice's, named in found_in. Every feature that drifts, categorical ones included,
    is localised, and no other: jobs are one scan, one look into slices and one ranking, however many features there are. A synthesizer is any function from alerts to reports; the default is rule-based and needs no network.
    """
    alerts = written(global_scan(panel, w).where(F.col("feature").isin(*NUMERIC, *CATEGORICAL)), "alerts")  # a row a feature
    quiet = [r["feature"] for r in alerts.where("not is_drift").collect() if r["feature"] in NUMERIC]
    alerts = alerts.withColumn("found_in", F.lit(None).cast("string"))
    if fallback and quiet:
        inside = fallback_alerts(panel, w, quiet).select("feature", F.col("js").alias("_js"), F.col("l_inf").alias("_l"), F.col("found_in").alias("_in"))
        alerts = alerts.join(F.broadcast(inside), "feature", "left")
        alerts = written(alerts.select("feature_ord", "feature", F.coalesce("_js", "js").alias("js"), F.coalesce("_l", "l_inf").alias("l_inf"), (F.col("is_drift") | F.col("_in").isNotNull()).alias("is_drift"), F.col("_in").alias("found_in")), "alerts")
    drifting = [r["feature"] for r in alerts.where("is_drift").orderBy("feature_ord").collect()]
    none = F.array().cast("array<struct<rank:int,slice_col:string,slice_val:string,score:double,coverage:double>>")
    out = alerts.withColumn("slices", none)
    if drifting:
        found = localised_alerts(panel, w, [f for f in drifting if f in NUMERIC], [f for f in drifting if f in CATEGORICAL], k)
        lists = found.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("rank", "slice_col", "slice_val", "score", "coverage"))).alias("_found"))  # k rows a feature
        out = alerts.join(F.broadcast(lists), "feature", "left").withColumn("slices", F.coalesce("_found", none)).drop("_found")
    return synthesizer(out).drop("feature_ord")
