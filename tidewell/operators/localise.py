"""Localisation: which slices moved? Ranking by divergence within slices, by removal, by bursts, over combinations; and the gated pipeline."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binning import N_BINS, adaptive_edges, bin_of, equal_width_edges
from ..functions.divergence import divergences, jsd_terms
from ..sources.panel import COARSE_COLUMNS, SLICE_COLUMNS, Windows, tag, unpivot_slices
from ..sources.written import written
from .detect import MIN_SLICE_SIZE, count_by_window, is_drift, scan_within_slices

#: Below the first bar the coarse ranking gives way to bursts; above the second the burst list is taken.
COARSE_BAR, BURST_BAR, TOP_K = 0.005, 60.0, 5
SPIKE_DAYS, BURST_EPS = 2, 0.5
MIN_COVERAGE, SEED_COLUMNS = 0.05, 5


def top_k(candidates: DataFrame, k: int = TOP_K, keys: Sequence[str] = (), score: str = "score") -> DataFrame:
    """The k best with `rank`; ties by slice column order, then value. Without keys a distributed top-k, with keys one per group.

    Scores are compared to 12 decimals: two slices of the same rows have one score, whatever the order in which its terms were added.
    """
    order = [F.desc(F.round(score, 12)), F.asc("slice_ord"), F.asc("slice_val")]
    if not keys:
        best = candidates.orderBy(*order).limit(k)
        return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # k rows
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def _tagged(panel: DataFrame, w: Windows | None, columns: Sequence[str]) -> DataFrame:
    return panel.select(*columns, "win") if w is None else tag(panel.select(*columns, "date"), w)


def slice_histograms(panel: DataFrame, feature: str, w: Windows | None, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """keys, slice_col, slice_ord, slice_val, bin, n_ref, n_cur: every slice's histograms in one aggregation; values beyond the edges fall into the end bins."""
    rows = _tagged(panel, w, [*keys, feature, *(c for c in columns if c != feature)])
    edges = adaptive_edges(rows.where(F.col(feature).isNotNull()), feature, keys)
    # A row a key (trial or window): a join by key would move every row of a trial to one task, and all that follows with it.
    binned = rows.join(F.broadcast(edges), list(keys)) if keys else rows.crossJoin(F.broadcast(edges))
    binned = binned.withColumn("bin", bin_of(F.col(feature).cast("double"), F.col("edges"), False)).where("bin is not null")
    # Counted by all slice columns at once first would be as wide as the items; by each it is what the result needs.
    return count_by_window(unpivot_slices(binned, [c for c in columns if c != feature], [*keys, "win", "bin"]), [*keys, "slice_col", "slice_ord", "slice_val"])


#: The slice that holds all rows, in the table of slice_counts.
ALL = "_all_"


def slice_counts(panel: DataFrame, feature: str, w: Windows, columns: Sequence[str] = COARSE_COLUMNS) -> DataFrame:
    """slice_col, slice_ord, slice_val, bin, inside, n_ref, n_cur: a written table of the histograms of every slice, and of all rows under slice_col ALL.

    Two passes over the panel, one for the edges and one for the counts; what is asked of the histograms afterwards reads this table only.
    bin is null where the feature is; values outside the edges are in the end bins, with inside false.
    """
    rows = tag(panel.select(feature, "date", *(c for c in columns if c != feature)), w)
    # One row of some twenty numbers: as literals they keep the comparisons short enough to be compiled; met as a joined array they don't.
    edges = [F.lit(float(e)) for e in adaptive_edges(rows.where(F.col(feature).isNotNull()), feature).first()["edges"]]
    x = F.col(feature).cast("double")
    inside = F.coalesce((x >= edges[0]) & (x <= edges[-1]), F.lit(False))
    binned = rows.withColumn(ALL, F.lit(ALL)).withColumns({"bin": bin_of(x, F.array(*edges), False), "inside": inside})
    long = unpivot_slices(binned, [*(c for c in columns if c != feature), ALL], ["win", "bin", "inside"])
    return written(count_by_window(long, ["slice_col", "slice_ord", "slice_val", "inside"]), "slice-counts", few=False)


def _total(counts: DataFrame) -> DataFrame:
    """One row: the current rows, those without a value included."""
    return counts.where(F.col("slice_col") == ALL).agg(F.coalesce(F.sum("n_cur"), F.lit(0)).alias("total"))


def _rank_histograms(counts: DataFrame, total: DataFrame, min_slice_size: int, keys: Sequence[str] = ()) -> DataFrame:
    out = divergences(counts, [*keys, "slice_col", "slice_ord", "slice_val"]).where((F.col("ref_n") >= min_slice_size) & (F.col("cur_n") >= min_slice_size))
    out = out.join(total, list(keys)) if keys else out.crossJoin(F.broadcast(total))
    return out.select(*keys, "slice_col", "slice_ord", "slice_val", F.col("js").alias("score"), (F.col("cur_n") / F.col("total")).alias("coverage"))


def rank_counts_within(counts: DataFrame, min_slice_size: int = MIN_SLICE_SIZE) -> DataFrame:
    """rank_within_slices from the table of slice_counts."""
    own = counts.where(F.col("bin").isNotNull() & (F.col("slice_col") != ALL)).groupBy("slice_col", "slice_ord", "slice_val", "bin").agg(F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur"))
    return _rank_histograms(own, _total(counts), min_slice_size)


def rank_within_slices(panel: DataFrame, feature: str, w: Windows | None, columns: Sequence[str] = COARSE_COLUMNS, min_slice_size: int = MIN_SLICE_SIZE, keys: Sequence[str] = ()) -> DataFrame:
    """slice_col, slice_ord, slice_val, score, coverage of every slice with enough rows in both windows: divergence of its own two histograms.

    coverage: its current rows over all current rows, those without a value included. Under keys (a trial or window id) all is done in one lazy plan.
    """
    if w is not None and not keys:
        return rank_counts_within(slice_counts(panel, feature, w, columns), min_slice_size)
    total = _tagged(panel, w, list(keys)).where("win = 'cur'").groupBy(*keys).agg(F.count("*").alias("total"))
    return _rank_histograms(slice_histograms(panel, feature, w, columns, keys), total, min_slice_size, keys)


def rank_by_removal(panel: DataFrame, feature: str, w: Windows, columns: Sequence[str] = COARSE_COLUMNS) -> DataFrame:
    """Score: how much the divergence falls when a slice's rows leave the current window. The rest's histogram is the whole's less the slice's.

    The reference side drops values outside the edges, the current side puts them into the end bins.
    """
    counts = slice_counts(panel, feature, w, columns)
    total = _total(counts)
    counts = counts.where("bin is not null")
    every = counts.where(F.col("slice_col") == ALL).groupBy("bin").agg(F.sum(F.when(F.col("inside"), F.col("n_ref")).otherwise(0)).alias("r"), F.sum("n_cur").alias("t"))
    slices = counts.where(F.col("slice_col") != ALL)
    slice_key = ["slice_col", "slice_ord", "slice_val"]
    own = slices.groupBy(*slice_key, "bin").agg(F.sum("n_cur").alias("n")).where("n > 0")
    # The whole of a slice column's rows: those without a value in it are in no slice.
    whole = own.groupBy("slice_col", "bin").agg(F.sum("n").alias("t"))
    columns_found = whole.select("slice_col").distinct()
    bins = every.select("bin", "r").crossJoin(F.broadcast(columns_found)).join(whole, ["slice_col", "bin"], "left").withColumn("t", F.coalesce("t", F.lit(0)))  # bins times slice columns
    grid = own.select(*slice_key).distinct().join(F.broadcast(bins), "slice_col")
    full = grid.join(own, [*slice_key, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    part = Window.partitionBy(*slice_key)
    full = full.withColumns({"all_r": F.sum("r").over(part), "all_t": F.sum("t").over(part), "all_n": F.sum("n").over(part)})
    p, q = F.try_divide("r", "all_r"), F.try_divide("t", "all_t")
    rest = F.try_divide(F.col("t") - F.col("n"), F.col("all_t") - F.col("all_n"))
    scores = full.groupBy(*slice_key).agg((F.sum(jsd_terms(p, q)) - F.sum(jsd_terms(p, rest))).alias("score"), F.max("all_n").alias("all_n"), F.max("all_t").alias("all_t"))
    return scores.where("all_n > 0 and all_n < all_t").crossJoin(F.broadcast(total)).select(*slice_key, "score", (F.col("all_n") / F.col("total")).alias("coverage"))


def rank_bursts(panel: DataFrame, w: Windows | None, slice_col: str = "item_id", feature: str = "sales", spike_days: int = SPIKE_DAYS, min_rows: int = MIN_SLICE_SIZE, keys: Sequence[str] = ()) -> DataFrame:
    """Score: (largest sum over spike_days observed days in the current window, less that of the reference) / (reference daily mean + 0.5), of daily sums.

    Slices need rows in both windows and min_rows current rows; a window with fewer days than a spike has largest sum 0.
    """
    daily = panel.select(*keys, "date", "win", slice_col, feature) if w is None else tag(panel.select(slice_col, "date", feature), w)
    daily = daily.groupBy(*keys, F.col(slice_col).cast("string").alias("slice_val"), "win", "date").agg(F.coalesce(F.sum(feature), F.lit(0.0)).alias("total"), F.count("*").alias("rows"))
    frame = Window.partitionBy(*keys, "slice_val", "win").orderBy("date").rowsBetween(1 - spike_days, 0)
    rolled = daily.withColumn("roll", F.when(F.count("*").over(frame) == spike_days, F.sum("total").over(frame)))
    of = lambda win, x: F.when(F.col("win") == win, x)
    out = rolled.groupBy(*keys, "slice_val").agg(
        F.coalesce(F.max(of("cur", F.col("roll"))), F.lit(0.0)).alias("cur_max"), F.coalesce(F.max(of("ref", F.col("roll"))), F.lit(0.0)).alias("ref_max"), F.avg(of("ref", F.col("total"))).alias("ref_mean"), F.coalesce(F.sum(of("cur", F.col("rows"))), F.lit(0)).alias("cur_n")
    )
    total = daily.where("win = 'cur'").groupBy(*keys).agg(F.sum("rows").alias("total"))
    out = out.where(F.col("ref_mean").isNotNull() & (F.col("cur_n") >= min_rows))
    out = out.join(total, list(keys)) if keys else out.crossJoin(F.broadcast(total))
    score = (F.col("cur_max") - F.col("ref_max")) / (F.col("ref_mean") + BURST_EPS)
    order = SLICE_COLUMNS.index(slice_col) if slice_col in SLICE_COLUMNS else 0
    return out.select(*keys, F.lit(slice_col).alias("slice_col"), F.lit(order).alias("slice_ord"), "slice_val", score.alias("score"), (F.col("cur_n") / F.col("total")).alias("coverage"))


@dataclass(frozen=True)
class Config:
    """Thresholds of the pipeline."""

    coarse_columns: tuple[str, ...] = COARSE_COLUMNS
    burst_column: str = "item_id"
    coarse_bar: float = COARSE_BAR
    burst_bar: float = BURST_BAR
    fallback_columns: tuple[str, ...] = ("cat_id", "item_id")
    min_slice_size: int = MIN_SLICE_SIZE
    top_k: int = TOP_K
    bursts_always: bool = False


def detect_and_localise(panel: DataFrame, w: Windows, cfg: Config = Config(), feature: str = "sales") -> DataFrame:
    """detected_by, method, rank, slice_col, slice_val, score, coverage: the gated two-stage localisation.

    The scan of the feature, or the first drifting slice of a fallback column, opens the gate. The coarse ranking is taken, unless its best is
    missing or under coarse_bar and the best burst is over burst_bar. The scan and the coarse ranking come from one table of counts; fallback
    scans and bursts read the panel again, only where the gates (a row each) ask for them.
    """
    counts = slice_counts(panel, feature, w, cfg.coarse_columns)
    every = counts.where((F.col("slice_col") == ALL) & F.col("inside") & F.col("bin").isNotNull()).groupBy("bin").agg(F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur"))
    scan = divergences(every, []).select(is_drift(F.col("js"), F.col("l_inf")).alias("fired")).first()
    found = "global" if scan and scan["fired"] else None
    for c in cfg.fallback_columns if found is None else ():
        if not scan_within_slices(panel, feature, c, w, cfg.min_slice_size).isEmpty():
            found = "within_slice_fallback"
            break
    chosen = top_k(rank_counts_within(counts, cfg.min_slice_size), cfg.top_k)
    method, best = "within_slice", chosen.agg(F.max("score")).first()[0] if found else None
    if found and (cfg.bursts_always or (best or 0.0) < cfg.coarse_bar):
        burst = written(top_k(rank_bursts(panel, w, cfg.burst_column, feature, min_rows=cfg.min_slice_size), cfg.top_k), "bursts")
        if (burst.agg(F.max("score")).first()[0] or 0.0) > cfg.burst_bar:
            method, chosen = "burst", burst
    out = chosen.select(F.lit(found).cast("string").alias("detected_by"), F.lit(method).alias("method"), "rank", "slice_col", "slice_val", "score", "coverage")
    return out if found else out.where("false")


# ---- conjunctions of slices


CONDITIONS = "array<struct<col:string,val:string>>"


@dataclass(frozen=True)
class ConjunctionIndex:
    """cells: a row a combination of frequent values (null: another value) with its counts by bin, `ref` and `cur`; a written table that any conjunction is scored from."""

    cells: DataFrame
    columns: tuple[str, ...]
    min_coverage: float


def conjunction_index(panel: DataFrame, feature: str, w: Windows, columns: Sequence[str] = COARSE_COLUMNS, min_coverage: float = MIN_COVERAGE, n_bins: int = N_BINS) -> ConjunctionIndex:
    """Two passes over the windows: edges and frequent values, then counts.

    A conjunction covers no more than any of its slices, so only values with enough coverage can be in one, at most 1 / min_coverage a column. All others are one value, and cells are few
    whatever the rows: what a conjunction of any width covers is a sum over cells. Equal-width bins over both windows; rows without the feature are left out.
    """
    columns = tuple(c for c in columns if c != feature)
    rows = tag(panel.select(feature, "date", *columns), w).where(F.col(feature).isNotNull())
    edges = written(equal_width_edges(rows, feature, n_bins), "edges")
    size = unpivot_slices(rows.where("win = 'cur'").withColumn(ALL, F.lit(ALL)), [*columns, ALL], ["win"]).groupBy("slice_col", "slice_val").agg(F.count("*").alias("n"))
    size = written(size, "slice-sizes", few=False)
    total = size.where(F.col("slice_col") == ALL).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    frequent = size.where(F.col("slice_col") != ALL).crossJoin(F.broadcast(total)).where(F.col("n") / F.col("total") >= min_coverage).collect()  # at most 1 / min_coverage a column
    known = {c: [r["slice_val"] for r in frequent if r["slice_col"] == c] for c in columns}
    value = [F.when(F.col(c).cast("string").isin(known[c]), F.col(c).cast("string")).alias(c) if known[c] else F.lit(None).cast("string").alias(c) for c in columns]
    binned = rows.crossJoin(F.broadcast(edges)).select(*value, "win", bin_of(F.col(feature).cast("double"), F.col("edges"), True).alias("bin"))  # one row
    # Counted by bin first: a row a cell, window and bin, before these become arrays.
    counts = binned.groupBy(*columns, "win", "bin").agg(F.count("*").alias("n"))
    by = lambda win: F.array(*(F.coalesce(F.sum(F.when((F.col("win") == win) & (F.col("bin") == i), F.col("n"))), F.lit(0)) for i in range(n_bins))).alias(win)
    return ConjunctionIndex(written(counts.groupBy(*columns).agg(by("ref"), by("cur")).withColumn("cell", F.monotonically_increasing_id()), "cells", few=False), columns, min_coverage)


def _sums(name: str, n_bins: int = N_BINS) -> Column:
    return F.array(*(F.sum(F.get(name, F.lit(i))) for i in range(n_bins)))


def _of_counts(index: ConjunctionIndex, counts: DataFrame) -> DataFrame:
    """conditions, score, coverage, efficiency of conjunctions (conditions, cur: counts by bin) with enough coverage that are not all rows."""
    whole = index.cells.agg(_sums("ref").alias("_r"), _sums("cur").alias("_t"))  # one row
    add = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    full = counts.crossJoin(F.broadcast(whole)).withColumns({"_n": add("cur"), "_all_r": add("_r"), "_all_t": add("_t")})
    full = full.where((F.col("_n") / F.col("_all_t") >= index.min_coverage) & (F.col("_n") < F.col("_all_t")))
    at = lambda c, i: F.get(c, F.lit(i))
    terms = []
    for i in range(N_BINS):
        p, q, rest = F.try_divide(at("_r", i), "_all_r"), F.try_divide(at("_t", i), "_all_t"), F.try_divide(at("_t", i) - at("cur", i), F.col("_all_t") - F.col("_n"))
        terms.append(jsd_terms(p, q) - jsd_terms(p, rest))
    scores = full.select("conditions", sum(terms[1:], terms[0]).alias("score"), (F.col("_n") / F.col("_all_t")).alias("coverage"))
    return scores.withColumn("efficiency", F.col("score") / F.greatest("coverage", F.lit(1e-6)))


def score_conjunctions(index: ConjunctionIndex, conjunctions: DataFrame) -> DataFrame:
    """conditions, score, coverage, efficiency of the given conjunctions (conditions: array of col and val, of any width) that have enough coverage, from the index alone.

    A conjunction meets the cells that hold its first condition, then those among them that hold as many of its conditions as it has.
    """
    columns = F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).alias("val")) for c in index.columns))
    held = index.cells.select("cell", "cur", F.explode(F.filter(columns, lambda x: x["val"].isNotNull())).alias("c")).select("cell", "cur", "c.col", "c.val")
    asked = conjunctions.select(F.array_sort(F.array_distinct(F.col("conditions").cast(CONDITIONS))).alias("conditions")).distinct()
    asked = asked.select("conditions", F.explode("conditions").alias("c")).select("conditions", "c.col", "c.val")
    met = held.join(asked, ["col", "val"]).groupBy("conditions", "cell").agg(F.count("*").alias("k"), F.first("cur").alias("cur")).where(F.col("k") == F.size("conditions"))
    return _of_counts(index, met.groupBy("conditions").agg(_sums("cur").alias("cur")))


def combination_scores(panel: DataFrame, feature: str, w: Windows, columns: Sequence[str] = COARSE_COLUMNS, size: int = 2, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """conditions (array of column and value), score, coverage, efficiency of every conjunction of up to `size` slices with enough coverage; the score is the divergence removed. Cells, not rows, are handed to the sets of columns."""
    index = conjunction_index(panel, feature, w, columns, min_coverage)
    sets = [s for k in range(1, size + 1) for s in combinations(index.columns, k)]
    each = F.array(*(F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).alias("val")) for c in s)) for s in sets))
    rows = index.cells.select("cur", F.explode(F.filter(each, lambda s: F.forall(s, lambda x: x["val"].isNotNull()))).alias("conditions"))
    return _of_counts(index, rows.groupBy("conditions").agg(_sums("cur").alias("cur")))


def search_conjunctions(panel: DataFrame, feature: str, w: Windows, columns: Sequence[str] = COARSE_COLUMNS, top: int = SEED_COLUMNS, keep: int = TOP_K, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """best_first() over conjunctions of any width: unions are scored from the index when they come up, and no others are."""
    index = conjunction_index(panel, feature, w, columns, min_coverage)
    each = F.array(*(F.array(F.struct(F.lit(c).alias("col"), F.col(c).alias("val"))) for c in index.columns))
    singles = index.cells.select(F.explode(F.filter(each, lambda s: s[0]["val"].isNotNull())).alias("conditions")).distinct()
    return best_first(score_conjunctions(index, singles), top, keep, lambda fresh: score_conjunctions(index, fresh))


def best_first(scored: DataFrame, top: int = SEED_COLUMNS, keep: int = TOP_K, look_up: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """rank, conditions, score, coverage, efficiency: what a best-first search over conjunctions ends with. scored: all of them (of combination_scores), or single slices and look_up for unions.

    Seeds: of the 3 * top most efficient slices the best-scored of each column, `top` columns at most. Rounds: unions of two members whose first columns
    differ, looked up among the scored and not met before; while the most efficient of them beats all so far, the `top` best join the members.
    Conjunctions that have no score (too little coverage) are never members. Each round is a small written table.
    """
    order = [F.desc(F.round("efficiency", 12)), F.asc("conditions")]
    scored = written(scored.select(F.array_sort("conditions").alias("conditions"), "score", "coverage", "efficiency"), "scored")
    place = scored.where(F.size("conditions") == 1).withColumn("place", F.row_number().over(Window.orderBy(*order)))  # at most 1 / MIN_COVERAGE a column
    of_column = Window.partitionBy(F.col("conditions")[0]["col"])
    seeds = place.where(F.col("place") <= 3 * top).withColumns({"first": F.min("place").over(of_column), "own": F.row_number().over(of_column.orderBy(F.desc(F.round("score", 12)), "place"))})
    seeds = seeds.where("own = 1").orderBy("first").limit(top)
    members, met = written(seeds.select(*scored.columns), "members"), None
    lead = members.agg(F.max(F.round("efficiency", 12))).first()[0]
    while lead is not None:
        a, b = (members.select(F.col("conditions").alias(n)) for n in "ab")
        pairs = a.join(F.broadcast(b), (F.col("a") < F.col("b")) & (F.col("a")[0]["col"] != F.col("b")[0]["col"]))  # a few members each
        fresh = pairs.select(F.array_sort(F.array_union("a", "b")).alias("conditions")).distinct()
        fresh = written(fresh if met is None else fresh.join(met, "conditions", "left_anti"), "unions")
        met = fresh if met is None else written(met.unionByName(fresh), "met")
        found = look_up(fresh) if look_up else scored.join(F.broadcast(fresh), "conditions")
        found = written(found.select(*members.columns).orderBy(*order).limit(top), "found")
        best = found.agg(F.max(F.round("efficiency", 12))).first()[0]
        if best is None or best <= lead:
            break
        lead, members = best, written(members.unionByName(found.select(*members.columns)), "members")
    return members.orderBy(*order).limit(keep).withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # keep rows


def merged_pool(coarse: DataFrame, item_divergence: DataFrame, item_burst: DataFrame) -> DataFrame:
    """slice_col, slice_val, coverage and the score of each source, a row a candidate: coarse ones by score, then others by the larger of divergence and burst / 100."""
    none = F.lit(None).cast("double")
    parts = [
        coarse.select("slice_col", "slice_val", "coverage", F.col("score").alias("coarse_score"), none.alias("item_score"), none.alias("burst_score")),
        item_divergence.select("slice_col", "slice_val", "coverage", none.alias("coarse_score"), F.col("score").alias("item_score"), none.alias("burst_score")),
        item_burst.select("slice_col", "slice_val", "coverage", none.alias("coarse_score"), none.alias("item_score"), F.col("score").alias("burst_score")),
    ]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("slice_col", "slice_val").agg(F.max("coverage").alias("coverage"), *(F.max(c).alias(c) for c in ("coarse_score", "item_score", "burst_score")))
    other: Column = F.greatest(F.coalesce("item_score", F.lit(0.0)), F.coalesce(F.col("burst_score") / 100, F.lit(0.0)))
    order = Window.orderBy(F.col("coarse_score").isNull(), F.desc_nulls_last("coarse_score"), F.desc(other), "slice_col", "slice_val")
    return merged.withColumn("pool_rank", F.row_number().over(order))  # a few candidates of each source
