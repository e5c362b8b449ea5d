"""Queries: slice rankings, bursts, combinations, the gated pipeline, and the hierarchy."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..operators import hierarchy, localise
from ..sources.panel import COARSE_COLUMNS, EVENT_WINDOWS, RETAIL_WINDOWS, SLICE_COLUMNS, event_panel, retail_panel
from . import sql as S
from .registry import query

TOP = "SELECT slice_col, slice_val, round(score, 9) AS score, round(coverage, 9) AS coverage, CAST(rank AS INT) AS rank"
RANK = "row_number() OVER (ORDER BY round(score, 12) DESC, slice_ord, slice_val) AS rank"


def _top(df):
    return df.select("slice_col", "slice_val", F.round("score", 9).alias("score"), F.round("coverage", 9).alias("coverage"), F.col("rank").cast("int").alias("rank"))


def within(panel: str, name: str, ref: str, cur: str, columns, out: str, prefix: str = "", least: int = 20) -> str:
    return (
        f"{S.tagged(prefix + 't', name, ref, cur)}, {S.edges(prefix + 'ed', prefix + 't', 'sales')}, {prefix}b AS (SELECT *, {S.bin_of('sales')} AS bin FROM {prefix}t, {prefix}ed WHERE sales IS NOT NULL), "
        f"{S.slices(prefix + 'u', prefix + 'b', 'win, bin', columns)}, {prefix}h AS (SELECT slice_col, slice_ord, slice_val, bin, {S.COUNTS} FROM {prefix}u GROUP BY ALL), "
        f"{S.js('slice_col, slice_ord, slice_val', prefix + 'h', prefix + 'd')}, "
        f"{out} AS (SELECT slice_col, slice_ord, slice_val, js AS score, c / (SELECT count(*) FROM {prefix}t WHERE win = 'cur')::DOUBLE AS coverage FROM {prefix}d WHERE r >= {least} AND c >= {least})"
    )


def burst(name: str, ref: str, cur: str, column: str, out: str, prefix: str = "") -> str:
    order = SLICE_COLUMNS.index(column)
    return (
        f"{S.tagged(prefix + 'bt', name, ref, cur)}, {prefix}day AS (SELECT CAST({column} AS VARCHAR) AS slice_val, win, date, sum(sales) AS total, count(*) AS n FROM {prefix}bt GROUP BY ALL), "
        f"{prefix}roll AS (SELECT *, CASE WHEN count(*) OVER w = 2 THEN sum(total) OVER w END AS roll FROM {prefix}day WINDOW w AS (PARTITION BY slice_val, win ORDER BY date ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)), "
        f"{prefix}agg AS (SELECT slice_val, coalesce(max(roll) FILTER (win = 'cur'), 0) AS cm, coalesce(max(roll) FILTER (win = 'ref'), 0) AS rm, avg(total) FILTER (win = 'ref') AS mean, coalesce(sum(n) FILTER (win = 'cur'), 0) AS n FROM {prefix}roll GROUP BY 1), "
        f"{out} AS (SELECT '{column}' AS slice_col, {order} AS slice_ord, slice_val, (cm - rm) / (mean + 0.5) AS score, n / (SELECT count(*) FROM {prefix}bt WHERE win = 'cur')::DOUBLE AS coverage FROM {prefix}agg WHERE mean IS NOT NULL AND n >= 20)"
    )


@query("k10_within_slice_topk", f"WITH {S.RETAIL}, {within(S.RETAIL, 'retail', S.RETAIL_REF, S.RETAIL_CUR, COARSE_COLUMNS, 's')}, k AS (SELECT *, {RANK} FROM s) {TOP} FROM k WHERE rank <= 5")
def k10(spark, sf_dir):
    """Top five slices by divergence within them."""
    return _top(localise.top_k(localise.rank_within_slices(retail_panel(spark, sf_dir), "sales", RETAIL_WINDOWS)))


@query("k10_within_slice_events", f"WITH {S.EVENTS}, {within(S.EVENTS, 'ev', S.EVENT_REF, S.EVENT_CUR, SLICE_COLUMNS, 's')}, k AS (SELECT *, {RANK} FROM s) {TOP} FROM k")
def k10_events(spark, sf_dir):
    """K10 over all five slice columns, every slice."""
    return _top(localise.top_k(localise.rank_within_slices(event_panel(spark, sf_dir), "sales", EVENT_WINDOWS, SLICE_COLUMNS), 1 << 30))


@query(
    "k11_removal",
    f"WITH {S.RETAIL}, {S.tagged('t', 'retail', S.RETAIL_REF, S.RETAIL_CUR)}, {S.edges('ed', 't', 'sales')}, b AS (SELECT *, {S.bin_of('sales')} AS bin, sales BETWEEN e[1] AND e[len(e)] AS inside FROM t, ed), "
    f"rp AS (SELECT bin, count(*) / sum(count(*)) OVER ()::DOUBLE AS p FROM b WHERE win = 'ref' AND inside GROUP BY bin), cb AS (SELECT * FROM b WHERE win = 'cur'), {S.slices('u', 'cb', 'bin', COARSE_COLUMNS)}, "
    "n AS (SELECT slice_col, slice_ord, slice_val, bin, count(*) AS n FROM u GROUP BY ALL), tot AS (SELECT slice_col, bin, sum(n) AS t FROM n GROUP BY ALL), "
    "v AS (SELECT slice_col, slice_ord, slice_val, sum(n) AS s FROM n GROUP BY ALL), allb AS (SELECT bin FROM rp UNION SELECT bin FROM tot), "
    "g AS (SELECT v.*, allb.bin, coalesce(p, 0) AS p, coalesce(t, 0) AS t, coalesce(n, 0) AS n, sum(coalesce(t, 0)) OVER (PARTITION BY v.slice_col, v.slice_val) AS tt "
    "FROM v CROSS JOIN allb LEFT JOIN rp ON rp.bin = allb.bin LEFT JOIN tot ON tot.slice_col = v.slice_col AND tot.bin = allb.bin LEFT JOIN n ON n.slice_col = v.slice_col AND n.slice_val = v.slice_val AND n.bin = allb.bin), "
    "q AS (SELECT *, t / tt::DOUBLE AS q, (t - n) / (tt - s)::DOUBLE AS rest FROM g WHERE s > 0 AND s < tt), "
    "s AS (SELECT slice_col, slice_ord, slice_val, sum(0.5 * (CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END)) "
    "- sum(0.5 * (CASE WHEN p > 0 THEN p * log2(2 * p / (p + rest)) ELSE 0 END + CASE WHEN rest > 0 THEN rest * log2(2 * rest / (p + rest)) ELSE 0 END)) AS score, max(s) / (SELECT count(*) FROM cb)::DOUBLE AS coverage FROM q GROUP BY ALL), "
    "x AS (SELECT * FROM s) SELECT slice_col, slice_val, round(score, 7) AS score, round(coverage, 9) AS coverage FROM x",
)
def k11(spark, sf_dir):
    """Divergence that goes when a slice goes, for every slice."""
    out = localise.rank_by_removal(retail_panel(spark, sf_dir), "sales", RETAIL_WINDOWS)
    return out.select("slice_col", "slice_val", F.round("score", 7).alias("score"), F.round("coverage", 9).alias("coverage"))


@query("k12_burst_topk", f"WITH {S.EVENTS}, {burst('ev', S.EVENT_REF, S.EVENT_CUR, 'item_id', 's')}, k AS (SELECT *, {RANK} FROM s) {TOP} FROM k WHERE rank <= 20")
def k12(spark, sf_dir):
    """Bursts of items."""
    return _top(localise.top_k(localise.rank_bursts(event_panel(spark, sf_dir), EVENT_WINDOWS), 20))


@query(
    "k13_gated_localisation",
    f"WITH {S.EVENTS}, {within(S.EVENTS, 'ev', S.EVENT_REF, S.EVENT_CUR, COARSE_COLUMNS, 's')}, {burst('ev', S.EVENT_REF, S.EVENT_CUR, 'item_id', 'bs', 'x')}, "
    f"c AS (SELECT *, {RANK} FROM s), y AS (SELECT *, {RANK} FROM bs), "
    f"go AS (SELECT coalesce((SELECT max(score) FROM c), 0) < 0.005 AND coalesce((SELECT max(score) FROM y), 0) > 60 AS use_burst), "
    "r AS (SELECT 'within_slice' AS method, * FROM c WHERE rank <= 5 AND NOT (SELECT use_burst FROM go) UNION ALL SELECT 'burst', * FROM y WHERE rank <= 5 AND (SELECT use_burst FROM go)), "
    f"cte AS (SELECT 1), {S.edges('ge', 'ev', 'sales')}, gb AS (SELECT win, {S.bin_of('sales')} AS bin FROM t, ed WHERE sales BETWEEN e[1] AND e[len(e)]), gh AS (SELECT bin, {S.COUNTS} FROM gb GROUP BY 1), {S.js('', 'gh', 'gd')}, "
    + ", ".join(
        f"f{i}b AS (SELECT CAST({c} AS VARCHAR) AS slice_val, win, {S.bin_of('sales')} AS bin FROM t, ge WHERE sales BETWEEN e[1] AND e[len(e)]), f{i}h AS (SELECT slice_val, bin, {S.COUNTS} FROM f{i}b GROUP BY 1, 2), {S.js('slice_val', f'f{i}h', f'f{i}')}"
        for i, c in enumerate(("cat_id", "item_id"))
    )
    + ", alert AS (SELECT CASE WHEN (SELECT js > 0.015 OR l_inf > 0.06 FROM gd) THEN 'global' WHEN EXISTS (SELECT 1 FROM f0 WHERE r >= 20 AND c >= 20 AND (js > 0.015 OR l_inf > 0.06)) OR EXISTS (SELECT 1 FROM f1 WHERE r >= 20 AND c >= 20 AND (js > 0.015 OR l_inf > 0.06)) THEN 'within_slice_fallback' END AS detected_by) "
    "SELECT detected_by, method, CAST(rank AS INT) AS rank, slice_col, slice_val, round(score, 9) AS score, round(coverage, 9) AS coverage FROM r, alert WHERE detected_by IS NOT NULL",
)
def k13(spark, sf_dir):
    """The gated two-stage localisation as one plan."""
    out = localise.detect_and_localise(event_panel(spark, sf_dir), EVENT_WINDOWS)
    return out.select("detected_by", "method", F.col("rank").cast("int").alias("rank"), "slice_col", "slice_val", F.round("score", 9).alias("score"), F.round("coverage", 9).alias("coverage"))


_PAIRS = [(a, b) for i, a in enumerate(COARSE_COLUMNS) for b in COARSE_COLUMNS[i + 1 :]]


@query(
    "k16_combinations",
    f"WITH {S.RETAIL}, {S.tagged('t', 'retail', S.RETAIL_REF, S.RETAIL_CUR)}, m AS (SELECT min(sales) AS lo, max(sales) AS hi FROM t), "
    "b AS (SELECT *, len(list_filter(range(1, 20), lambda i: sales >= lo + (hi - lo) * i / 20.0)) AS bin FROM t, m), rp AS (SELECT bin, count(*) FILTER (win = 'ref') AS r, count(*) FILTER (win = 'cur') AS t FROM b GROUP BY 1), "
    "u AS ("
    + " UNION ALL ".join([f"SELECT '{c}=' || {c} AS conditions, bin FROM b WHERE win = 'cur'" for c in COARSE_COLUMNS] + [f"SELECT '{a}=' || {a} || ' & {b}=' || {b}, bin FROM b WHERE win = 'cur'" for a, b in _PAIRS])
    + "), n AS (SELECT conditions, bin, count(*) AS n FROM u GROUP BY 1, 2), v AS (SELECT conditions, sum(n) AS s FROM n GROUP BY 1), tot AS (SELECT sum(t) AS tt, sum(r) AS rr FROM rp), "
    "g AS (SELECT v.conditions, s, tt, r / rr::DOUBLE AS p, t / tt::DOUBLE AS q, (t - coalesce(n, 0)) / (tt - s)::DOUBLE AS rest FROM v, tot, rp LEFT JOIN n ON n.conditions = v.conditions AND n.bin = rp.bin WHERE s / tt::DOUBLE >= 0.05 AND s < tt) "
    "SELECT conditions, round(sum(0.5 * (CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END)) "
    "- sum(0.5 * (CASE WHEN p > 0 THEN p * log2(2 * p / (p + rest)) ELSE 0 END + CASE WHEN rest > 0 THEN rest * log2(2 * rest / (p + rest)) ELSE 0 END)), 7) AS score, round(max(s / tt::DOUBLE), 9) AS coverage FROM g GROUP BY 1",
)
def k16(spark, sf_dir):
    """Every one- and two-slice conjunction with enough coverage, fixed bins, in one pass."""
    out = localise.combination_scores(retail_panel(spark, sf_dir), "sales", RETAIL_WINDOWS)
    name = F.array_join(F.transform("conditions", lambda c: F.concat(c["col"], F.lit("="), c["val"])), " & ")
    return out.select(name.alias("conditions"), F.round("score", 7).alias("score"), F.round("coverage", 9).alias("coverage"))


def _search_sql(rounds: int = 3) -> str:
    """The best-first search over conjunctions of as many slices as there are columns, its rounds written out."""
    sets = [s for k in range(1, len(COARSE_COLUMNS) + 1) for s in combinations(COARSE_COLUMNS, k)]
    each = " UNION ALL ".join("SELECT [" + ", ".join(f"'{c}=' || {c}" for c in s) + "] AS conditions, bin FROM b WHERE win = 'cur'" for s in sets)
    best, first = "ORDER BY round(eff, 12) DESC, conditions LIMIT 5", "split_part({}.conditions[1], '=', 1)"
    out = (
        f"WITH {S.RETAIL}, {S.tagged('t', 'retail', S.RETAIL_REF, S.RETAIL_CUR)}, m AS (SELECT min(sales) AS lo, max(sales) AS hi FROM t), "
        "b AS (SELECT *, len(list_filter(range(1, 20), lambda i: sales >= lo + (hi - lo) * i / 20.0)) AS bin FROM t, m), rp AS (SELECT bin, count(*) FILTER (win = 'ref') AS r, count(*) FILTER (win = 'cur') AS t FROM b GROUP BY 1), "
        f"u AS ({each}), n AS (SELECT conditions, bin, count(*) AS n FROM u GROUP BY 1, 2), v AS (SELECT conditions, sum(n) AS s FROM n GROUP BY 1), tot AS (SELECT sum(t) AS tt, sum(r) AS rr FROM rp), "
        "g AS (SELECT v.conditions, s, tt, r / rr::DOUBLE AS p, t / tt::DOUBLE AS q, (t - coalesce(n, 0)) / (tt - s)::DOUBLE AS rest FROM v, tot, rp LEFT JOIN n ON n.conditions = v.conditions AND n.bin = rp.bin WHERE s / tt::DOUBLE >= 0.05 AND s < tt), "
        "sc AS (SELECT *, score / greatest(coverage, 1e-6) AS eff FROM (SELECT conditions, sum(0.5 * (CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END)) "
        "- sum(0.5 * (CASE WHEN p > 0 THEN p * log2(2 * p / (p + rest)) ELSE 0 END + CASE WHEN rest > 0 THEN rest * log2(2 * rest / (p + rest)) ELSE 0 END)) AS score, max(s / tt::DOUBLE) AS coverage FROM g GROUP BY 1)), "
        f"sp AS (SELECT *, {first.format('sc')} AS c, row_number() OVER (ORDER BY round(eff, 12) DESC, conditions) AS place FROM sc WHERE len(conditions) = 1), "
        "so AS (SELECT *, min(place) OVER (PARTITION BY c) AS first, row_number() OVER (PARTITION BY c ORDER BY round(score, 12) DESC, place) AS own FROM sp WHERE place <= 15), "
        "f0 AS (SELECT conditions, score, coverage, eff FROM so WHERE own = 1 ORDER BY first LIMIT 5), go0 AS (SELECT true AS go)"
    )
    for i in range(1, rounds + 1):
        before = "".join(f" EXCEPT SELECT conditions FROM u{j}" for j in range(1, i))
        out += (
            f", u{i} AS (SELECT DISTINCT list_sort(list_distinct(list_concat(a.conditions, b.conditions))) AS conditions FROM f{i - 1} a, f{i - 1} b WHERE a.conditions < b.conditions AND {first.format('a')} <> {first.format('b')}{before}), "
            f"n{i} AS (SELECT sc.* FROM sc JOIN u{i} USING (conditions) {best}), go{i} AS (SELECT go AND coalesce((SELECT max(round(eff, 12)) FROM n{i}) > (SELECT max(round(eff, 12)) FROM f{i - 1}), false) AS go FROM go{i - 1}), "
            f"f{i} AS (SELECT * FROM f{i - 1} UNION ALL SELECT n{i}.* FROM n{i}, go{i} WHERE go)"
        )
    return out + f" SELECT CAST(row_number() OVER (ORDER BY round(eff, 12) DESC, conditions) AS INT) AS rank, array_to_string(conditions, ' & ') AS conditions, round(score, 7) AS score, round(coverage, 9) AS coverage FROM (SELECT * FROM f{rounds} {best})"


@query("k17_best_first_search", _search_sql())
def k17(spark, sf_dir):
    """The best-first search over conjunctions of any width, scored from the index of cells."""
    out = localise.search_conjunctions(retail_panel(spark, sf_dir), "sales", RETAIL_WINDOWS)
    name = F.array_join(F.transform("conditions", lambda c: F.concat(c["col"], F.lit("="), c["val"])), " & ")
    return out.select(F.col("rank").cast("int").alias("rank"), name.alias("conditions"), F.round("score", 7).alias("score"), F.round("coverage", 9).alias("coverage"))


@query(
    "k18_hierarchy_edges",
    f"WITH {S.RETAIL} SELECT DISTINCT 'dept_id' AS child_col, dept_id AS child_val, 'cat_id' AS parent_col, cat_id AS parent_val FROM retail UNION ALL SELECT DISTINCT 'store_id', store_id, 'state_id', state_id FROM retail UNION ALL SELECT DISTINCT 'item_id', item_id, 'dept_id', dept_id FROM retail",
)
def k18(spark, sf_dir):
    """The hierarchy's edges, each child under one parent."""
    return hierarchy.edges(retail_panel(spark, sf_dir))


@query(
    "k19_ancestors",
    f"WITH RECURSIVE {S.RETAIL}, e AS (SELECT DISTINCT 'item_id' AS cc, item_id AS cv, 'dept_id' AS pc, dept_id AS pv FROM retail UNION SELECT DISTINCT 'dept_id', dept_id, 'cat_id', cat_id FROM retail UNION SELECT DISTINCT 'store_id', store_id, 'state_id', state_id FROM retail), "
    "a AS (SELECT cc, cv, pc, pv, 1 AS depth FROM e UNION ALL SELECT a.cc, a.cv, e.pc, e.pv, a.depth + 1 FROM a JOIN e ON a.pc = e.cc AND a.pv = e.cv) "
    "SELECT cc AS col, cv AS val, pc AS ancestor_col, pv AS ancestor_val, CAST(depth AS INT) AS depth FROM a",
)
def k19(spark, sf_dir):
    """The closure of the edges (depth three at most)."""
    return hierarchy.closure(hierarchy.edges(retail_panel(spark, sf_dir)))


@query(
    "k20_related_slices",
    f"WITH {S.RETAIL}, {within(S.RETAIL, 'retail', S.RETAIL_REF, S.RETAIL_CUR, COARSE_COLUMNS, 's')}, k AS (SELECT *, {RANK} FROM s), p AS (SELECT DISTINCT dept_id, cat_id, store_id, state_id FROM retail) "
    "SELECT a.slice_col AS col_a, a.slice_val AS val_a, b.slice_col AS col_b, b.slice_val AS val_b FROM k a, k b WHERE "
    "a.slice_col = b.slice_col AND a.slice_val = b.slice_val OR EXISTS (SELECT 1 FROM p WHERE (a.slice_col = 'dept_id' AND b.slice_col = 'cat_id' AND dept_id = a.slice_val AND cat_id = b.slice_val) OR (b.slice_col = 'dept_id' AND a.slice_col = 'cat_id' AND dept_id = b.slice_val AND cat_id = a.slice_val) "
    "OR (a.slice_col = 'store_id' AND b.slice_col = 'state_id' AND store_id = a.slice_val AND state_id = b.slice_val) OR (b.slice_col = 'store_id' AND a.slice_col = 'state_id' AND store_id = b.slice_val AND state_id = a.slice_val))",
)
def k20(spark, sf_dir):
    """Which of all ranked slices are related to which."""
    panel = retail_panel(spark, sf_dir)
    ranked = localise.rank_within_slices(panel, "sales", RETAIL_WINDOWS)
    coarse = {c: p for c, p in hierarchy.PARENT_OF.items() if c in COARSE_COLUMNS}  # items are not ranked here
    return hierarchy.related_pairs(ranked, hierarchy.closure(hierarchy.edges(panel, coarse)))


@query(
    "k21_expanded_pool",
    f"WITH {S.EVENTS}, {within(S.EVENTS, 'ev', S.EVENT_REF, S.EVENT_CUR, COARSE_COLUMNS, 's')}, {within(S.EVENTS, 'ev', S.EVENT_REF, S.EVENT_CUR, ('item_id',), 'si', 'i')}, {burst('ev', S.EVENT_REF, S.EVENT_CUR, 'item_id', 'bs', 'x')}, "
    f"pa AS (SELECT *, {RANK} FROM s), pb AS (SELECT *, {RANK} FROM si), pc AS (SELECT *, {RANK} FROM bs), "
    "pool AS (SELECT slice_col, slice_val, coverage, score AS coarse_score, NULL::DOUBLE AS item_score, NULL::DOUBLE AS burst_score FROM pa WHERE rank <= 5 UNION ALL SELECT slice_col, slice_val, coverage, NULL, score, NULL FROM pb WHERE rank <= 5 UNION ALL SELECT slice_col, slice_val, coverage, NULL, NULL, score FROM pc WHERE rank <= 5), "
    "m AS (SELECT slice_col, slice_val, max(coverage) AS coverage, max(coarse_score) AS coarse_score, max(item_score) AS item_score, max(burst_score) AS burst_score FROM pool GROUP BY 1, 2) "
    "SELECT slice_col, slice_val, round(coverage, 9) AS coverage, round(coarse_score, 9) AS coarse_score, round(item_score, 9) AS item_score, round(burst_score, 9) AS burst_score, "
    "CAST(row_number() OVER (ORDER BY coarse_score IS NULL, coarse_score DESC NULLS LAST, greatest(coalesce(item_score, 0), coalesce(burst_score / 100, 0)) DESC, slice_col, slice_val) AS INT) AS pool_rank FROM m",
)
def k21(spark, sf_dir):
    """K21, G6, DM14: coarse, item divergence and item burst candidates merged into one pool."""
    p = event_panel(spark, sf_dir)
    pool = localise.merged_pool(
        localise.top_k(localise.rank_within_slices(p, "sales", EVENT_WINDOWS)), localise.top_k(localise.rank_within_slices(p, "sales", EVENT_WINDOWS, ("item_id",))), localise.top_k(localise.rank_bursts(p, EVENT_WINDOWS))
    )
    return pool.select("slice_col", "slice_val", *(F.round(c, 9).alias(c) for c in ("coverage", "coarse_score", "item_score", "burst_score")), F.col("pool_rank").cast("int").alias("pool_rank"))
