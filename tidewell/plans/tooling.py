"""Queries: analysis tools and the fault checker."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality, tools
from ..operators.inject import Injection, zero_fill
from ..sources.panel import EVENT_WINDOWS, RETAIL_WINDOWS, Windows, event_panel, read, retail_panel
from . import sql as S
from .localisation import within as within_sql
from .registry import query

_R = lambda *names, d=9: [F.round(n, d).alias(n) for n in names]


@query(
    "p1_slice_history",
    f"WITH {S.RETAIL}, d AS (SELECT store_id AS v, date, sum(sales) / count(*)::DOUBLE AS m FROM retail GROUP BY ALL), f AS (SELECT min(date) AS first FROM d WHERE date < DATE '2001-01-01'), "
    "k AS (SELECT k, DATE '2001-01-01' - CAST(7 * k + 90 AS INT) AS a, DATE '2001-01-01' - CAST(7 * k + 31 AS INT) AS b, DATE '2001-01-01' - CAST(7 * k + 1 AS INT) AS e FROM (SELECT unnest(range(1, 40)) AS k)), "
    f"n AS (SELECT v, avg(m) FILTER ({S.RETAIL_REF}) AS r, avg(m) FILTER ({S.RETAIL_CUR}) AS c FROM d GROUP BY 1), p AS (SELECT v, r, c, (c - r) / (r + 0.05) AS pct FROM n), "
    "w AS (SELECT v, k, avg(m) FILTER (date <= b) AS r, avg(m) FILTER (date > b) AS c FROM d, f, k WHERE a >= first AND date BETWEEN a AND e GROUP BY 1, 2), h AS (SELECT v, abs((c - r) / (r + 0.05)) AS x FROM w WHERE r IS NOT NULL AND c IS NOT NULL) "
    "SELECT v AS slice_val, round(p.r, 9) AS ref_mean, round(p.c, 9) AS cur_mean, round(pct, 9) AS pct_change, round(quantile_cont(x, 0.9), 9) AS own_p90, round(avg(CAST(x <= abs(pct) AS INT)) * 100, 6) AS percentile, count(*) AS n_past, round(abs(pct) / (quantile_cont(x, 0.9) + 1e-9), 6) AS change_vs_own_p90 FROM p JOIN h USING (v) GROUP BY v, p.r, p.c, pct",
)
def p1(spark, sf_dir):
    """Every store's change beside its own history."""
    h = tools.history(retail_panel(spark, sf_dir), "store_id", RETAIL_WINDOWS)
    return h.select("slice_val", *_R("ref_mean", "cur_mean", "pct_change", "own_p90"), *_R("percentile", d=6), "n_past", *_R("change_vs_own_p90", d=6))


@query(
    "p4_breakdown",
    f"WITH {S.RETAIL}, {S.tagged('t', 'retail', S.RETAIL_REF, S.RETAIL_CUR)}, "
    + ", ".join(
        f"{n} AS (SELECT {k}, coalesce(sum(sales) FILTER (win = 'cur'), 0) / greatest(count(DISTINCT date) FILTER (win = 'cur'), 1) - coalesce(sum(sales) FILTER (win = 'ref'), 0) / greatest(count(DISTINCT date) FILTER (win = 'ref'), 1) AS delta, "
        f"(coalesce(avg(sales) FILTER (win = 'cur'), 0) - coalesce(avg(sales) FILTER (win = 'ref'), 0)) / (coalesce(avg(sales) FILTER (win = 'ref'), 0) + 0.05) AS pct FROM t GROUP BY {k})"
        for n, k in (("g", "state_id, cat_id"), ("h", "state_id"))
    )
    + " SELECT g.state_id AS slice_val, g.cat_id AS \"group\", round(g.pct, 9) AS pct, round(CASE WHEN abs(h.delta) > 1e-9 THEN g.delta / h.delta END, 6) AS share, CASE WHEN h.pct >= 0 THEN g.pct >= h.pct / 2 ELSE g.pct <= h.pct / 2 END AS follows FROM g JOIN h ON g.state_id = h.state_id",
)
def p4(spark, sf_dir):
    """Where each state's change lives, by category."""
    return tools.breakdown(retail_panel(spark, sf_dir), "state_id", "cat_id", RETAIL_WINDOWS).select("slice_val", "group", *_R("pct"), *_R("share", d=6), "follows")


@query(
    "p5_compare_windows",
    f"WITH {S.RETAIL}, {within_sql(S.RETAIL, 'retail', S.RETAIL_REF, S.RETAIL_CUR, ('store_id',), 's')}, z AS (SELECT store_id, avg(CAST(sales = 0 AS INT)) FILTER (win = 'ref') AS ref_zero, avg(CAST(sales = 0 AS INT)) FILTER (win = 'cur') AS cur_zero FROM t GROUP BY 1) "
    "SELECT slice_val, round(score, 9) AS js, CAST(row_number() OVER (ORDER BY round(score, 12) DESC, slice_val) AS INT) AS place, count(*) OVER () AS of_n, round(median(score) OVER (), 9) AS column_median_js, round(coverage, 9) AS coverage, round(ref_zero, 9) AS ref_zero, round(cur_zero, 9) AS cur_zero FROM s JOIN z ON store_id = slice_val",
)
def p5(spark, sf_dir):
    """Divergence, rank of n, column median, zero shares."""
    c = tools.compare_windows(retail_panel(spark, sf_dir), "store_id", RETAIL_WINDOWS)
    return c.select("slice_val", *_R("js"), "place", "of_n", *_R("column_median_js", "coverage", "ref_zero", "cur_zero"))


@query(
    "p6_days_above",
    f"WITH {S.EVENTS}, d AS (SELECT item_id AS v, date, sum(sales) / count(*)::DOUBLE AS m FROM ev GROUP BY ALL), t AS (SELECT v, max(m) AS top FROM d WHERE {S.EVENT_REF} GROUP BY 1) SELECT v AS slice_val, count(*) FILTER (m > top) AS n_days FROM d JOIN t USING (v) WHERE {S.EVENT_CUR} GROUP BY 1",
)
def p6(spark, sf_dir):
    """Days above the reference's highest."""
    return tools.days_above(event_panel(spark, sf_dir), "item_id", EVENT_WINDOWS)


_MONTHS = ", ".join(f"avg(m) FILTER (ceil(datediff('day', date, DATE '{RETAIL_WINDOWS.cur_start}') / 30.0) = {k})" for k in range(12, 0, -1))
_BLOCKS = ", ".join(f"avg(m) FILTER ({S.RETAIL_CUR} AND block = {b})" for b in range(6))


@query(
    "p2_slice_detail",
    f"WITH {S.RETAIL}, d AS (SELECT state_id AS slice_val, date, avg(sales) AS m FROM retail GROUP BY ALL), o AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM d WHERE {S.RETAIL_CUR})), "
    "k AS (SELECT date, CASE WHEN i < (n % 6) * (n // 6 + 1) THEN i // (n // 6 + 1) ELSE n % 6 + (i - (n % 6) * (n // 6 + 1)) // (n // 6) END AS block FROM o), "
    f"g AS (SELECT slice_val, [{_MONTHS}] AS months, [{_BLOCKS}] AS blocks, max(m) FILTER ({S.RETAIL_REF}) / (avg(m) FILTER ({S.RETAIL_REF}) + 1e-9) AS ref_max, max(m) FILTER ({S.RETAIL_CUR}) / (avg(m) FILTER ({S.RETAIL_REF}) + 1e-9) AS cur_max, avg(m) FILTER ({S.RETAIL_REF}) AS a, avg(m) FILTER ({S.RETAIL_CUR}) AS c FROM d LEFT JOIN k USING (date) GROUP BY 1), "
    f"{S.tagged('t', 'retail', S.RETAIL_REF, S.RETAIL_CUR)}, "
    + ", ".join(
        f"{n} AS (SELECT {k}, coalesce(sum(sales) FILTER (win = 'cur'), 0) / greatest(count(DISTINCT date) FILTER (win = 'cur'), 1) - coalesce(sum(sales) FILTER (win = 'ref'), 0) / greatest(count(DISTINCT date) FILTER (win = 'ref'), 1) AS delta FROM t GROUP BY {k})"
        for n, k in (("bg", "state_id, cat_id"), ("bh", "state_id"))
    )
    + ", b AS (SELECT bg.state_id, bg.cat_id, bg.delta / bh.delta AS share FROM bg JOIN bh ON bg.state_id = bh.state_id QUALIFY row_number() OVER (PARTITION BY bg.state_id ORDER BY round(abs(bg.delta / bh.delta), 12) DESC NULLS LAST, bg.cat_id) <= 5) "
    "SELECT slice_val, round(a, 9) AS ref_mean, round(c, 9) AS cur_mean, round((c - a) / (a + 0.05), 9) AS pct_change, list_transform(months, lambda x: round(x, 9)) AS months, list_transform(blocks, lambda x: round(x, 9)) AS blocks, round(ref_max, 9) AS ref_max, round(cur_max, 9) AS cur_max, "
    "(SELECT list(cat_id ORDER BY round(abs(share), 12) DESC, cat_id) FROM b WHERE b.state_id = slice_val) AS lives_in FROM g",
)
def p2(spark, sf_dir):
    """A state's whole history in one answer: months, blocks, peaks, and the categories in which its change lives."""
    d = tools.slice_detail(retail_panel(spark, sf_dir), "state_id", RETAIL_WINDOWS, "cat_id")
    rounded = [F.transform(c, lambda x: F.round(x, 9)).alias(c) for c in ("months", "blocks")]
    return d.select("slice_val", *_R("ref_mean", "cur_mean", "pct_change"), *rounded, *_R("ref_max", "cur_max"), F.col("where_it_lives.group").alias("lives_in"))


_PEAKS = (
    f"d AS (SELECT dept_id AS v, date, sum(sales) / count(*)::DOUBLE AS m FROM ev GROUP BY ALL), b AS (SELECT v, avg(m) + 1e-9 AS base FROM d WHERE {S.EVENT_REF} GROUP BY 1), "
    f"r AS (SELECT * FROM (SELECT v, date, avg(m) OVER w AS x, count(*) OVER w AS n FROM d WHERE {S.EVENT_CUR} WINDOW w AS (PARTITION BY v ORDER BY date ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)) WHERE n = 2)"
)
_TAKE = "SELECT v, arg_min(date, (-x, date)) AS d, max(x) AS x FROM {} GROUP BY v"


@query(
    "e12_peaks",
    f"WITH {S.EVENTS}, {_PEAKS}, p1 AS ({_TAKE.format('r')}), r2 AS (SELECT r.* FROM r JOIN p1 USING (v) WHERE abs(datediff('day', r.date, p1.d)) >= 2), p2 AS ({_TAKE.format('r2')}), r3 AS (SELECT r2.* FROM r2 JOIN p2 USING (v) WHERE abs(datediff('day', r2.date, p2.d)) >= 2), p3 AS ({_TAKE.format('r3')}), "
    "a AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3) SELECT v AS slice_val, d AS end_date, round(x / base, 9) AS level FROM a JOIN b USING (v)",
)
def e12(spark, sf_dir):
    """The three highest peaks of each department, two days apart, by a fold."""
    return tools.peaks(event_panel(spark, sf_dir), "dept_id", EVENT_WINDOWS).select("slice_val", "end_date", *_R("level"))


@query("p9_values", f"WITH {S.RETAIL} SELECT list_sort(list_distinct(list(cat_id))) AS cats, list_sort(list_distinct(list(state_id))) AS states FROM retail")
def p9(spark, sf_dir):
    """Sorted values of small slice columns, for prompts and checks."""
    return retail_panel(spark, sf_dir).agg(F.array_sort(F.collect_set("cat_id")).alias("cats"), F.array_sort(F.collect_set("state_id")).alias("states"))


@query(
    "t1_t4_fault_summaries",
    f"WITH {S.RETAIL}, {S.tagged('t', 'retail', S.RETAIL_REF, S.RETAIL_CUR)} SELECT win, count(*) AS n, round(avg(CAST(sell_price IS NULL AS INT)), 9) AS null_rate, round(avg(sales), 9) AS mean, round(avg(CAST(sales = 0 AS INT)), 9) AS zero_share, min(sales) AS lo, round(quantile_cont(sales, 0.25), 6) AS q25, round(median(sales), 6) AS q50, round(quantile_cont(sales, 0.75), 6) AS q75, round(quantile_cont(sales, 0.99), 6) AS q99, max(sales) AS hi FROM t GROUP BY 1",
)
def t1(spark, sf_dir):
    """Rows, null rate and summary of each window."""
    from ..sources.panel import tag

    q = F.percentile("sales", F.array(*(F.lit(x) for x in (0.25, 0.5, 0.75, 0.99))))
    g = tag(retail_panel(spark, sf_dir), RETAIL_WINDOWS).groupBy("win").agg(F.count("*").alias("n"), F.round(F.avg(F.col("sell_price").isNull().cast("int")), 9).alias("null_rate"), F.round(F.avg("sales"), 9).alias("mean"), F.round(F.avg((F.col("sales") == 0).cast("int")), 9).alias("zero_share"), F.min("sales").alias("lo"), q.alias("q"), F.max("sales").alias("hi"))
    return g.select("win", "n", "null_rate", "mean", "zero_share", "lo", *(F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("q25", "q50", "q75", "q99"))), "hi")


@query(
    "t5_slice_weeks",
    f"WITH {S.RETAIL}, r AS (SELECT * FROM retail WHERE state_id = 'ASIA' AND {S.RETAIL_REF}) SELECT CAST(floor(datediff('day', DATE '2000-01-01', date) / 7) AS INT) AS week, round(avg(sales), 9) AS mean, round(count(*) / count(DISTINCT date)::DOUBLE, 9) AS rows_a_day FROM r GROUP BY 1",
)
def t5(spark, sf_dir):
    """Weekly means and rows a day of a slice."""
    r = retail_panel(spark, sf_dir).where((F.col("state_id") == "ASIA") & F.col("date").between(F.lit("2000-01-01").cast("date"), F.lit("2000-12-31").cast("date")))
    week = F.floor(F.datediff("date", F.lit("2000-01-01").cast("date")) / 7).cast("int")
    return r.groupBy(week.alias("week")).agg(F.round(F.avg("sales"), 9).alias("mean"), F.round(F.count("*") / F.count_distinct("date"), 9).alias("rows_a_day"))


@query(
    "t6_compare_means",
    f"WITH {S.RETAIL}, {S.tagged('t', 'retail', S.RETAIL_REF, S.RETAIL_CUR)}, n AS (SELECT count(DISTINCT date) FILTER (win = 'ref') AS rd, count(DISTINCT date) FILTER (win = 'cur') AS cd FROM t), g AS (SELECT dept_id, avg(sales) FILTER (win = 'ref') AS rm, avg(sales) FILTER (win = 'cur') AS cm, count(*) FILTER (win = 'ref') AS rn, count(*) FILTER (win = 'cur') AS cn FROM t GROUP BY 1), "
    "x AS (SELECT dept_id, rm, cm, CASE WHEN rm <> 0 THEN cm / rm END AS mr, (cn / cd::DOUBLE) / nullif(rn / rd::DOUBLE, 0) AS rr FROM g, n) SELECT dept_id AS slice_val, round(rm, 9) AS ref_mean, round(cm, 9) AS cur_mean, round(mr, 9) AS mean_ratio, round(rr, 9) AS rows_ratio, round(abs(ln(greatest(coalesce(mr, 1), 1e-6))) + abs(ln(greatest(coalesce(rr, 1), 1e-6))), 9) AS change FROM x ORDER BY abs(ln(greatest(coalesce(mr, 1), 1e-6))) + abs(ln(greatest(coalesce(rr, 1), 1e-6))) DESC, dept_id LIMIT 12",
)
def t6(spark, sf_dir):
    """Mean and row ratios, the twelve largest changes."""
    return tools.compare_means(retail_panel(spark, sf_dir), "dept_id", RETAIL_WINDOWS).select("slice_val", *_R("ref_mean", "cur_mean", "mean_ratio", "rows_ratio", "change"))


@query("t7_duplicates", "WITH l AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (n > 1) AS BIGINT) AS n_duplicated FROM l GROUP BY 1")
def t7(spark, sf_dir):
    """Repeated keys by slice."""
    return tools.duplicate_check(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], "l_returnflag")


def _run_sql(source: str, cur: str, ref: str) -> str:
    return (
        f"c AS (SELECT item_id || '_' || store_id AS id, date, min(sales) AS x FROM {source} WHERE {cur} GROUP BY ALL), dd AS (SELECT date, row_number() OVER (ORDER BY date DESC) AS day FROM (SELECT DISTINCT date FROM c)), p AS (SELECT id, day, x FROM c JOIN dd USING (date)), "
        "v AS (SELECT id, max(x) FILTER (day = 1) AS v0 FROM p GROUP BY 1), y AS (SELECT id, day, row_number() OVER (PARTITION BY id ORDER BY day) AS seq FROM p JOIN v USING (id) WHERE v0 IS NOT NULL AND abs(x - v0) <= 1e-8 + 1e-5 * abs(v0)), "
        f"u AS (SELECT id, max(day) AS run FROM y WHERE day = seq GROUP BY 1), rf AS (SELECT item_id || '_' || store_id AS id, avg(sales) AS m FROM {source} WHERE {ref} GROUP BY 1), "
        "st AS (SELECT v.id, coalesce(run, 0) AS trail_run, v0 AS trail_value, coalesce(m, 0) AS ref_mean FROM v LEFT JOIN u ON u.id = v.id LEFT JOIN rf ON rf.id = v.id)"
    )


@query("t8_e3_trailing_runs", f"WITH {S.EVENTS}, zx AS (SELECT * REPLACE (CASE WHEN dept_id = 'view' AND date >= DATE '2024-01-24' THEN 0 ELSE sales END AS sales) FROM ev), {_run_sql('zx', S.EVENT_CUR, S.EVENT_REF)} SELECT id, CAST(trail_run AS INT) AS trail_run, trail_value, round(ref_mean, 9) AS ref_mean FROM st")
def t8(spark, sf_dir):
    """How long each series has stood still, on a feed that went to zero."""
    p = zero_fill(event_panel(spark, sf_dir), Injection("zero_fill", "dept_id", "view", "2024-01-24", "2024-01-30"))
    return tools.trailing_runs(p, EVENT_WINDOWS).select("id", "trail_run", "trail_value", *_R("ref_mean"))


@query("t9_label_consistency", "WITH p AS (SELECT p_brand AS a, p_type AS b, DATE '2000-01-01' + CAST(p_size AS INT) AS date FROM part), g AS (SELECT a, b, min(date) AS first_day, max(date) AS last_day, count(*) AS n FROM p GROUP BY 1, 2) SELECT a, b, first_day, last_day, n, n_labels FROM g JOIN (SELECT a, count(*) AS n_labels FROM g GROUP BY 1 HAVING count(*) > 1) USING (a)")
def t9(spark, sf_dir):
    """Values that carry several labels."""
    p = read(spark, sf_dir, "part").select(F.col("p_brand").alias("a"), F.col("p_type").alias("b"), F.date_add(F.lit("2000-01-01").cast("date"), F.col("p_size").cast("int")).alias("date"))
    return tools.label_consistency(p, "a", "b")


def _faulty(spark, sf_dir):
    return zero_fill(event_panel(spark, sf_dir), Injection("zero_fill", "dept_id", "view", "2024-01-24", "2024-01-30"))


_O = f"WITH {S.EVENTS}, zx AS (SELECT * REPLACE (CASE WHEN dept_id = 'view' AND date >= DATE '2024-01-24' THEN 0 ELSE sales END AS sales) FROM ev), {_run_sql('zx', S.EVENT_CUR, S.EVENT_REF)}, fl AS (SELECT st.*, coalesce(trail_value = 0 AND trail_run >= 2 AND ref_mean >= 2, false) AS z, coalesce(trail_value <> 0 AND trail_run >= 4, false) AS s FROM st)"


@query("o2_locate", _O + ", me AS (SELECT DISTINCT item_id || '_' || store_id AS id, cat_id, dept_id, state_id, store_id, item_id FROM zx WHERE " + S.EVENT_CUR + "), j AS (SELECT * FROM fl JOIN me USING (id)), " + S.slices("u2", "j", "z", ("cat_id", "dept_id", "state_id", "store_id", "item_id")) + " SELECT slice_col, slice_val, round(2 * count(*) FILTER (z) / (count(*) + (SELECT count(*) FROM fl WHERE z))::DOUBLE, 9) AS f1 FROM u2 GROUP BY 1, 2 HAVING count(*) FILTER (z) > 0")
def o2(spark, sf_dir):
    """O2: which slice's series are the flagged ones."""
    f = quality.flags(quality.series_stats(_faulty(spark, sf_dir), EVENT_WINDOWS), k_zero=2)
    return quality.locate(f, "is_zero").select("slice_col", "slice_val", *_R("f1"))


@query("o3_decide", _O + ", dp AS (SELECT count(DISTINCT id) AS n FROM (SELECT item_id || '_' || store_id AS id, date FROM zx WHERE " + S.EVENT_CUR + " GROUP BY ALL HAVING count(*) > 1)) SELECT (SELECT n FROM dp) AS n_duplicated, count(*) FILTER (z) AS n_zero, count(*) FILTER (s) AS n_stale, CASE WHEN (SELECT n FROM dp) > 0 THEN 'duplicated_rows' WHEN count(*) FILTER (z) >= 15 AND (count(*) FILTER (s) < 15 OR count(*) FILTER (z) >= count(*) FILTER (s)) THEN 'zero_fill' WHEN count(*) FILTER (s) >= 15 THEN 'stale_feed' ELSE 'none' END AS fault FROM fl")
def o3(spark, sf_dir):
    """O3, O1: the verdict and the counts behind it."""
    return quality.decide(quality.flags(quality.series_stats(_faulty(spark, sf_dir), EVENT_WINDOWS), k_zero=2))


@query("o4_grid", _O + ", kz AS (SELECT unnest([3, 5, 7, 10, 14]) AS k_zero), mr AS (SELECT unnest([0.5, 1.0, 2.0]::DOUBLE[]) AS m_ref), ks AS (SELECT unnest([3, 4, 5, 7]) AS k_stale) SELECT k_zero, m_ref, k_stale, CAST(count(*) FILTER (trail_value = 0 AND trail_run >= k_zero AND ref_mean >= m_ref) AS BIGINT) AS n_zero, CAST(count(*) FILTER (trail_value <> 0 AND trail_run >= k_stale) AS BIGINT) AS n_stale FROM st, kz, mr, ks GROUP BY ALL")
def o4(spark, sf_dir):
    """Counts of every threshold combination in one pass."""
    return quality.grid_counts(quality.series_stats(_faulty(spark, sf_dir), EVENT_WINDOWS))


@query("m5_mean_shift", f"WITH {S.RETAIL}, {S.tagged('t', 'retail', S.RETAIL_REF, S.RETAIL_CUR)}, {S.slices('u', 't', 'win, sell_price AS x', ('cat_id', 'dept_id', 'state_id', 'store_id'))}, g AS (SELECT slice_col, slice_ord, slice_val, abs(avg(x) FILTER (win = 'cur') - avg(x) FILTER (win = 'ref')) AS score FROM u GROUP BY ALL) SELECT slice_col, slice_val, round(score, 6) AS score FROM g WHERE score IS NOT NULL ORDER BY g.score DESC, slice_ord, slice_val LIMIT 10")
def m5(spark, sf_dir):
    """M5: slices whose mean contribution moved most (any numeric column stands for a contribution)."""
    from ..operators.model import mean_shift
    from ..sources.panel import COARSE_COLUMNS

    return mean_shift(retail_panel(spark, sf_dir), "sell_price", RETAIL_WINDOWS, COARSE_COLUMNS, 10).select("slice_col", "slice_val", *_R("score", d=6))


#: Trials of the full fit, all in one pair of windows: name, kind, slice.
FIT_WINDOWS = Windows("2024-01-01", "2024-01-14", "2024-01-15", "2024-01-30")
FIT_TRIALS = [("z1", "zero_fill", "dept_id", "view"), ("z2", "zero_fill", "store_id", "3"), ("s1", "stale_feed", "store_id", "4"), ("s2", "stale_feed", "dept_id", "click"), ("d1", "duplicated_rows", "cat_id", "TRAFFIC"), ("c1", "clean", "", ""), ("c2", "clean", "", "")]


def _fit_sql() -> str:
    ref, cur = (f"date BETWEEN DATE '{a}' AND DATE '{b}'" for a, b in ((FIT_WINDOWS.ref_start, FIT_WINDOWS.ref_end), (FIT_WINDOWS.cur_start, FIT_WINDOWS.cur_end)))
    parts = []
    for name, kind, col, val in FIT_TRIALS:
        mask = f"({col} = '{val}' AND {cur})" if col else "false"
        sales = {"zero_fill": f"CASE WHEN {mask} THEN 0 ELSE sales END", "stale_feed": f"CASE WHEN {mask} THEN coalesce((SELECT arg_max(o.sales, (o.date, o.sales)) FROM ev o WHERE o.item_id = ev.item_id AND o.store_id = ev.store_id AND o.date < DATE '{FIT_WINDOWS.cur_start}'), 0) ELSE sales END"}.get(kind, "sales")
        parts.append(f"SELECT '{name}' AS trial_id, '{name}/' || item_id AS item_id, item_id AS item, store_id, dept_id, cat_id, state_id, date, {sales} AS sales FROM ev")
        if kind == "duplicated_rows":
            parts.append(f"SELECT '{name}', '{name}/' || item_id, item_id, store_id, dept_id, cat_id, state_id, date, sales FROM ev WHERE {mask}")
    grid = quality.FIT_GRID
    lists = ", ".join(f"{k[0] if k != 'k_stale' else 's'}g AS (SELECT unnest([{', '.join(map(str, v))}]::DOUBLE[]) AS {k}, unnest(range({len(v)})) AS i_{k})" for k, v in grid.items() if k not in ("m_ref", "n_min")) + "".join(
        f", {k}_g AS (SELECT unnest([{', '.join(map(str, grid[k]))}]::DOUBLE[]) AS {k}, unnest(range({len(grid[k])})) AS i_{k})" for k in ("m_ref", "n_min")
    )
    truth = ", ".join(f"('{n}', '{k}', '{c}', '{v}')" for n, k, c, v in FIT_TRIALS)
    order = "CASE slice_col WHEN 'cat_id' THEN 0 WHEN 'dept_id' THEN 1 WHEN 'state_id' THEN 2 WHEN 'store_id' THEN 3 ELSE 4 END"
    per = "SELECT trial_id, {keys}, slice_col, slice_val, count(*) FILTER ({hit}) AS tp, count(*) AS size FROM sl{grids} GROUP BY ALL"
    best = lambda name, keys, hit, grids: (
        f"{name}_c AS ({per.format(keys=keys, hit=hit, grids=grids)}), {name}_n AS (SELECT trial_id, {keys}, count(*) FILTER ({hit}) AS n FROM me{grids} GROUP BY ALL), "
        f"{name}_b AS (SELECT c.*, n FROM {name}_c c JOIN {name}_n USING (trial_id, {keys}) WHERE tp > 0 QUALIFY row_number() OVER (PARTITION BY trial_id, {keys} ORDER BY round(2 * tp / (size + n)::DOUBLE, 12) DESC, {order}, slice_val) = 1), "
        f"{name} AS (SELECT n.trial_id, {', '.join(f'n.{k.strip()}' for k in keys.split(','))}, n.n, slice_col, slice_val FROM {name}_n n LEFT JOIN {name}_b USING (trial_id, {keys}))"
    )
    cols = ("cat_id", "dept_id", "state_id", "store_id", "item")
    slices = " UNION ALL ".join(f"SELECT trial_id, trail_value, trail_run, ref_mean, dup, '{'item_id' if c == 'item' else c}' AS slice_col, {c} AS slice_val FROM me" for c in cols)
    return (
        f"WITH {S.EVENTS}, zx AS ({' UNION ALL '.join(parts)}), {_run_sql('zx', cur, ref)}, {lists}, tr(trial_id, kind, true_col, true_val) AS (VALUES {truth}), "
        f"pd AS (SELECT item_id || '_' || store_id AS id, date, count(*) AS n, min(trial_id) AS trial_id, min(item) AS item, min(store_id) AS store_id, min(dept_id) AS dept_id, min(cat_id) AS cat_id, min(state_id) AS state_id FROM zx WHERE {cur} GROUP BY 1, 2), "
        "me AS (SELECT st.*, m.* EXCLUDE (id) FROM st JOIN (SELECT id, max(n) > 1 AS dup, min(trial_id) AS trial_id, min(item) AS item, min(store_id) AS store_id, min(dept_id) AS dept_id, min(cat_id) AS cat_id, min(state_id) AS state_id FROM pd GROUP BY id) m USING (id)), "
        f"sl AS ({slices}), one AS (SELECT 0 AS i_one), "
        f"{best('bz', 'i_k_zero, i_m_ref', 'coalesce(trail_value = 0 AND trail_run >= k_zero AND ref_mean >= m_ref, false)', ', kg, m_ref_g')}, {best('bs', 'i_k_stale', 'coalesce(trail_value <> 0 AND trail_run >= k_stale, false)', ', sg')}, {best('bd', 'i_one', 'dup', ', one')}, "
        "a AS (SELECT tr.*, k_zero, m_ref, k_stale, n_min, ((i_k_zero * 6 + i_m_ref) * 5 + i_k_stale) * 6 + i_n_min AS place, CASE WHEN bd.n > 0 THEN {'f': 'duplicated_rows', 'c': bd.slice_col, 'v': bd.slice_val} WHEN bz.n >= n_min AND (bs.n < n_min OR bz.n >= bs.n) THEN {'f': 'zero_fill', 'c': bz.slice_col, 'v': bz.slice_val} "
        "WHEN bs.n >= n_min THEN {'f': 'stale_feed', 'c': bs.slice_col, 'v': bs.slice_val} ELSE {'f': 'none', 'c': NULL, 'v': NULL} END AS said FROM tr JOIN bz USING (trial_id) JOIN bs USING (trial_id) JOIN bd USING (trial_id) JOIN kg USING (i_k_zero) JOIN m_ref_g USING (i_m_ref) JOIN sg USING (i_k_stale) CROSS JOIN n_min_g), "
        "r AS (SELECT *, CASE WHEN kind = 'clean' THEN said.f = 'none' ELSE coalesce(said.f = kind AND said.c = true_col AND said.v = true_val, false) END AS ok FROM a), "
        "g AS (SELECT CAST(place AS INT) AS place, CAST(k_zero AS INT) AS k_zero, m_ref, CAST(k_stale AS INT) AS k_stale, CAST(n_min AS INT) AS n_min, "
        + ", ".join(f"avg(ok::INT) FILTER (kind = '{k}') AS acc_{k}" for k in quality.FIT_KINDS)
        + " FROM r GROUP BY ALL), x AS (SELECT *, (acc_stale_feed + acc_zero_fill + acc_duplicated_rows + acc_clean) / 4 AS score FROM g) "
        "SELECT *, row_number() OVER (ORDER BY round(score, 12) DESC, place) = 1 AS picked FROM x"
    )


@query("o4_full_fit", _fit_sql())
def o4_fit(spark, sf_dir):
    """All 1,080 combinations over fault and clean trials, accuracies by kind, the objective, and the pick."""
    from ..operators.inject import with_trials

    injections = [(n, None if k == "clean" else Injection(k, c, v, FIT_WINDOWS.cur_start, FIT_WINDOWS.cur_end)) for n, k, c, v in FIT_TRIALS]
    stats = quality.trial_stats(with_trials(event_panel(spark, sf_dir), injections), FIT_WINDOWS)
    return quality.fit_thresholds(stats, spark.createDataFrame(FIT_TRIALS, "trial_id string, kind string, true_col string, true_val string"))
