"""Queries: injections, windows, trials, and the sweeps over them."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from ..operators import hierarchy, inject, trials
from ..operators.inject import Injection
from ..sources.panel import COARSE_COLUMNS, Windows, event_panel, retail_panel
from . import sql as S
from .registry import query

W = "date BETWEEN DATE '2001-01-01' AND DATE '2001-01-31'"
DEPT, STORE, CAT = "dept_id = 'ECONOMY#Brand#13'", "store_id = 'NATION_9'", "cat_id = 'LARGE'"
CASES: dict[str, tuple[Injection, str]] = {
    "n1_sudden": (Injection("sudden", "store_id", "NATION_9", "2001-01-01", "2001-01-31", 0.6), f"CASE WHEN {STORE} AND {W} AND date >= DATE '2001-01-11' THEN sales * 1.6 ELSE sales END AS sales, sell_price, revenue, cat_id FROM retail"),
    "n2_gradual": (Injection("gradual", "store_id", "NATION_9", "2001-01-01", "2001-01-31", 0.7), f"CASE WHEN {STORE} AND {W} THEN sales * (1 + 0.7 * datediff('day', DATE '2001-01-01', date) / 30.0::DOUBLE) ELSE sales END AS sales, sell_price, revenue, cat_id FROM retail"),
    "n3_intermittent": (
        Injection("intermittent", "store_id", "NATION_9", "2001-01-01", "2001-01-31", 3.0, ("2001-01-04", "2001-01-05", "2001-01-20")),
        f"CASE WHEN {STORE} AND date = DATE '2001-01-05' THEN (sales * 4 + 3) * 4 + 3 WHEN {STORE} AND date IN (DATE '2001-01-04', DATE '2001-01-06', DATE '2001-01-20', DATE '2001-01-21') THEN sales * 4 + 3 ELSE sales END AS sales, sell_price, revenue, cat_id FROM retail",
    ),
    "n4_price_shift": (Injection("price_shift", "cat_id", "LARGE", "2001-01-01", "2001-01-31", 0.37), f"sales, CASE WHEN {CAT} AND {W} THEN sell_price * 1.37 ELSE sell_price END AS sell_price, CASE WHEN {CAT} AND {W} THEN sales * sell_price * 1.37 ELSE revenue END AS revenue, cat_id FROM retail"),
    "n5_intersection": (Injection("intersection", "store_id", "NATION_9", "2001-01-01", "2001-01-31", 0.6, extra={"col": "cat_id", "val": "LARGE"}), f"CASE WHEN {STORE} AND {CAT} AND {W} THEN sales * 1.6 + 1 ELSE sales END AS sales, sell_price, revenue, cat_id FROM retail"),
    "n6_stale_feed": (
        Injection("stale_feed", "store_id", "NATION_9", "2001-01-01", "2001-01-31"),
        f"CASE WHEN {STORE} AND {W} THEN coalesce(last, 0) ELSE sales END AS sales, sell_price, CASE WHEN {STORE} AND {W} THEN coalesce(last, 0) * sell_price ELSE revenue END AS revenue, cat_id FROM retail LEFT JOIN (SELECT item_id AS i, arg_max(sales, (date, sales)) AS last FROM retail WHERE {STORE} AND date < DATE '2001-01-01' GROUP BY 1) ON i = item_id",
    ),
    "n7_zero_fill": (Injection("zero_fill", "cat_id", "LARGE", "2001-01-01", "2001-01-31"), f"CASE WHEN {CAT} AND {W} THEN 0 ELSE sales END AS sales, sell_price, CASE WHEN {CAT} AND {W} THEN 0 ELSE revenue END AS revenue, cat_id FROM retail"),
    "n8_duplicated_rows": (Injection("duplicated_rows", "cat_id", "LARGE", "2001-01-01", "2001-01-31"), f"sales, sell_price, revenue, cat_id FROM (SELECT * FROM retail UNION ALL SELECT * FROM retail WHERE {CAT} AND {W})"),
    "n9_unit_change": (Injection("unit_change", "cat_id", "LARGE", "2001-01-01", "2001-01-31"), f"CASE WHEN {CAT} AND {W} THEN sales * 12 ELSE sales END AS sales, sell_price, CASE WHEN {CAT} AND {W} THEN sales * 12 * sell_price ELSE revenue END AS revenue, cat_id FROM retail"),
    "n10_mislabelled": (Injection("mislabelled_category", "cat_id", "LARGE", "2001-01-01", "2001-01-31", extra={"label_col": "cat_id", "wrong_label": "PROMO"}), f"sales, sell_price, revenue, CASE WHEN {CAT} AND {W} THEN 'PROMO' ELSE cat_id END AS cat_id FROM retail"),
}


def _case(name: str, i: Injection, body: str) -> None:
    @query(name, f"WITH {S.RETAIL}, x AS (SELECT store_id, date, {body}) SELECT store_id, cat_id, date, count(*) AS n, round(sum(sales), 7) AS sales, round(sum(sell_price), 6) AS price, round(sum(revenue), 6) AS revenue FROM x WHERE year(date) = 2001 GROUP BY ALL")
    def run(spark, sf_dir):
        p = inject.inject(retail_panel(spark, sf_dir), i).where(F.year("date") == 2001)
        return p.groupBy("store_id", "cat_id", "date").agg(F.count("*").alias("n"), F.round(F.sum("sales"), 7).alias("sales"), F.round(F.sum("sell_price"), 6).alias("price"), F.round(F.sum("revenue"), 6).alias("revenue"))


for _name, (_i, _body) in CASES.items():
    _case(_name, _i, _body)

SWEEP = [(f"w{o:03d}", Windows("2000-01-01", "2000-12-31", (date(2001, 1, 1) + timedelta(o)).isoformat(), (date(2001, 1, 1) + timedelta(o + 30)).isoformat())) for o in trials.spaced_offsets(300, 10)]
_SWEEP_SQL = ", ".join(f"('{n}', DATE '{w.ref_start}', DATE '{w.ref_end}', DATE '{w.cur_start}', DATE '{w.cur_end}')" for n, w in SWEEP)
_WINDOWED = f"ws(window_id, a, b, c, d) AS (VALUES {_SWEEP_SQL}), t AS (SELECT p.*, window_id, CASE WHEN date BETWEEN c AND d THEN 'cur' ELSE 'ref' END AS win FROM retail p JOIN ws ON date BETWEEN a AND b OR date BETWEEN c AND d)"


@query("c14_window_join", f"WITH {S.RETAIL}, {_WINDOWED} SELECT window_id, win, count(*) AS n, round(sum(sales), 4) AS sales FROM t GROUP BY ALL")
def c14(spark, sf_dir):
    """Rows handed to every window they lie in, without a range join."""
    return trials.assign_windows(retail_panel(spark, sf_dir), SWEEP).groupBy("window_id", "win").agg(F.count("*").alias("n"), F.round(F.sum("sales"), 4).alias("sales"))


def _sweep_sql(tail: str) -> str:
    numeric = " UNION ALL ".join(f"SELECT window_id, '{c}' AS feature, window_id || '/{c}' AS wf, win, {c} AS x FROM t" for c in ("sales", "revenue"))
    categorical = " UNION ALL ".join(f"SELECT window_id, '{c}' AS feature, win, {c} AS bin FROM t" for c in ("cat_id", "state_id"))
    return (
        f"WITH {S.RETAIL}, {_WINDOWED}, n AS ({numeric}), {S.edges('ed', 'n', 'x', 'wf')}, "
        f"l AS (SELECT window_id, feature, win, CAST({S.bin_of('x')} AS VARCHAR) AS bin FROM n JOIN ed USING (wf) WHERE x BETWEEN e[1] AND e[len(e)] UNION ALL {categorical}), h AS (SELECT window_id, feature, bin, {S.COUNTS} FROM l GROUP BY ALL), {S.js('window_id, feature', 'h', 'd')} {tail}"
    )


@query("k22_false_alarm_sweep", _sweep_sql("SELECT window_id, feature, round(js, 9) AS js, round(l_inf, 9) AS l_inf, js > 0.015 OR l_inf > 0.06 AS is_drift FROM d"))
def k22(spark, sf_dir):
    """Every feature over ten clean windows, in one job."""
    return trials.false_alarm_sweep(retail_panel(spark, sf_dir), SWEEP).select("window_id", "feature", F.round("js", 9).alias("js"), F.round("l_inf", 9).alias("l_inf"), "is_drift")


@query(
    "k22_firing_rates",
    _sweep_sql(", f AS (SELECT feature, count(*) FILTER (js > 0.015 OR l_inf > 0.06) AS fired, count(*) AS n FROM d GROUP BY 1), z AS (SELECT *, 1.959963984540054 AS z, fired / n::DOUBLE AS p FROM f) SELECT feature, fired, n, round(p, 9) AS rate, "
    "round(greatest(0, (p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / (1 + z * z / n)), 9) + 0.0 AS lo, round(least(1, (p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / (1 + z * z / n)), 9) AS hi FROM z"),
)
def k22_rates(spark, sf_dir):
    """How often each feature fires on clean windows, with Wilson bounds."""
    return trials.firing_rates(trials.false_alarm_sweep(retail_panel(spark, sf_dir), SWEEP)).select("feature", "fired", "n", *(F.round(c, 9).alias(c) for c in ("rate", "lo", "hi")))


_POOL, _SEED, _N = date(2024, 1, 1) + timedelta(trials.REF_DAYS), 42, 3
_SERIES = ", ".join(f"('{t}', '{k}', '{c}', {m})" for t, k, c, m in trials.trial_ids(_SEED, _N))
_DRAWN = f"""i(trial_id, drift_type, slice_col, magnitude) AS (VALUES {_SERIES}),
v AS (SELECT DISTINCT 'dept_id' AS slice_col, dept_id AS slice_val FROM ev UNION SELECT DISTINCT 'store_id', store_id FROM ev UNION SELECT DISTINCT 'item_id', item_id FROM ev),
d AS (SELECT trial_id, any_value(drift_type) AS drift_type, any_value(i.slice_col) AS slice_col, any_value(magnitude) AS magnitude, arg_min(slice_val, md5(trial_id || ':' || slice_val)) AS slice_val,
      DATE '{_POOL}' + CAST(CAST('0x' || substr(md5(any_value(trial_id) || ':offset'), 1, 8) AS BIGINT) % {trials.POOL_DAYS - trials.WINDOW_DAYS} AS INT) AS day FROM i JOIN v ON v.slice_col = i.slice_col GROUP BY trial_id),
k AS (SELECT trial_id, day, unnest(range({trials.WINDOW_DAYS - 1})) AS n FROM d WHERE drift_type = 'intermittent'),
s AS (SELECT trial_id, list(CAST(day + CAST(n AS INT) AS VARCHAR) ORDER BY n) AS spikes FROM (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY trial_id ORDER BY md5(trial_id || ':spike:' || n), n) <= {inject.SPIKES}) GROUP BY trial_id)"""


@query(
    "k23_trials",
    f"WITH {S.EVENTS}, {_DRAWN} SELECT trial_id, drift_type, slice_col, slice_val, CAST(day - {trials.REF_DAYS} AS VARCHAR) AS ref_start, CAST(day - 1 AS VARCHAR) AS ref_end, CAST(day AS VARCHAR) AS cur_start, CAST(day + {trials.WINDOW_DAYS} AS VARCHAR) AS cur_end, CAST(magnitude AS DOUBLE) AS magnitude, coalesce(spikes, []) AS spikes FROM d LEFT JOIN s USING (trial_id)",
)
def k23(spark, sf_dir):
    """Seeded trials, each slice drawn among all values."""
    drawn = trials.draw_trials_of(event_panel(spark, sf_dir), _POOL, _SEED, _N)
    rows = [(n, i.kind, i.slice_col, i.slice_val, w.ref_start, w.ref_end, w.cur_start, w.cur_end, i.magnitude, list(i.spikes)) for n, w, i in drawn]
    return spark.createDataFrame(rows, "trial_id string, drift_type string, slice_col string, slice_val string, ref_start string, ref_end string, cur_start string, cur_end string, magnitude double, spikes array<string>")


_TRIALS = [("a", Injection("sudden", "cat_id", "TRAFFIC", "2024-01-11", "2024-01-30", 2.0)), ("b", Injection("gradual", "store_id", "3", "2024-01-21", "2024-01-30", 4.0)), ("c", Injection("zero_fill", "dept_id", "click", "2024-01-21", "2024-01-30"))]


_SHIFTED = (
    ("a", "CASE WHEN cat_id = 'TRAFFIC' AND date BETWEEN DATE '2024-01-21' AND DATE '2024-01-30' THEN sales * 3 ELSE sales END"),
    ("b", "CASE WHEN store_id = '3' AND date BETWEEN DATE '2024-01-21' AND DATE '2024-01-30' THEN sales * (1 + 4.0::DOUBLE * (datediff('day', DATE '2024-01-21', date) / 9.0::DOUBLE)) ELSE sales END"),
    ("c", "CASE WHEN dept_id = 'click' AND date BETWEEN DATE '2024-01-21' AND DATE '2024-01-30' THEN 0 ELSE sales END"),
)
_TRUTH = ", ".join(f"('{n}', '{i.slice_col}', '{i.slice_val}')" for n, i in _TRIALS)


def _scored_sql() -> str:
    """The trials injected, each slice's own divergence, the five best of each trial, and how they meet the truth."""
    rows = " UNION ALL ".join(f"SELECT '{n}' AS trial_id, * REPLACE ({x} AS sales) FROM ev" for n, x in _SHIFTED)
    keys = "trial_id, slice_col, slice_ord, slice_val"
    up = " UNION ".join(f"SELECT '{c}' AS col, {c} AS val, '{p}' AS up_col, {p} AS up_val FROM ev" for c, p in (("item_id", "dept_id"), ("item_id", "cat_id"), ("dept_id", "cat_id"), ("store_id", "state_id")))
    return (
        f"WITH {S.EVENTS}, tr AS ({rows}), {S.tagged('t', 'tr', S.EVENT_REF, S.EVENT_CUR)}, {S.edges('ed', 't', 'sales', 'trial_id')}, {S.slices('u', 't', 'trial_id, win, sales', COARSE_COLUMNS)}, "
        f"b AS (SELECT u.*, {S.bin_of('sales')} AS bin FROM u JOIN ed USING (trial_id)), h AS (SELECT {keys}, bin, {S.COUNTS} FROM b GROUP BY ALL), {S.js(keys, 'h', 'd')}, "
        "k AS (SELECT *, row_number() OVER (PARTITION BY trial_id ORDER BY round(js, 12) DESC, slice_ord, slice_val) AS rank FROM d WHERE r >= 20 AND c >= 20 QUALIFY rank <= 5), "
        f"x AS ({up}), w(trial_id, true_col, true_val) AS (VALUES {_TRUTH}), "
        "m AS (SELECT w.trial_id, rank, slice_col = true_col AND slice_val = true_val AS strict, EXISTS (SELECT 1 FROM x WHERE (col = slice_col AND val = slice_val AND up_col = true_col AND up_val = true_val) OR (col = true_col AND val = true_val AND up_col = slice_col AND up_val = slice_val)) AS kin FROM w LEFT JOIN k ON k.trial_id = w.trial_id) "
        "SELECT trial_id, coalesce(bool_or(strict AND rank <= 1), false) AS strict_top1, coalesce(bool_or(strict AND rank <= 3), false) AS strict_topk, coalesce(bool_or((strict OR kin) AND rank <= 1), false) AS hier_top1, coalesce(bool_or((strict OR kin) AND rank <= 3), false) AS hier_topk, CAST(min(rank) FILTER (strict) AS INT) AS true_rank FROM m GROUP BY 1"
    )


@query("l4_score_rankings", _scored_sql())
def l4(spark, sf_dir):
    """Three injected trials localised in one job and scored strictly and along the hierarchy."""
    from ..sources.panel import EVENT_WINDOWS, tag

    p = event_panel(spark, sf_dir)
    ranked = trials.localise_trials(tag(inject.with_trials(p, _TRIALS), EVENT_WINDOWS), "sales", COARSE_COLUMNS)
    truth = spark.createDataFrame([(n, i.slice_col, i.slice_val) for n, i in _TRIALS], "trial_id string, true_col string, true_val string")
    return trials.score_rankings(ranked, truth, hierarchy.closure(hierarchy.edges(p)))


@query("l16_rerank_harness")
def l16(spark, sf_dir):
    """Three trials through the re-ranking harness, with a scripted model that puts the last candidate first."""
    import json

    from ..operators import harness
    from ..sources.panel import EVENT_WINDOWS

    def scripted(messages):
        n = len(json.loads(messages[0]["content"])["candidates"])
        return {"content": json.dumps({"ranking": list(range(n))[::-1]})}

    p = event_panel(spark, sf_dir)
    rows = harness.rerank_trials([(n, inject.inject(p, i), EVENT_WINDOWS, (i.slice_col, i.slice_val)) for n, i in _TRIALS], scripted, mode="hybrid")
    return spark.createDataFrame(rows, "trial_id string, n_candidates int, base string, model string, base_hit boolean, model_hit boolean, used boolean, reason string")
