"""Queries: the boosted demand model (M1 to M7, A14), held against SQL that fits and explains the same small tree by itself."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from ..operators import boosting, hierarchy, inject, model, trials
from ..operators.boosting import Params
from ..operators.inject import Injection
from ..sources.panel import COARSE_COLUMNS, RETAIL_WINDOWS, retail_panel
from . import sql as S
from .registry import query

NUMERIC, CATEGORICAL = ("sell_price", "wday", "month"), ("cat_id", "store_id")
#: One tree of two levels is what the SQL can write out.
SMALL = Params(trees=1, depth=2, rate=0.5, bins=16)
_MARKS = ", ".join(str(i / SMALL.bins) for i in range(SMALL.bins + 1))
_NAME = "CASE f " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate((*NUMERIC, *CATEGORICAL))) + " END"
_EDGES = lambda i: f"e{i} AS (SELECT list_sort(list_distinct(list_transform(quantile_cont(x{i}, [{_MARKS}]), lambda z: round(z, 6)))) AS e{i} FROM tr)"


def _level(i: int, source: str) -> str:
    """From rows (node, g, h, b0.., c3..): the best split of each node, b{i}, and the members of its set."""
    long = " UNION ALL ".join([f"SELECT node, {f} AS f, b{f} AS bin, NULL::VARCHAR AS cat, g, h FROM {source}" for f in range(3)] + [f"SELECT node, {f}, NULL, c{f}, g, h FROM {source}" for f in (3, 4)])
    frame, full = "(PARTITION BY node, f ORDER BY place, cat ROWS UNBOUNDED PRECEDING)", "(PARTITION BY node, f)"
    gain = "gl * gl / (hl + reg) + (g - gl) * (g - gl) / (h - hl + reg) - g * g / h"
    return f"""l{i} AS ({long}),
h{i} AS (SELECT node, f, bin, cat, sum(g) AS gs, sum(h) AS hs, count(*) AS ns, round(CASE WHEN f > 2 THEN sum(g) / (sum(h) + {SMALL.cat_smooth}) ELSE bin END, 9) AS place FROM l{i} GROUP BY node, f, bin, cat),
c{i} AS (SELECT node, f, bin, cat, row_number() OVER (PARTITION BY node, f ORDER BY place, cat) AS k, count(*) OVER {full} AS ks, sum(gs) OVER {frame} AS gl, sum(hs) OVER {frame} AS hl, sum(ns) OVER {frame} AS nl, sum(gs) OVER {full} AS g, sum(hs) OVER {full} AS h, sum(ns) OVER {full} AS n, CASE WHEN f > 2 THEN {SMALL.cat_l2} ELSE 0 END AS reg FROM h{i}),
a{i} AS (SELECT *, round({gain}, 6) AS gain FROM c{i} WHERE nl >= {SMALL.min_rows} AND n - nl >= {SMALL.min_rows} AND (f < 3 OR k <= {SMALL.most_in_set} OR ks - k <= {SMALL.most_in_set})),
s{i} AS (SELECT a.*, (SELECT list(c.cat ORDER BY c.cat) FROM c{i} c WHERE c.node = a.node AND c.f = a.f AND a.f > 2 AND (c.k <= a.k) = (a.k <= {SMALL.most_in_set})) AS cats, a.f > 2 AND a.k > {SMALL.most_in_set} AS others FROM a{i} a WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, k) = 1)"""


_LEFT = "CASE s.f WHEN 0 THEN b0 <= s.bin WHEN 1 THEN b1 <= s.bin WHEN 2 THEN b2 <= s.bin WHEN 3 THEN list_contains(s.cats, c3) <> s.others WHEN 4 THEN list_contains(s.cats, c4) <> s.others END"
#: r: every row of the panel, binned; s1, s2: the splits of the root and of its children; leaf: the leaves.
_TREE = f"""{S.RETAIL},
p AS (SELECT *, sell_price::DOUBLE AS x0, CAST((isodow(date) + 1) % 7 + 1 AS DOUBLE) AS x1, CAST(month(date) AS DOUBLE) AS x2, cat_id AS c3, store_id AS c4 FROM retail),
tr AS (SELECT * FROM p WHERE {S.RETAIL_REF}), base AS (SELECT ln(avg(sales)) AS base FROM tr), {_EDGES(0)}, {_EDGES(1)}, {_EDGES(2)},
r AS (SELECT p.*, base, len(list_filter(e0, lambda z: z < x0)) AS b0, len(list_filter(e1, lambda z: z < x1)) AS b1, len(list_filter(e2, lambda z: z < x2)) AS b2 FROM p, base, e0, e1, e2),
t1 AS (SELECT 1 AS node, exp(base) - sales AS g, exp(base) * exp({SMALL.step}) AS h, b0, b1, b2, c3, c4 FROM r WHERE {S.RETAIL_REF}), {_level(1, "t1")},
t2 AS (SELECT CASE WHEN {_LEFT} THEN 2 ELSE 3 END AS node, t1.g, t1.h, b0, b1, b2, c3, c4 FROM t1, s1 s), {_level(2, "t2")},
leaf AS (
  SELECT 2 * node + i AS leaf, node, CASE WHEN i = 0 THEN nl ELSE n - nl END AS n, n AS up, f,
         -{SMALL.rate} * CASE WHEN i = 0 THEN gl / (hl + reg) ELSE (g - gl) / (h - hl + reg) END AS value FROM s2, range(2) t(i)),
y AS (
  SELECT r.*, {_LEFT} AS left1, 2 * CASE WHEN {_LEFT} THEN 2 ELSE 3 END AS twice FROM r, s1 s),
z AS (SELECT y.*, y.twice + CASE WHEN {_LEFT} THEN 0 ELSE 1 END AS leaf FROM y JOIN s2 s ON s.node * 2 = y.twice),
scored AS (SELECT z.*, exp(z.base + leaf.value) AS y_pred FROM z JOIN leaf USING (leaf))"""
_BOTH = f"SELECT * EXCLUDE (b, n_all), CASE f WHEN 0 THEN e0[bin + 1] WHEN 1 THEN e1[bin + 1] WHEN 2 THEN e2[bin + 1] END AS edge FROM (SELECT *, 1 AS b, n AS n_all FROM s1 UNION ALL SELECT *, 2, n FROM s2), e0, e1, e2"


def _small(spark, sf_dir):
    panel = retail_panel(spark, sf_dir)
    return panel, boosting.fit(panel, RETAIL_WINDOWS, NUMERIC, CATEGORICAL, p=SMALL)


@query("m2_boosted_splits", f"WITH {_TREE}, b AS ({_BOTH}) SELECT CAST(node AS INT) AS node, {_NAME} AS feature, round(edge, 4) AS edge, coalesce(array_to_string(cats, ','), '') AS members, others, round(gain, 3) AS gain, CAST(nl AS BIGINT) AS n_left, CAST(n - nl AS BIGINT) AS n_right FROM b")
def m2_splits(spark, sf_dir):
    """M1, M2: the splits of a Poisson tree over the retail panel, numbers and sets of categories."""
    _, m = _small(spark, sf_dir)
    t = m.trees[0]
    rows = [(i, s.feature, None if s.edge is None else round(s.edge, 4), ",".join(s.members), s.others, round(s.gain, 3), t.rows[2 * i], t.rows[2 * i + 1]) for i, s in t.splits.items()]
    return spark.createDataFrame(rows, "node int, feature string, edge double, members string, others boolean, gain double, n_left long, n_right long")


@query("m3_boosted_errors", f"WITH {_TREE} SELECT cat_id, count(*) AS n, round(avg(y_pred), 7) AS y_pred, round(avg(abs(sales - y_pred)), 7) AS mae, round(avg(sales - y_pred), 7) AS bias FROM scored GROUP BY 1")
def m3(spark, sf_dir):
    """The whole panel scored by the tree."""
    panel, m = _small(spark, sf_dir)
    return boosting.score(m, panel).groupBy("cat_id").agg(F.count("*").alias("n"), F.round(F.avg("y_pred"), 7).alias("y_pred"), F.round(F.avg("abs_error"), 7).alias("mae"), F.round(F.avg("residual"), 7).alias("bias"))


#: A leaf's game has two players, or one where both levels ask for the same feature; k: which of them leads there.
_PHI = f""", steps AS (
  SELECT z.*, leaf.leaf AS at, leaf.value, leaf.f AS f2, s.f AS f1, leaf.n / leaf.up::DOUBLE AS z2, leaf.up / s.n::DOUBLE AS z1,
         CAST(left1 = (leaf.leaf < 6) AS INT) AS o1, CAST(CASE leaf.f WHEN 0 THEN b0 <= q.bin WHEN 1 THEN b1 <= q.bin WHEN 2 THEN b2 <= q.bin WHEN 3 THEN list_contains(q.cats, c3) <> q.others WHEN 4 THEN list_contains(q.cats, c4) <> q.others END = (leaf.leaf % 2 = 0) AS INT) AS o2
  FROM z, s1 s, leaf JOIN s2 q ON q.node = leaf.node),
parts AS (SELECT *, CASE WHEN f1 = f2 THEN value * (o1 * o2 - z1 * z2) ELSE value * (o1 - z1) * (o2 + z2) / 2 END AS phi1, CASE WHEN f1 = f2 THEN 0 ELSE value * (o2 - z2) * (o1 + z1) / 2 END AS phi2 FROM steps)"""


def _phi(f: int) -> str:
    return f"sum(CASE WHEN f1 = {f} THEN phi1 ELSE 0 END + CASE WHEN f2 = {f} THEN phi2 ELSE 0 END)"


_ALL_PHI = ", ".join(f"round({_phi(i)} / count(DISTINCT leaf_row), 9) + 0.0 AS phi_{c}" for i, c in enumerate((*NUMERIC, *CATEGORICAL)))


@query("m4_tree_contributions", f"WITH {_TREE.replace('p AS (SELECT *,', 'p AS (SELECT *, row_number() OVER () AS leaf_row,', 1)}{_PHI} SELECT store_id, count(DISTINCT leaf_row) AS n, {_ALL_PHI} FROM parts GROUP BY 1")
def m4(spark, sf_dir):
    """M4: mean contributions of every feature, categories included, by store."""
    panel, m = _small(spark, sf_dir)
    phi = boosting.contributions(m, panel, ["store_id"])
    return phi.groupBy("store_id").agg(F.count("*").alias("n"), *((F.round(F.avg(f"phi_{c}"), 9) + 0.0).alias(f"phi_{c}") for c in (*NUMERIC, *CATEGORICAL)))


_SHIFT = f", w AS (SELECT leaf_row, any_value(CASE WHEN {S.RETAIL_REF} THEN 'ref' ELSE 'cur' END) AS win, {_phi(0)} AS x, " + ", ".join(f"any_value({c}) AS {c}" for c in COARSE_COLUMNS) + f" FROM parts WHERE {S.RETAIL_REF} OR {S.RETAIL_CUR} GROUP BY leaf_row), {S.slices('u', 'w', 'win, x', COARSE_COLUMNS)}"


@query(
    "m5_contribution_shift",
    f"WITH {_TREE.replace('p AS (SELECT *,', 'p AS (SELECT *, row_number() OVER () AS leaf_row,', 1)}{_PHI}{_SHIFT}, g AS (SELECT slice_col, slice_ord, slice_val, abs(avg(x) FILTER (win = 'cur') - avg(x) FILTER (win = 'ref')) AS score FROM u GROUP BY ALL) "
    "SELECT slice_col, slice_val, round(score, 8) AS score FROM g WHERE score IS NOT NULL ORDER BY round(g.score, 12) DESC, slice_ord, slice_val LIMIT 10",
)
def m5_shift(spark, sf_dir):
    """M5: the slices whose mean contribution of the price moved most."""
    panel, m = _small(spark, sf_dir)
    phi = boosting.contributions(m, panel, ["date", *COARSE_COLUMNS])
    return model.mean_shift(phi, "phi_sell_price", RETAIL_WINDOWS, COARSE_COLUMNS, 10).select("slice_col", "slice_val", F.round("score", 8).alias("score"))


_DRIFT = Injection("sudden", "store_id", "NATION_9", "2001-01-01", "2001-10-31", 4.0)


@query(
    "m7_harm_of_drift",
    f"WITH {_TREE}, h AS (SELECT avg(abs(sales - y_pred)) AS mae_clean, avg(abs(CASE WHEN store_id = 'NATION_9' AND date >= DATE '2001-01-11' THEN sales * 5 ELSE sales END - y_pred)) AS mae_drifted FROM scored WHERE {S.RETAIL_CUR}), "
    "x AS (SELECT round(mae_clean, 6) AS mae_clean, round(mae_drifted, 6) AS mae_drifted, round(mae_drifted / mae_clean, 6) AS ratio, mae_drifted / mae_clean >= 1.05 AS harmful FROM h) "
    "SELECT *, '{\"slice\":\"store_id=NATION_9\",\"harmful\":' || harmful || '}' AS payload FROM x",
)
def m7_harm(spark, sf_dir):
    """M7, DM17, H6: whether an injected drift makes the deployed model's errors worse, and the label's payload."""
    panel, m = _small(spark, sf_dir)
    clean, drifted = (boosting.score(m, x) for x in (panel, inject.inject(panel, _DRIFT)))
    h = model.harm(drifted, clean, RETAIL_WINDOWS)
    payload = F.to_json(F.struct(F.lit(f"{_DRIFT.slice_col}={_DRIFT.slice_val}").alias("slice"), "harmful"))
    return h.select(*(F.round(c, 6).alias(c) for c in ("mae_clean", "mae_drifted", "ratio")), "harmful", payload.alias("payload"))


#: The head-to-head: drift types, columns and sizes, over a pool of windows after the days that the model was trained on.
SERIES = (("sudden", "store_id", inject.SUDDEN), ("gradual", "cat_id", inject.GRADUAL))
POOL = date.fromisoformat(RETAIL_WINDOWS.cur_start) + timedelta(trials.REF_DAYS)


@query("m6_head_to_head")
def m6(spark, sf_dir):
    """Drawn trials localised by ranking and by the shift of the price's contributions, with each arm's rates."""
    panel, m = _small(spark, sf_dir)
    drawn = trials.draw_trials_of(panel, POOL, 123, 3, series=SERIES)
    return trials.arm_rates(trials.head_to_head(panel, drawn, m, hierarchy.closure(hierarchy.edges(panel))))
