"""Queries: bin edges, histograms, divergences, and the scans built of them (K1 to K9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.binning import adaptive_edges, bin_of
from ..functions.divergence import divergences
from ..operators import detect
from ..sources.panel import EVENT_WINDOWS, RETAIL_WINDOWS, event_panel, read, retail_panel, tag
from . import sql as S
from .registry import query


@query(
    "k1_adaptive_edges",
    f"WITH {S.RETAIL}, v AS (SELECT 'sales' AS feature, sales AS x FROM retail UNION ALL SELECT 'sell_price', sell_price FROM retail UNION ALL SELECT 'line', CAST(l_linenumber AS DOUBLE) FROM lineitem), "
    f"{S.edges('ed', 'v', 'x', 'feature')} SELECT feature, CAST(i AS INT) AS pos, round(e[i], 6) AS edge FROM (SELECT feature, e, unnest(range(1, len(e) + 1)) AS i FROM ed)",
)
def k1(spark, sf_dir):
    """K1: adaptive edges of a quantile-path, a price and an integer-path feature."""
    p = retail_panel(spark, sf_dir)
    v = p.select("sales", "sell_price").unpivot([], ["sales", "sell_price"], "feature", "x")
    v = v.unionByName(read(spark, sf_dir, "lineitem").select(F.lit("line").alias("feature"), F.col("l_linenumber").cast("double").alias("x")))
    return adaptive_edges(v, "x", ["feature"]).select("feature", F.posexplode("edges").alias("pos", "edge")).select("feature", (F.col("pos") + 1).alias("pos"), F.round("edge", 6).alias("edge"))


@query(
    "k2_k3_histograms",
    f"WITH {S.RETAIL}, {S.edges('ed', 'retail', 'sales')}, {S.tagged('t', 'retail', S.RETAIL_REF, S.RETAIL_CUR)}, "
    f"b AS (SELECT win, {S.bin_of('sales + 3')} AS bin, sales + 3 BETWEEN e[1] AND e[len(e)] AS inside FROM t, ed) "
    "SELECT win, CAST(bin AS INT) AS bin, count(*) AS clipped, count(*) FILTER (inside) AS dropped_outside FROM b GROUP BY ALL",
)
def k2_k3(spark, sf_dir):
    """Both histogram rules on values shifted past the edges."""
    p = retail_panel(spark, sf_dir)
    rows = tag(p, RETAIL_WINDOWS).crossJoin(F.broadcast(adaptive_edges(p, "sales")))
    x = F.col("sales") + 3
    b = rows.select("win", bin_of(x, F.col("edges"), False).alias("bin"), bin_of(x, F.col("edges"), True).isNotNull().alias("inside"))
    return b.groupBy("win", "bin").agg(F.count("*").alias("clipped"), F.count_if("inside").alias("dropped_outside"))


@query(
    "k4_k5_k6_categorical",
    f"WITH {S.EVENTS}, {S.tagged('t', 'ev', S.EVENT_REF, S.EVENT_CUR)}, h AS (SELECT dept_id AS bin, {S.COUNTS} FROM t GROUP BY 1), {S.js('', 'h', 'd')} SELECT round(js, 9) AS js, round(l_inf, 9) AS l_inf FROM d",
)
def k4(spark, sf_dir):
    """A categorical feature over the union of its categories."""
    rows = tag(event_panel(spark, sf_dir), EVENT_WINDOWS).select("win", F.col("dept_id").alias("bin"))
    return divergences(detect.count_by_window(rows, []), []).select(F.round("js", 9).alias("js"), F.round("l_inf", 9).alias("l_inf"))


def _scan_sql(panel: str, name: str, ref: str, cur: str) -> str:
    numeric = " UNION ALL ".join(f"SELECT {i} AS feature_ord, '{c}' AS feature, win, CAST({c} AS DOUBLE) AS x FROM t" for i, c in enumerate(detect.NUMERIC))
    categorical = " UNION ALL ".join(f"SELECT {3 + i} AS feature_ord, '{c}' AS feature, win, CAST({c} AS VARCHAR) AS bin FROM t" for i, c in enumerate(detect.CATEGORICAL))
    return (
        f"WITH {panel}, {S.tagged('t', name, ref, cur)}, n AS ({numeric}), {S.edges('ed', 'n', 'x', 'feature')}, "
        f"l AS (SELECT feature_ord, feature, win, CAST({S.bin_of('x')} AS VARCHAR) AS bin FROM n JOIN ed USING (feature) WHERE x BETWEEN e[1] AND e[len(e)] UNION ALL {categorical}), "
        f"h AS (SELECT feature_ord, feature, bin, {S.COUNTS} FROM l GROUP BY ALL), {S.js('feature_ord, feature', 'h', 'd')} "
        "SELECT CAST(feature_ord AS INT) AS feature_ord, feature, round(js, 9) AS js, round(l_inf, 9) AS l_inf, js > 0.015 OR l_inf > 0.06 AS is_drift FROM d"
    )


def _rounded(df):
    return df.withColumns({"js": F.round("js", 9), "l_inf": F.round("l_inf", 9)})


@query("k7_global_scan", _scan_sql(S.RETAIL, "retail", S.RETAIL_REF, S.RETAIL_CUR))
def k7(spark, sf_dir):
    """All monitored features in one job."""
    return _rounded(detect.global_scan(retail_panel(spark, sf_dir), RETAIL_WINDOWS))


@query("k7_global_scan_events", _scan_sql(S.EVENTS, "ev", S.EVENT_REF, S.EVENT_CUR))
def k7_events(spark, sf_dir):
    return _rounded(detect.global_scan(event_panel(spark, sf_dir), EVENT_WINDOWS))


@query(
    "k8_scan_within_slices",
    f"WITH {S.RETAIL}, {S.edges('ed', 'retail', 'sales')}, {S.tagged('t', 'retail', S.RETAIL_REF, S.RETAIL_CUR)}, "
    "z AS (SELECT store_id FROM t GROUP BY 1 HAVING count(*) FILTER (win = 'ref') >= 20 AND count(*) FILTER (win = 'cur') >= 20), "
    f"b AS (SELECT store_id, win, {S.bin_of('sales')} AS bin FROM t, ed WHERE sales BETWEEN e[1] AND e[len(e)]), h AS (SELECT store_id, bin, {S.COUNTS} FROM b GROUP BY 1, 2), "
    f"{S.js('store_id', 'h', 'd')} SELECT store_id AS slice_val, round(js, 9) AS js, round(l_inf, 9) AS l_inf FROM d JOIN z USING (store_id) WHERE js > 0.015 OR l_inf > 0.06",
)
def k8(spark, sf_dir):
    """K8: slices that drift by themselves."""
    return _rounded(detect.scan_within_slices(retail_panel(spark, sf_dir), "sales", "store_id", RETAIL_WINDOWS))


@query(
    "k9_scan_adaptive",
    f"WITH {S.EVENTS}, w AS (SELECT unnest(range(7, 91, 7)) AS window_days), "
    "x AS (SELECT window_days, sales AS x, CASE WHEN datediff('day', DATE '2024-01-01', date) < window_days // 2 THEN 'ref' ELSE 'cur' END AS win FROM ev, w "
    "WHERE date >= DATE '2024-01-01' AND datediff('day', DATE '2024-01-01', date) < window_days), "
    "big AS (SELECT window_days FROM x GROUP BY 1 HAVING count(*) FILTER (win = 'ref') >= 20 AND count(*) FILTER (win = 'cur') >= 20), "
    f"{S.edges('ed', 'x', 'x', 'window_days')}, b AS (SELECT window_days, win, {S.bin_of('x')} AS bin FROM x JOIN ed USING (window_days) WHERE x BETWEEN e[1] AND e[len(e)]), "
    f"h AS (SELECT window_days, bin, {S.COUNTS} FROM b GROUP BY 1, 2), {S.js('window_days', 'h', 'd')} "
    "SELECT CAST(window_days AS INT) AS window_days, CAST(DATE '2024-01-01' + CAST(window_days // 2 AS INT) AS DATE) AS change_point, round(js, 9) AS js FROM d JOIN big USING (window_days) WHERE js > 0.002",
)
def k9(spark, sf_dir):
    """Growing windows split in halves, every one that differs."""
    return detect.scan_adaptive(event_panel(spark, sf_dir), "sales", "2024-01-01", threshold=0.002).withColumn("js", F.round("js", 9))
