"""Queries: evaluation (L1 to L15, D23, D29), over orders as a stand-in for trials: priority is the trial type, status the arm."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.draws import poisson_steps
from ..operators import scoring
from ..sources.panel import read
from .registry import query

_T = "t AS (SELECT o_orderkey, o_orderpriority AS kind, o_orderstatus AS arm, o_totalprice AS x, o_custkey % 7 < 3 AS hit_a, (o_custkey + o_orderkey) % 5 < 2 AS hit_b, o_totalprice + (o_orderkey % 11) * 9000 > 190000 AS harmful FROM orders)"
_W = "round(greatest(0, (p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / (1 + z * z / n)), 9) AS lo, round(least(1, (p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / (1 + z * z / n)), 9) AS hi"
_R = lambda *names, d=9: [F.round(n, d).alias(n) for n in names]


def _trials(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey", F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("arm"), F.col("o_totalprice").alias("x"), (F.col("o_custkey") % 7 < 3).alias("hit_a"), ((F.col("o_custkey") + F.col("o_orderkey")) % 5 < 2).alias("hit_b"),
        (F.col("o_totalprice") + (F.col("o_orderkey") % 11) * 9000 > 190000).alias("harmful"),
    )


@query("l1_wilson_rates", f"WITH {_T}, g AS (SELECT coalesce(kind, 'ALL') AS kind, count(*) FILTER (hit_a) AS k, count(*) AS n FROM t GROUP BY ROLLUP (kind)), y AS (SELECT *, k / n::DOUBLE AS p, 1.959963984540054 AS z FROM g) SELECT kind, k, n, round(p, 9) AS rate, {_W} FROM y")
def l1(spark, sf_dir):
    """Rates by type and pooled, with Wilson bounds."""
    return scoring.rate_table(_trials(spark, sf_dir), "kind", "hit_a").select("kind", "k", "n", *_R("rate", "lo", "hi"))


@query("l2_t_interval", f"WITH {_T}, s AS (SELECT n_regionkey AS kind, n_nationkey * 1.5 AS x FROM nation), g AS (SELECT kind, count(*) AS n, avg(x) AS m, stddev_samp(x) AS s FROM s GROUP BY 1) SELECT kind, n, round(m, 9) AS mean, round(m - 2.776445 * s / sqrt(n), 6) AS lo, round(m + 2.776445 * s / sqrt(n), 6) AS hi FROM g")
def l2(spark, sf_dir):
    """T intervals of small samples (five a region)."""
    s = read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("kind"), (F.col("n_nationkey") * 1.5).alias("x"))
    return scoring.mean_table(s, "kind", "x").select("kind", "n", *_R("mean"), *_R("lo", "hi", d=6))


@query(
    "l3_mcnemar",
    f"WITH {_T}, g AS (SELECT kind || arm || (o_orderkey % 40) AS kind, count(*) FILTER (hit_a AND NOT hit_b) AS b, count(*) FILTER (hit_b AND NOT hit_a) AS c FROM t GROUP BY 1), "
    "x AS (SELECT kind, b, c, unnest(range(least(b, c) + 1)) AS i, b + c AS n FROM g) SELECT kind, b, c, round(CASE WHEN b + c = 0 THEN 1 ELSE least(1, 2 * sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)))) END + 1e-9, 7) AS p FROM x GROUP BY kind, b, c",
)
def l3(spark, sf_dir):
    """L3: exact McNemar tests of two arms over many small groups."""
    t = _trials(spark, sf_dir).withColumn("kind", F.concat("kind", "arm", (F.col("o_orderkey") % 40).cast("string")))
    return scoring.paired_test(t, "kind", "hit_a", "hit_b").select("kind", "b", "c", F.round(F.col("p") + 1e-9, 7).alias("p"))  # exact halves of the last digit go up


@query("l3_paired_arms", f"WITH {_T} SELECT kind, count(*) FILTER (hit_a AND NOT hit_b) AS b, count(*) FILTER (hit_b AND NOT hit_a) AS c FROM t GROUP BY 1")
def l3_arms(spark, sf_dir):
    """Discordant pairs of two arms by type."""
    return scoring.paired_test(_trials(spark, sf_dir), "kind", "hit_a", "hit_b").select("kind", "b", "c")


@query(
    "l6_l8_rules",
    f"WITH {_T}, r AS (SELECT unnest(['always', 'never', 'price']) AS rule), y AS (SELECT rule, harmful, CASE rule WHEN 'always' THEN true WHEN 'never' THEN false ELSE x >= 180000 END AS p FROM t, r), g AS (SELECT rule, count(*) FILTER (p AND harmful) AS tp, count(*) FILTER (p AND NOT harmful) AS fp, count(*) FILTER (NOT p AND harmful) AS fn, count(*) FILTER (NOT p AND NOT harmful) AS tn FROM y GROUP BY 1) "
    "SELECT rule, tp, fp, fn, tn, round(tp / nullif(tp + fn, 0)::DOUBLE, 9) AS recall, round(tn / nullif(tn + fp, 0)::DOUBLE, 9) AS specificity, round(tp / nullif(tp + fp, 0)::DOUBLE, 9) AS \"precision\", round((tp / nullif(tp + fn, 0)::DOUBLE + tn / nullif(tn + fp, 0)::DOUBLE) / 2, 9) AS balanced FROM g",
)
def l6(spark, sf_dir):
    """Rule predictions and their scores."""
    t = _trials(spark, sf_dir).select("harmful", F.explode(F.array(F.struct(F.lit("always").alias("rule"), F.lit(True).alias("p")), F.struct(F.lit("never").alias("rule"), F.lit(False).alias("p")), F.struct(F.lit("price").alias("rule"), (F.col("x") >= 180000).alias("p")))).alias("r")).select("harmful", "r.*")
    return scoring.confusion(t, ["rule"], F.col("p"), F.col("harmful")).select("rule", "tp", "fp", "fn", "tn", *_R("recall", "specificity", "precision", "balanced"))


@query(
    "l7_threshold_fit",
    f"WITH {_T}, v AS (SELECT x, count(*) FILTER (harmful) AS pos, count(*) FILTER (NOT harmful) AS neg FROM t GROUP BY 1), n AS (SELECT sum(pos) AS a, sum(neg) AS b FROM v), "
    "c AS (SELECT coalesce((lag(x) OVER w + x) / 2, x - 1) AS th, coalesce(sum(pos) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pb, coalesce(sum(neg) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM v WINDOW w AS (ORDER BY x) UNION ALL SELECT max(x) + 1, sum(pos), sum(neg) FROM v), "
    "s AS (SELECT th, ((a - pb) / a::DOUBLE + nb / b::DOUBLE) / 2 AS bal FROM c, n) SELECT round(median(th), 6) AS threshold, round(max(bal), 9) AS balanced FROM s WHERE abs(bal - (SELECT max(bal) FROM s)) < 1e-12",
)
def l7(spark, sf_dir):
    """The threshold of largest balanced accuracy by running counts."""
    return scoring.threshold_fit(_trials(spark, sf_dir), "x", "harmful").select(*_R("threshold", d=6), *_R("balanced"))


@query("l9_class_balance", f"WITH {_T} SELECT kind, arm, round(avg(CAST(harmful AS INT)), 9) AS share, avg(CAST(harmful AS INT)) BETWEEN 0.2 AND 0.8 AS usable FROM t GROUP BY ALL")
def l9(spark, sf_dir):
    """Class balance by group and whether it is usable."""
    return _trials(spark, sf_dir).groupBy("kind", "arm").agg(F.avg(F.col("harmful").cast("int")).alias("s")).select("kind", "arm", F.round("s", 9).alias("share"), F.col("s").between(0.2, 0.8).alias("usable"))


_GRID = {"low": (150000.0, 175000.0, 200000.0), "span": (40000.0, 90000.0, 400000.0)}


@query(
    "l10_grid_search",
    f"WITH {_T}, l AS (SELECT unnest([150000.0, 175000.0, 200000.0]::DOUBLE[]) AS low), s AS (SELECT unnest([40000.0, 90000.0, 400000.0]::DOUBLE[]) AS span), y AS (SELECT low, span, harmful, x BETWEEN low AND low + span AS p, x BETWEEN 150000 AND 190000 AS q FROM t, l, s), "
    "g AS (SELECT low, span, (count(*) FILTER (p AND harmful) / count(*) FILTER (harmful)::DOUBLE + count(*) FILTER (NOT p AND NOT harmful) / count(*) FILTER (NOT harmful)::DOUBLE) / 2 AS bal, count(*) FILTER (p <> q) AS n_changed FROM y GROUP BY 1, 2) SELECT low, span, round(bal, 9) AS balanced, n_changed, CAST(row_number() OVER (ORDER BY bal DESC, n_changed, low, span) AS INT) AS place FROM g",
)
def l10(spark, sf_dir):
    """A grid in one job, best first, then fewest changes."""
    t = _trials(spark, sf_dir)
    g = scoring.grid_search(t, _GRID, lambda c: F.col("x").between(c["low"], c["low"] + c["span"]), "harmful")
    return g.select("low", "span", *_R("balanced"), "n_changed", "place")


#: Resamples of the query, and the steps of the Poisson distribution function.
RESAMPLES = 200
_POISSON = " + ".join(f"CAST(u >= {s!r} AS INT)" for s in poisson_steps())
_RESAMPLED = f"""b AS (SELECT o_orderkey, harmful AS y, x >= 180000 AS p, unnest(range({-(-RESAMPLES // 4)})) AS block FROM t),
h AS (SELECT y, p, block, md5('0:' || block || ':' || o_orderkey) AS h FROM b),
u AS (SELECT y, p, block * 4 + i AS resample, CAST('0x' || substr(h, CAST(1 + 8 * i AS INT), 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM h, range(4) r(i)),
c AS (SELECT resample, y, p, {_POISSON} AS n FROM u),
g AS (SELECT sum(n) FILTER (p AND y) AS tp, sum(n) FILTER (p AND NOT y) AS fp, sum(n) FILTER (NOT p AND y) AS fn, sum(n) FILTER (NOT p AND NOT y) AS tn FROM c GROUP BY resample)"""


@query("d29_bootstrap", f"WITH {_T}, {_RESAMPLED}, q AS (SELECT quantile_cont((tp / (tp + fn)::DOUBLE + tn / (tn + fp)::DOUBLE) / 2, [0.025, 0.975]) AS q FROM g) SELECT round(q[1], 9) AS lo, round(q[2], 9) AS hi FROM q")
def d29(spark, sf_dir):
    """Bootstrap bounds of a rule's balanced accuracy, every row resampled."""
    return scoring.bootstrap(_trials(spark, sf_dir).withColumn("p", F.col("x") >= 180000), "harmful", "p", RESAMPLES, key="o_orderkey").select(*_R("lo", "hi"))


@query("o5_fault_strata", f"WITH {_T}, y AS (SELECT CASE WHEN kind LIKE '1%' OR kind LIKE '2%' THEN 'COVERED' ELSE 'HELD_OUT' END AS stratum, hit_a, hit_b FROM t) SELECT coalesce(stratum, 'ALL') AS stratum, count(*) AS n, count(*) FILTER (hit_a) AS type_ok, count(*) FILTER (hit_b) AS place_ok, count(*) FILTER (hit_a AND hit_b) AS both_ok FROM y GROUP BY ROLLUP (stratum)")
def o5(spark, sf_dir):
    """Type, place and both right, by stratum and overall."""
    t = _trials(spark, sf_dir).withColumn("stratum", F.when(F.col("kind").rlike("^[12]"), "COVERED").otherwise("HELD_OUT"))
    return t.rollup("stratum").agg(F.count("*").alias("n"), F.count_if("hit_a").alias("type_ok"), F.count_if("hit_b").alias("place_ok"), F.count_if(F.col("hit_a") & F.col("hit_b")).alias("both_ok")).withColumn("stratum", F.coalesce("stratum", F.lit("ALL")))


@query("m7_harm_payload", "SELECT o_orderkey, o_totalprice >= 150000 AS harmful, '{\"key\":' || o_orderkey || ',\"status\":\"' || o_orderstatus || '\"}' AS payload FROM orders")
def m7(spark, sf_dir):
    """M7, DM17, H6: a label and its JSON payload."""
    return read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") >= 150000).alias("harmful"), F.to_json(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))).alias("payload"))
