"""Queries: profiles, dependencies, hierarchy discovery, converters, reports, generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import model, onboarding, profile, report
from ..sources import synthetic
from ..sources.panel import RETAIL_WINDOWS, event_panel, read, retail_panel
from ..sources.written import written

from . import sql as S
from .registry import query

_R = lambda *names, d=9: [F.round(n, d).alias(n) for n in names]


def _profile_sql(table: str, columns: tuple[str, ...]) -> str:
    u = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS v FROM {table}" for c in columns)
    return (
        f"WITH u AS ({u}), x AS (SELECT *, TRY_CAST(v AS DOUBLE) AS x, TRY_CAST(v AS DATE) AS d FROM u) SELECT \"column\", count(*) AS n, count(*) - count(v) AS n_null, count(DISTINCT v) AS n_unique, round(count(d) / nullif(count(v), 0)::DOUBLE, 9) AS dates, round(count(x) / nullif(count(v), 0)::DOUBLE, 9) AS numbers, "
        "round(count(*) FILTER (x = 0) / nullif(count(x), 0)::DOUBLE, 9) AS zero, round(count(*) FILTER (x < 0) / nullif(count(x), 0)::DOUBLE, 9) AS negative, round(count(*) FILTER (x % 1 <> 0) / nullif(count(x), 0)::DOUBLE, 9) AS fractional FROM x GROUP BY 1"
    )


_COLS = ("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")


@query("q2_q5_columns", _profile_sql("customer", _COLS))
def q2(spark, sf_dir):
    """Every column's profile in one pass."""
    return profile.columns_profile(read(spark, sf_dir, "customer"), _COLS).select("column", "n", "n_null", "n_unique", *_R("dates", "numbers", "zero", "negative", "fractional"))


@query("q3_dependencies", "WITH p AS (SELECT DISTINCT p_brand, p_type, p_size FROM part), x AS (" + " UNION ALL ".join(f"SELECT '{a}' AS determinant, '{b}' AS dependent, CAST({a} AS VARCHAR) AS a, count(DISTINCT {b}) AS n FROM p GROUP BY {a}" for a in ("p_brand", "p_type", "p_size") for b in ("p_brand", "p_type", "p_size") if a != b) + ") SELECT determinant, dependent, count(*) FILTER (n > 1) AS n_violations FROM x GROUP BY 1, 2")
def q3(spark, sf_dir):
    """Dependencies between all pairs of columns in one job."""
    return profile.dependency_matrix(read(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size"])


@query("q4_numeric_summary", "SELECT s_nationkey, count(s_acctbal) AS n, round(avg(s_acctbal), 6) AS mean, round(stddev_samp(s_acctbal), 6) AS std, " + ", ".join(f"round(quantile_cont(s_acctbal, {q}), 6) AS {k}" for k, q in profile.QUANTILES.items()).replace("AS min", 'AS "min"').replace("AS max", 'AS "max"') + " FROM supplier GROUP BY 1")
def q4(spark, sf_dir):
    """Exact quantiles, mean and deviation by group."""
    return profile.numeric_summary(read(spark, sf_dir, "supplier"), "s_acctbal", ["s_nationkey"]).select("s_nationkey", "n", *_R("mean", "std", *profile.QUANTILES, d=6))


@query("q6_date_gaps", "WITH g AS (SELECT l_suppkey, min(CAST(l_shipdate AS DATE)) AS a, max(CAST(l_shipdate AS DATE)) AS b, count(DISTINCT CAST(l_shipdate AS DATE)) AS n FROM lineitem GROUP BY 1), m AS (SELECT 1 - n / (datediff('day', a, b) + 1)::DOUBLE AS x FROM g) SELECT count(*) AS n_groups, round(avg(x), 9) AS mean, round(median(x), 9) AS median, round(quantile_cont(x, 0.9), 9) AS p90, round(avg(CAST(x > 0 AS INT)), 9) AS any_gap FROM m")
def q6(spark, sf_dir):
    """Days missing in each series."""
    d = read(spark, sf_dir, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("d"))
    return profile.date_gaps(d, "d", ["l_suppkey"]).select("n_groups", *_R("mean", "median", "p90", "any_gap"))


@query("q7_schema_inference")
def q7(spark, sf_dir):
    """Q7: roles of all columns whatever their names (rules over small profiles)."""
    t = {"a": read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("x1"), F.col("o_custkey").alias("x2"), F.col("o_totalprice").alias("x3"), F.to_date("o_orderdate").cast("string").alias("x4")), "b": read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("y1"), F.col("n_name").alias("y2"))}
    found = profile.infer_schema(t)
    return spark.createDataFrame([(name, c, r, name == found["fact"]) for name, cs in found["roles"].items() for c, r in cs.items()], "table string, column string, role string, is_fact boolean")


_SLICES = ("cat_id", "dept_id", "state_id", "store_id", "item_id")


def _hierarchy_sql(name: str, source: str, columns: tuple[str, ...]) -> str:
    """name: child, parent of the dependencies among columns that hold, towards fewer values, without those by way of another."""
    pairs = [(a, b) for a in columns for b in columns if a != b]
    held = " UNION ALL ".join(f"SELECT '{a}' AS child, '{b}' AS parent FROM (SELECT count(DISTINCT {b}) AS k FROM {source} GROUP BY {a}) HAVING max(k) <= 1 AND (SELECT count(DISTINCT {b}) < count(DISTINCT {a}) FROM {source})" for a, b in pairs)
    return f"{name}_h AS ({held}), {name} AS (SELECT child, parent FROM {name}_h h WHERE NOT EXISTS (SELECT 1 FROM {name}_h x JOIN {name}_h y ON x.parent = y.child WHERE x.child = h.child AND y.parent = h.parent))"


@query("q8_hierarchy", f"WITH {S.RETAIL}, {_hierarchy_sql('q', 'retail', _SLICES)} SELECT * FROM q")
def q8(spark, sf_dir):
    """The hierarchy of the slice columns, found from the data."""
    return profile.hierarchy_of(retail_panel(spark, sf_dir), list(_SLICES))


@query("q9_flags", "SELECT avg(CAST(value = 0 AS INT)) > 0.3 AS zero_inflated, avg(CAST(value % 1 <> 0 AS INT)) > 0 AS fractional, avg(CAST(value < 0 AS INT)) > 0 AS negative, CASE WHEN bool_and(value % 1 = 0) AND quantile_cont(value, 0.99) < 21 THEN 'integer' ELSE 'quantile' END AS bin_path FROM events")
def q9(spark, sf_dir):
    """Q9: flags of a target."""
    return profile.flags(read(spark, sf_dir, "events"), "value")


@query("q10_to_panel", "WITH g AS (SELECT CAST(l_partkey AS VARCHAR) AS item_id, CAST(l_suppkey AS VARCHAR) AS store_id, CAST(l_shipdate AS DATE) AS date, sum(greatest(l_quantity, 0)) AS sales FROM lineitem GROUP BY ALL) SELECT store_id, count(*) AS n, min(date) AS first_day, round(sum(sales), 4) AS sales FROM g GROUP BY 1")
def q10(spark, sf_dir):
    """Any fact table with known roles as a panel."""
    p, _ = profile.to_panel(read(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey", "l_shipdate", "l_quantity")
    return p.groupBy("store_id").agg(F.count("*").alias("n"), F.min("date").alias("first_day"), F.round(F.sum("sales"), 4).alias("sales"))


@query("q11_edge_scores", f"WITH {S.RETAIL}, {_hierarchy_sql('q', 'retail', _SLICES)}, t(child, parent) AS (VALUES ('dept_id', 'cat_id'), ('store_id', 'state_id'), ('item_id', 'cat_id')), n AS (SELECT (SELECT count(*) FROM q SEMI JOIN t USING (child, parent)) AS tp, (SELECT count(*) FROM q) AS n_found, (SELECT count(*) FROM t) AS n_true) SELECT *, round(tp / n_found::DOUBLE, 9) AS precision, round(tp / n_true::DOUBLE, 9) AS recall, round(2 * tp / (n_found + n_true)::DOUBLE, 9) AS f1 FROM n")
def q11(spark, sf_dir):
    """Precision and recall of found edges against known ones."""
    found = profile.hierarchy_of(retail_panel(spark, sf_dir), list(_SLICES))
    truth = spark.createDataFrame([("dept_id", "cat_id"), ("store_id", "state_id"), ("item_id", "cat_id")], "child string, parent string")
    return profile.edge_scores(found, truth).select("tp", "n_found", "n_true", *_R("precision", "recall", "f1"))


#: Runs that configure the retail panel from other columns, and the hierarchy that is known of it.
_RUNS = {"all": _SLICES, "no_dept": ("cat_id", "state_id", "store_id", "item_id"), "places": ("state_id", "store_id"), "goods": ("cat_id", "dept_id", "item_id")}
_KNOWN = (("item_id", "dept_id"), ("dept_id", "cat_id"), ("store_id", "state_id"))
_RUN_SQL = f"{S.RETAIL}, " + ", ".join(_hierarchy_sql(f"r_{n}", "retail", c) for n, c in _RUNS.items()) + ", e AS (" + " UNION ALL ".join(f"SELECT '{n}' AS run, * FROM r_{n}" for n in _RUNS) + f"), k(child, parent) AS (VALUES {', '.join(map(str, _KNOWN))})"


def _runs(spark, sf_dir):
    found = profile.hierarchies_of(retail_panel(spark, sf_dir), _RUNS)
    return spark.createDataFrame([(n,) for n in _RUNS], "run string"), found, spark.createDataFrame(list(_KNOWN), "child string, parent string")


_SCORED_RUNS = (
    f"WITH RECURSIVE {_RUN_SQL}, fc AS (SELECT run, child, parent FROM e UNION SELECT fc.run, fc.child, e.parent FROM fc JOIN e ON e.run = fc.run AND e.child = fc.parent), kc AS (SELECT * FROM k UNION SELECT kc.child, k.parent FROM kc JOIN k ON k.child = kc.parent), "
    f"rr(run) AS (VALUES {', '.join(f'({n!r})' for n in _RUNS)}), b AS (SELECT coalesce(f.run, t.run) AS run, coalesce(f.child, t.child) || '->' || coalesce(f.parent, t.parent) AS edge, f.run IS NOT NULL AS f, t.run IS NOT NULL AS t FROM fc f FULL JOIN (SELECT * FROM rr, kc) t ON f.run = t.run AND f.child = t.child AND f.parent = t.parent), "
    "g AS (SELECT run, count(*) FILTER (f AND t) AS tp, count(*) FILTER (f) AS n_found, count(*) FILTER (t) AS n_true, coalesce(string_agg(edge, '; ' ORDER BY edge) FILTER (f AND NOT t), '') AS invented, coalesce(string_agg(edge, '; ' ORDER BY edge) FILTER (t AND NOT f), '') AS missed FROM b GROUP BY 1) "
    "SELECT run, tp, n_found, n_true, round(tp / n_found::DOUBLE, 9) AS precision, round(tp / n_true::DOUBLE, 9) AS recall, round(2 * tp / (n_found + n_true)::DOUBLE, 9) AS f1, invented, missed FROM g"
)


@query("q11_scores_of_runs", _SCORED_RUNS)
def q11_runs(spark, sf_dir):
    """Found hierarchies of several runs against the known one, on transitive closures."""
    return onboarding.edge_scores_by_run(*_runs(spark, sf_dir)).select("run", "tp", "n_found", "n_true", *_R("precision", "recall", "f1"), "invented", "missed")


@query("q13_choice_among_runs", f"WITH s AS ({_SCORED_RUNS}), c AS (SELECT *, row_number() OVER (ORDER BY f1 DESC, precision DESC, recall DESC, n_found DESC, run) AS b, row_number() OVER (ORDER BY md5('3:' || run), run) AS r FROM s) SELECT run, f1, n_found, 'best' AS chosen_by FROM c WHERE b = 1 UNION ALL SELECT run, f1, n_found, 'random' FROM c WHERE r = 1")
def q13_runs(spark, sf_dir):
    """The best of the scored runs by four keys, and one at random."""
    return onboarding.choose(q11_runs(spark, sf_dir), "run", ("f1", "precision", "recall", "n_found"), 3).select("run", "f1", "n_found", "chosen_by")


@query("q11_agreement", f"WITH {_RUN_SQL}, rr(run) AS (VALUES {', '.join(f'({n!r})' for n in _RUNS)}), p AS (SELECT a.run AS a, b.run AS b FROM rr a JOIN rr b ON a.run < b.run), j AS (SELECT (SELECT count(*) FROM e x JOIN e y USING (child, parent) WHERE x.run = p.a AND y.run = p.b) AS s, (SELECT count(*) FROM (SELECT child, parent FROM e WHERE run = p.a UNION SELECT child, parent FROM e WHERE run = p.b)) AS u FROM p) SELECT count(*) AS n_pairs, round(avg(s / u::DOUBLE), 9) AS mean_jaccard, round(avg((s = u)::INT), 9) AS identical_share, 4::BIGINT AS n_runs FROM j")
def q11_agreement(spark, sf_dir):
    """How far the runs' hierarchies agree."""
    runs, found, _ = _runs(spark, sf_dir)
    return onboarding.edge_agreement(runs, found).select("n_pairs", *_R("mean_jaccard", "identical_share"), "n_runs")


_FLAGGED = "f AS (SELECT event_type AS run, CAST(avg((value < 5)::INT) > 0.4 AS VARCHAR) AS zero_inflated, CAST(max(value) > 300 AS VARCHAR) AS fractional FROM events GROUP BY 1)"


@query("q11_flags", f"WITH {_FLAGGED}, l AS (SELECT run, 'zero_inflated' AS name, zero_inflated AS value FROM f UNION ALL SELECT run, 'fractional', fractional FROM f), t(name, want) AS (VALUES ('zero_inflated', 'true'), ('fractional', 'false'), ('negative', 'false')) SELECT l.run, count(DISTINCT t.name) AS n_flags, count(*) FILTER (l.name = t.name AND value = want) AS n_right, round(count(*) FILTER (l.name = t.name AND value = want) / 3.0::DOUBLE, 9) AS accuracy FROM l, t GROUP BY 1")
def q11_flags(spark, sf_dir):
    """Q11, Q9: accuracy of the flags that each run sets; one that none sets is wrong."""
    e = read(spark, sf_dir, "events")
    f = e.groupBy(F.col("event_type").alias("run")).agg((F.avg((F.col("value") < 5).cast("int")) > 0.4).cast("string").alias("zero_inflated"), (F.max("value") > 300).cast("string").alias("fractional"))
    said = f.unpivot("run", ["zero_inflated", "fractional"], "name", "value")
    truth = spark.createDataFrame([("zero_inflated", "true"), ("fractional", "false"), ("negative", "false")], "name string, value string")
    return onboarding.flag_accuracy(f, said, truth).select("run", "n_flags", "n_right", *_R("accuracy"))


_FACT = "x AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderkey % 9 = 0 THEN -o_totalprice ELSE o_totalprice END AS v, CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END AS p FROM orders)"


@query(
    "q9_issue_list",
    f"WITH {_FACT}, s AS (SELECT avg(1 - n / (datediff('day', a, b) + 1)::DOUBLE) AS m FROM (SELECT min(d) AS a, max(d) AS b, count(DISTINCT d) AS n FROM x GROUP BY k)), w AS (SELECT (datediff('day', min(d), max(d)) + 1 - count(DISTINCT d))::DOUBLE AS m FROM x), "
    "i AS (SELECT 'negative values of the target' AS issue, 'v' AS column, avg((v < 0)::INT) AS evidence FROM x HAVING avg((v < 0)::INT) > 0 UNION ALL SELECT 'days without a row within a series', NULL, m FROM s WHERE m > 0 UNION ALL SELECT 'days missing for every series', NULL, m FROM w WHERE m > 0 "
    "UNION ALL SELECT 'nulls in a column', 'p', avg((p IS NULL)::INT) FROM x HAVING avg((p IS NULL)::INT) > 0 UNION ALL SELECT 'no column that looks like a price', NULL, 0) SELECT issue, \"column\", round(evidence, 9) AS evidence FROM i",
)
def q9_issues(spark, sf_dir):
    """Q9: what is wrong with a fact table, orders with some targets negative and some values gone."""
    o, key = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    fact = o.select(F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("d"), F.when(key % 9 == 0, -F.col("o_totalprice")).otherwise(F.col("o_totalprice")).alias("v"), F.when(key % 5 > 0, F.col("o_orderpriority")).alias("p"))
    return onboarding.issue_list(fact, "d", ["k"], "v").select("issue", "column", *_R("evidence"))


@query("q11_issue_recall", "WITH g AS (SELECT source AS run, count(*) AS n_issues, count(*) FILTER (NOT (regexp_matches(lower(text), 'data|model') OR regexp_matches(lower(text), '(very|most).{0,40}time'))) AS n_unmatched, bool_or(regexp_matches(lower(text), 'data|model')) AS hit_a, bool_or(regexp_matches(lower(text), '(very|most).{0,40}time')) AS hit_b FROM documents WHERE text IS NOT NULL GROUP BY 1) SELECT *, round((hit_a::INT + hit_b::INT) / 2.0::DOUBLE, 9) AS recall FROM g")
def q11_recall(spark, sf_dir):
    """Q11: which categories of issues each source's texts speak of."""
    d = read(spark, sf_dir, "documents").where("text is not null").select(F.col("source").alias("run"), "text")
    return onboarding.issue_recall(d, d, {"a": "data|model", "b": "(very|most).{0,40}time"}).withColumn("recall", F.round("recall", 9))


@query("q13_config_choice", "WITH c AS (SELECT s_nationkey AS k, count(*) AS n, round(max(s_acctbal), 2) AS top, min(s_suppkey) AS first FROM supplier GROUP BY 1) SELECT k, n, top, first FROM c ORDER BY n DESC, top DESC, first LIMIT 1")
def q13(spark, sf_dir):
    """The best configuration by several keys."""
    c = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n"), F.round(F.max("s_acctbal"), 2).alias("top"), F.min("s_suppkey").alias("first"))
    return c.orderBy(F.desc("n"), F.desc("top"), "first").limit(1)


@query("r1_report")
def r1(spark, sf_dir):
    """R1, K15, DM10: a narrated report of each monitored feature that drifts."""
    return report.reports(retail_panel(spark, sf_dir), RETAIL_WINDOWS)


@query("a8_synthetic_panel")
def a8(spark, sf_dir):
    """A seeded synthetic panel with as many items and stores as there are parts and nations."""
    p = synthetic.panel(spark, days=30, items=read(spark, sf_dir, "part").count(), stores=read(spark, sf_dir, "nation").count(), seed=7)
    return p.groupBy("state_id", "is_weekend").agg(F.count("*").alias("n"), F.avg("sales").alias("mean"))


@query("m2_m4_demand_model")
def m2(spark, sf_dir):
    """M1-M3: a Poisson regression as the demand model, trained on the reference window, and its errors (boosted trees: modelling.py)."""
    p = event_panel(spark, sf_dir)
    from ..sources.panel import EVENT_WINDOWS

    numeric, categorical = ("wday", "is_weekend"), ("dept_id", "store_id")
    m = model.train(p, EVENT_WINDOWS, numeric, categorical)
    return model.score(m, p).groupBy("dept_id").agg(F.avg("abs_error").alias("mae"), F.avg("residual").alias("bias"))




@query("a7_first_available", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, 'orders.parquet' AS source FROM orders")
def a7(spark, sf_dir):
    """The first source that can be read, a missing one passed over."""
    from ..sources import io

    df, name = io.first_available(spark, [(f"{sf_dir}/no_such_table.parquet", spark.read.parquet), (f"{sf_dir}/orders.parquet", spark.read.parquet)], lambda: synthetic.panel(spark))
    return df.agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).withColumn("source", F.lit(name.rsplit("/", 1)[-1]))


@query(
    "a17_obscured_copy",
    "WITH c AS (SELECT c_mktsegment AS v, 'v' || dense_rank() OVER (ORDER BY c_mktsegment) AS code FROM (SELECT DISTINCT c_mktsegment FROM customer)) SELECT c_custkey, code AS x1 FROM customer JOIN c ON v = c_mktsegment",
)
def a17(spark, sf_dir):
    """Values replaced by codes, columns renamed."""
    from ..sources import io

    hidden, _ = io.obscured(read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"], {"c_mktsegment": "x1"})
    return hidden
