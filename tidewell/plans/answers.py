"""Queries: summaries of a model's answers (L11, L12, L15, E14), over orders as a stand-in: an order is an answer, two keys in a row its repeats; and answers joined with the pools of injected trials."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers, hierarchy, inject, trials
from ..sources.panel import COARSE_COLUMNS, EVENT_WINDOWS, event_panel, read, tag
from .registry import query
from .trials import _TRIALS

_A = (
    "a AS (SELECT o_orderkey % 3 AS seed, o_orderpriority AS drift_type, o_orderkey // 2 AS trial, o_orderkey % 2 AS repeat, CASE o_custkey % 11 WHEN 0 THEN 'timeout' WHEN 1 THEN 'rate_limit' WHEN 2 THEN 'malformed_response' WHEN 3 THEN 'not_detected' ELSE 'ok' END AS reason, "
    "o_custkey % 900 + 100 AS prompt_tokens, o_orderkey % 50 AS completion_tokens, (o_custkey % 100) / 10.0::DOUBLE AS latency_s, [CAST(o_custkey % 2 AS VARCHAR), o_orderstatus] AS ranking, o_custkey % 7 < 3 AS strict, o_custkey % 7 < 5 AS hier, o_orderstatus AS arm FROM orders)"
)
_W = lambda k, n, p: f"round({k} / nullif({n}, 0)::DOUBLE, 9) AS {p}rate, round(greatest(0, ({k} / {n}::DOUBLE + zz / (2 * {n})) / (1 + zz / {n}) - sqrt(zz) * sqrt({k} / {n}::DOUBLE * (1 - {k} / {n}::DOUBLE) / {n} + zz / (4.0 * {n} * {n})) / (1 + zz / {n})), 9) AS {p}lo, round(least(1, ({k} / {n}::DOUBLE + zz / (2 * {n})) / (1 + zz / {n}) + sqrt(zz) * sqrt({k} / {n}::DOUBLE * (1 - {k} / {n}::DOUBLE) / {n} + zz / (4.0 * {n} * {n})) / (1 + zz / {n})), 9) AS {p}hi"
_ZZ = "z AS (SELECT 1.959963984540054 * 1.959963984540054 AS zz)"
_LONG = "m AS (SELECT *, 'strict' AS metric, strict AS hit FROM a UNION ALL SELECT *, 'hier', hier FROM a)"


def _answers(spark, sf_dir):
    o, key, cust = read(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    reason = F.when(cust % 11 == 0, "timeout").when(cust % 11 == 1, "rate_limit").when(cust % 11 == 2, "malformed_response").when(cust % 11 == 3, "not_detected").otherwise("ok")
    return o.select(
        (key % 3).alias("seed"), F.col("o_orderpriority").alias("drift_type"), F.floor(key / 2).alias("trial"), (key % 2).alias("repeat"), reason.alias("reason"), (cust % 900 + 100).alias("prompt_tokens"), (key % 50).alias("completion_tokens"), ((cust % 100) / 10.0).alias("latency_s"),
        F.array((cust % 2).cast("string"), "o_orderstatus").alias("ranking"), (cust % 7 < 3).alias("strict"), (cust % 7 < 5).alias("hier"), F.col("o_orderstatus").alias("arm"),
    ).withColumn("used", F.col("reason") == "ok")


def _rounded(df):
    return df.select(*(F.round(c, 9).alias(c) if t == "double" else c for c, t in df.dtypes))


@query("l11_fired_and_used", f"WITH {_A}, {_LONG}, {_ZZ}, g AS (SELECT coalesce(drift_type, 'ALL') AS drift_type, metric, count(*) FILTER (hit) AS fk, count(*) AS fn, count(*) FILTER (hit AND reason = 'ok') AS uk, count(*) FILTER (reason = 'ok') AS un FROM m GROUP BY GROUPING SETS ((metric, drift_type), (metric))) SELECT drift_type, metric, fk AS fired_k, fn AS fired_n, {_W('fk', 'fn', 'fired_')}, uk AS used_k, un AS used_n, {_W('uk', 'un', 'used_')} FROM g, z")
def l11(spark, sf_dir):
    """Accuracy as fired and of the used answers only, by type and pooled, with Wilson bounds."""
    return _rounded(answers.accuracy(_answers(spark, sf_dir), "drift_type", ("strict", "hier")))


@query("l12_fallbacks", f"WITH {_A} SELECT seed, repeat, reason, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY seed, repeat)::DOUBLE, 9) AS share FROM a GROUP BY seed, repeat, reason")
def l12_fallbacks(spark, sf_dir):
    """Why answers were not used."""
    return _rounded(answers.fallbacks(_answers(spark, sf_dir)))


_ASKED = "FILTER (reason <> 'not_detected')"


@query(
    "l12_usage",
    f"WITH {_A} SELECT count(*) {_ASKED} AS n_calls, count(*) FILTER (reason = 'ok') AS n_used, CAST(sum(prompt_tokens) {_ASKED} AS BIGINT) AS total_prompt_tokens, CAST(sum(completion_tokens) {_ASKED} AS BIGINT) AS total_completion_tokens, round(avg(prompt_tokens) {_ASKED}, 9) AS mean_prompt_tokens, "
    f"round(avg(completion_tokens) {_ASKED}, 9) AS mean_completion_tokens, round(avg(latency_s) {_ASKED}, 9) AS mean_latency_s, round(quantile_cont(latency_s, 0.95) {_ASKED}, 9) AS p95_latency_s, " + ", ".join(f"count(*) FILTER (reason = '{r}') AS n_{r}" for r in answers.FAILURES) + " FROM a",
)
def l12_usage(spark, sf_dir):
    """Calls, tokens, latency, failures by kind."""
    return _rounded(answers.usage(_answers(spark, sf_dir)))


@query("l12_stability", f"WITH {_A}, g AS (SELECT trial, count(*) AS n, count(DISTINCT ranking) AS o, count(DISTINCT ranking[1]) AS f FROM a WHERE reason = 'ok' GROUP BY 1 HAVING count(*) > 1) SELECT n AS n_repeats, o = 1 AS identical, f = 1 AS top1_identical, count(*) AS n_trials FROM g GROUP BY ALL")
def l12_stability(spark, sf_dir):
    """Agreement of a trial's repeats."""
    return answers.stability(_answers(spark, sf_dir), ("trial",)).groupBy("n_repeats", "identical", "top1_identical").agg(F.count("*").alias("n_trials"))


@query("l15_arms_without_fallbacks", f"WITH {_A}, {_LONG}, {_ZZ}, g AS (SELECT arm, coalesce(drift_type, 'ALL') AS drift_type, metric, count(*) FILTER (hit AND reason = 'ok') AS k, count(*) FILTER (reason = 'ok') AS n, count(*) AS n_trials FROM m GROUP BY GROUPING SETS ((arm, metric, drift_type), (arm, metric))) SELECT arm, drift_type, metric, k, n, n_trials, n_trials - n AS n_fallbacks, {_W('k', 'n', '')} FROM g, z")
def l15(spark, sf_dir):
    """Arms with fallbacks left out and counted."""
    return _rounded(answers.arm_accuracy(_answers(spark, sf_dir), ("strict", "hier"), "used"))


@query("l16_answers_in_one_plan")
def l16_plan(spark, sf_dir):
    """Three trials' pools, each with three answers, joined and scored in one plan: both arms, strictly and along the hierarchy."""
    p = event_panel(spark, sf_dir)
    pools = trials.localise_trials(tag(inject.with_trials(p, _TRIALS), EVENT_WINDOWS), "sales", COARSE_COLUMNS)
    given = [(n, r, reason, order) for n, _ in _TRIALS for r, (reason, order) in enumerate([("ok", [1, 0]), ("ok", [0, 0]), ("timeout", None)])]
    ranked = answers.rerank_answers(pools, spark.createDataFrame(given, "trial_id string, repeat int, reason string, order array<int>"))
    truth = ranked.select("trial_id", "repeat", "arm", "reason").distinct().join(spark.createDataFrame([(n, i.slice_col, i.slice_val) for n, i in _TRIALS], "trial_id string, true_col string, true_val string"), "trial_id")
    scored = trials.score_rankings(ranked.drop("reason"), truth, hierarchy.closure(hierarchy.edges(p)), by=("trial_id", "repeat", "arm"))
    return truth.select("trial_id", "repeat", "arm", "reason").join(scored, ["trial_id", "repeat", "arm"])
