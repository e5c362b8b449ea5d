"""A table of a model's answers to re-ranking trials: joined with all trials' pools in one plan, and summed up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import wilson

#: An answer that was used; and reasons for which no call was made.
OK, NOT_ASKED = "ok", ("not_detected", "no_candidates")
#: Kinds of failed calls that are counted by name.
FAILURES = ("rate_limit", "timeout", "network_error", "malformed_response", "auth_error", "http_error")


def rerank_answers(pools: DataFrame, answers: DataFrame) -> DataFrame:
    """trial_id, repeat, arm (base or model), reason, rank, slice_col, slice_val: the pool's order and the answer's, of every answer; no job a trial.

    pools: trial_id, rank, slice_col, slice_val; answers: trial_id, repeat, reason, order (places of the pool from 0). What an answer leaves out follows in the pool's order. An order with a
    place twice or outside the pool is malformed, and like any other reason than "ok" it leaves the pool as it is. An answer to a trial without candidates has no rows.
    """
    size = pools.groupBy("trial_id").agg(F.count("*").alias("_size"))
    good = (F.size(F.array_distinct("order")) == F.size("order")) & F.forall("order", lambda i: (i >= 0) & (i < F.col("_size")))
    asked = answers.select("trial_id", "repeat", "reason", "order").join(size, "trial_id")
    valid = F.coalesce(good, F.lit(False))
    asked = asked.withColumn("reason", F.when((F.col("reason") == OK) & ~valid, "malformed_response").otherwise(F.col("reason")))
    rows = pools.join(asked, "trial_id")
    at = F.array_position("order", (F.col("rank") - 1).cast("int"))
    place = F.when(F.col("reason") == OK, F.when(at > 0, at).otherwise(F.size("order") + F.col("rank"))).otherwise(F.col("rank"))
    model = F.row_number().over(Window.partitionBy("trial_id", "repeat").orderBy(place))
    both = F.explode(F.array(F.struct(F.lit("base").alias("arm"), F.col("rank").cast("int").alias("rank")), F.struct(F.lit("model").alias("arm"), F.col("_rank").alias("rank"))))
    return rows.withColumn("_rank", model).select("trial_id", "repeat", "reason", "slice_col", "slice_val", both.alias("b")).select("trial_id", "repeat", F.col("b.arm").alias("arm"), "reason", F.col("b.rank").alias("rank"), "slice_col", "slice_val")


def accuracy(answers: DataFrame, by: str, metrics: Sequence[str], used: str = "used") -> DataFrame:
    """by (ALL: all), metric, and of all answers as they fired and of the used ones: k, n, rate and Wilson bounds. A fallback counts as fired with what it fell back to."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.coalesce(F.col(m), F.lit(False)).alias("hit")) for m in metrics)))
    g = answers.select(by, F.col(used).alias("_used"), each.alias("m")).select(by, "_used", "m.*").rollup("metric", by)
    out = g.agg(F.count_if("hit").alias("k"), F.count("*").alias("n"), F.count_if(F.col("hit") & F.col("_used")).alias("k_used"), F.count_if("_used").alias("n_used")).where("metric is not null")
    columns = []
    for k, n, name in (("k", "n", "fired"), ("k_used", "n_used", "used")):
        lo, hi = wilson(F.col(k), F.col(n))
        columns += [F.col(k).alias(f"{name}_k"), F.col(n).alias(f"{name}_n"), F.try_divide(k, n).alias(f"{name}_rate"), lo.alias(f"{name}_lo"), hi.alias(f"{name}_hi")]
    return out.select(F.coalesce(by, F.lit("ALL")).alias(by), "metric", *columns)


def fallbacks(answers: DataFrame, keys: Sequence[str] = ("seed", "repeat")) -> DataFrame:
    """keys, reason, n, share: why answers were not used, those that were included."""
    n = answers.groupBy(*keys, "reason").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def usage(answers: DataFrame) -> DataFrame:
    """One row: calls made and used, tokens in all and a call, latency, and failed calls by kind. A trial that was never asked is no call; means of no calls are null."""
    asked = ~F.col("reason").isin(*NOT_ASKED)
    of = lambda c: F.when(asked, F.col(c))
    return answers.agg(
        F.count_if(asked).alias("n_calls"), F.count_if(F.col("reason") == OK).alias("n_used"),
        *(F.coalesce(F.sum(of(c)), F.lit(0)).alias(f"total_{c}") for c in ("prompt_tokens", "completion_tokens")), *(F.avg(of(c)).alias(f"mean_{c}") for c in ("prompt_tokens", "completion_tokens", "latency_s")),
        F.percentile(of("latency_s"), F.lit(0.95)).alias("p95_latency_s"), *(F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in FAILURES),
    )


def stability(answers: DataFrame, keys: Sequence[str] = ("seed", "drift_type", "trial")) -> DataFrame:
    """keys, n_repeats, identical, top1_identical: of every trial with two used repeats or more, whether all of them gave one order, and one first place. One aggregation: orders never meet in pairs."""
    g = answers.where(F.col("reason") == OK).groupBy(*keys).agg(F.count("*").alias("n_repeats"), F.count_distinct("ranking").alias("_orders"), F.count_distinct(F.coalesce(F.get("ranking", F.lit(0)), F.lit(""))).alias("_firsts"))
    return g.where("n_repeats > 1").select(*keys, "n_repeats", (F.col("_orders") == 1).alias("identical"), (F.col("_firsts") == 1).alias("top1_identical"))


def arm_accuracy(trials: DataFrame, metrics: Sequence[str], ok: str = "ok") -> DataFrame:
    """arm, drift_type (ALL: all), metric, k, n, n_trials, n_fallbacks, rate, lo, hi: fallbacks (ok false) are left out of k and n, and counted. A null ok is no fallback: arms without a model have none."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.coalesce(F.col(m), F.lit(False)).alias("hit")) for m in metrics)))
    rows = trials.select("arm", "drift_type", F.coalesce(F.col(ok), F.lit(True)).alias("_ok"), each.alias("m")).select("arm", "drift_type", "_ok", "m.*")
    g = rows.rollup("arm", "metric", "drift_type").agg(F.count_if(F.col("hit") & F.col("_ok")).alias("k"), F.count_if("_ok").alias("n"), F.count("*").alias("n_trials")).where("metric is not null")
    lo, hi = wilson(F.col("k"), F.col("n"))
    return g.select("arm", F.coalesce("drift_type", F.lit("ALL")).alias("drift_type"), "metric", "k", "n", "n_trials", (F.col("n_trials") - F.col("n")).alias("n_fallbacks"), F.try_divide("k", "n").alias("rate"), lo.alias("lo"), hi.alias("hi"))
