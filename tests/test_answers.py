"""Answers joined with pools, and their summaries, by hand."""

import pytest

from tidewell.operators import answers

POOL = "trial_id string, rank int, slice_col string, slice_val string"
ANSWER = "trial_id string, repeat int, reason string, order array<int>"
TRIAL = "seed int, drift_type string, trial int, repeat int, reason string, prompt_tokens int, completion_tokens int, latency_s double, ranking array<string>"


def test_orders_of_answers(spark):
    pools = spark.createDataFrame([(t, r, "c", f"{t}{r}") for t in "ab" for r in (1, 2, 3)], POOL)
    given = [("a", 0, "ok", [2, 0]), ("a", 1, "ok", [1, 1]), ("b", 0, "timeout", None), ("b", 1, "ok", [3]), ("b", 2, "ok", []), ("b", 3, "ok", None), ("none", 0, "ok", [0])]
    rows = answers.rerank_answers(pools, spark.createDataFrame(given, ANSWER)).collect()
    order = lambda t, k, arm: [r["slice_val"][1:] for r in sorted((r for r in rows if (r["trial_id"], r["repeat"], r["arm"]) == (t, k, arm)), key=lambda r: r["rank"])]
    why = {(r["trial_id"], r["repeat"]): r["reason"] for r in rows}
    assert order("a", 0, "model") == ["3", "1", "2"] and order("a", 0, "base") == ["1", "2", "3"] and why["a", 0] == "ok"
    assert order("a", 1, "model") == ["1", "2", "3"] and why["a", 1] == "malformed_response"
    assert order("b", 0, "model") == ["1", "2", "3"] and why["b", 0] == "timeout" and why["b", 1] == "malformed_response"
    assert why["b", 2] == "ok" and order("b", 2, "model") == ["1", "2", "3"] and why["b", 3] == "malformed_response"
    assert len(rows) == 6 * 3 * 2


def test_summaries(spark):
    rows = [
        (1, "x", 1, 0, "ok", 100, 10, 1.0, ["a", "b"]), (1, "x", 1, 1, "ok", 100, 10, 3.0, ["a", "c"]), (1, "x", 2, 0, "ok", 50, 5, 2.0, ["a", "b"]), (1, "x", 2, 1, "timeout", 40, 0, 9.0, None),
        (1, "y", 3, 0, "not_detected", None, None, None, None), (1, "y", 4, 0, "ok", 10, 1, 1.0, ["d"]), (1, "y", 4, 1, "ok", 10, 1, 1.0, ["d"]),
    ]
    df = spark.createDataFrame(rows, TRIAL)
    u = answers.usage(df).first()
    assert (u["n_calls"], u["n_used"], u["total_prompt_tokens"], u["n_timeout"], u["n_rate_limit"]) == (6, 5, 310, 1, 0)
    assert u["mean_latency_s"] == pytest.approx(17 / 6)
    got = {r["trial"]: (r["identical"], r["top1_identical"]) for r in answers.stability(df).collect()}
    assert got == {1: (False, True), 4: (True, True)}
    f = {(r["repeat"], r["reason"]): (r["n"], r["share"]) for r in answers.fallbacks(df).collect()}
    assert f[0, "ok"] == (3, 0.75) and f[1, "timeout"] == (1, 1 / 3)
    empty = answers.usage(df.where("false")).first()
    assert empty["n_calls"] == 0 and empty["mean_latency_s"] is None and empty["total_prompt_tokens"] == 0


def test_fallbacks_are_left_out_and_counted(spark):
    rows = [("m", "x", True, True), ("m", "x", False, True), ("m", "y", False, False), ("d", "x", None, True), ("d", "y", None, None)]
    df = spark.createDataFrame(rows, "arm string, drift_type string, ok boolean, strict boolean")
    got = {(r["arm"], r["drift_type"]): r for r in answers.arm_accuracy(df, ("strict",)).collect()}
    assert (got["m", "x"]["k"], got["m", "x"]["n"], got["m", "x"]["n_trials"], got["m", "x"]["n_fallbacks"]) == (1, 1, 2, 1)
    assert got["m", "y"]["rate"] is None and got["m", "ALL"]["n_fallbacks"] == 2 and got["d", "ALL"]["rate"] == 0.5
    fired = {r["drift_type"]: r for r in answers.accuracy(df.fillna(False, ["ok"]), "drift_type", ("strict",), "ok").collect()}
    assert (fired["ALL"]["fired_k"], fired["ALL"]["fired_n"], fired["ALL"]["used_k"], fired["ALL"]["used_n"]) == (3, 5, 1, 1)
