"""Seeded draws, the bootstrap over rows, and the head-to-head of two ways to localise, against plain Python."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from tests.test_operators import W, small_panel
from tidewell.functions import draws
from tidewell.operators import hierarchy, scoring, trials
from tidewell.operators.boosting import Model, Split, Tree
from tidewell.operators.inject import Injection


def pieces(*parts):
    h = draws.hash_text(*parts)
    return [int(h[8 * i : 8 * i + 8], 16) / 2**32 for i in range(4)]


def test_draws_are_those_of_python(spark):
    df = spark.range(500).select("id", draws.uniforms(draws.hash_of(F.lit(3), F.col("id"))).alias("u"))
    got = {r["id"]: r["u"] for r in df.collect()}
    assert all(got[i] == pieces(3, i) for i in range(500))
    times = df.select(F.explode("u").alias("u")).select(draws.poisson(F.col("u")).alias("k")).groupBy("k").count().collect()
    share = {r["k"]: r["count"] / 2000 for r in times}
    assert share[0] == pytest.approx(0.3679, abs=0.04) and share[2] == pytest.approx(0.1839, abs=0.03)
    assert sum(k * v for k, v in share.items()) == pytest.approx(1, abs=0.08)


def test_draws_are_told_from_digits(spark):
    marks = {min(max(int(s * 2**32) + d, 0), 2**32 - 1) for s in [0.0, 1.0, *draws.poisson_steps()] for d in (-1, 0, 1, 2)}
    df = spark.createDataFrame([(f"{m:08x}", m / 2**32) for m in marks], "digits string, u double")
    assert df.where(draws.poisson_of(F.col("digits")) != draws.poisson(F.col("u"))).count() == 0


def test_a_row_is_copied_once_a_hash(spark):
    g = scoring.resamples(spark.range(50).select("id", (F.col("id") % 2 == 0).alias("y"), (F.col("id") % 3 == 0).alias("p")), "id", "y", "p", 40, 1)
    plan = g._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("posexplode") < plan.index("Aggregate [_block")  # printed from the top: draws are unpacked after they are added up


@pytest.mark.parametrize("n", [1, 6])
def test_every_row_is_resampled(spark, n):
    rng = random.Random(1)
    rows = [(f"k{i}", rng.random() < 0.4, rng.random() < 0.5) for i in range(300)]
    df = spark.createDataFrame(rows, "id string, y boolean, p boolean").repartition(5)
    got = {r["resample"]: (r["tp"], r["fp"], r["fn"], r["tn"]) for r in scoring.resamples(df, "id", "y", "p", n, 9).collect()}
    steps = draws.poisson_steps()
    for b in range(n):
        want = {c: 0 for c in [(True, True), (True, False), (False, True), (False, False)]}
        for k, y, p in rows:
            want[p, y] += sum(pieces(9, b // 4, k)[b % 4] >= s for s in steps)
        assert got[b] == (want[True, True], want[True, False], want[False, True], want[False, False])
    assert len(got) == n


def test_bootstrap_bounds(spark):
    df = spark.range(400).select("id", (F.col("id") % 3 == 0).alias("y"), (F.col("id") % 4 == 0).alias("p"))
    r = scoring.bootstrap(df, "y", "p", 300).first()
    truth = (34 / 134 + 200 / 266) / 2
    assert r["lo"] < truth < r["hi"] < r["lo"] + 0.15
    assert scoring.bootstrap(df.repartition(7), "y", "p", 300).first() == r
    one = scoring.bootstrap(df.withColumn("y", F.lit(True)), "y", "p", 20).first()
    assert one["lo"] is None and scoring.bootstrap(df.where("false"), "y", "p", 20).first()["lo"] is None


def test_draws_among_all_values(spark):
    """Values drawn by one job are those that a loop over all of them draws; a column without values has no trials."""
    p = small_panel(spark, [(f"{'abc'[i % 3]}{i}", f"s{i % 40}", 1 + i % 20, 1) for i in range(300)])
    values = {c: [r[0] for r in p.select(c).distinct().collect()] for c in ("dept_id", "store_id", "item_id")}
    assert len(values["item_id"]) == 300
    got = trials.draw_trials_of(p, date(2024, 1, 1), 7, 4)
    assert got == list(trials.draw_trials(values, date(2024, 1, 1), 7, 4))
    assert len({i.slice_val for _, _, i in got if i.slice_col == "item_id"}) > 1
    assert all(len(i.spikes) == 4 and i.spikes == tuple(sorted(i.spikes)) for _, _, i in got if i.kind == "intermittent")
    none = p.withColumn("store_id", F.lit(None).cast("string"))
    assert {i.slice_col for _, _, i in trials.draw_trials_of(none, date(2024, 1, 1), 7, 1)} == {"dept_id", "item_id"}


def test_head_to_head(spark):
    """A change of price that leaves sales alone is found by contributions of the price only, a change of sales by the ranking only."""
    p = small_panel(spark, [(i, s, d, 1 + (d + ord(i)) % 3) for i in "ab" for s in "123" for d in range(1, 21)])
    m = Model(("sell_price",), (), 0.0, [Tree({1: Split("sell_price", 2.5)}, {2: -0.1, 3: 0.4}, {1: 10, 2: 6, 3: 4})])
    drawn = [("a", W, Injection("price_shift", "store_id", "1", W.cur_start, W.cur_end, 1.0)), ("b", W, Injection("unit_change", "store_id", "2", W.cur_start, W.cur_end)), ("c", W, Injection("sudden", "store_id", "3", W.cur_start, W.cur_end, 0.0))]
    out = trials.head_to_head(p, drawn, m, hierarchy.closure(hierarchy.edges(p)), columns=("cat_id", "store_id"), min_slice_size=1)
    got = {(r["trial_id"], r["arm"]): r for r in out.collect()}
    assert len(got) == 6
    assert got["a", "contributions"]["strict_top1"] and got["b", "ranking"]["strict_top1"]
    assert not got["b", "contributions"]["strict_top1"] and got["b", "ranking"]["detected"] and not got["c", "ranking"]["detected"]
    rates = {(r["arm"], r["drift_type"]): r for r in trials.arm_rates(out).collect()}
    assert rates["ranking", "unit_change"]["strict_top1"] == 1.0 and rates["contributions", "unit_change"]["strict_top1"] == 0.0
    assert rates["ranking", "ALL"]["n"] == 3 and rates["ranking", "sudden"]["n_detected"] == 0 and rates["ranking", "sudden"]["strict_top1"] is None
