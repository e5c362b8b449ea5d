"""The full fit of the checker's thresholds against a loop over trials and combinations."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators import quality
from tidewell.sources.panel import SLICE_COLUMNS

GRID = {"k_zero": (2, 5), "m_ref": (0.5, 2.0, 3.0), "k_stale": (3, 6), "n_min": (1, 4)}
STATS = "id string, trail_run int, trail_value double, ref_mean double, duplicated boolean, cat_id string, dept_id string, state_id string, store_id string, item_id string, trial_id string"


def brute_decide(rows, k_zero, m_ref, k_stale, n_min):
    def locate(flagged):
        best, best_f1 = (None, None), -1.0
        for c in range(5):
            for v in sorted({r[5 + c] for r in rows}):
                own = {r[0] for r in rows if r[5 + c] == v}
                tp = len(own & flagged)
                if tp and 2 * tp / (len(own) + len(flagged)) > best_f1 + 1e-12:
                    best, best_f1 = (SLICE_COLUMNS[c], v), 2 * tp / (len(own) + len(flagged))
        return best

    dup = {r[0] for r in rows if r[4]}
    zero = {r[0] for r in rows if r[2] == 0 and r[1] >= k_zero and r[3] >= m_ref}
    stale = {r[0] for r in rows if r[2] != 0 and r[1] >= k_stale}
    if dup:
        return "duplicated_rows", locate(dup)
    if len(zero) >= n_min and (len(stale) < n_min or len(zero) >= len(stale)):
        return "zero_fill", locate(zero)
    return ("stale_feed", locate(stale)) if len(stale) >= n_min else ("none", (None, None))


def test_fit_is_that_of_a_loop(spark):
    rng, stats, truth = random.Random(3), [], []
    for t, kind in enumerate(["zero_fill"] * 4 + ["stale_feed"] * 4 + ["duplicated_rows"] * 2 + ["clean"] * 4):
        name, store = f"t{t}", f"s{t % 3}"
        truth.append((name, kind, "store_id", store) if kind != "clean" else (name, kind, None, None))
        for i in range(24):
            at = (f"c{i % 2}", f"d{i % 4}", f"x{i % 2}", f"s{i % 3}", f"i{i}")
            hit = at[3] == store and rng.random() < 0.9
            value = 0.0 if (kind == "zero_fill" and hit) or rng.random() < 0.1 else 1.5
            run = rng.randint(3, 9) if hit and kind in ("zero_fill", "stale_feed") else rng.randint(1, 4)
            stats.append((f"{name}/{i}", run, value, rng.choice([0.1, 1.0, 2.5, 4.0]), kind == "duplicated_rows" and hit, *at, name))
    truth.append(("t99", "clean", None, None))  # a trial without series finds nothing
    got = quality.fit_thresholds(spark.createDataFrame(stats, STATS).repartition(3), spark.createDataFrame(truth, "trial_id string, kind string, true_col string, true_val string"), GRID).collect()
    want = []
    for place, combo in enumerate(itertools.product(*GRID.values())):
        right = {k: [] for k in quality.FIT_KINDS}
        for name, kind, col, val in truth:
            fault, where = brute_decide([r for r in stats if r[-1] == name], *combo)
            right[kind].append(fault == "none" if kind == "clean" else (fault == kind and where == (col, val)))
        want.append((place, *combo, *(sum(v) / len(v) for v in right.values())))
    got = sorted(got, key=lambda r: r["place"])
    assert [tuple(r)[:5] for r in got] == [w[:5] for w in want]
    for r, w in zip(got, want, strict=True):
        assert tuple(r)[5:9] == pytest.approx(w[5:]) and r["score"] == pytest.approx(sum(w[5:]) / 4)
    best = max(want, key=lambda w: (round(sum(w[5:]), 10), -w[0]))
    assert [r["place"] for r in got if r["picked"]] == [best[0]]
    assert len({r["score"] for r in got}) > 5


def test_settings_meet_by_trial_only(spark):
    """Counts of all settings come from one aggregation: the plan has no join of series with settings."""
    stats = spark.createDataFrame([("t/1", 9, 0.0, 5.0, False, "c", "d", "x", "s", "i", "t")], STATS)
    got = {(r["rule"], r["i"]): r for r in quality.located_counts(stats).collect()}
    assert len(got) == 36 + 5 + 1 and got["zero", 0]["n"] == 1 and got["zero", 0]["loc_col"] == "cat_id"
    assert got["zero", 35]["n"] == 0 and got["zero", 35]["loc_col"] is None and got["duplicated", 0]["n"] == 0
    assert quality.fit_thresholds(stats.where(F.lit(False)), spark.createDataFrame([], "trial_id string, kind string, true_col string, true_val string")).count() == 0
