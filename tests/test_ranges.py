"""Running sums and positions over ranges against a plain loop."""

import random

import pytest

from tidewell.functions.ranges import positions, running
from tidewell.operators import scoring


def test_running_sums(spark):
    rng = random.Random(1)
    rows = [(float(x), rng.randint(0, 5), rng.randint(0, 5)) for x in rng.sample(range(10_000), 500)]
    got = {r["x"]: r for r in running(spark.createDataFrame(rows, "x double, a int, b int").repartition(7), "x", ("a", "b")).collect()}
    a = b = 0
    prev = None
    for x, da, db in sorted(rows):
        assert (got[x]["a_below"], got[x]["b_below"], got[x]["prev"]) == (a, b, prev)
        a, b, prev = a + da, b + db, x


def test_positions(spark):
    rows = [(g, f"v{i:04d}") for g in "abc" for i in range({"a": 1, "b": 300, "c": 40}[g])]
    got = positions(spark.createDataFrame(rows, "g string, v string").repartition(6), "g", "v").collect()
    assert sorted((r["g"], r["v"], r["position"]) for r in got) == [(g, v, int(v[1:]) + 1) for g, v in sorted(rows)]
    assert positions(spark.createDataFrame([], "g string, v string"), "g", "v").collect() == []


def test_threshold_of_a_loop(spark):
    rng = random.Random(2)
    rows = [(rng.choice([*range(12), None]), rng.random() < 0.4) for _ in range(300)]
    rows = [(None if x is None else float(x), y if x is None or rng.random() < 0.3 else x > 7) for x, y in rows]
    known = [(x, y) for x, y in rows if x is not None]
    values = sorted({x for x, _ in known})
    cuts = [values[0] - 1, *((p + q) / 2 for p, q in zip(values, values[1:], strict=False)), values[-1] + 1]
    pos, neg = sum(y for _, y in known), sum(not y for _, y in known)
    score = {t: (sum(y and x >= t for x, y in known) / pos + sum((not y) and x < t for x, y in known) / neg) / 2 for t in cuts}
    best = max(score.values())
    tied = sorted(t for t in cuts if abs(score[t] - best) < 1e-12)
    got = scoring.threshold_fit(spark.createDataFrame(rows, "x double, y boolean"), "x", "y").first()
    assert got["balanced"] == pytest.approx(best) and got["threshold"] == pytest.approx((tied[(len(tied) - 1) // 2] + tied[len(tied) // 2]) / 2)
