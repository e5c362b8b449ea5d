"""Scores of conjunctions from the index of cells, against masks over the rows."""

import itertools
import math
import random
from datetime import date, timedelta

import pytest

from tidewell.operators import localise
from tidewell.sources.panel import Windows

W = Windows("2024-01-01", "2024-01-10", "2024-01-11", "2024-01-20")
COLUMNS = ("cat_id", "dept_id", "state_id", "store_id", "kind")


def panel(spark, shift=3.0, n=4000):
    rng, rows = random.Random(2), []
    for i in range(n):
        day = date(2024, 1, 1) + timedelta(i % 20)
        row = [rng.choice("ab"), rng.choice(["d1", "d2", None]), rng.choice("xy"), rng.choice(["s1", "s2", *(f"r{k}" for k in range(40))] if i % 2 else ["s1", "s2"]), rng.choice("mn")]
        planted = day > date(2024, 1, 10) and row == ["a", "d1", "x", "s1", "m"]
        rows.append((*row, day, rng.uniform(0, 10) + shift * planted, None if i % 97 else 1.0))
    return rows, spark.createDataFrame(rows, "cat_id string, dept_id string, state_id string, store_id string, kind string, date date, sales double, other double")


def js(p, q):
    part = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b, strict=True) if x > 0)
    return (part(p, q) + part(q, p)) / 2


def brute(rows, conditions):
    """(divergence removed, coverage) by masking rows."""
    lo, hi = min(r[6] for r in rows), max(r[6] for r in rows)
    bin_of = lambda x: sum(x >= lo + (hi - lo) * i / 20 for i in range(1, 20))
    count = lambda some: [sum(1 for r in some if bin_of(r[6]) == b) for b in range(20)]
    share = lambda c: [x / sum(c) for x in c]
    ref, cur = ([r for r in rows if (r[5] <= date(2024, 1, 10)) == side] for side in (True, False))
    inside = [r for r in cur if all(r[COLUMNS.index(c)] == v for c, v in conditions)]
    rest = [a - b for a, b in zip(count(cur), count(inside), strict=True)]
    return js(share(count(ref)), share(count(cur))) - js(share(count(ref)), share(rest)), len(inside) / len(cur)


def test_any_width_without_another_scan(spark):
    rows, df = panel(spark)
    index = localise.conjunction_index(df, "sales", W, COLUMNS, min_coverage=0.005)
    assert index.cells.count() <= 2 * 3 * 2 * 43 * 2
    asked = [[("cat_id", "a")], [("kind", "m"), ("cat_id", "a"), ("dept_id", "d1"), ("state_id", "x")], [("cat_id", "a"), ("dept_id", "d1"), ("state_id", "x"), ("store_id", "s1"), ("kind", "m")], [("cat_id", "a"), ("cat_id", "b")], [("store_id", "r3")], [("store_id", "s1"), ("store_id", "s1")]]
    df_asked = spark.createDataFrame([([{"col": c, "val": v} for c, v in a],) for a in asked], "conditions array<struct<col:string,val:string>>")
    got = {tuple((c["col"], c["val"]) for c in r["conditions"]): r for r in localise.score_conjunctions(index, df_asked).collect()}
    want = {tuple(sorted(set(a))): brute(rows, set(a)) for a in asked}
    want = {k: v for k, v in want.items() if v[1] >= 0.005}
    assert got.keys() == want.keys() and len(got) == 5
    for k, (score, coverage) in want.items():
        assert got[k]["score"] == pytest.approx(score, abs=1e-9) and got[k]["coverage"] == pytest.approx(coverage)


def test_all_conjunctions(spark):
    rows, df = panel(spark, n=1200)
    got = {tuple((c["col"], c["val"]) for c in r["conditions"]): r["score"] for r in localise.combination_scores(df, "sales", W, COLUMNS[:3], size=3, min_coverage=0.05).collect()}
    values = [[(c, v) for v in {r[i] for r in rows} if v] for i, c in enumerate(COLUMNS[:3])]
    every = [s for k in (1, 2, 3) for cols in itertools.combinations(values, k) for s in itertools.product(*cols)]
    want = {s: brute(rows, s) for s in every}
    want = {s: v[0] for s, v in want.items() if v[1] >= 0.05}
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s], abs=1e-9) for s in want)


def test_search_finds_a_conjunction_of_five(spark):
    _, df = panel(spark, shift=40.0, n=12_000)
    best = localise.search_conjunctions(df, "sales", W, COLUMNS, min_coverage=0.005).orderBy("rank").first()
    assert {(c["col"], c["val"]) for c in best["conditions"]} == {("cat_id", "a"), ("dept_id", "d1"), ("state_id", "x"), ("store_id", "s1"), ("kind", "m")}


def test_empty_windows(spark):
    _, df = panel(spark, n=40)
    assert localise.search_conjunctions(df.where("false"), "sales", W, COLUMNS).count() == 0
    assert localise.combination_scores(df.where("sales is null"), "sales", W, COLUMNS).count() == 0
