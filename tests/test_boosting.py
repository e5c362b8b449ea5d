"""Boosted trees against exhaustive search, brute-force Shapley values and the regression they replace."""

import itertools
import json
import math
import random
from datetime import date, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewell.operators import boosting, model
from tidewell.operators.boosting import Model, Params, Split, Tree
from tidewell.sources.panel import Windows

ROWS = "x double, z double, c string, k string, sales double, date date"
W = Windows("2024-01-01", "2024-02-15", "2024-02-16", "2024-03-10")


def table(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, z, c, k = rng.choice([0.5, 1.0, 2.5, 4.0, None]), rng.uniform(0, 10), rng.choice("abcdef"), rng.choice(["u", "v", None])
        mean = math.exp(0.3 * (x or 0) - (c in "bd") + 0.5 * (z > 6) * (c in "ae") + (k == "u") * 0.4)
        rows.append((x, z, c, k, float(sum(rng.random() < mean / 20 for _ in range(20))), date(2024, 1, 1) + timedelta(i % 70)))
    return rows, spark.createDataFrame(rows, ROWS)


def brute_split(rows, p, numeric, margin=0.0):
    """(gain, feature, left rows) of every allowed cut of rows (features..., y), the best first; by looping over all cuts."""
    g = [math.exp(margin) - r[-1] for r in rows]
    h = [math.exp(margin) * math.exp(p.step) for _ in rows]
    score = lambda at, reg: sum(g[i] for i in at) ** 2 / (sum(h[i] for i in at) + reg)
    every, found = range(len(rows)), []
    for f in range(len(rows[0]) - 1):
        if f < numeric:
            cuts = [[i for i in every if rows[i][f] is None or rows[i][f] <= e] for e in sorted({r[f] for r in rows if r[f] is not None})]
            cuts.append([i for i in every if rows[i][f] is None])
        else:
            groups = {}
            for i in every:
                groups.setdefault(rows[i][f] or "", []).append(i)
            ratio = sorted((round(sum(g[i] for i in at) / (sum(h[i] for i in at) + p.cat_smooth), 9), c) for c, at in groups.items())
            cuts = [[i for _, c in ratio[:k] for i in groups[c]] for k in range(1, len(ratio)) if k <= p.most_in_set or len(ratio) - k <= p.most_in_set]
        for left in cuts:
            right = sorted(set(every) - set(left))
            if min(len(left), len(right)) >= p.min_rows:
                reg = p.l2 + (p.cat_l2 if f >= numeric else 0)
                found.append((round(score(left, reg) + score(right, reg) - score(every, p.l2), 6), f, sorted(left)))
    return max((x for x in found if x[0] > 0), key=lambda x: (x[0], -x[1], -len(x[2]))) if found else None


@pytest.mark.parametrize(("seed", "most"), [(1, 1), (2, 32)])
def test_a_tree_is_that_of_exhaustive_search(spark, seed, most):
    rows, df = table(spark, 300, seed)
    rows = [(r[0], round(r[1]), *r[2:5]) for r in rows]
    df = df.withColumn("z", F.round("z").cast("double"))
    p = Params(trees=1, depth=2, min_rows=20, most_in_set=most, bins=64)
    tree = boosting.fit(df, None, ("x", "z"), ("c", "k"), p=p).trees[0]
    base = math.log(sum(r[-1] for r in rows) / len(rows))
    todo = {1: rows}
    for i in (1, 2, 3):
        best = brute_split(todo[i], p, 2, base)
        split = tree.splits.get(i)
        assert (best is None) == (split is None)
        if best:
            gain, f, left = best
            assert split.gain == pytest.approx(gain, abs=2e-6) and split.feature == "xzck"[f]
            goes = lambda r, s=split, f=f: (r[f] is None or r[f] <= s.edge) if s.edge is not None else ((r[f] or "") in s.members) != s.others
            assert [j for j, r in enumerate(todo[i]) if goes(r)] == left
            todo[2 * i], todo[2 * i + 1] = [r for r in todo[i] if goes(r)], [r for r in todo[i] if not goes(r)]
            assert (tree.rows[2 * i], tree.rows[2 * i + 1]) == (len(todo[2 * i]), len(todo[2 * i + 1]))


def deviance(df):
    log = F.when(F.col("sales") > 0, F.col("sales") * F.log(F.col("sales") / F.col("y_pred"))).otherwise(0.0)
    return df.agg(F.avg(2 * (log - F.col("sales") + F.col("y_pred")))).first()[0]


def test_beats_the_regression_on_later_days(spark):
    """The target has an interaction, a step and a null effect: trees see them, a log-linear model doesn't. Written margins don't change the trees."""
    rng, rows = random.Random(7), []
    for i in range(3000):
        x, z, c = rng.choice([0.5, 1.0, 2.5, 4.0]), rng.uniform(0, 10), rng.choice("abcdef")
        mean = math.exp(1.2 * (4 < z < 6) + (1.0 if x > 2 else -1.0) * (c in "ace"))
        rows.append((x, z, c, None, float(sum(rng.random() < mean / 40 for _ in range(40))), date(2024, 1, 1) + timedelta(i % 70)))
    df = spark.createDataFrame(rows, ROWS)
    later = df.where(F.col("date") > F.lit(W.ref_end).cast("date"))
    p = Params(trees=6, depth=3, rate=1.2, min_rows=20, bins=32, together=2)
    boosted = boosting.fit(df, W, ("x", "z"), ("c",), p=p)
    linear = model.train(df.select("x", "z", "c", "sales", "date"), W, ("x", "z"), ("c",))
    ours, theirs = deviance(boosting.score(boosted, later)), deviance(model.score(linear, later))
    assert len(boosted.trees) == 6 and ours < theirs * 0.9
    few = boosting.fit(df, W, ("x", "z"), ("c",), p=Params(trees=3, depth=3, rate=1.2, min_rows=20, bins=32, together=50))
    assert [{i: (s.feature, s.edge, s.members) for i, s in t.splits.items()} for t in few.trees] == [{i: (s.feature, s.edge, s.members) for i, s in t.splits.items()} for t in boosted.trees[:3]]


# ---- contributions


def expected_value(tree, row, known, node=1):
    """Of the tree, knowing some features of a row: unknown splits go both ways by their training rows."""
    if node not in tree.splits:
        return tree.values[node]
    s = tree.splits[node]
    if s.feature in known:
        x = row[s.feature]
        left = (x is None or x <= s.edge) if s.edge is not None else ((x or "") in s.members) != s.others
        return expected_value(tree, row, known, 2 * node + (not left))
    a, b = 2 * node, 2 * node + 1
    return (tree.rows[a] * expected_value(tree, row, known, a) + tree.rows[b] * expected_value(tree, row, known, b)) / tree.rows[node]


def brute_shapley(m, row):
    value = {s: sum(expected_value(t, row, s) for t in m.trees) for k in range(len(m.features) + 1) for s in map(frozenset, itertools.combinations(m.features, k))}
    n, out = len(m.features), {}
    for f in m.features:
        out[f] = sum(math.factorial(len(s)) * math.factorial(n - len(s) - 1) / math.factorial(n) * (value[s | {f}] - value[s]) for s in value if f not in s)
    return out, value[frozenset()] + m.base


def test_contributions_of_a_fitted_model(spark):
    rows, df = table(spark, 500, 3)
    m = boosting.fit(df, None, ("x", "z"), ("c", "k"), p=Params(trees=3, depth=4, rate=0.3, min_rows=10, bins=16))
    assert any(s.members for t in m.trees for s in t.splits.values())
    odd = spark.createDataFrame([(None, None, None, None, 1.0, date(2024, 1, 1)), (99.0, float("nan"), "never seen", "u", 1.0, date(2024, 1, 1))], ROWS)
    given = df.limit(30).unionByName(odd)
    for r in boosting.contributions(m, given).collect():
        row = {c: None if isinstance(r[c], float) and math.isnan(r[c]) else r[c] for c in m.features}
        want, base = brute_shapley(m, row)
        assert {c: r[f"phi_{c}"] for c in m.features} == pytest.approx(want, abs=1e-9) and r["expected"] == pytest.approx(base)
    both = boosting.contributions(m, boosting.score(m, given))
    total = F.col("expected") + sum((F.col(f"phi_{c}") for c in m.features[1:]), F.col(f"phi_{m.features[0]}"))
    assert both.where(F.abs(total - F.log("y_pred")) > 1e-9).count() == 0 and both.count() == 32


def test_contributions_of_eight_features(spark):
    """A hand-made tree that tests a feature twice on a path, and eight features."""
    rng = random.Random(4)
    names = [f"f{i}" for i in range(8)]
    trees = []
    for _ in range(3):
        splits = {i: Split(rng.choice(names), round(rng.random(), 2)) for i in range(1, 16)}
        splits[2], splits[4] = Split("f1", 0.8), Split("f1", 0.3)
        values = {i: rng.uniform(-1, 1) for i in range(16, 32)}
        rows = {i: rng.randint(1, 50) for i in values}
        for i in range(15, 0, -1):
            rows[i] = rows[2 * i] + rows[2 * i + 1]
        trees.append(Tree(splits, values, rows))
    m = Model(tuple(names), (), 0.25, trees)
    given = [tuple(rng.random() for _ in names) for _ in range(12)]
    got = boosting.contributions(m, spark.createDataFrame(given, ", ".join(f"{c} double" for c in names)))
    for r in got.collect():
        want, base = brute_shapley(m, {c: r[c] for c in names})
        assert {c: r[f"phi_{c}"] for c in names} == pytest.approx(want, abs=1e-9) and r["expected"] == pytest.approx(base)


def test_saved_and_read_again(spark, tmp_path):
    _, df = table(spark, 200)
    m = boosting.fit(df, None, ("x",), ("c",), p=Params(trees=2, depth=2, min_rows=5))
    m.save(spark, str(tmp_path / "m"))
    again = Model.load(spark, str(tmp_path / "m"))
    assert again == m and json.loads(m.to_json())["numeric"] == ["x"]
    with pytest.raises(ValueError, match="no model"):
        spark.createDataFrame([], "value string").write.text(str(tmp_path / "none"))
        Model.load(spark, str(tmp_path / "none"))


def test_edges_of_fitting(spark):
    _, df = table(spark, 60)
    none = boosting.fit(df.where("false"), None, ("x",), ("c",), p=Params(trees=2))
    assert none.trees == [] and boosting.score(none, df).where("y_pred > 1e-6").count() == 0
    assert boosting.fit(df.withColumn("sales", F.lit(0.0)), None, ("x",), ("c",), p=Params(trees=2)).trees == []
    assert boosting.fit(df.withColumn("sales", F.lit(2.0)), None, ("x",), ("c",), p=Params(trees=2)).trees == []
    clash = df.withColumns({"node": F.lit("n"), "g": F.lit(1), "margin": F.lit("m"), "row": F.lit("r")})
    p = Params(trees=2, depth=2, min_rows=5)
    plain = boosting.fit(df, None, ("x",), ("c",), p=p)
    assert boosting.fit(clash, None, ("x",), ("c",), p=p) == plain
    assert boosting.score(plain, clash).columns == [*clash.columns, "y_pred", "residual", "abs_error"]
    assert boosting.contributions(plain, clash).columns == [*clash.columns, "phi_x", "phi_c", "expected"]
    assert boosting.fit(df.unionByName(df), None, ("x",), ("c",), p=Params(trees=1, depth=1, min_rows=10)).trees[0].rows[1] == 120


def test_shift_of_contributions_is_that_of_sql(spark, tmp_path):
    """Localisation by contributions against SQL over the same table of contributions."""
    _, df = table(spark, 800, 9)
    df = df.withColumns({"cat_id": F.col("c"), "store_id": F.coalesce("k", F.lit("w"))})
    m = boosting.fit(df, W, ("x", "z"), ("c",), p=Params(trees=2, depth=2, min_rows=10))
    phi = boosting.contributions(m, df, ["date", "cat_id", "store_id"])
    phi.write.parquet(str(tmp_path / "phi"))
    got = model.mean_shift(spark.read.parquet(str(tmp_path / "phi")), "phi_x", W, ("cat_id", "store_id"), 6).collect()
    cur = f"date BETWEEN DATE '{W.cur_start}' AND DATE '{W.cur_end}'"
    ref = f"date BETWEEN DATE '{W.ref_start}' AND DATE '{W.ref_end}'"
    want = duckdb.sql(
        f"WITH p AS (SELECT * FROM '{tmp_path}/phi/*.parquet'), u AS (SELECT 'cat_id' AS c, 0 AS o, cat_id AS v, date, phi_x FROM p UNION ALL SELECT 'store_id', 3, store_id, date, phi_x FROM p) "
        f"SELECT c, v, abs(avg(phi_x) FILTER ({cur}) - avg(phi_x) FILTER ({ref})) AS s FROM u GROUP BY c, o, v ORDER BY s DESC, o, v LIMIT 6"
    ).fetchall()
    assert [(r["slice_col"], r["slice_val"]) for r in got] == [w[:2] for w in want]
    assert [r["score"] for r in got] == pytest.approx([w[2] for w in want])
