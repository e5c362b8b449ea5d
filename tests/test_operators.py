"""Hand-checked fixtures of the operators, and their edges: nulls, empty tables, ties, clashing names."""

import json
import math
from datetime import date
from fractions import Fraction
from itertools import accumulate

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.functions.binning import adaptive_edges, bin_of
from tidewell.functions.divergence import divergences
from tidewell.functions.quantiles import LARGE_BYTES, leaf_bytes, quantiles
from tidewell.functions.stats import mcnemar, wilson
from tidewell.operators import agents, detect, hierarchy, inject, localise, profile, quality, report, tools, trials
from tidewell.operators.inject import Injection
from tidewell.sources import io, synthetic
from tidewell.sources.panel import PANEL_COLUMNS, Windows, densify, derive, tag

W = Windows("2024-01-01", "2024-01-10", "2024-01-11", "2024-01-20")


def small_panel(spark, rows):
    """rows: item, store, day of January, sales."""
    df = spark.createDataFrame([(i, s, date(2024, 1, d), float(x)) for i, s, d, x in rows], "item_id string, store_id string, date date, sales double")
    return derive(df.withColumns({"dept_id": F.concat(F.lit("d"), F.substring("item_id", 1, 1)), "cat_id": F.lit("c"), "state_id": F.lit("s"), "sell_price": F.lit(2.0), "revenue": F.col("sales") * 2}))


def edges_of(spark, values):
    df = spark.createDataFrame([(float(v) if v is not None else None,) for v in values], "x double")
    return adaptive_edges(df, "x").first()["edges"]


def test_edges(spark):
    assert edges_of(spark, [0] * 90 + [1] * 8 + [2, 3]) == [0, 1, 2, 3]
    assert edges_of(spark, [0] * 90 + [1] * 8 + [2, 9]) == [0, 1, 2, 3, 10]
    assert len(edges_of(spark, range(1, 51))) == 21
    assert edges_of(spark, [0.5] * 30) == [0.5, 1.5]
    assert edges_of(spark, [None]) == [0, 1]


def test_histogram_rules(spark):
    df = spark.createDataFrame([(x, [0.0, 1.0, 2.0]) for x in (-1.0, 0.0, 1.0, 2.0, 5.0)], "x double, e array<double>")
    got = df.select(bin_of(F.col("x"), F.col("e"), True).alias("k2"), bin_of(F.col("x"), F.col("e"), False).alias("k3")).collect()
    assert [r["k2"] for r in got] == [None, 0, 1, 1, None]
    assert [r["k3"] for r in got] == [0, 0, 1, 1, 1]


def test_divergence(spark):
    df = spark.createDataFrame([("a", 2, 1), ("b", 2, 1), ("c", 0, 2)], "bin string, n_ref long, n_cur long")
    r = divergences(df, []).first()
    assert r["js"] == pytest.approx(0.3112781244591328, abs=1e-12)
    assert r["l_inf"] == pytest.approx(0.5)
    assert divergences(df.withColumn("n_cur", F.lit(0)), []).first()["js"] == 0


def test_wilson_and_mcnemar(spark):
    df = spark.createDataFrame([(0, 50), (20, 20), (11, 20)], "k int, n int")
    got = df.select(*wilson(F.col("k"), F.col("n"))).collect()
    assert got[0][1] == pytest.approx(0.071348, abs=1e-6)
    assert got[1][0] == pytest.approx(0.838875, abs=1e-6)
    assert got[2][0] == pytest.approx(0.342085, abs=1e-6) and got[2][1] == pytest.approx(0.741802, abs=1e-6)
    pairs = spark.createDataFrame([(15, 0), (0, 13), (4, 17), (0, 0)], "b int, c int").select(mcnemar(F.col("b"), F.col("c"))).collect()
    assert [r[0] for r in pairs] == pytest.approx([6.1035e-05, 2.4414e-04, 0.0071974, 1.0], rel=1e-4)


def test_mcnemar_of_many_pairs(spark):
    """Counts whose binomial terms, and whose 2 ** -n, are beyond a double."""
    given = [(520, 560), (3600, 3600), (3500, 3750), (0, 1200), (9000, 9200)]
    got = spark.createDataFrame(given, "b int, c int").select(mcnemar(F.col("b"), F.col("c"))).collect()
    tails = [list(accumulate(range(1, min(b, c) + 1), lambda term, i, n=b + c: term * (n - i + 1) // i, initial=1)) for b, c in given]
    exact = [min(1.0, float(Fraction(2 * sum(tail), 2 ** (b + c)))) for tail, (b, c) in zip(tails, given, strict=True)]
    assert [r[0] for r in got] == pytest.approx(exact, rel=1e-9, abs=1e-300)


def test_burst(spark):
    p = small_panel(spark, [("a", "1", d, 1) for d in (1, 2, 3, 4)] + [("a", "1", d, x) for d, x in ((11, 1), (12, 1), (13, 9), (14, 9))])
    assert localise.rank_bursts(p, W, min_rows=1).first()["score"] == pytest.approx(16 / 1.5)
    assert localise.rank_bursts(p, W, min_rows=20).count() == 0


def test_injections(spark):
    p = small_panel(spark, [("a", "1", d, 10) for d in range(1, 31)])
    of = lambda df, d: df.where(F.dayofmonth("date") == d).first()["sales"]
    i = lambda kind, m, spikes=(): Injection(kind, "store_id", "1", "2024-01-01", "2024-01-31", m, spikes)
    assert of(inject.sudden(p, i("sudden", 0.6)), 10) == 10 and of(inject.sudden(p, i("sudden", 0.6)), 11) == 16
    assert of(inject.gradual(p, i("gradual", 0.7)), 16) == pytest.approx(13.5)
    spiked = inject.intermittent(p.withColumn("sales", F.lit(2.0)), i("intermittent", 3.0, ("2024-01-05", "2024-01-06")))
    assert of(spiked, 5) == 11 and of(spiked, 6) == 47 and of(spiked, 7) == 11 and of(spiked, 8) == 2
    assert inject.inject(p, i("duplicated_rows", 0)).count() == 60
    stale = inject.stale_feed(p.withColumn("sales", F.dayofmonth("date").cast("double")), Injection("stale_feed", "store_id", "1", "2024-01-10", "2024-01-31"))
    assert of(stale, 9) == 9 and of(stale, 20) == 9
    assert set(inject.DRIFTS) | set(inject.FAULTS) >= {"sudden", "gradual", "intermittent", "zero_fill", "unit_change"}


def test_trailing_runs_and_faults(spark):
    rows = [("a", "1", d, x) for d, x in ((17, 1), (18, 4), (19, 4), (20, 4))] + [("b", "1", d, 5) for d in (17, 18, 19, 20)] + [("c", "1", d, 5) for d in (17, 18)]
    runs = {r["id"]: r["trail_run"] for r in tools.trailing_runs(small_panel(spark, rows), W).collect()}
    assert runs == {"a_1": 3, "b_1": 4, "c_1": 0}
    f = spark.createDataFrame([(x, x in "ab", x in "abcd") for x in "abcdef"], "id string, hit boolean, s boolean")
    f = f.withColumns({c: F.lit("z") for c in ("cat_id", "dept_id", "state_id", "item_id")}).withColumn("store_id", F.when(F.col("hit"), "S2").otherwise("S1"))
    best = quality.locate(f, "hit").orderBy(F.desc("f1")).first()
    assert (best["slice_col"], best["slice_val"], best["f1"]) == ("store_id", "S2", 1.0)


def test_hierarchy(spark):
    p = small_panel(spark, [("a1", "1", 1, 1), ("b1", "2", 1, 1)])
    up = hierarchy.closure(hierarchy.validated(p))
    pairs = spark.createDataFrame([("item_id", "a1", "cat_id", "c"), ("dept_id", "da", "dept_id", "db"), ("store_id", "1", "store_id", "1")], "col_a string, val_a string, col_b string, val_b string")
    assert {(r["col_a"], r["related"]) for r in hierarchy.related(pairs, up).collect()} == {("item_id", True), ("dept_id", False), ("store_id", True)}
    with pytest.raises(ValueError, match="a1"):
        hierarchy.validated(p.unionByName(p.where("item_id = 'a1'").withColumn("dept_id", F.lit("other"))))


def test_hierarchy_is_read_once_and_told_apart_by_level(spark):
    """Items times stores are never distinct rows of their own, and the self joins of the closure don't read the panel again."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        read.add(1)
        return x

    rows = [(f"{a}{i}", str(s), 1, 1) for a in "ab" for i in range(3) for s in range(4)]
    p = small_panel(spark, rows)
    found = hierarchy.edges(p.withColumn("item_id", counted("item_id")))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1
    up = hierarchy.closure(found)
    pairs = {tuple(r)[:4] for r in up.collect()}
    assert {("item_id", "a0", "dept_id"), ("item_id", "a0", "cat_id"), ("dept_id", "da", "cat_id")} <= {t[:3] for t in pairs} and read.value == len(rows)
    gaps = p.withColumn("dept_id", F.when(F.col("item_id") != "a0", F.col("dept_id")))
    assert not hierarchy.edges(gaps).where("child_val = 'a0' or child_val is null or parent_val is null").count()


def test_slices_are_counted_in_generated_code(spark, monkeypatch):
    """Edges are literals and slices are unpivoted row by row: no join with the edges, no array of slices."""
    plans, write = [], localise.written
    monkeypatch.setattr(localise, "written", lambda df, *a, **k: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, *a, **k))
    rows = [("a1", "1", d, x) for d in range(1, 21) for x in (1, 2, 9)]
    panel = small_panel(spark, rows).withColumn("sales", F.when(F.col("sales") < 9, F.col("sales")))
    counts = localise.slice_counts(panel, "sales", W, ["store_id"])
    assert len(plans) == 1 and "Join" not in plans[0] and "Generate" not in plans[0]
    got = {(r["slice_col"], r["bin"], r["inside"], r["n_ref"], r["n_cur"]) for r in counts.collect()}
    assert got == {(c, b, i, 10, 10) for c in ("store_id", localise.ALL) for b, i in ((1, True), (2, True), (None, False))}


def test_empty_and_null(spark):
    empty = small_panel(spark, [("a", "1", 1, 1)]).where("false")
    assert detect.global_scan(empty, W).where("is_drift").count() == 0
    assert localise.rank_within_slices(empty, "sales", W).count() == 0
    assert localise.detect_and_localise(empty, W).count() == 0
    assert detect.scan_within_slices(empty, "sales", "store_id", W).count() == 0
    some = small_panel(spark, [("a", "1", d, d) for d in range(1, 21)]).withColumn("sales", F.when(F.dayofmonth("date") % 2 == 0, F.col("sales")))
    assert localise.rank_within_slices(some, "sales", W, min_slice_size=1).count() == 4
    assert tag(some, W).count() == 20


def test_ties_go_by_column_then_value(spark):
    c = spark.createDataFrame([("store_id", 3, "b", 1.0), ("store_id", 3, "a", 1.0), ("cat_id", 0, "z", 1.0)], "slice_col string, slice_ord int, slice_val string, score double")
    assert [r["slice_val"] for r in localise.top_k(c, 3).orderBy("rank").collect()] == ["z", "a", "b"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3), st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=12))
def test_divergence_is_bounded_and_symmetric(spark, rows):
    df = spark.createDataFrame(rows, "k int, bin int, n_ref int, n_cur int").groupBy("k", "bin").agg(F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur"))
    a = {r["k"]: r["js"] for r in divergences(df, ["k"]).collect()}
    b = {r["k"]: r["js"] for r in divergences(df, ["k"], "n_cur", "n_ref").collect()}
    for k, js in a.items():
        assert -1e-12 <= js <= 1 + 1e-12 and js == pytest.approx(b[k], abs=1e-12)


def test_densify(spark):
    f = spark.createDataFrame([("a", date(2024, 1, 2), 3.0)], "k string, date date, x double")
    assert [r["x"] for r in densify(f, ["k"], "x", "2024-01-01", "2024-01-03").orderBy("date").collect()] == [0.0, 3.0, 0.0]


def test_densify_tells_fillings_from_facts(spark):
    f = spark.createDataFrame([("a", date(2024, 1, 2), 0.0), ("a", date(2024, 1, 3), None)], "k string, date date, x double")
    assert [tuple(r) for r in densify(f, ["k"], "x", "2024-01-01", "2024-01-03", filled="none").orderBy("date").select("x", "none").collect()] == [(0.0, True), (0.0, False), (0.0, True)]


def test_windows_and_draws():
    w = trials.rolling_windows(date(2024, 3, 1))
    assert (w.ref_start, w.ref_end, w.cur_end) == ("2024-01-01", "2024-02-29", "2024-03-31")
    values = {"dept_id": ["a", "b"], "store_id": ["s"], "item_id": ["i", "j"]}
    draw = lambda: list(trials.draw_trials(values, date(2024, 1, 1), 42, 2))
    assert draw() == draw() and len(draw()) == 6


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", 1.5), (2, "y", None)], "k int, name string, v double")
    df.coalesce(1).write.option("header", True).csv(str(tmp_path / "c"))
    assert io.read_csv(spark, str(tmp_path / "c"), "k int, name string, v double", ["name"], "k = 2").collect()[0]["name"] == "y"
    p = str(tmp_path / "cache")
    assert io.cached(spark, p, lambda: df).count() == 2 and io.cached(spark, p, lambda: 1 / 0).count() == 2
    assert io.pending(df.unionByName(df.withColumn("k", F.lit(3))), spark, p, ["k"]).count() == 2
    io.append(df, p)
    assert spark.read.parquet(p).count() == 4
    io.write_json_lines(df.withColumn("at", F.lit(1)).unionByName(df.withColumn("at", F.lit(2))), str(tmp_path / "j"))
    assert io.last_per_key(io.read_json(spark, str(tmp_path / "j"), "k int, name string, at int"), ["k"], "at").select("at").distinct().collect()[0]["at"] == 2
    hidden, codes = io.obscured(df, ["name"], {"name": "c1"})
    assert {r["c1"] for r in hidden.collect()} == {"v1", "v2"} and codes.count() == 2
    wide = spark.createDataFrame([("a", 1, 2)], "id string, d_1 int, d_2 int")
    assert io.unpivot_days(wide, ["id"]).count() == 2
    df.toPandas().to_csv(tmp_path / "t.csv", index=False)
    cat = io.Catalogue(spark, str(tmp_path))
    assert cat.files() == ["t.csv"] and cat.head("t.csv", 1).count() == 1
    with pytest.raises(ValueError):
        cat.table("../t.csv")
    _, name = io.first_available(spark, [(str(tmp_path / "none"), spark.read.parquet)], lambda: df)
    assert name == "generated" and "| k |" in io.markdown_table(df)


def test_synthetic_panel_is_the_same_again(spark):
    a, b = (synthetic.panel(spark, 20, 4, 2, seed=1) for _ in range(2))
    assert a.columns == list(PANEL_COLUMNS) and a.count() == 160 and a.exceptAll(b).count() == 0 and a.where("sales < 0 or sales % 1 <> 0").count() == 0


def test_profile_rules(spark):
    df = spark.createDataFrame([(i, f"g{i % 3}", "h" if i % 3 else "k", float(i), f"2024-01-{i % 28 + 1:02d}") for i in range(60)], "id int, g string, h string, x double, day string")
    roles = profile.infer_schema({"f": df, "d": spark.createDataFrame([(i,) for i in range(3)], "k int")})
    assert roles["fact"] == "f" and roles["date"] == "day" and roles["keys"]["d"] == ["k"]
    assert {(r["child"], r["parent"]) for r in profile.hierarchy_of(df, ["id", "g", "h"]).collect()} == {("id", "g"), ("g", "h")}


def test_agent_loop():
    said = iter([{"tool": "f", "args": {"x": 1}}, {"tool": "nope"}, {"text": "hm"}, {"submit": {"bad": 1}}, {"submit": {"ok": 1}}])
    out = agents.run(lambda m: next(said), {"f": lambda x: {"y": x}}, "task", 10, lambda a: None if "ok" in a else "no ok")
    assert out.answer == {"ok": 1} and out.calls == 2
    forced = agents.run(lambda m: {"tool": "f", "args": {"x": 1}}, {"f": lambda x: x}, "t", 2, lambda a: None)
    assert forced.answer is None and forced.calls == 2 and forced.reason == "no submission"
    assert agents.valid_ranking('```json\n{"ranking": [1, 0]}\n```', 2) == ([1, 0], "ok")
    assert agents.valid_ranking('{"ranking": [1, 1]}', 2)[0] is None
    order, why = agents.rerank([{"v": "a"}, {"v": "b"}], lambda m: {"content": json.dumps({"ranking": [1, 0]})}, 3)
    assert [c["v"] for c in order] == ["b", "a"] and why == "ok"
    assert agents.rerank([{"v": "a"}], lambda m: {"content": "?"})[1].startswith("fallback")


def test_failing_models_and_long_results():
    def broken(messages):
        raise TimeoutError("slow")

    order, why = agents.rerank([{"v": "a"}, {"v": "b"}], broken)
    assert [c["v"] for c in order] == ["a", "b"] and why == "fallback: TimeoutError: slow"
    shown = json.loads(agents._fitted([{"value": "x" * 100, "i": i} for i in range(100)]))
    assert shown["of"] == 100 and 0 < len(shown["rows"]) < 100 and len(json.dumps(shown)) <= agents.SHOWN


def test_report_branches(spark):
    kind = "array<struct<rank:int,slice_col:string,slice_val:string,score:double,coverage:double>>"
    df = spark.createDataFrame([("sales", 0.1, 0.2, True, []), ("price", 0.1, 0.2, True, [(1, "cat_id", "A", 0.5, 0.25), (2, "cat_id", "B", 0.4, 0.2)])], f"feature string, js double, l_inf double, is_drift boolean, slices {kind}")
    none, two = report.narrate(df).orderBy(F.size("slices")).collect()
    assert "whole panel" in none["narrative"] and len(none["recommended_actions"]) == 2
    assert "cat_id A" in two["narrative"] and "25.0%" in two["narrative"] and len(two["recommended_actions"]) == 3
    planned = report.narrate(df, promo="Sale").orderBy(F.desc(F.size("slices"))).first()
    assert "Sale" in planned["narrative"] and "campaign" in planned["recommended_actions"][0]


def test_synthesizer_falls_back(spark):
    df = spark.createDataFrame([("sales", 0.1, 0.2, True, [])], "feature string, js double, l_inf double, is_drift boolean, slices array<struct<rank:int,slice_col:string,slice_val:string,score:double,coverage:double>>")

    def broken(alerts):
        raise OSError("quota")

    with pytest.warns(UserWarning, match="quota"):
        assert report.with_fallback(broken)(df).first()["synthesized_by"] == "rules"
    assert report.with_fallback(lambda a: a)(df).first()["synthesized_by"] == "rules"  # lacks the columns
    assert report.with_fallback(report.narrate)(df).first()["synthesized_by"] == "model"


def test_best_first_search(spark):
    def search(rows):
        scored = [([{"col": c, "val": v} for c, v in conditions], score, coverage, score / coverage) for conditions, score, coverage in rows]
        df = spark.createDataFrame(scored, "conditions array<struct<col:string,val:string>>, score double, coverage double, efficiency double")
        return [tuple(c["val"] for c in r["conditions"]) for r in localise.best_first(df).orderBy("rank").collect()]

    a, s, d = ("cat_id", "a"), ("store_id", "s"), ("dept_id", "d")
    singles = [((a,), 0.1, 0.5), ((s,), 0.05, 0.5), ((d,), 0.04, 0.5), ((("cat_id", "b"),), 0.01, 0.3)]
    assert search(singles + [((a, s), 0.2, 0.25), ((a, d), 0.02, 0.25)]) == [("a", "s"), ("a",), ("s",), ("a", "d"), ("d",)]
    assert search(singles + [((a, s), 0.01, 0.25)]) == [("a",), ("s",), ("d",)]  # no union beats its members
    assert search(singles + [((a, s), 0.2, 0.25), ((a, d, s), 0.3, 0.1)])[0] == ("a", "d", "s")
    assert search([]) == []


def test_agents_with_tools(spark):
    from tidewell.operators import harness

    p = small_panel(spark, [(i, s, d, 1 + (d > 10) * (s == "1") * 5) for i in "ab" for s in "12" for d in range(1, 21)])
    said = iter([{"tool": "compare_windows", "args": {"col": "store_id"}}, {"tool": "get_slice_history", "args": {"col": "nope"}}, {"tool": "check_spikes", "args": {"col": "store_id", "val": "1"}}, {"submit": {"col": "store_id", "val": "9"}}, {"submit": {"col": "store_id", "val": "1"}}])
    out = harness.investigate(p, W, lambda m: next(said))
    assert out.answer == {"col": "store_id", "val": "1"} and out.calls == 3 and "unknown" in json.dumps(out.transcript)
    said = iter([{"tool": "duplicate_check", "args": {}}, {"tool": "constant_run_check", "args": {}}, {"submit": {"fault": "none"}}])
    assert harness.inspect_faults(p, W, lambda m: next(said)).answer == {"fault": "none"}
    said = iter([{"tool": "list_files", "args": {}}, {"tool": "profile", "args": {"file": "f"}}, {"submit": {"fact": "f", "item": "item_id", "store": "store_id", "date": "date", "target": "sales"}}])
    assert harness.onboard({"f": p}, lambda m: next(said)).answer["target"] == "sales"
    assert harness.decide({"mae": 1}, lambda m: {"submit": {"decision": "retrain", "confidence": 0.9}}).answer["decision"] == "retrain"
    assert harness.decide({"mae": 1}, lambda m: {"submit": {"decision": "maybe"}}).reason.startswith("invalid")
    rows = harness.rerank_trials([("t", p, W, ("store_id", "1")), ("u", p, W, ("store_id", "1"))], lambda m: {"content": "no"}, "coarse_only", done=frozenset({"u"}))
    assert [r["trial_id"] for r in rows] == ["t"] and not rows[0]["used"] and rows[0]["reason"].startswith("fallback")


def test_model_and_harm(spark, tmp_path):
    from pyspark.ml import PipelineModel

    from tidewell.operators import model

    p = small_panel(spark, [(i, s, d, (i == "a") * 3 + d % 3 + 1) for i in "ab" for s in "12" for d in range(1, 21)])
    m = model.train(p, W, ("wday",), ("dept_id",))
    m.write().overwrite().save(str(tmp_path / "m"))
    scored = model.score(PipelineModel.load(str(tmp_path / "m")), p)
    assert scored.agg(F.avg("abs_error")).first()[0] < 2
    worse = model.harm(model.score(m, p.withColumn("sales", F.col("sales") * 4)), scored, W).first()
    assert worse["harmful"] and worse["ratio"] > 1.05
    assert "phi_wday" in model.contributions(m, p, ("wday",)).columns


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_ranked_quantiles_are_the_same(spark, keys):
    rows = [(i % 3, float(v)) for i, v in enumerate([*range(200), *[7] * 90, 1e9, -5.5, 0.25])] + [(0, None), (5, 3.0)]
    df = spark.createDataFrame(rows, "k int, x double")
    marks = [0.0, 0.05, 0.5, 0.77, 0.99, 1.0]
    of = lambda ranked: {tuple(r[k] for k in keys): r["q"] for r in quantiles(df, "x", marks, keys, ranked).collect()}
    a, b = of(True), of(False)
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-12) for k in a)
    e = lambda ranked: sorted(map(str, adaptive_edges(df, "x", keys, ranked=ranked).collect()))
    assert e(True) == e(False)
    assert adaptive_edges(df.where("false"), "x", ranked=True).first()["edges"] == [0, 1]


def test_large_quantiles_count_ranges_not_values(spark, monkeypatch):
    """What is handed on is a row a range, and the few values of the ranges that hold a wanted rank: not all distinct values."""
    from tidewell.functions import quantiles as q

    tables, write = [], q.written
    monkeypatch.setattr(q, "written", lambda *a, **k: tables.append(write(*a, **k)) or tables[-1])
    df = spark.range(100_000).select(F.sqrt(F.col("id") + 1).alias("x"))
    marks = [i / 20 for i in range(21)]
    assert quantiles(df, "x", marks, ranked=True).first()["q"] == pytest.approx(quantiles(df, "x", marks, ranked=False).first()["q"], rel=1e-12)
    assert sum(t.count() for t in tables) < 12_000


@pytest.mark.parametrize("most", [1 << 20, 3])
def test_ranges_ascend_with_values(spark, monkeypatch, most):
    """Ends of doubles, neighbours of powers of two, zeros, crowded ranges and null keys: ranks by ranges are those of sorted values."""
    from tidewell.functions import quantiles as q

    monkeypatch.setattr(q, "MOST_ROWS", most)
    odd = [v for e in (-1074, -1022, -3, 0, 1, 10, 52, 1023) for v in (2.0**e, math.nextafter(2.0**e, 0), math.nextafter(2.0**e, math.inf))]
    crowd = [1e9 + i / 7 for i in range(194)] + [math.nextafter(1e9, math.inf)] * 9
    values = [*odd, *(-v for v in odd), 0.0, -0.0, math.inf, -math.inf, 1.7976931348623157e308, -1.7976931348623157e308, *crowd]
    df = spark.createDataFrame([(k, v) for k in ("a", None) for v in values] + [("b", None), ("c", 2.5)], "k string, x double")
    n, ordered = len(values), sorted(values)  # 257: ranks are exact
    found = {r["k"]: r["q"] for r in quantiles(df, "x", [i / (n - 1) for i in range(n)], ["k"], True).collect()}
    assert n == 257 and found == {"a": ordered, None: ordered, "c": [2.5] * n}
    numbers = [r["b"] for r in df.where("k = 'a'").orderBy("x").select(q._range(F.col("x")).alias("b")).collect()]
    assert numbers == sorted(numbers)
    some = df.where("k is null or k <> 'a'").where("x is null or abs(x) between 1e-3 and 1e12")
    edges = lambda ranked: sorted(map(str, adaptive_edges(some, "x", ["k"], ranked=ranked).collect()))
    assert edges(True) == edges(False)


def test_input_size_is_seen(spark):
    size = leaf_bytes(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").join(spark.range(3).withColumnRenamed("id", "l_orderkey"), "l_orderkey"))
    assert 1000 < size < LARGE_BYTES


def test_global_scan_reads_its_rows_once(spark):
    """Edges and bins come from counted values: the numbers of a feature are computed once a row, and a value's weight is its count."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        read.add(1)
        return x

    rows = [("a", "1", d, x) for d in range(1, 21) for x in (1.5, 1.5, 2.25, float(d))]
    panel = small_panel(spark, rows).drop("sell_price", "revenue")
    plain = detect.global_scan(panel, W, ("sales",), ()).collect()
    assert detect.global_scan(panel.withColumn("sales", counted("sales")), W, ("sales",), ()).collect() == plain and read.value == len(rows)
    weighed = panel.groupBy("sales").agg(F.count("*").alias("n"))
    for ranked in (False, True):
        assert adaptive_edges(weighed, "sales", ranked=ranked, weight="n").collect() == adaptive_edges(panel, "sales", ranked=ranked).collect()


@pytest.mark.parametrize("ranked", [False, True])
def test_trials_are_not_gathered_by_key(spark, ranked):
    """Rows of a trial meet its edges, and values their ranges, where they are: no sort-merge join by trial alone."""
    df = small_panel(spark, [("a1", "s1", d, d) for d in range(1, 21)]).withColumns({"trial_id": F.col("item_id"), "win": F.when(F.dayofmonth("date") < 11, "ref").otherwise("cur")})
    found = quantiles(df, "sales", [0.5], ["trial_id"], True) if ranked else localise.slice_histograms(df, "sales", None, ["store_id"], ("trial_id",))
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_statistics_by_store_keep_no_values_in_a_task(spark, monkeypatch):
    from tests.held import connection, same
    from tidewell.functions import quantiles as q
    from tidewell.plans import catalogue

    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(q, "LARGE_BYTES", 0)
    df = catalogue.queries()["d5_d14_statistics"](spark, sf)
    assert "percentile(" not in df._jdf.queryExecution().optimizedPlan().toString() and "median(" not in df._jdf.queryExecution().optimizedPlan().toString()
    same(df, connection(sf), catalogue.oracle_sql()["d5_d14_statistics"])
