"""Scores of configurations by hand: closures of any depth, flags, issues, agreement."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.operators import onboarding, profile

EDGE = "run string, child string, parent string"


def runs_of(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "run string")


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from("pqrstu"), st.sampled_from("pqrstu")), max_size=12))
def test_closure_is_reachability(spark, edges):
    want = set(edges)
    while True:
        more = want | {(r, c, q) for r, c, p in want for s, d, q in want if r == s and d == p}
        if more == want:
            break
        want = more
    assert {tuple(r) for r in onboarding.closure(spark.createDataFrame(edges, EDGE), ("run",)).collect()} == want


def test_long_chains(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(9)] + [(None, "n1")], "child string, parent string")
    assert onboarding.closure(chain).count() == 45


def test_edges_are_scored_on_closures(spark):
    """Naming a long edge instead of the two short ones is no invention; a run without edges has recall 0."""
    truth = spark.createDataFrame([("item", "dept"), ("dept", "cat"), ("store", "state")], "child string, parent string")
    found = spark.createDataFrame([("full", "item", "dept"), ("full", "dept", "cat"), ("full", "store", "state"), ("skip", "item", "cat"), ("skip", "store", "cluster"), ("odd", "cat", "item")], EDGE)
    got = {r["run"]: r for r in onboarding.edge_scores_by_run(runs_of(spark, "full", "skip", "odd", "none"), found, truth).collect()}
    assert (got["full"]["precision"], got["full"]["recall"], got["full"]["f1"], got["full"]["missed"]) == (1.0, 1.0, 1.0, "")
    assert (got["skip"]["tp"], got["skip"]["n_found"], got["skip"]["invented"]) == (1, 2, "store->cluster") and got["skip"]["missed"] == "dept->cat; item->dept; store->state"
    assert (got["none"]["n_true"], got["none"]["recall"], got["none"]["precision"], got["none"]["f1"]) == (4, 0.0, 0.0, 0.0)
    assert got["odd"]["f1"] == 0.0
    inside = onboarding.edge_scores_by_run(runs_of(spark, "skip"), found.where("run = 'skip'"), truth, ["item", "dept", "cat", "store", "state"]).first()
    assert inside["invented"] == "" and inside["precision"] == 1.0


def test_flags_issues_and_agreement(spark):
    runs = runs_of(spark, "a", "b", "c")
    flags = spark.createDataFrame([("a", "zero", "true"), ("a", "frac", "false"), ("b", "zero", "false"), ("b", "zero", "true")], "run string, name string, value string")
    truth = spark.createDataFrame([("zero", "true"), ("frac", "false")], "name string, value string")
    got = {r["run"]: (r["n_right"], r["accuracy"]) for r in onboarding.flag_accuracy(runs, flags, truth).collect()}
    assert got == {"a": (2, 1.0), "b": (0, 0.0), "c": (0, 0.0)}
    issues = spark.createDataFrame([("a", "NEGATIVE sales"), ("a", "something else"), ("b", None), ("b", "no price; negative too")], "run string, text string")
    recall = {r["run"]: r for r in onboarding.issue_recall(runs, issues, {"negative": "negativ|return", "price": "price"}).collect()}
    assert (recall["a"]["recall"], recall["a"]["n_unmatched"], recall["b"]["recall"], recall["c"]["n_issues"]) == (0.5, 1, 1.0, 0)
    found = spark.createDataFrame([("a", "x", "y"), ("a", "y", "z"), ("b", "x", "y"), ("b", "x", "y")], EDGE)
    agree = onboarding.edge_agreement(runs, found).first()
    assert (agree["n_runs"], agree["n_pairs"], agree["mean_jaccard"], agree["identical_share"]) == (3, 3, pytest.approx(0.5 / 3), 0.0)
    values = spark.createDataFrame([("a", "f1", "1"), ("b", "f1", "1"), ("c", "f1", "0"), ("a", "path", None), ("b", "path", "q")], "run string, name string, value string")
    modes = {r["name"]: (r["mode"], r["n_runs"], r["share"]) for r in onboarding.modal_shares(values).collect()}
    assert modes["f1"] == ("1", 3, pytest.approx(2 / 3)) and modes["path"] == (None, 2, 0.5)


def test_issues_of_a_fact_table(spark):
    rows = [("i1", "2024-01-01", -1.0, None), ("i1", "2024-01-03", 2.0, "x"), ("i2", "2024-01-01", 3.0, "y"), ("i2", "2024-01-05", 3.0, "y")]
    df = spark.createDataFrame(rows, "k string, d string, v double, p string")
    got = {(r["issue"], r["column"]): r["evidence"] for r in onboarding.issue_list(df, "d", ["k"], "v").collect()}
    assert got == {("negative values of the target", "v"): 0.25, ("days without a row within a series", None): pytest.approx((1 / 3 + 3 / 5) / 2), ("days missing for every series", None): 2.0, ("nulls in a column", "p"): 0.25, ("no column that looks like a price", None): 0.0}
    priced = df.selectExpr("k", "d", "abs(v) AS v", "1.5 AS price")
    assert {r["issue"] for r in onboarding.issue_list(priced, "d", ["k"], "v").collect()} == {"days without a row within a series", "days missing for every series"}


def test_choice(spark):
    df = spark.createDataFrame([("b", 1.0, None), ("a", 1.0, 2.0), ("c", 0.5, 9.0), ("d", 1.0, 2.0)], "run string, f1 double, recall double")
    got = {r["chosen_by"]: r["run"] for r in onboarding.choose(df, "run", ("f1", "recall"), 1).collect()}
    assert got["best"] == "a" and got == {r["chosen_by"]: r["run"] for r in onboarding.choose(df.repartition(3), "run", ("f1", "recall"), 1).collect()}
    assert onboarding.choose(df.where("false"), "run", ("f1",)).collect() == []


def test_hierarchies_read_their_table_once(spark):
    """All runs come from one pass, however many columns there are; nulls are no values, and a column without values has no parent."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        read.add(1)
        return x

    rows = [("i1", "d1", "c1", None), ("i2", "d1", "c1", None), ("i3", "d2", "c1", None), ("i4", "d3", "c2", None), (None, "d3", "c2", None), ("i4", None, "c2", None)]
    df = spark.createDataFrame(rows, "item string, dept string, cat string, none string").withColumn("item", counted("item"))
    found = profile.hierarchies_of(df, {"all": ("item", "dept", "cat", "none"), "no_dept": ("item", "cat"), "alone": ("dept",)})
    assert {tuple(r) for r in found.select("run", "child", "parent").collect()} == {("all", "item", "dept"), ("all", "dept", "cat"), ("no_dept", "item", "cat")}
    assert read.value == len(rows)
    read.value = 0
    assert {tuple(r) for r in profile.hierarchy_of(df, ["item", "cat"]).collect()} == {("item", "cat")} and read.value == len(rows)
