"""Reports of a panel: each alert localised as the single operators do it, categorical alerts too, and drift that only a slice shows."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tests.test_operators import W, small_panel
from tidewell.operators import detect, localise, report, tools
from tidewell.sources.panel import COARSE_COLUMNS, Windows


def panel(spark, shift):
    rows = [(i, s, d, 1 + (d + ord(i) + ord(s)) % 4 + shift(i, s, d)) for i in "abcd" for s in "123" for d in range(1, 21)]
    p = small_panel(spark, rows)
    return p.withColumn("cat_id", F.when(F.col("item_id").isin("a", "b"), "c1").otherwise("c2"))


def test_alerts_are_localised_like_one_by_one(spark):
    """Sales jump in store 1, and categories swap places: numeric and categorical alerts have the slices that the single operators find."""
    p = panel(spark, lambda i, s, d: 6 * (s == "1" and d > 10))
    p = p.where("NOT (cat_id = 'c1' AND date > DATE '2024-01-12')")
    got = {r["feature"]: r for r in report.reports(p, W, k=3).collect()}
    scan = {r["feature"]: r for r in detect.global_scan(p, W).collect()}
    assert set(got) == set(scan)
    for f, r in got.items():
        assert r["narrative"] and (r["found_in"] is not None or (r["js"], r["l_inf"], r["is_drift"]) == (scan[f]["js"], scan[f]["l_inf"], scan[f]["is_drift"]))
        assert bool(r["slices"]) <= r["is_drift"]
    want = localise.top_k(localise.rank_within_slices(p, "sales", W, COARSE_COLUMNS), 3).orderBy("rank").collect()
    assert [(s["slice_col"], s["slice_val"]) for s in got["sales"]["slices"]] == [(r["slice_col"], r["slice_val"]) for r in want]
    assert [s["score"] for s in got["sales"]["slices"]] == pytest.approx([r["score"] for r in want]) and [s["coverage"] for s in got["sales"]["slices"]] == pytest.approx([r["coverage"] for r in want])
    assert got["cat_id"]["is_drift"] and got["cat_id"]["slices"] and all(s["slice_col"] != "cat_id" for s in got["cat_id"]["slices"])


def test_drift_inside_a_slice_only(spark):
    """Two categories trade places, so the whole stands still: only the look into slices opens the alert, and not if it is off."""
    p = panel(spark, lambda i, s, d: 0).withColumn("sales", F.when((F.col("cat_id") == "c1") == (F.col("date") > F.lit(date(2024, 1, 10))), 8.0).otherwise(2.0))
    assert not detect.global_scan(p, W, ("sales",), ()).first()["is_drift"]
    got = {r["feature"]: r for r in report.reports(p, W).collect()}
    assert got["sales"]["is_drift"] and got["sales"]["found_in"].startswith("cat_id=") and got["sales"]["js"] > 0.5 and got["sales"]["slices"]
    inside = {(r["slice_val"]): r["js"] for r in detect.scan_within_slices(p, "sales", "cat_id", W).collect()}
    assert got["sales"]["js"] == pytest.approx(max(inside.values()))
    off = {r["feature"]: r for r in report.reports(p, W, fallback=False).collect()}
    assert not off["sales"]["is_drift"] and off["sales"]["slices"] == []


def test_nothing_drifts(spark):
    p = panel(spark, lambda i, s, d: 0).withColumn("sales", F.lit(3.0)).withColumn("revenue", F.lit(6.0))
    assert all(not r["is_drift"] and r["slices"] == [] for r in report.reports(p, W).collect())


def test_slice_detail(spark):
    """Months, blocks and peaks of a slice by hand."""
    from tidewell.sources.panel import derive

    w = Windows("2023-12-01", "2023-12-30", "2023-12-31", "2024-01-12")
    days = [(s, date.fromordinal(date(2023, 12, 31).toordinal() + k), float(k % 5 + (s == "y"))) for s in "xy" for k in range(-360, 13) if not (s == "y" and -60 <= k < -30)]
    df = spark.createDataFrame(days, "store_id string, date date, sales double").withColumns({"item_id": F.lit("i"), "dept_id": F.lit("d"), "cat_id": F.col("store_id"), "state_id": F.lit("s"), "sell_price": F.lit(1.0), "revenue": F.col("sales")})
    got = {r["slice_val"]: r for r in tools.slice_detail(derive(df), "store_id", w, "cat_id").collect()}
    by = {s: {d: v for t, d, v in days if t == s} for s in "xy"}
    for s, r in got.items():
        at = lambda lo, hi, s=s: [v for d, v in by[s].items() if lo <= (d - date(2023, 12, 31)).days <= hi]
        months = [at(-30 * k, -30 * k + 29) for k in range(12, 0, -1)]
        assert r["months"] == [pytest.approx(sum(m) / len(m)) if m else None for m in months]
        blocks = [at(0, 2), at(3, 4), at(5, 6), at(7, 8), at(9, 10), at(11, 12)]
        assert r["blocks"] == pytest.approx([sum(b) / len(b) for b in blocks])
        ref = at(-30, -1)
        assert r["ref_max"] == pytest.approx(max(ref) / (sum(ref) / len(ref))) and r["cur_max"] == pytest.approx(max(at(0, 12)) / (sum(ref) / len(ref)))
        assert [x["group"] for x in r["where_it_lives"]] == [s] and r["where_it_lives"][0]["share"] == pytest.approx(1.0)
    assert got["y"]["months"][10] is None
