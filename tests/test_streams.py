"""Detection inside streams against the batch operators: restarts, late rows, state that is dropped."""

from datetime import date, datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.test_operators import edges_of as batch_edges
from tidewell.operators import detect
from tidewell.streaming import drift, stateful

SCHEMA = "k string, ts timestamp, v double"


def rows_of(days, shift_at, per_day=30, key="a", seed=0):
    rng = np.random.default_rng(seed)
    return [(key, datetime(2024, 1, 1) + timedelta(days=d, minutes=int(m)), round(float(x), 2)) for d in days for m, x in zip(rng.integers(0, 1440, per_day), rng.gamma(2, 3, per_day) + (4 if d >= shift_at else 0), strict=True)]


def run(spark, src, base, make):
    """What has arrived in src since the last run with the same checkpoint; all that was reported so far."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    with stateful.rocksdb(spark):
        out = make(stream)
        q = out.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


def add(spark, src, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)


def test_growing_windows_across_a_restart(spark, tmp_path):
    """Three runs from one checkpoint report what the batch scan finds first; a key without a change stays quiet; after a change nothing more is said and no state is left."""
    src, base = str(tmp_path / "in"), str(tmp_path / "q")
    make = lambda s: stateful.growing_windows(s, "ts", "k", "v", "2024-01-01", max_days=28, threshold=0.1)
    a, b = rows_of(range(40), 9), rows_of(range(40), 99, key="b", seed=1)
    of = lambda first, last: [r for r in (*a, *b) if first <= (r[1] - datetime(2024, 1, 1)).days < last]
    add(spark, src, of(0, 8))
    assert run(spark, src, base, make).count() == 0
    add(spark, src, of(8, 18))
    got = run(spark, src, base, make).collect()
    panel = spark.createDataFrame([r for r in a if r[1] < datetime(2024, 1, 15)], SCHEMA).select(F.to_date("ts").alias("date"), F.col("v").alias("sales"))
    want = detect.first_change(detect.scan_adaptive(panel, "sales", "2024-01-01", max_days=14, threshold=0.1)).first()
    assert [(r["key"], r["window_days"], r["change_point"]) for r in got] == [("a", want["window_days"], want["change_point"])]
    assert got[0]["js"] == pytest.approx(want["js"], abs=1e-12) and got[0]["change_point"] == date(2024, 1, 8)
    add(spark, src, of(18, 40))
    assert run(spark, src, base, make).collect() == got
    with stateful.rocksdb(spark):
        state = spark.read.format("statestore").option("path", f"{base}/checkpoint").option("stateVarName", "histograms").load()
        assert {r["k"] for r in state.select("key.key").distinct().toDF("k").collect()} == {"b"}


def test_late_rows_and_nulls(spark, tmp_path):
    """Rows behind the watermark change nothing; rows without a time are left out, rows without a value only count for the size."""
    src, base = str(tmp_path / "in"), str(tmp_path / "q")
    make = lambda s: stateful.growing_windows(s, "ts", "k", "v", "2024-01-01", max_days=14, threshold=0.1)
    add(spark, src, [*rows_of(range(10), 99), ("a", None, 1e6), (None, datetime(2024, 1, 2), None)])
    run(spark, src, base, make)
    add(spark, src, [("a", datetime(2024, 1, 1), 500.0)] * 400)  # nine days late
    add(spark, src, rows_of(range(10, 20), 99, seed=3))
    assert run(spark, src, base, make).count() == 0


def test_rolling_reference_across_a_restart(spark, tmp_path):
    src, base = str(tmp_path / "in"), str(tmp_path / "q")
    make = lambda s: stateful.rolling_reference(s, "ts", "v", "1 day", "k")
    rows = [(k, datetime(2024, 1, d, h), float((d * h + (k == "b")) % 3)) for k in "ab" for d in range(1, 9) for h in range(1, 12 + d) if h < 24 and d != 5]
    add(spark, src, [r for r in rows if r[1].day < 4])
    run(spark, src, base, make)
    add(spark, src, [*(r for r in rows if r[1].day >= 4), ("a", datetime(2024, 1, 1), 77.0), ("a", datetime(2024, 1, 7), None)])  # one late, one without a value
    got = run(spark, src, base, make).collect()
    for k in "ab":
        one = spark.createDataFrame([r for r in rows if r[0] == k], SCHEMA)
        counts = one.groupBy(F.window("ts", "1 day").start.alias("start"), F.col("v").cast("string").alias("bin")).agg(F.count("*").alias("n"))
        want = {r["start"]: (r["js"], r["l_inf"]) for r in drift.neighbour_drift(counts, "bin").collect() if r["start"] < datetime(2024, 1, 7)}
        mine = {r["start"]: (r["js"], r["l_inf"]) for r in got if r["key"] == k}
        assert mine.keys() == want.keys() and len(mine) == 4 and all(mine[s] == pytest.approx(want[s], abs=1e-12) for s in want)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 30), st.floats(0, 99).map(lambda x: round(x, 2))), min_size=1, max_size=60))
def test_edges_of_counts(spark, values):
    """Edges from counted values are those from rows."""
    found, n = np.unique(np.array(values, dtype=float), return_counts=True)
    assert stateful.edges_of(found, n).tolist() == pytest.approx(list(batch_edges(spark, values)), abs=1e-9)


def test_histograms_merge():
    a = stateful.merged(np.array([5, 1, 5]), np.array([2, 1, 3]))
    assert [x.tolist() for x in a] == [[1, 5], [1, 5]] and [x.tolist() for x in stateful.merged(*(np.zeros(0, dtype=np.int64),) * 2)] == [[], []]
    assert stateful.divergence_of(np.zeros(2), np.zeros(2)) == (0.0, 0.0)
