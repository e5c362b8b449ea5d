"""Result logs: repeated and killed appends, odd texts, the scan's filters."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tidewell.sources.logged import ResultLog, scan_csv

SCHEMA = "k long, name string, day date, v double"


def rows(spark, *given):
    return spark.createDataFrame(list(given), SCHEMA)


@pytest.mark.parametrize("kind", ["csv", "json"])
def test_a_repeated_append_adds_nothing(spark, tmp_path, kind):
    log = ResultLog(spark, str(tmp_path / "log"), SCHEMA, ("k",), kind)
    assert log.read().count() == 0 and log.latest().count() == 0
    odd = 'a "quoted", text\nwith, a line end'
    first = rows(spark, (1, odd, date(2024, 1, 1), 1.5), (2, None, None, None), (2, None, None, None), (None, "no key", date(2024, 1, 2), 0.1))
    assert log.add(first.withColumn("other", F.lit(1))) == 3 and log.add(first) == 0
    assert log.add(first.unionByName(rows(spark, (3, "é", date(2024, 2, 1), float("inf"))))) == 1
    got = {r["k"]: tuple(r) for r in log.read().collect()}
    assert got == {1: (1, odd, date(2024, 1, 1), 1.5), 2: (2, None, None, None), None: (None, "no key", date(2024, 1, 2), 0.1), 3: (3, "é", date(2024, 2, 1), float("inf"))}
    assert log.add(first.where("false")) == 0 and len(log.batches()) == 2


@pytest.mark.parametrize("when", ["writing", "committing"])
def test_a_killed_append_is_repeated(spark, tmp_path, monkeypatch, when):
    """Killed in the middle of a batch, or between the batch and its commit: what it left is not read, and the repeat has every key once."""
    log = ResultLog(spark, str(tmp_path / "log"), SCHEMA, ("k",))
    log.add(rows(spark, (1, "a", None, 1.0)))
    more = rows(spark, *((i, "b", None, float(i)) for i in range(6)))
    with monkeypatch.context() as m:
        if when == "writing":
            write = ResultLog._write
            m.setattr(ResultLog, "_write", lambda self, df, folder: (write(self, df.limit(2), folder), 1 / 0))
        else:
            m.setattr(ResultLog, "_commit", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            log.add(more)
    assert [r["k"] for r in log.read().collect()] == [1]
    again = ResultLog(spark, str(tmp_path / "log"), SCHEMA, ("k",))
    assert again.add(more) == 5
    assert sorted(r["k"] for r in again.read().collect()) == list(range(6)) and again.add(more) == 0


def test_last_write_wins(spark, tmp_path):
    log = ResultLog(spark, str(tmp_path / "log"), SCHEMA, ("k", "name"), "json")
    log.add(rows(spark, (1, "a", None, 1.0), (2, None, None, 2.0)))
    log.add(rows(spark, (1, "a", None, 5.0), (2, None, None, 6.0), (3, "c", None, 7.0)), again=True)
    assert sorted((r["k"], r["v"]) for r in log.latest().collect()) == [(1, 5.0), (2, 6.0), (3, 7.0)] and log.read().count() == 5


def test_columns_and_days_reach_the_scan(spark, tmp_path):
    log = ResultLog(spark, str(tmp_path / "log"), SCHEMA, ("k",))
    log.add(rows(spark, *((i, f"n{i}", date(2024, 1, 1 + i), float(i)) for i in range(20))))
    df = log.read(["v"], "day BETWEEN DATE '2024-01-03' AND DATE '2024-01-05'")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<day:date,v:double>" in plan and "GreaterThanOrEqual(day,2024-01-03)" in plan
    assert sorted(r["v"] for r in df.collect()) == [2.0, 3.0, 4.0]


def test_scan_of_foreign_csv(spark, tmp_path):
    (tmp_path / "f.csv").write_text("date,x,name\n2024-01-01,1,a\nnot a day,2,b\n2024-01-03,3.5,\"c, d\"\n,4,e\n")
    df = scan_csv(spark, str(tmp_path / "f.csv"), None, ["date", "x", "name"], "date", "2024-01-02", "2024-01-09")
    assert [tuple(r) for r in df.collect()] == [(date(2024, 1, 3), 3.5, "c, d")]
    typed = scan_csv(spark, str(tmp_path / "f.csv"), "date date, x double, name string", ["x"], "date", None, "2024-01-02")
    assert [r["x"] for r in typed.collect()] == [1.0]
    assert scan_csv(spark, str(tmp_path / "f.csv"), "date string, x double, name string", ["x"]).count() == 4
