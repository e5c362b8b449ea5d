"""Queries over streams, each run to its end and read back (I1 to I5), with the SQL of the batch they amount to."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.panel import read
from ..sources.written import shared_folder
from ..streaming import drift, stateful
from . import sql as S
from .registry import ORACLES, query


def _stream(spark, sf_dir):
    return drift.read_stream(spark, f"{sf_dir}/events.parquet")


@query("i2_sliding_windows", "WITH w AS (SELECT ts, event_type, value, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY, date_trunc('day', ts) - INTERVAL 2 DAY]) AS start FROM events) SELECT CAST(start AS VARCHAR) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1, 2 HAVING max(start) + INTERVAL 3 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)")
def i2(spark, sf_dir):
    """Three-day windows a day apart; those the watermark has closed."""
    out = drift.run_to_table(drift.window_counts(_stream(spark, sf_dir), "ts", "event_type", "3 days", "1 day"), shared_folder(spark))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("i1_rolling_reference", "WITH c AS (SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING date_trunc('day', min(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)), s AS (SELECT start, lag(start) OVER (ORDER BY start) AS before FROM (SELECT DISTINCT start FROM c)), p AS (SELECT s.start, c.event_type, sum(CASE WHEN c.start = s.before THEN n ELSE 0 END) AS r, sum(CASE WHEN c.start = s.start THEN n ELSE 0 END) AS k FROM s JOIN c ON c.start IN (s.start, s.before) WHERE before IS NOT NULL GROUP BY 1, 2), q AS (SELECT start, r / sum(r) OVER (PARTITION BY start)::DOUBLE AS p, k / sum(k) OVER (PARTITION BY start)::DOUBLE AS q FROM p) SELECT CAST(start AS VARCHAR) AS start, round(sum(0.5 * (CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END)), 9) AS js, round(max(abs(p - q)), 9) AS l_inf FROM q GROUP BY 1")
def i1(spark, sf_dir):
    """Each day's mix of event types against the day before."""
    counts = drift.run_to_table(drift.window_counts(_stream(spark, sf_dir), "ts", "event_type", "1 day"), shared_folder(spark))
    return drift.neighbour_drift(counts, "event_type").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.round("js", 9).alias("js"), F.round("l_inf", 9).alias("l_inf"))


@query("i4_without_repeats", "SELECT count(DISTINCT event_id) AS n FROM events")
def i4(spark, sf_dir):
    """I4: repeated events dropped within the watermark."""
    return drift.run_to_table(drift.without_repeats(_stream(spark, sf_dir), ["event_id"], "ts", "60 days").select("event_id"), shared_folder(spark)).agg(F.count("*").alias("n"))


@query("i5_sessions", "WITH d AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 DAY THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM d), g AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM g GROUP BY 1")
def i5(spark, sf_dir):
    """Sessions with a gap of two days (batch form of the same expression)."""
    e = read(spark, sf_dir, "events")
    s = e.groupBy(F.session_window("ts", "2 days").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))


_CLOSED = "(SELECT CAST(max(ts) - INTERVAL 1 DAY AS DATE) FROM events)"


@query(
    "i3_growing_windows",
    f"WITH {S.EVENTS}, w AS (SELECT unnest(range(7, 91, 7)) AS window_days), k AS (SELECT dept_id || '/' || window_days AS kw, dept_id, window_days, sales AS x, CASE WHEN datediff('day', DATE '2024-01-01', date) < window_days // 2 THEN 'ref' ELSE 'cur' END AS win FROM ev, w "
    f"WHERE date >= DATE '2024-01-01' AND datediff('day', DATE '2024-01-01', date) < window_days AND DATE '2024-01-01' + CAST(window_days AS INT) <= {_CLOSED}), "
    "big AS (SELECT kw, any_value(dept_id) AS dept_id, any_value(window_days) AS window_days FROM k GROUP BY 1 HAVING count(*) FILTER (win = 'ref') >= 20 AND count(*) FILTER (win = 'cur') >= 20), "
    f"{S.edges('ed', 'k', 'x', 'kw')}, b AS (SELECT kw, win, {S.bin_of('x')} AS bin FROM k JOIN ed USING (kw) WHERE x BETWEEN e[1] AND e[len(e)]), h AS (SELECT kw, bin, {S.COUNTS} FROM b GROUP BY 1, 2), {S.js('kw', 'h', 'd')} "
    "SELECT dept_id AS key, CAST(window_days AS INT) AS window_days, CAST(DATE '2024-01-01' + CAST(window_days // 2 AS INT) AS DATE) AS change_point, round(js, 9) AS js FROM d JOIN big USING (kw) WHERE js > 0.02 QUALIFY row_number() OVER (PARTITION BY dept_id ORDER BY window_days) = 1",
)
def i3(spark, sf_dir):
    """Of each event type the first growing window whose halves differ, from the stream itself."""
    with stateful.rocksdb(spark):
        out = drift.run_to_table(stateful.growing_windows(_stream(spark, sf_dir), "ts", "event_type", "value", "2024-01-01", threshold=0.02), shared_folder(spark))
    return out.withColumn("js", F.round("js", 9))


@query("i1_rolling_reference_in_stream", ORACLES["i1_rolling_reference"])
def i1_stream(spark, sf_dir):
    """Each day's mix of event types against the day before, compared inside the stream."""
    with stateful.rocksdb(spark):
        out = drift.run_to_table(stateful.rolling_reference(_stream(spark, sf_dir), "ts", "event_type", "1 day"), shared_folder(spark))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.round("js", 9).alias("js"), F.round("l_inf", 9).alias("l_inf"))


@query("i5_sessions_in_stream", "WITH d AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 DAY THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM d), g AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2 HAVING max(ts) + INTERVAL 2 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)) SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM g GROUP BY 1")
def i5_stream(spark, sf_dir):
    """Sessions that the watermark has closed, from the stream."""
    out = drift.run_to_table(drift.sessions(_stream(spark, sf_dir), "ts", "user_id", "2 days"), shared_folder(spark))
    return out.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))
