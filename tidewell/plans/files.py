"""Queries through files of the engine's own: given tables written out as CSV and JSON lines, added to, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources.io import last_date
from ..sources.logged import ResultLog, scan_csv
from ..sources.panel import read
from ..sources.written import shared_folder
from .registry import query

_ORDERS = "o_orderkey long, o_orderdate date, o_orderpriority string, o_totalprice double"


def _log(spark, schema, keys, kind):
    return ResultLog(spark, f"{shared_folder(spark)}/log-{uuid.uuid4().hex}", schema, keys, kind)


@query("a2_csv_log", "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, CAST(max(o_orderdate) AS DATE) AS last FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1998-06-30' GROUP BY 1")
def a2(spark, sf_dir):
    """Orders in CSV batches that overlap, each key once; columns and days read back by the scan."""
    orders = read(spark, sf_dir, "orders").withColumn("o_orderdate", F.to_date("o_orderdate"))
    log = _log(spark, _ORDERS, ("o_orderkey",), "csv")
    log.add(orders.where("o_orderdate < DATE '1997-06-01'"))
    log.add(orders)
    rows = log.read(["o_orderdate", "o_orderpriority", "o_totalprice"], "o_orderdate BETWEEN DATE '1996-01-01' AND DATE '1998-06-30'")
    return rows.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.max("o_orderdate").alias("last"))


@query("a1_csv_inferred", "SELECT CAST(max(CAST(l_shipdate AS DATE)) AS DATE) AS last_date, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE CAST(l_shipdate AS DATE) >= DATE '1997-01-01'")
def a1(spark, sf_dir):
    """A1, A3: line items as CSV, types and dates found by the scan, cut to the days from a start."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    read(spark, sf_dir, "lineitem").select("l_orderkey", F.to_date("l_shipdate").alias("l_shipdate"), "l_quantity").write.option("header", True).csv(path)
    rows = scan_csv(spark, path, None, ["l_shipdate", "l_quantity"], "l_shipdate", "1997-01-01")
    return last_date(rows, "l_shipdate").crossJoin(rows.agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity")))  # one row each


@query("a13_json_log", "SELECT event_type, count(*) AS n, round(sum(CASE WHEN event_id % 3 = 0 THEN value * 2 ELSE value END), 4) AS total FROM events GROUP BY 1")
def a13(spark, sf_dir):
    """Events as JSON lines, a third of them written again; the last write of a key wins."""
    events = read(spark, sf_dir, "events").select("event_id", "event_type", "value")
    log = _log(spark, "event_id long, event_type string, value double", ("event_id",), "json")
    log.add(events)
    log.add(events.where("event_id % 3 = 0").withColumn("value", F.col("value") * 2), again=True)
    return log.latest().groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
