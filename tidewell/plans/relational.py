"""Queries: scans, predicates, joins, aggregates, windows, sorting, set operations and scalar functions as the engine uses them (A to H)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.quantiles import quantiles
from ..functions.stats import is_close, seed_of
from ..sources.panel import densify, event_panel, read, retail_panel
from . import sql as S
from .registry import query


@query("a4_projected_scan", "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 4) AS quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01' GROUP BY 1")
def a4(spark, sf_dir):
    """A4, A1-A3: a scan that reads three columns and pushes its filter down."""
    return read(spark, sf_dir, "lineitem").where(F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp")).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 4).alias("quantity"))


@query("a10_resume_anti_join", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def a10(spark, sf_dir):
    """A10, C11: keys not yet in a sink."""
    done = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, sf_dir, "orders").where("o_orderstatus = 'O'").join(done, "o_orderkey", "left_anti").select("o_orderkey")


@query(
    "b_predicates",
    f"WITH {S.RETAIL} SELECT cat_id, count(*) FILTER (date BETWEEN DATE '2000-03-01' AND DATE '2000-03-31') AS inclusive, count(*) FILTER (date >= DATE '2000-03-01' AND date < DATE '2000-03-31') AS half_open, "
    "count(*) FILTER (CAST(item_id AS VARCHAR) = '7') AS one_item, count(*) FILTER (store_id IN ('NATION_7', 'NATION_9')) AS in_set, count(*) FILTER (state_id = 'ASIA' AND sales > 25) AS conjunction, "
    "round(sum(CASE WHEN state_id = 'ASIA' THEN sales * 2 ELSE sales END), 4) AS updated FROM retail GROUP BY 1",
)
def b_predicates(spark, sf_dir):
    """Window, equality, membership and conjunction filters, conditional update."""
    p = retail_panel(spark, sf_dir)
    d = lambda x: F.lit(x).cast("date")
    day = F.col("date")
    return p.groupBy("cat_id").agg(
        F.count_if(day.between(d("2000-03-01"), d("2000-03-31"))).alias("inclusive"), F.count_if((day >= d("2000-03-01")) & (day < d("2000-03-31"))).alias("half_open"),
        F.count_if(F.col("item_id") == "7").alias("one_item"), F.count_if(F.col("store_id").isin("NATION_7", "NATION_9")).alias("in_set"), F.count_if((F.col("state_id") == "ASIA") & (F.col("sales") > 25)).alias("conjunction"),
        F.round(F.sum(F.when(F.col("state_id") == "ASIA", F.col("sales") * 2).otherwise(F.col("sales"))), 4).alias("updated"),
    )


@query(
    "b7_derived_columns",
    f"WITH {S.RETAIL}, d AS (SELECT *, (isodow(date) - 1 + 2) % 7 + 1 AS wday FROM retail) SELECT CAST(wday AS INT) AS wday, CAST(wday IN (1, 2) AS INT) AS is_weekend, "
    "CAST(CASE state_id WHEN 'ASIA' THEN day(date) <= 10 WHEN 'EUROPE' THEN day(date) BETWEEN 3 AND 12 ELSE day(date) >= 20 END AS INT) AS snap, CAST(month(date) = 12 AND day(date) IN (24, 25, 26) AS INT) AS event_flag, count(*) AS n, round(sum(sales * sell_price), 2) AS revenue FROM d GROUP BY ALL",
)
def b7(spark, sf_dir):
    """Calendar columns, pick by state, revenue."""
    return retail_panel(spark, sf_dir).groupBy("wday", "is_weekend", "snap", "event_flag").agg(F.count("*").alias("n"), F.round(F.sum(F.col("sales") * F.col("sell_price")), 2).alias("revenue"))


@query(
    "b9_b18_cleaning",
    "SELECT c_mktsegment, count(*) FILTER (c_acctbal < 0) AS clipped, round(sum(greatest(c_acctbal, 0)), 2) AS kept, CAST(sum(CAST(coalesce(TRY_CAST(CASE c_custkey % 4 WHEN 0 THEN 'True' WHEN 1 THEN 'false' END AS BOOLEAN), false) AS INT)) AS BIGINT) AS flags, "
    "count(TRY_CAST(CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE CAST(c_custkey AS VARCHAR) END AS DOUBLE)) AS numbers, count(TRY_CAST(CASE WHEN c_custkey % 5 = 0 THEN 'no day' ELSE '2024-02-29' END AS DATE)) AS dates, "
    "round(sum(coalesce(CASE WHEN c_nationkey > 5 THEN c_acctbal END, 1)), 2) AS filled, count(CASE WHEN c_nationkey > 5 THEN 1 END) AS kept_rows FROM customer GROUP BY 1",
)
def b9(spark, sf_dir):
    """Clip and count, boolean and numeric and date coercion, fill and drop of nulls."""
    c = read(spark, sf_dir, "customer")
    flag = F.expr("CASE c_custkey % 4 WHEN 0 THEN 'True' WHEN 1 THEN 'false' END").try_cast("boolean")
    return c.groupBy("c_mktsegment").agg(
        F.count_if(F.col("c_acctbal") < 0).alias("clipped"), F.round(F.sum(F.greatest("c_acctbal", F.lit(0))), 2).alias("kept"), F.sum(F.coalesce(flag, F.lit(False)).cast("int")).alias("flags"),
        F.count(F.expr("CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE CAST(c_custkey AS STRING) END").try_cast("double")).alias("numbers"), F.count(F.expr("CASE WHEN c_custkey % 5 = 0 THEN 'no day' ELSE '2024-02-29' END").try_cast("date")).alias("dates"),
        F.round(F.sum(F.coalesce(F.when(F.col("c_nationkey") > 5, F.col("c_acctbal")), F.lit(1))), 2).alias("filled"), F.count(F.when(F.col("c_nationkey") > 5, 1)).alias("kept_rows"),
    )


@query(
    "c1_c5_star_join",
    "WITH cal AS (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY))::DATE AS d), pr AS (SELECT l_partkey, l_suppkey, date_trunc('month', l_shipdate)::DATE AS m, max(l_extendedprice / l_quantity) AS price FROM lineitem GROUP BY ALL) "
    "SELECT r_name, p_type, count(*) AS n, count(cal.d) AS with_day, round(sum(l_quantity * price), 2) AS value FROM lineitem l LEFT JOIN cal ON cal.d = CAST(l_shipdate AS DATE) LEFT JOIN pr ON pr.l_partkey = l.l_partkey AND pr.l_suppkey = l.l_suppkey AND pr.m = date_trunc('month', l_shipdate)::DATE "
    "JOIN part ON l.l_partkey = p_partkey JOIN supplier ON l.l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
)
def c1(spark, sf_dir):
    """Calendar, three-key prices, dimensions."""
    line = read(spark, sf_dir, "lineitem").withColumn("d", F.to_date("l_shipdate")).withColumn("m", F.trunc("d", "month"))
    cal = spark.sql("SELECT explode(sequence(DATE'1995-01-01', DATE'2001-12-31')) AS d, true AS known")
    price = line.groupBy("l_partkey", "l_suppkey", "m").agg(F.max(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    dims = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("s_suppkey").alias("l_suppkey"), "r_name")
    j = line.join(F.broadcast(cal), "d", "left").join(price, ["l_partkey", "l_suppkey", "m"], "left").join(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey").join(dims, "l_suppkey")  # a row a day
    return j.groupBy("r_name", "p_type").agg(F.count("*").alias("n"), F.count("known").alias("with_day"), F.round(F.sum(F.col("l_quantity") * F.col("price")), 2).alias("value"))


@query(
    "c3_c4_densify",
    "WITH f AS (SELECT user_id, event_type, CAST(ts AS DATE) AS date, sum(value) AS value FROM events GROUP BY ALL), k AS (SELECT DISTINCT user_id, event_type FROM f), g AS (SELECT * FROM k, (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY))::DATE AS date)) "
    "SELECT g.event_type, g.date, count(*) AS n, round(sum(coalesce(value, 0)), 4) AS value, count(*) FILTER (value IS NULL) AS zeros FROM g LEFT JOIN f ON f.user_id = g.user_id AND f.event_type = g.event_type AND f.date = g.date GROUP BY ALL",
)
def c3(spark, sf_dir):
    """Sparse facts on the full grid of pairs and days."""
    f = read(spark, sf_dir, "events").groupBy("user_id", "event_type", F.to_date("ts").alias("date")).agg(F.sum("value").alias("value"))
    g = densify(f, ["user_id", "event_type"], "value", "2024-01-01", "2024-01-30", filled="filled")
    return g.groupBy("event_type", "date").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"), F.count_if("filled").alias("zeros"))


@query("c6_semi_join", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def c6(spark, sf_dir):
    """Rows whose key is in a set."""
    keys = read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return read(spark, sf_dir, "orders").join(keys, "o_custkey", "left_semi").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    "c7_event_flag",
    f"WITH {S.RETAIL}, nat AS (SELECT DISTINCT date FROM retail WHERE day(date) = 1 AND month(date) % 3 = 0), st AS (SELECT DISTINCT date, state_id FROM retail WHERE day(date) = 15 AND length(state_id) > 4), ci AS (SELECT DISTINCT date, store_id FROM retail WHERE day(date) = 20 AND store_id LIKE '%1%') "
    "SELECT CAST(nat.date IS NOT NULL OR st.date IS NOT NULL OR ci.date IS NOT NULL AS INT) AS flag, count(*) AS n FROM retail p LEFT JOIN nat ON nat.date = p.date LEFT JOIN st ON st.date = p.date AND st.state_id = p.state_id LEFT JOIN ci ON ci.date = p.date AND ci.store_id = p.store_id GROUP BY 1",
)
def c7(spark, sf_dir):
    """National, state and city events, or-ed memberships of distinct keys."""
    p = retail_panel(spark, sf_dir)
    day = F.dayofmonth("date")
    nat = p.where((day == 1) & (F.month("date") % 3 == 0)).select("date").distinct().withColumn("a", F.lit(True))
    st = p.where((day == 15) & (F.length("state_id") > 4)).select("date", "state_id").distinct().withColumn("b", F.lit(True))
    ci = p.where((day == 20) & F.col("store_id").like("%1%")).select("date", "store_id").distinct().withColumn("c", F.lit(True))
    j = p.join(nat, "date", "left").join(st, ["date", "state_id"], "left").join(ci, ["date", "store_id"], "left")
    return j.groupBy(F.coalesce("a", "b", "c", F.lit(False)).cast("int").alias("flag")).agg(F.count("*").alias("n"))


@query(
    "c10_full_outer_windows",
    f"WITH {S.RETAIL}, r AS (SELECT item_id, avg(sales) AS m FROM retail WHERE date BETWEEN DATE '2000-01-01' AND DATE '2000-02-28' GROUP BY 1), c AS (SELECT item_id, avg(sales) AS m FROM retail WHERE date BETWEEN DATE '2001-01-01' AND DATE '2001-02-28' GROUP BY 1) "
    "SELECT coalesce(r.item_id, c.item_id) AS item_id, round(r.m, 6) AS ref_mean, round(c.m, 6) AS cur_mean FROM r FULL JOIN c ON r.item_id = c.item_id",
)
def c10(spark, sf_dir):
    """Both windows aligned by value, either side kept, by one aggregation."""
    d = lambda a, b: F.col("date").between(F.lit(a).cast("date"), F.lit(b).cast("date"))
    ref, cur = d("2000-01-01", "2000-02-28"), d("2001-01-01", "2001-02-28")
    p = retail_panel(spark, sf_dir).where(ref | cur)
    return p.groupBy("item_id").agg(F.round(F.avg(F.when(ref, F.col("sales"))), 6).alias("ref_mean"), F.round(F.avg(F.when(cur, F.col("sales"))), 6).alias("cur_mean"))


@query(
    "c12_c13_paired_results",
    "WITH b AS (SELECT o_custkey AS k, max(o_totalprice) AS top FROM orders GROUP BY 1), a AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1) SELECT b.k, round(top, 2) AS top_base, coalesce(n, 0) AS n_arm, n IS NOT NULL AS answered FROM b LEFT JOIN a ON a.k = b.k",
)
def c12(spark, sf_dir):
    """Two result sets on their key, missing answers as zero."""
    o = read(spark, sf_dir, "orders")
    base = o.groupBy(F.col("o_custkey").alias("k")).agg(F.round(F.max("o_totalprice"), 2).alias("top_base"))
    arm = o.where(F.col("o_orderpriority").startswith("1")).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    return base.join(arm, "k", "left").select("k", "top_base", F.coalesce("n", F.lit(0)).alias("n_arm"), F.col("n").isNotNull().alias("answered"))


@query(
    "c17_value_before",
    f"WITH {S.EVENTS}, d AS (SELECT item_id, store_id, date, sum(sales) AS x FROM ev GROUP BY ALL) SELECT item_id, store_id, round(arg_max(x, date), 6) AS last_value FROM d WHERE date < DATE '2024-01-21' GROUP BY 1, 2",
)
def c17(spark, sf_dir):
    """The value in effect before a day, a series at a time, as one aggregation."""
    d = event_panel(spark, sf_dir).groupBy("item_id", "store_id", "date").agg(F.sum("sales").alias("x"))
    return d.where(F.col("date") < F.lit("2024-01-21").cast("date")).groupBy("item_id", "store_id").agg(F.round(F.max_by("x", "date"), 6).alias("last_value"))


@query(
    "d5_d14_statistics",
    f"WITH {S.RETAIL} SELECT store_id, round(avg(sales), 9) AS mean, count(DISTINCT item_id) AS items, min(date) AS first_day, max(date) AS last_day, round(median(revenue), 4) AS middle, round(stddev_samp(sales), 9) AS std, round(stddev_samp(sales) / sqrt(count(*)), 9) AS sem, "
    "round(quantile_cont(sell_price, 0.25), 6) AS q25, round(quantile_cont(sell_price, 0.99), 6) AS q99, max(state_id) AS state_id, round(avg(CAST(sales = 1 AS INT)), 9) AS share_one, round(avg(CAST(sales % 1 <> 0 AS INT)), 9) AS fractional, round(avg(abs(sales - 25)), 9) AS mae FROM retail GROUP BY 1",
)
def d5(spark, sf_dir):
    """Exact statistics by group."""
    p = retail_panel(spark, sf_dir)
    # Quantiles of both columns at once, beside the other statistics: a percentile among them keeps all values of a store in a task.
    values = p.select("store_id", F.explode(F.array(F.struct(F.lit("revenue").alias("c"), F.col("revenue").cast("double").alias("x")), F.struct(F.lit("sell_price").alias("c"), F.col("sell_price").alias("x")))).alias("f")).select("store_id", "f.*")
    marks = [0.25, 0.5, 0.99]
    of = lambda column, mark: F.max(F.when(F.col("c") == column, F.get("q", F.lit(marks.index(mark)))))
    q = quantiles(values, "x", marks, ["store_id", "c"]).groupBy(F.col("store_id").alias("_store")).agg(F.round(of("revenue", 0.5), 4).alias("middle"), F.round(of("sell_price", 0.25), 6).alias("q25"), F.round(of("sell_price", 0.99), 6).alias("q99"))
    stats = p.groupBy("store_id").agg(
        F.round(F.avg("sales"), 9).alias("mean"), F.count_distinct("item_id").alias("items"), F.min("date").alias("first_day"), F.max("date").alias("last_day"),
        F.round(F.stddev_samp("sales"), 9).alias("std"), F.round(F.stddev_samp("sales") / F.sqrt(F.count("*").cast("double")), 9).alias("sem"),
        F.max("state_id").alias("state_id"), F.round(F.avg((F.col("sales") == 1).cast("int")), 9).alias("share_one"), F.round(F.avg((F.col("sales") % 1 != 0).cast("int")), 9).alias("fractional"), F.round(F.avg(F.abs(F.col("sales") - 25)), 9).alias("mae"),
    )
    met = stats.join(q, F.col("store_id").eqNullSafe(F.col("_store")), "left")
    return met.select("store_id", "mean", "items", "first_day", "last_day", "middle", "std", "sem", "q25", "q99", "state_id", "share_one", "fractional", "mae")


@query("d11_duplicated_keys", "SELECT l_orderkey, l_linenumber, n FROM (SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n > 1")
def d11(spark, sf_dir):
    """Every copy of a repeated key."""
    n = F.count("*").over(Window.partitionBy("l_orderkey", "l_linenumber"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", n.alias("n")).where("n > 1")


@query("d15_top_values", "SELECT coalesce(o_orderpriority, 'null') AS value, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, value LIMIT 15")
def d15(spark, sf_dir):
    """The fifteen most frequent values."""
    return read(spark, sf_dir, "orders").groupBy(F.coalesce("o_orderpriority", F.lit("null")).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(15)


@query(
    "d16_d26_mix",
    "WITH w AS (SELECT p_type AS g, unnest(string_split(p_name, ' ')) AS w FROM part), c AS (SELECT g, w, count(*) AS n FROM w GROUP BY ALL) SELECT g, w, n, round(n / sum(n) OVER (PARTITION BY g)::DOUBLE, 9) AS share, round(max(n) OVER (PARTITION BY g) / sum(n) OVER (PARTITION BY g)::DOUBLE, 9) AS modal FROM c",
)
def d16(spark, sf_dir):
    """Exploded tokens, their shares in each group, and the modal share."""
    c = read(spark, sf_dir, "part").select(F.col("p_type").alias("g"), F.explode(F.split("p_name", " ")).alias("w")).groupBy("g", "w").agg(F.count("*").alias("n"))
    part = Window.partitionBy("g")
    return c.select("g", "w", "n", F.round(F.col("n") / F.sum("n").over(part), 9).alias("share"), F.round(F.max("n").over(part) / F.sum("n").over(part), 9).alias("modal"))


@query(
    "d21_d22_pivot",
    "SELECT n_regionkey, CAST(count(*) FILTER (n_nationkey % 3 = 0) AS BIGINT) AS a, CAST(count(*) FILTER (n_nationkey % 3 = 1) AS BIGINT) AS b, CAST(count(*) FILTER (n_nationkey % 3 = 2) AS BIGINT) AS c FROM nation GROUP BY 1",
)
def d21(spark, sf_dir):
    """A crosstab with zeros, its columns named so that no extra job finds them."""
    n = read(spark, sf_dir, "nation").select("n_regionkey", F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("n_nationkey") % 3 + 1).cast("int")).alias("k"))
    return n.groupBy("n_regionkey").pivot("k", ["a", "b", "c"]).count().fillna(0)


@query("d24_joined_reasons", "SELECT o_custkey, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ';') AS reasons FROM orders GROUP BY 1")
def d24(spark, sf_dir):
    """Distinct reasons, sorted and joined."""
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ";").alias("reasons"))


@query(
    "d25_rollup",
    "SELECT coalesce(o_orderpriority, 'ALL') AS drift_type, coalesce(o_orderstatus, 'ALL') AS arm, count(*) AS n, round(avg(CAST(o_totalprice > 150000 AS INT)), 9) AS rate FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)",
)
def d25(spark, sf_dir):
    """Groups and their pooled rows in one aggregation."""
    r = read(spark, sf_dir, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.avg((F.col("o_totalprice") > 150000).cast("int")), 9).alias("rate"))
    return r.select(F.coalesce("o_orderpriority", F.lit("ALL")).alias("drift_type"), F.coalesce("o_orderstatus", F.lit("ALL")).alias("arm"), "n", "rate")


@query(
    "d27_votes",
    "WITH v AS (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_suppkey, l_partkey) - 1 AS pos FROM lineitem), a AS (SELECT l_suppkey, count(*) AS votes, avg(pos) AS mean_rank FROM v WHERE pos < 3 GROUP BY 1) SELECT l_suppkey, votes, round(mean_rank, 9) AS mean_rank, CAST(row_number() OVER (ORDER BY votes DESC, mean_rank, l_suppkey) AS INT) AS place FROM a",
)
def d27(spark, sf_dir):
    """Votes of ranked lists: appearances, then mean position."""
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_suppkey", "l_partkey")
    v = read(spark, sf_dir, "lineitem").select("l_suppkey", (F.row_number().over(w) - 1).alias("pos")).where("pos < 3")
    a = v.groupBy("l_suppkey").agg(F.count("*").alias("votes"), F.avg("pos").alias("mean_rank"))
    place = F.row_number().over(Window.orderBy(F.desc("votes"), "mean_rank", "l_suppkey"))  # a row a candidate
    return a.select("l_suppkey", "votes", F.round("mean_rank", 9).alias("mean_rank"), place.alias("place"))


@query(
    "d31_jaccard",
    "WITH s AS (SELECT n_regionkey AS g, list_distinct(list(n_nationkey % 7)) AS x FROM nation GROUP BY 1) SELECT a.g AS a, b.g AS b, round(len(list_intersect(a.x, b.x)) / len(list_distinct(list_concat(a.x, b.x)))::DOUBLE, 9) AS jaccard FROM s a JOIN s b ON a.g < b.g",
)
def d31(spark, sf_dir):
    """Pairwise Jaccard of small sets (a set a run)."""
    s = read(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("g")).agg(F.collect_set(F.col("n_nationkey") % 7).alias("x"))
    b = s.select(F.col("g").alias("b"), F.col("x").alias("y"))
    return s.join(F.broadcast(b), F.col("g") < F.col("b")).select(F.col("g").alias("a"), "b", F.round(F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y")), 9).alias("jaccard"))  # five regions


@query(
    "e2_e10_windows",
    f"WITH {S.EVENTS}, d AS (SELECT dept_id, date, avg(sales) AS m FROM ev GROUP BY ALL) SELECT dept_id, date, round(m, 9) AS m, round(CASE WHEN count(*) OVER w = 2 THEN avg(m) OVER w END, 9) AS rolling, CAST(ntile(6) OVER (PARTITION BY dept_id ORDER BY date) AS INT) AS block, "
    "CAST(floor(datediff('day', date, DATE '2024-01-30') / 7) AS INT) AS back, CAST(floor(datediff('day', DATE '2024-01-01', date) / 7) AS INT) AS week, CAST(row_number() OVER (PARTITION BY dept_id ORDER BY m DESC, date) AS INT) AS place, count(*) OVER (PARTITION BY dept_id) AS of_n FROM d WINDOW w AS (PARTITION BY dept_id ORDER BY date ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)",
)
def e2(spark, sf_dir):
    """Rolling mean of full frames, blocks, trailing and anchored weeks, rank of n."""
    d = event_panel(spark, sf_dir).groupBy("dept_id", "date").agg(F.avg("sales").alias("m"))
    by, frame = Window.partitionBy("dept_id"), Window.partitionBy("dept_id").orderBy("date").rowsBetween(-1, 0)
    lit = lambda x: F.lit(x).cast("date")
    return d.select(
        "dept_id", "date", F.round("m", 9).alias("m"), F.round(F.when(F.count("*").over(frame) == 2, F.avg("m").over(frame)), 9).alias("rolling"), F.ntile(6).over(by.orderBy("date")).alias("block"),
        F.floor(F.datediff(lit("2024-01-30"), "date") / 7).cast("int").alias("back"), F.floor(F.datediff("date", lit("2024-01-01")) / 7).cast("int").alias("week"), F.row_number().over(by.orderBy(F.desc("m"), "date")).alias("place"), F.count("*").over(by).alias("of_n"),
    )


@query(
    "e4_fill",
    "WITH d AS (SELECT user_id, CAST(ts AS DATE) AS date, CASE WHEN max(event_id) % 3 = 0 THEN max(value) END AS x FROM events GROUP BY ALL), f AS (SELECT user_id, date, last_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f, first_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM d) SELECT user_id, date, coalesce(f, b) AS x FROM f",
)
def e4(spark, sf_dir):
    """Forward fill, then back fill, both within the series."""
    d = read(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("date")).agg(F.when(F.max("event_id") % 3 == 0, F.max("value")).alias("x"))
    w = Window.partitionBy("user_id").orderBy("date")
    return d.select("user_id", "date", F.coalesce(F.last("x", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("x", True).over(w.rowsBetween(0, Window.unboundedFollowing))).alias("x"))


@query(
    "e6_e8_per_group",
    "WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(CAST(o_orderkey AS VARCHAR))) AS pick, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS latest FROM orders) SELECT o_orderkey, CAST(pick <= 20 AS INT) AS sampled, CAST(latest = 1 AS INT) AS kept_last FROM r WHERE pick <= 20 OR latest = 1",
)
def e6(spark, sf_dir):
    """N of each group by hash, and the last row of each key."""
    pick = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(F.md5(F.col("o_orderkey").cast("string").cast("binary"))))
    latest = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    r = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_custkey", "o_orderdate").select("o_orderkey", pick.alias("pick"), latest.alias("latest"))
    return r.where("pick <= 20 or latest = 1").select("o_orderkey", (F.col("pick") <= 20).cast("int").alias("sampled"), (F.col("latest") == 1).cast("int").alias("kept_last"))


@query(
    "e14_repeats",
    "WITH r AS (SELECT o_custkey, o_orderpriority AS answer, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS rep FROM orders) SELECT o_custkey, max(answer) FILTER (rep = 0) = max(answer) FILTER (rep = 1) AS stable FROM r GROUP BY 1 HAVING count(*) > 1",
)
def e14(spark, sf_dir):
    """Does the second answer of a key repeat the first?"""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    r = read(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("answer"), (F.row_number().over(w) - 1).alias("rep"))
    at = lambda k: F.max(F.when(F.col("rep") == k, F.col("answer")))
    return r.groupBy("o_custkey").agg(F.count("*").alias("n"), (at(0) == at(1)).alias("stable")).where("n > 1").select("o_custkey", "stable")


@query("f4_f7_ordering", "SELECT n_regionkey, count(*) AS n, arg_max(n_name, n_nationkey) AS newest, min(n_name) AS first_name FROM nation GROUP BY 1 ORDER BY n DESC, newest DESC, n_regionkey LIMIT 3")
def f4(spark, sf_dir):
    """Mixed sort keys, head, arg max."""
    return read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n"), F.max_by("n_name", "n_nationkey").alias("newest"), F.min("n_name").alias("first_name")).orderBy(F.desc("n"), F.desc("newest"), "n_regionkey").limit(3)


@query(
    "g_set_operations",
    "SELECT 'union_all' AS op, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) UNION ALL SELECT 'union', count(*) FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL "
    "SELECT 'intersect', count(*) FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'except', count(*) FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier)",
)
def g(spark, sf_dir):
    """G1-G5."""
    a, b = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    parts = {"union_all": a.union(b), "union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b)}
    out = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "h_scalar_functions",
    "SELECT s_suppkey, round(abs(s_acctbal), 4) AS a, round(ln(abs(s_acctbal) + 1), 9) AS l, round(sqrt(abs(s_acctbal)), 9) AS r, round(sin(s_acctbal), 9) AS s, abs(s_acctbal - s_acctbal * 1.000001) <= 1e-8 + 1e-5 * abs(s_acctbal * 1.000001) AS close, lower(s_name) || '_x' AS low, "
    "regexp_replace(s_name, '[0-9]+', '#') AS masked, regexp_matches(s_name, '[0-9]{2}') AS has_two, starts_with(s_name, 'Supp') AS starts, substr(s_name, 1, 5) AS cut FROM supplier",
)
def h(spark, sf_dir):
    """H1, H3, H4: scalar functions."""
    b = F.col("s_acctbal")
    return read(spark, sf_dir, "supplier").select(
        "s_suppkey", F.round(F.abs(b), 4).alias("a"), F.round(F.log(F.abs(b) + 1), 9).alias("l"), F.round(F.sqrt(F.abs(b)), 9).alias("r"), F.round(F.sin(b), 9).alias("s"), is_close(b, b * 1.000001).alias("close"), F.concat(F.lower("s_name"), F.lit("_x")).alias("low"),
        F.regexp_replace("s_name", "[0-9]+", "#").alias("masked"), F.col("s_name").rlike("[0-9]{2}").alias("has_two"), F.col("s_name").startswith("Supp").alias("starts"), F.substring("s_name", 1, 5).alias("cut"),
    )


@query("h5_seed_of_name", f"SELECT name, CAST({S.crc32('name')} % 1000 AS INT) AS seed FROM (SELECT DISTINCT event_type AS name FROM events UNION SELECT DISTINCT o_orderpriority FROM orders)")
def h5(spark, sf_dir):
    """H5: crc32 seeds of the names of event types and priorities."""
    names = read(spark, sf_dir, "events").select(F.col("event_type").alias("name")).union(read(spark, sf_dir, "orders").select("o_orderpriority")).distinct()
    return names.select("name", seed_of(F.col("name")).cast("int").alias("seed"))


@query("h6_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, '{\"event_type\":\"' || event_type || '\",\"k\":' || json_extract_string(props, '$.k') || '}' AS payload FROM events")
def h6(spark, sf_dir):
    """H6, DM16, DM17, A11: JSON in and out."""
    e = read(spark, sf_dir, "events").select("event_id", "event_type", F.from_json("props", "k int").alias("p"))
    return e.select("event_id", "p.k", F.to_json(F.struct("event_type", "p.k")).alias("payload"))


@query(
    "h9_durations",
    "SELECT o_orderkey, round(CASE o_orderkey % 4 WHEN 0 THEN o_custkey / 1000.0::DOUBLE WHEN 1 THEN (o_custkey % 90) * 60 + (o_orderkey % 600) / 10.0::DOUBLE WHEN 2 THEN (o_custkey % 30) * 3600 + (o_orderkey % 60) * 60 ELSE o_custkey END, 6) AS seconds FROM orders",
)
def h9(spark, sf_dir):
    """H9: durations such as 577ms, 1m26.4s, 2h3m and 45s, made of each order's numbers."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    tenths = F.concat(F.floor(key % 600 / 10), F.lit("."), key % 600 % 10)
    text = F.when(key % 4 == 0, F.concat(cust, F.lit("ms"))).when(key % 4 == 1, F.concat(cust % 90, F.lit("m"), tenths, F.lit("s"))).when(key % 4 == 2, F.concat(cust % 30, F.lit("h"), key % 60, F.lit("m"))).otherwise(F.concat(cust, F.lit("s")))
    part = lambda p: F.coalesce(F.regexp_extract("text", p, 1).try_cast("double"), F.lit(0.0))
    seconds = part(r"([0-9.]+)h") * 3600 + part(r"([0-9.]+)m(?!s)") * 60 + part(r"([0-9.]+)s$") + part(r"([0-9.]+)ms") / 1000
    return read(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")).select("o_orderkey", F.round(seconds, 6).alias("seconds"))
