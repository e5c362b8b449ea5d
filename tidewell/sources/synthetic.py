"""A synthetic panel with promotions, weekends, seasons and counts, generated where its rows will be."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .panel import PANEL_COLUMNS, week_day

#: Shares and lifts of the generator.
PROMO_SHARE, PROMO_LIFT, WEEKEND_LIFT, SEASON, CHRISTMAS_LIFT, SNAP_LIFT = 0.06, 0.40, 0.35, 0.25, 0.90, 0.15


def panel(spark: SparkSession, days: int = 913, items: int = 200, stores: int = 10, seed: int = 42, start: str = "2014-01-01") -> DataFrame:
    """One row an item, store and day. Draws are hashes of (seed, item, store, day), so any task gives the same rows, however the range is split.

    Counts follow the demand by inverse transform of a normal approximation, which needs no Python.
    """
    n = days * items * stores
    ids = spark.range(n)
    u = lambda salt, *keys: (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *keys), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    df = ids.select((F.col("id") % days).cast("int").alias("d"), (F.floor(F.col("id") / days) % items).cast("int").alias("i"), F.floor(F.col("id") / (days * items)).cast("int").alias("s"))
    day = F.date_add(F.lit(start).cast("date"), F.col("d"))
    df = df.withColumns({"date": day, "promo": u("promo", "i", "s", "d") < PROMO_SHARE, "base": -2.0 * F.log(u("a", "i", "s") * u("b", "i", "s")), "price": 2 + 10 * u("price", "i")})
    weekend = week_day(F.col("date")).isin(1, 2)
    snap = F.dayofmonth("date") <= 10
    christmas = (F.month("date") == 12) & F.dayofmonth("date").between(18, 24)
    lift = lambda cond, x: F.when(cond, 1 + x).otherwise(1.0)
    demand = F.col("base") * lift(weekend, WEEKEND_LIFT) * (1 + SEASON * F.sin(2 * 3.141592653589793 * F.dayofyear("date") / 365)) * lift(christmas, CHRISTMAS_LIFT) * lift(F.col("promo"), PROMO_LIFT) * lift(snap, SNAP_LIFT)
    normal = F.sqrt(-2 * F.log(u("n1", "i", "s", "d"))) * F.cos(2 * 3.141592653589793 * u("n2", "i", "s", "d"))
    sales = F.greatest(F.lit(0.0), F.rint(demand + F.sqrt(demand) * normal))
    price = F.col("price") * F.when(F.col("promo"), 0.6 + 0.25 * u("off", "i", "s", "d")).otherwise(1.0)
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    out = df.select(
        name("ITEM_", F.col("i")).alias("item_id"), name("DEPT_", F.col("i") % 7).alias("dept_id"), name("CAT_", (F.col("i") % 7) % 3).alias("cat_id"), name("STORE_", F.col("s")).alias("store_id"), name("STATE_", F.col("s") % 3).alias("state_id"),
        "date", sales.alias("sales"), price.alias("sell_price"), snap.cast("int").alias("snap"), weekend.cast("int").alias("is_weekend"), christmas.cast("int").alias("event_flag"),
    )
    return out.withColumns({"id": F.concat_ws("_", "item_id", "store_id"), "wday": week_day(F.col("date")), "revenue": F.col("sales") * F.col("sell_price")}).select(*PANEL_COLUMNS)
