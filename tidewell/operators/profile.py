"""Profiles of raw tables, and what they say about a data set: keys, roles, hierarchy, flags, issues."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import count, permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.written import written
from .hierarchy import dependencies, reduced

#: Share of parsed values that makes a date column, and share of zeros that makes a target zero-inflated.
DATE_SHARE, ZERO_INFLATED = 0.95, 0.3
QUANTILES = {"min": 0.0, "p01": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99, "max": 1.0}


def columns_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, n, n_null, n_unique, dates (share that parses as one), zero, negative, fractional shares: all columns in one pass over the table.

    Each row is unpivoted to text; distinct values are counted exactly.
    """
    columns = list(columns or df.columns)
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns))
    rows = df.select(F.explode(each).alias("c")).select("c.*")
    n = rows.groupBy("column", "v").agg(F.count("*").alias("n"))  # equal values meet before they are parsed
    x, day = F.col("v").try_cast("double"), F.when(F.col("v").rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"), F.col("v").try_cast("date"))  # else a number would count as a year
    part = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    g = n.groupBy("column").agg(F.sum("n").alias("n"), part(F.col("v").isNull()).alias("n_null"), F.count("v").alias("n_unique"), part(day.isNotNull()).alias("d"), part(x.isNotNull()).alias("num"), part(x == 0).alias("z"), part(x < 0).alias("neg"), part(x % 1 != 0).alias("frac"))
    share = lambda k, of: F.try_divide(F.col(k), F.nullif(F.col(of), F.lit(0)))
    g = g.withColumn("some", F.col("n") - F.col("n_null"))
    return g.select("column", "n", "n_null", "n_unique", share("d", "some").alias("dates"), share("num", "some").alias("numbers"), share("z", "num").alias("zero"), share("neg", "num").alias("negative"), share("frac", "num").alias("fractional"))


def numeric_summary(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """by, n, mean, std and seven exact quantiles."""
    x = F.col(column).try_cast("double")
    g = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.percentile(x, F.array(*(F.lit(q) for q in QUANTILES.values()))).alias("q"))
    return g.select(*by, "n", "mean", "std", *(F.col("q")[i].alias(k) for i, k in enumerate(QUANTILES)))


def date_gaps(df: DataFrame, date: str, by: Sequence[str] = ()) -> DataFrame:
    """n_groups, mean, median and p90 of the share of days missing between a group's first and last, and the share of groups with a gap."""
    g = df.groupBy(*by).agg(F.min(date).alias("a"), F.max(date).alias("b"), F.count_distinct(date).alias("n")).where("a is not null")
    days = F.datediff("b", "a") + 1
    g = g.withColumn("missing", 1 - F.col("n") / days)
    return g.agg(F.count("*").alias("n_groups"), F.avg("missing").alias("mean"), F.median("missing").alias("median"), F.percentile("missing", 0.9).alias("p90"), F.avg((F.col("missing") > 0).cast("int")).alias("any_gap"))


def dependency_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """determinant, dependent, n_violations of every ordered pair of columns."""
    return dependencies(df, list(permutations(columns, 2)))


def relations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """child, parent: dependencies without violations where the parent has fewer values. Nulls are no values; a written table of a few rows.

    One aggregation: a value of a column holds the least and largest hash of each other column's values beside it, numbers of fixed size that are added up before anything moves, so
    combinations of values are never rows. Hashes of unequal values differ: that is counted for each column's values, and where it fails other hashes are taken.
    """
    texts = [F.col(c).cast("string").alias(f"v{i}") for i, c in enumerate(columns)]
    each = F.array(*(F.struct(F.lit(c).alias("child"), F.col(f"v{i}").alias("v")) for i, c in enumerate(columns)))
    for seed in count():
        of = lambda v: F.when(v.isNotNull(), F.xxhash64(F.lit(seed), v))  # noqa: B023, E731
        hashes = [of(F.col(f"v{i}")).alias(f"h{i}") for i in range(len(columns))]
        rows = df.select(*texts).select(*hashes, F.explode(each).alias("e")).select("e.child", "e.v", *(f"h{i}" for i in range(len(columns)))).where("v is not null")
        by_value = rows.groupBy("child", "v").agg(*(f(f"h{i}").alias(f"{n}{i}") for i in range(len(columns)) for n, f in (("a", F.min), ("b", F.max))))
        met = [m for i in range(len(columns)) for m in (F.count_if(F.col(f"a{i}") != F.col(f"b{i}")).alias(f"bad{i}"), F.count(f"a{i}").alias(f"met{i}"))]
        by_hash = by_value.groupBy("child", of(F.col("v")).alias("h")).agg(F.count("*").alias("n"), *met)
        totals = [F.sum(f"{k}{i}").alias(f"{k}{i}") for i in range(len(columns)) for k in ("bad", "met")]
        by_column = written(by_hash.groupBy("child").agg(F.sum("n").alias("n"), F.count("*").alias("n_hashes"), *totals), "dependencies")  # a row a column
        if by_column.where("n <> n_hashes").isEmpty():
            break
    pairs = F.array(*(F.struct(F.lit(c).alias("parent"), F.col(f"bad{i}").alias("bad"), F.col(f"met{i}").alias("met")) for i, c in enumerate(columns)))
    found = by_column.select("child", F.col("n").alias("nc"), F.explode(pairs).alias("p")).select("child", "nc", "p.*").where("bad = 0 and met > 0 and child <> parent")
    return written(found.join(F.broadcast(by_column.select(F.col("child").alias("parent"), F.col("n").alias("np"))), "parent").where("np < nc").select("child", "parent"), "relations")


def hierarchies_of(df: DataFrame, runs: Mapping[str, Sequence[str]]) -> DataFrame:
    """run, child, parent: hierarchy_of() the columns of each run, from one pass over df."""
    held = relations(df, sorted({c for columns in runs.values() for c in columns}))
    parts = [reduced(held.where(F.col("child").isin(*columns) & F.col("parent").isin(*columns))).select(F.lit(run).alias("run"), "child", "parent") for run, columns in runs.items()]
    return written(reduce(DataFrame.unionByName, parts), "hierarchies")


def hierarchy_of(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """child, parent: dependencies without violations where the parent has fewer values, less those with a column between."""
    return hierarchies_of(df, {"": columns}).select("child", "parent")


def infer_schema(tables: Mapping[str, DataFrame]) -> dict:
    """What each table and column is for, whatever the names: the fact table (largest with a date), keys (integers unique in a smaller table), target (numeric non-key of most values), roles.

    Profiles are small; the rules run on the driver.
    """
    profiles = {t: {r["column"]: r.asDict() for r in columns_profile(df).collect()} for t, df in tables.items()}
    sizes = {t: max((c["n"] for c in p.values()), default=0) for t, p in profiles.items()}
    dates = {t: [c for c, r in p.items() if (r["dates"] or 0) >= DATE_SHARE and (r["numbers"] or 0) < DATE_SHARE] for t, p in profiles.items()}
    dated = [t for t in tables if dates[t]] or list(tables)
    fact = max(dated, key=lambda t: (sizes[t], t))
    whole = lambda r: (r["numbers"] or 0) >= DATE_SHARE and not r["fractional"] and not r["negative"]
    keys = {t: [c for c, r in p.items() if whole(r) and r["n_unique"] == sizes[t] and sizes[t] < sizes[fact]] for t, p in profiles.items()}
    key_like = {r["n_unique"] for t in keys for c in keys[t] for r in [profiles[t][c]]}
    measures = [c for c, r in profiles[fact].items() if (r["numbers"] or 0) >= DATE_SHARE and c not in dates[fact] and not (whole(r) and r["n_unique"] in key_like)]
    target = max(measures, key=lambda c: (profiles[fact][c]["n_unique"], c), default=None)
    role = lambda t, c: "date" if c in dates[t] else "key" if c in keys[t] else "target" if (t, c) == (fact, target) else "measure" if (profiles[t][c]["numbers"] or 0) >= DATE_SHARE else "category"
    return {"fact": fact, "target": target, "date": (dates[fact] or [None])[0], "keys": keys, "roles": {t: {c: role(t, c) for c in p} for t, p in profiles.items()}}


def flags(df: DataFrame, target: str) -> DataFrame:
    """zero_inflated, fractional, negative of a target, and its bin path."""
    x = F.col(target)
    whole = F.bool_and(x % 1 == 0)
    g = df.agg(F.avg((x == 0).cast("int")).alias("zero"), F.avg((x % 1 != 0).cast("int")).alias("f"), F.avg((x < 0).cast("int")).alias("neg"), whole.alias("whole"), F.percentile(x, 0.99).alias("q99"))
    return g.select((F.col("zero") > ZERO_INFLATED).alias("zero_inflated"), (F.col("f") > 0).alias("fractional"), (F.col("neg") > 0).alias("negative"), F.when(F.col("whole") & (F.col("q99") < 21), "integer").otherwise("quantile").alias("bin_path"))


def edge_scores(found: DataFrame, truth: DataFrame) -> DataFrame:
    """tp, n_found, n_true, precision, recall, f1 of two sets of (child, parent)."""
    tp = found.distinct().join(truth.distinct(), ["child", "parent"], "left_semi").agg(F.count("*").alias("tp"))
    out = tp.crossJoin(found.distinct().agg(F.count("*").alias("n_found"))).crossJoin(truth.distinct().agg(F.count("*").alias("n_true")))  # one row each
    p, r = F.try_divide("tp", "n_found"), F.try_divide("tp", "n_true")
    return out.select("*", p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))


def to_panel(fact: DataFrame, item: str, store: str, date: str, target: str, item_dim: DataFrame | None = None, store_dim: DataFrame | None = None, clip: bool = True) -> tuple[DataFrame, list[str]]:
    """A panel-shaped table of any fact table with roles found, and the edits made on the way."""
    edits = []
    day = F.to_date(date)
    x = F.coalesce(F.col(target).try_cast("double"), F.lit(0.0))
    if clip:
        edits.append("negative targets count as 0")
        x = F.greatest(x, F.lit(0.0))
    out = fact.where(day.isNotNull()).groupBy(F.col(item).cast("string").alias("item_id"), F.col(store).cast("string").alias("store_id"), day.alias("date")).agg(F.sum(x).alias("sales"))
    edits.append("rows of one item, store and day are added up")
    for dim, key in ((item_dim, "item_id"), (store_dim, "store_id")):
        if dim is not None:
            out = out.join(dim, key, "left")
            edits.append(f"attributes joined by {key}")
    return out.withColumn("id", F.concat_ws("_", "item_id", "store_id")), edits
