"""The slice hierarchy: items under departments under categories, stores under states."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.written import written

PARENT_OF: Mapping[str, str] = {"item_id": "dept_id", "dept_id": "cat_id", "store_id": "state_id"}


def edges(panel: DataFrame, parent_of: Mapping[str, str] = PARENT_OF) -> DataFrame:
    """child_col, child_val, parent_col, parent_val: distinct pairs of all levels from one pass.

    Pairs are told apart level by level, map-side: distinct rows of all columns would be as many as items times stores.
    """
    level = lambda c, p: F.struct(F.lit(c).alias("child_col"), F.col(c).cast("string").alias("child_val"), F.lit(p).alias("parent_col"), F.col(p).cast("string").alias("parent_val"))
    each = panel.select(*(level(c, p).alias(f"level_{c}") for c, p in parent_of.items())).unpivot([], [f"level_{c}" for c in parent_of], "level", "e")
    return each.select("e.*").where("child_val is not null and parent_val is not null").distinct()


def violations(found: DataFrame) -> DataFrame:
    """Children with more than one parent: child_col, child_val, n_parents."""
    return found.groupBy("child_col", "child_val").agg(F.count_distinct("parent_val").alias("n_parents")).where("n_parents > 1")


def validated(panel: DataFrame, parent_of: Mapping[str, str] = PARENT_OF) -> DataFrame:
    """edges(), or a ValueError that names a child with two parents."""
    found = edges(panel, parent_of)
    bad = violations(found).orderBy("child_col", "child_val").first()
    if bad:
        raise ValueError(f"{bad['child_col']}={bad['child_val']} has {bad['n_parents']} parents")
    return found


def closure(found: DataFrame, depth: int = 3) -> DataFrame:
    """col, val, ancestor_col, ancestor_val, depth: every ancestor, by at most depth - 1 self joins of the edges, which are computed once."""
    found = written(found, "hierarchy-edges", few=False)
    up = found.select(F.col("child_col").alias("ancestor_col"), F.col("child_val").alias("ancestor_val"), F.col("parent_col").alias("_c"), F.col("parent_val").alias("_v"))
    level = found.select(F.col("child_col").alias("col"), F.col("child_val").alias("val"), F.col("parent_col").alias("ancestor_col"), F.col("parent_val").alias("ancestor_val"), F.lit(1).alias("depth"))
    out = level
    for k in range(2, depth + 1):
        level = level.join(up, ["ancestor_col", "ancestor_val"]).select("col", "val", F.col("_c").alias("ancestor_col"), F.col("_v").alias("ancestor_val"), F.lit(k).alias("depth"))
        out = out.unionByName(level)
    return out


def related(pairs: DataFrame, ancestors: DataFrame) -> DataFrame:
    """pairs (col_a, val_a, col_b, val_b) with `related`: equal, or one an ancestor of the other."""
    x = ancestors.select("col", "val", "ancestor_col", "ancestor_val").distinct()
    down = x.toDF("col_a", "val_a", "col_b", "val_b").withColumn("_down", F.lit(True))
    rise = x.toDF("col_b", "val_b", "col_a", "val_a").withColumn("_up", F.lit(True))
    keys = ["col_a", "val_a", "col_b", "val_b"]
    joined = pairs.join(down, keys, "left").join(rise, keys, "left")
    same = (F.col("col_a") == F.col("col_b")) & (F.col("val_a") == F.col("val_b"))
    return joined.select(*keys, (same | F.col("_down").isNotNull() | F.col("_up").isNotNull()).alias("related"))


def related_pairs(slices: DataFrame, ancestors: DataFrame) -> DataFrame:
    """col_a, val_a, col_b, val_b of all pairs of the given slices (slice_col, slice_val) that are equal, or one an ancestor of the other: by the ancestors, not by trying all pairs."""
    names = ["col_a", "val_a", "col_b", "val_b"]
    up = ancestors.select("col", "val", "ancestor_col", "ancestor_val").distinct()
    each = slices.select("slice_col", "slice_val").distinct()
    pairs = up.toDF(*names).unionByName(up.toDF("col_b", "val_b", "col_a", "val_a")).unionByName(each.select("slice_col", "slice_val", "slice_col", "slice_val").toDF(*names))
    return pairs.join(each.toDF("col_a", "val_a"), ["col_a", "val_a"], "left_semi").join(each.toDF("col_b", "val_b"), ["col_b", "val_b"], "left_semi").select(*names)


def dependencies(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """determinant, dependent, n_violations for each pair of columns: values of the one that go with several of the other. One pass over the distinct rows."""
    names = sorted({c for p in pairs for c in p})
    each = F.array(*(F.struct(F.lit(a).alias("determinant"), F.lit(b).alias("dependent"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")) for a, b in pairs))
    rows = df.select(*names).distinct().select(F.explode(each).alias("p")).select("p.*").where("a is not null and b is not null").distinct()
    return rows.groupBy("determinant", "dependent", "a").agg(F.count("*").alias("n")).groupBy("determinant", "dependent").agg(F.count_if(F.col("n") > 1).alias("n_violations"))


def reduced(relations: DataFrame) -> DataFrame:
    """Relations (child, parent) without those that another column lies between: the transitive reduction of a two-step order."""
    mid = relations.select(F.col("child").alias("c"), F.col("parent").alias("m")).join(relations.select(F.col("child").alias("m"), F.col("parent").alias("p")), "m").where("c <> m and m <> p")
    return relations.join(mid.select(F.col("c").alias("child"), F.col("p").alias("parent")).distinct(), ["child", "parent"], "left_anti")


def first_parent(found: DataFrame) -> DataFrame:
    """One parent a child, the smallest, for data that breaks the rule."""
    w = Window.partitionBy("child_col", "child_val").orderBy("parent_val")
    return found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
