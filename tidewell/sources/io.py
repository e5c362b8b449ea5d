"""Files in and out: typed CSV, JSON, append-only results with resume, caches, a guarded catalogue, obscured copies."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ranges import positions


def read_csv(spark: SparkSession, path: str, schema: str, columns: Sequence[str] | None = None, where: str | None = None) -> DataFrame:
    """A CSV with a header and a given schema (no inference pass); column choice and filter reach the scan."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    df = df.where(where) if where else df
    return df.select(*columns) if columns else df


def last_date(df: DataFrame, date: str = "date") -> DataFrame:
    return df.agg(F.max(F.to_date(date)).alias("last_date"))


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path).schema
        return True
    except AnalysisException:
        return False


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at path; built and written there first if it isn't."""
    if not exists(spark, path):
        build().write.parquet(path)
    return spark.read.parquet(path)


def first_available(spark: SparkSession, sources: Iterable[tuple[str, Callable[[str], DataFrame]]], fallback: Callable[[], DataFrame]) -> tuple[DataFrame, str]:
    """The first source whose path can be read, else the generator; and its name."""
    for path, load in sources:
        try:
            return load(path), path
        except AnalysisException:
            continue
    return fallback(), "generated"


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def pending(todo: DataFrame, spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The rows of todo whose keys aren't in the results at path."""
    if not exists(spark, path):
        return todo
    return todo.join(spark.read.parquet(path).select(*keys), list(keys), "left_anti")


def last_per_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Of rows with equal keys the one with the largest order: the last written wins."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def read_json(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_config(path: str) -> dict:
    with open(path) as f:
        return json.load(f)


def unpivot_days(df: DataFrame, ids: Sequence[str], prefix: str = "d_") -> DataFrame:
    """A wide table with a column a day as rows (ids, d, sales)."""
    return df.unpivot(list(ids), [c for c in df.columns if c.startswith(prefix)], "d", "sales")


class Catalogue:
    """The tables of one directory by file name: no paths, no links out of it."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.root = spark, os.path.realpath(directory)

    def files(self) -> list[str]:
        return sorted(f for f in os.listdir(self.root) if f.endswith((".csv", ".parquet")))

    def table(self, name: str) -> DataFrame:
        path = os.path.realpath(os.path.join(self.root, name))
        if os.path.basename(name) != name or os.path.dirname(path) != self.root or name not in self.files():
            raise ValueError(f"no such file: {name!r}")
        return self.spark.read.parquet(path) if name.endswith(".parquet") else self.spark.read.option("header", True).csv(path)

    def head(self, name: str, n: int = 5) -> DataFrame:
        df = self.table(name)
        return df.orderBy(*df.columns).limit(min(n, 20))


def obscured(df: DataFrame, columns: Sequence[str], names: dict[str, str] | None = None, prefix: str = "v") -> tuple[DataFrame, DataFrame]:
    """df with the values of columns replaced by codes and columns renamed, and the code table (column, value, code)."""
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))
    values = df.select(F.explode(each).alias("e")).select("e.*").where("value is not null").distinct()
    codes = positions(values, "column", "value", "codes").select("column", "value", F.concat(F.lit(prefix), F.col("position").cast("string")).alias("code"))
    out = df
    for c in columns:
        out = out.join(codes.where(F.col("column") == c).select(F.col("value").alias(c), F.col("code").alias(f"_{c}")), c, "left").drop(c).withColumnRenamed(f"_{c}", c)
    out = out.select(*df.columns)
    return (out.withColumnsRenamed(names) if names else out), codes


def markdown_table(df: DataFrame) -> str:
    """A small result as Markdown."""
    rows = df.collect()
    head = f"| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}"
    return "\n".join([head, *(f"| {' | '.join('' if v is None else str(v) for v in r)} |" for r in rows)])
