"""Result files that are only added to: CSV or JSON lines in batches, a batch counting once its commit is written, and every key once however often an append is repeated."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .written import written

#: Where the commits are kept, under the log's path, and a batch's column.
COMMITS, BATCH = "_commits", "_batch"


@dataclass(frozen=True)
class ResultLog:
    """Batches of rows under a path of any file system that Spark writes to. schema: DDL of the rows; keys: the columns that name a row; kind: csv (with a header) or json.

    A batch is a folder that Spark fills, and then a line in the commits: a reader sees committed batches only, so what a killed append left behind is never read. One writer at a time.
    """

    spark: SparkSession
    path: str
    schema: str
    keys: tuple[str, ...]
    kind: str = "csv"

    def batches(self) -> list[tuple[int, str]]:
        """(number, folder) of the committed batches in order: a row an append."""
        try:
            rows = self.spark.read.schema("number long, folder string").json(f"{self.path}/{COMMITS}").collect()
        except AnalysisException:
            return []
        return sorted((r["number"], r["folder"]) for r in rows)

    def _read(self, folders: Sequence[str]) -> DataFrame:
        reader = self.spark.read.schema(self.schema)
        if self.kind == "csv":  # an empty text is kept apart from null; texts may hold line ends
            reader = reader.option("header", True).option("nullValue", "").option("emptyValue", '""').option("multiLine", True).option("escape", '"')
        paths = [f"{self.path}/{f}" for f in folders]
        return getattr(reader, self.kind)(paths)

    def read(self, columns: Sequence[str] | None = None, where: str | None = None) -> DataFrame:
        """The rows of all committed batches; the choice of columns and the filter reach the scan. Without any the table is empty."""
        found = [f for _, f in self.batches()]
        df = self._read(found) if found else self.spark.createDataFrame([], StructType.fromDDL(self.schema))
        df = df.where(where) if where else df
        return df.select(*columns) if columns else df

    def latest(self) -> DataFrame:
        """Of each key the row of the last batch that has it: the last write wins (with add(..., again=True)). Keys may be null."""
        parts = [self._read([f]).withColumn(BATCH, F.lit(n)) for n, f in self.batches()]
        if not parts:
            return self.read()
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        w = Window.partitionBy(*self.keys).orderBy(F.desc(BATCH))
        return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", BATCH)

    def add(self, df: DataFrame, again: bool = False) -> int:
        """Append the rows of df whose keys are not there yet (again: all of them), and return how many. Of rows of df with equal keys one is taken; other columns than the schema's are left out."""
        names = StructType.fromDDL(self.schema).names
        rows = df.select(*names).dropDuplicates(list(self.keys))
        done = self.batches()
        if done and not again:
            there = self.read(self.keys).distinct().select(F.struct(*self.keys).alias("_key"))
            rows = rows.withColumn("_key", F.struct(*self.keys)).join(there, "_key", "left_anti").drop("_key")  # a struct: null keys are equal
        rows = written(rows, "pending", few=False)  # read twice: counted, and written out
        n = rows.count()
        if not n:
            return 0
        folder = f"batch-{len(done):06d}-{uuid.uuid4().hex}"
        self._write(rows, folder)
        self._commit(done[-1][0] + 1 if done else 0, folder)
        return n

    def _write(self, rows: DataFrame, folder: str) -> None:
        writer = rows.write
        if self.kind == "csv":
            writer = writer.option("header", True).option("nullValue", "").option("emptyValue", '""').option("escape", '"')
        getattr(writer, self.kind)(f"{self.path}/{folder}")

    def _commit(self, number: int, folder: str) -> None:
        self.spark.createDataFrame([(number, folder)], "number long, folder string").coalesce(1).write.mode("append").json(f"{self.path}/{COMMITS}")


def scan_csv(spark: SparkSession, path: str, schema: str | None = None, columns: Sequence[str] | None = None, date: str | None = None, start: str | None = None, end: str | None = None, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """CSV files with a header: columns, and rows whose `date` lies within start and end (both in it), of a given schema, or of one that a pass over the values finds.

    Spark splits the files among tasks; only the chosen columns are parsed into rows, and the filter is pushed to the scan where the date's type is known. A date that is no date is null, and out.
    """
    reader = spark.read.option("header", True).option("dateFormat", date_format).option("escape", '"')
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    if date:
        if df.schema[date].dataType.typeName() == "string":
            df = df.withColumn(date, F.try_to_timestamp(date, F.lit(date_format)).cast("date"))
        df = df.where(F.col(date).isNotNull())
        df = df.where(F.col(date) >= F.lit(start).cast("date")) if start else df
        df = df.where(F.col(date) <= F.lit(end).cast("date")) if end else df
    return df.select(*columns) if columns else df
