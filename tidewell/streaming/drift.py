"""Structured Streaming forms of the windowed operators: tumbling and sliding counts, late and repeated events, sessions, and drift between neighbouring windows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.divergence import divergences


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Parquet files as a stream, with the schema of those there; times without a zone are taken in the session's, as event times need one."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(_as_pattern(path))
    return stream.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def _as_pattern(path: str) -> str:
    """A pattern that only path matches: a stream takes a plain path for a folder, a pattern also for a file."""
    folder, _, name = path.rpartition("/")
    return f"{folder}/[{name[0]}]{name[1:]}"


def window_counts(events: DataFrame, ts: str, by: str, length: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """start, by, n, total of event-time windows; state is dropped once the watermark passes."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return events.withWatermark(ts, late).groupBy(w, by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, ts: str, by: str, gap: str, late: str = "1 day") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), "n")


def without_repeats(events: DataFrame, keys: list[str], ts: str, late: str = "1 day") -> DataFrame:
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def run_to_table(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Everything available through the stream into a Parquet table of its own, exactly once by its checkpoint; and the table."""
    base = f"{folder}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/out")


def neighbour_drift(counts: DataFrame, by: str) -> DataFrame:
    """start, js, l_inf of each window against the one before it, from window_counts: the rolling reference."""
    starts = counts.select("start").distinct().withColumn("before", F.lag("start").over(Window.orderBy("start"))).where("before is not null")  # a row a window
    pairs = starts.select(F.explode(F.array(F.struct(F.col("start").alias("at"), F.col("start").alias("of"), F.lit(False).alias("old")), F.struct(F.col("start").alias("at"), F.col("before").alias("of"), F.lit(True).alias("old")))).alias("p")).select("p.*")
    rows = counts.join(pairs, counts.start == pairs.of).groupBy("at", by).agg(F.sum(F.when(F.col("old"), F.col("n")).otherwise(0)).alias("n_ref"), F.sum(F.when(~F.col("old"), F.col("n")).otherwise(0)).alias("n_cur"))
    return divergences(rows, ["at"]).select(F.col("at").alias("start"), "js", "l_inf")
