"""What the operators share: the shared folder, written intermediate tables, reading, and Arrow batches of texts."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of a kernel handles at once (a longer document is handled alone).
CHUNK_BYTES = 1 << 20
#: Rows of an Arrow batch of texts, and its bytes (a longer row is a batch).
ARROW_ROWS, ARROW_BYTES = 1000, "4m"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset and Spark runs in one process (tests) one under /tmp."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        found = "file://" + tempfile.mkdtemp(prefix="tidewell-", dir="/tmp/checkpoints")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir() or found
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def spool(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there and survives lost executors.

    small: its rows are short, so a file takes in four partitions; thousands of little files cost more than they hold.
    """
    path = fresh_path(df.sparkSession, name)
    (df.coalesce(max(1, partitions(df.sparkSession) // 4)) if small else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spool_counted(df: DataFrame, name: str, *metrics: Column, small: bool = False) -> tuple[DataFrame, dict]:
    """spool(), and aggregates over its rows, observed while they are written rather than in a job of their own."""
    seen = Observation()
    return spool(df.observe(seen, F.count(F.lit(1)).alias("rows"), *metrics), name, small), seen.get


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package() -> None:
    """Make the package importable in Python workers that start elsewhere than the driver: a zip of its sources, once a context.

    Not done where PYTHONPATH, which workers inherit, already leads to it.
    """
    context = SparkContext._active_spark_context
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if context is None or getattr(context, "_tidewell_shipped", False):
        return
    if root not in map(os.path.abspath, filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))):
        package = os.path.join(root, "tidewell")
        if not os.path.isdir(package):
            return  # it is itself in an archive, so was shipped already
        path = os.path.join(tempfile.mkdtemp(prefix="tidewell-"), "tidewell_package.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(package):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, root))
        context.addPyFile(path)
    context._tidewell_shipped = True


def tidied(kernel: Callable) -> Callable:
    """The kernel of a mapInArrow, which at its end hands memory back: workers outlive their tasks, and what each holds adds up beside the JVM."""
    ship_package()

    @functools.wraps(kernel)
    def run(batches):
        try:
            yield from kernel(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
                ctypes.CDLL(None).malloc_trim(0)

    return run


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: Iterable[str] = ()) -> DataFrame:
    """Only the columns that are needed, as (id, text bytes, extra...): bytes reach Python without a decode.

    Sets the session's Arrow batches to ARROW_ROWS rows and ARROW_BYTES, since the default ten thousand long texts don't fit a worker.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), *extra)


def others(docs: DataFrame, text_col: str = "text") -> Column:
    """A struct `row` of the columns but the text, so that no name clashes with what an operator adds; with a flag first, so that it is never empty."""
    return F.struct(F.lit(True).alias("_"), *(F.col(c) for c in docs.columns if c != text_col)).alias("row")


def as_before(df: DataFrame, columns: list[str], text_col: str = "text") -> DataFrame:
    """The columns of docs again from `text` and `row`."""
    return df.select(*(F.col("text").cast("string").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in columns))


#: Most bits of the map by which without_ids() tells most rows apart: at most 8192 rows of 4 KB.
MAP_BITS = 1 << 28


def without_ids(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without the rows whose id is in gone (id_col, distinct). Rows with a null id stay.

    Few ids are gone as a rule, and rows carry texts: a map of the gone ids' hashes (16 bits an id, 32 MB at most) is sent to the scan, and only
    rows that it marks, rightly or not, are moved for the join that decides. gone is read three times, so it should be a written table.
    """
    size = min(MAP_BITS, max(1 << 6, 1 << (16 * gone.count()).bit_length()))
    at = F.xxhash64(F.col(id_col).cast("long")).bitwiseAND(F.lit(size - 1))
    maps = gone.select(at.alias("_h")).groupBy(F.bitmap_bucket_number("_h").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_h")).alias("_bits"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("_id"), F.bitmap_bucket_number(at).alias("_bucket"), F.bitmap_bit_position(at).cast("int").alias("_bit"))
    marked = rows.join(F.broadcast(maps), "_bucket", "left")
    byte = F.conv(F.hex(F.col("_bits").substr((F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce((F.col("_id").isNotNull()) & (F.getbit(byte, F.col("_bit") % 8) == 1), F.lit(False))
    marked = marked.select("row", "_id", hit.alias("_hit"))
    moved = marked.where("_hit").join(gone.select(F.col(id_col).cast("long").alias("_id")), "_id", "left_anti")
    return marked.where("not _hit").select("row.*").unionByName(moved.select("row.*"))


def text_chunks(batches: Iterable[pa.RecordBatch], limit: int = CHUNK_BYTES, rows: int = 2048) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with at most `limit` bytes of text and `rows` rows, and their texts (null: empty)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("text"))
        sizes = [0 if n is None else n for n in pa.compute.binary_length(column).to_pylist()]
        start = held = 0
        for i, n in enumerate([*sizes, None]):
            if n is None or (i > start and (held + n > limit or i - start >= rows)):
                if i > start:
                    part = batch.slice(start, i - start)
                    yield part, [t or b"" for t in part.column(batch.schema.get_field_index("text")).to_pylist()]
                start, held = i, 0
            held += n or 0


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
