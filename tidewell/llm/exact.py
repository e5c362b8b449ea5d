"""Exact duplicates by tree-merging sorted runs of digests, in DataFrame operations only.

Every input partition is a run: its documents' digests, a row a digest, sorted. Runs meet in binomial rounds. There are fan ** rounds places, and a
run's number and a digest's slice are both numbers of so many digits to the base fan. Before round r, a place holds the digests whose
slice agrees with its own number in the lowest r digits, from the runs that agree with it in the others; in the round it exchanges rows with the fan - 1 places
that differ from it in digit r alone, and merges what it then has of a digest into one row. After the last round a place has all rows of its own slice of the digests,
and no place has ever had more than fan rows of a digest in a round, however many copies there are. The answers go back by the same steps.

Of a digest in a run the row keeps the best identifier (below) and the number of documents, merged by min and sum. min of a struct is a sort-based aggregate
in Spark: each side of an exchange sorts by (place, digest) and merges neighbours, so runs stay sorted at every level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import partitions, spool, table

#: Runs that a merge takes in, at most.
FAN = 8
#: Fixed value: characters that don't count.
SPACES = r"[\x20\x09-\x0D]"
KEYS = ["at", "digest", "check"]


def digests(docs: DataFrame, places: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(run, row, doc_id, best, digest, check), written. digest: SHA-256 of the text without SPACES; check: a second hash of it and of its length, so that
    rows are only taken for equal where digest, length and check agree. best: the smallest one stays (most code points, then a known id, then the smallest id).
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumns({"plain": F.regexp_replace("text", SPACES, ""), "row": F.monotonically_increasing_id()})
    best = F.struct((-F.length("text")).alias("points"), F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")
    run = F.pmod(F.spark_partition_id(), F.lit(places)).cast("int")
    return spool(given.select(run.alias("run"), "row", "doc_id", best.alias("best"), F.unhex(F.sha2("plain", 256)).alias("digest"), F.xxhash64("plain", F.octet_length("plain")).alias("check")), "digests")


def after_round(places: int, width: int) -> Column:
    """The place of a row of place `at` after the round of the digit before width (a power of the fan)."""
    slice_ = F.pmod(F.xxhash64("digest"), F.lit(places)).cast("int")
    return (slice_ % width + F.floor(F.col("at") / width) * width).cast("int")


def exact_duplicates(docs: DataFrame, fan: int = FAN, runs: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): a row for every row of docs.

    Texts are equal when they are so without white space (SPACES); a null text is an empty one, and all texts of white space alone are equal. Of equal ones that with
    the most code points as given stays, then that with the smallest id; a row without an id stays only among such rows (keep_id is null then). Rows that repeat an id are
    rows of their own, and one row of a group has `kept`. An empty table gives no rows; other columns are not looked at. runs: how many there are at least, by default the session's shuffle partitions.
    """
    least = runs or partitions(docs.sparkSession)
    rounds = 1
    while fan**rounds < least:
        rounds += 1
    while fan > 2 and (fan - 1) ** rounds >= least:
        fan -= 1
    places = fan**rounds

    rows = digests(docs, places, id_col, text_col)
    merged = [F.min("best").alias("best"), F.sum("n").alias("n")]
    level = rows.select(F.col("run").alias("at"), "digest", "check", "best", F.lit(1).cast("long").alias("n")).groupBy(*KEYS).agg(*merged)
    levels = [spool(level, "run-0")]
    for r in range(1, rounds + 1):
        met = levels[-1].withColumn("at", after_round(places, fan**r)).repartitionById(places, F.col("at"))
        levels.append(spool(met.groupBy(*KEYS).agg(*merged), f"run-{r}"))

    answers = levels[-1].where("n > 1").select(*KEYS, "best", F.col("n").alias("group_size"))
    for r in range(rounds, 0, -1):
        asking = levels[r - 1].select("at", "digest", "check", after_round(places, fan**r).alias("_to"))
        answers = asking.join(answers.withColumnRenamed("at", "_to"), ["_to", "digest", "check"]).select(*KEYS, "best", "group_size")
    answers = answers.select(*KEYS, F.col("best").alias("_kept"), "group_size").withColumnRenamed("at", "run")
    told = rows.join(answers, ["run", "digest", "check"], "left")
    alone = F.col("group_size").isNull()
    return told.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("_kept.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("_kept.row") == F.col("row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op12(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST)
"""
