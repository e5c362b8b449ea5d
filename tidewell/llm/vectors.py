"""What the vector searches share: which rows take part, query blocks dealt to every shard, and the merge of the shards' best."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import spool, tidied

#: Rows of a shard, about: as many as give MOST_SHARDS shards, within bounds; queries of a block. A task holds one shard at a time and streams the blocks past it.
SHARD_ROWS, LARGEST_SHARD, MOST_SHARDS, BLOCK_QUERIES = 1536, 250_000, 4096, 256


def usable(df: DataFrame, id_col: str, vector_col: str, allow_zero: bool) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part: no null id or vector, as many components as most rows have, none null, NaN or infinite, and not all zero unless allowed."""
    v = F.col(vector_col).cast("array<double>")
    rows = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.where((F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    if not allow_zero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    return rows


def dimension(rows: DataFrame) -> int:
    """The commonest number of components (the smaller of equally common ones); 0 of an empty table."""
    found = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return found["d"] if found else 0


def matrix(column: pa.ListArray) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def query_blocks(queries: DataFrame, shards: int) -> DataFrame:
    """(shard, ids, data): each block of BLOCK_QUERIES queries once for every shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, v = batch.column(0).to_numpy(), matrix(batch.column(1))
            at = range(0, len(ids), BLOCK_QUERIES)
            yield pa.RecordBatch.from_arrays([pa.array([ids[i : i + BLOCK_QUERIES].tobytes() for i in at], type=pa.binary()), pa.array([v[i : i + BLOCK_QUERIES].tobytes() for i in at], type=pa.binary())], names=["ids", "data"])

    blocks = queries.mapInArrow(tidied(run), "ids binary, data binary")
    return blocks.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "ids", "data")


def sharded_search(data: DataFrame, queries: DataFrame, shards: int, k: int, build: Callable[[np.ndarray, np.ndarray], object], score: str = "double") -> DataFrame:
    """(query_id, rank, vec_id, score double, or long): the best k of all shards. data: (shard int, vec_id, v); queries: (vec_id, v).

    build(ids, vectors) makes a shard's index, whose search(query ids, query vectors, k) gives arrays (ids, scores), k or fewer a
    query by falling score then id, padded with id -1. Every query is held against every shard, in blocks; a shard's best of a query are a row.
    """

    kind = np.int64 if score == "long" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, vectors, index = None, [], [], None

        def parts():
            for whole in batches:
                at = whole.column(0).to_numpy()
                cut = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
                for a, b in zip(cut, cut[1:], strict=False):
                    if b > a:
                        yield int(at[a]), whole.slice(a, b - a)

        for now, part in parts():
            if now != shard:
                shard, ids, vectors, index = now, [], [], None
            is_data = part.column(1).is_valid().to_numpy(zero_copy_only=False)
            if is_data.any():
                own = part.filter(pa.array(is_data))
                ids.append(own.column(1).to_numpy())
                vectors.append(matrix(own.column(2)))
            rest = part.filter(pa.array(~is_data))
            if not rest.num_rows or not ids:
                continue
            if index is None:
                index = build(np.concatenate(ids), np.concatenate(vectors))
            for q, d in zip(rest.column(3).to_pylist(), rest.column(4).to_pylist(), strict=True):
                q = np.frombuffer(q, dtype=np.int64)
                found, value = index.search(q, np.frombuffer(d, dtype=np.float64).reshape(len(q), -1), k)
                size = (found >= 0).sum(axis=1)
                ends = pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32))
                keep = found >= 0
                lists = (pa.ListArray.from_arrays(ends, pa.array(x)) for x in (found[keep], value[keep].astype(kind)))
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.full(len(q), shard, dtype=np.int32)), *lists], names=["query_id", "shard", "ids", "scores"])

    none = F.lit(None)
    rows = data.select("shard", "vec_id", "v", none.cast("binary").alias("ids"), none.cast("binary").alias("data"))
    rows = rows.unionByName(query_blocks(queries, shards).select("shard", none.cast("long").alias("vec_id"), none.cast("array<double>").alias("v"), "ids", "data"))
    dealt = rows.repartition(max(shards, 1), "shard").sortWithinPartitions("shard", F.col("vec_id").isNull(), "vec_id")
    best = dealt.mapInArrow(tidied(run), f"query_id long, shard int, ids array<long>, scores array<{score}>")
    best = best.select("query_id", "shard", F.arrays_zip((F.transform("scores", lambda s: -s)).alias("least"), F.col("ids").alias("vec_id")).alias("found"))
    width = shards
    while True:  # a merge takes in 64 shards of a query at most
        width = -(-width // 64)
        group = F.floor(F.col("shard") / 64).cast("int").alias("shard")
        best = best.groupBy("query_id", group).agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("found"))
        if width <= 1:
            break
    ranked = best.select("query_id", F.posexplode("found").alias("at", "f"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), (-F.col("f.least")).alias("score"))


class Best:
    """The k best (score, id) so far of each query of a block: higher scores first, ties to smaller ids; a query's own id is left out."""

    def __init__(self, query_ids: np.ndarray, k: int, floor: np.ndarray | None = None):
        n = len(query_ids)
        self.own, self.k = query_ids, k
        self.score = np.full((n, k), -np.inf)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.row = np.full((n, k), -1, dtype=np.int64)
        self.floor = np.full(n, -np.inf) if floor is None else floor
        self.compared = 0

    def kth(self) -> np.ndarray:
        """Scores below this can't enter."""
        return np.maximum(self.score[:, -1], self.floor)

    def add(self, q: np.ndarray, ids: np.ndarray, rows: np.ndarray, scores: np.ndarray) -> None:
        """scores: of queries q (indices) with data rows `rows` of ids `ids`."""
        self.compared += scores.size
        scores = np.where(ids[None, :] == self.own[q][:, None], -np.inf, scores)
        on = np.flatnonzero(scores.max(axis=1, initial=-np.inf) >= self.kth()[q])
        if not len(on):
            return
        q, scores = q[on], scores[on]
        if scores.shape[1] > 2 * self.k:  # all that can enter, ties included
            bar = np.partition(scores, -self.k, axis=1)[:, -self.k]
            most = int((scores >= bar[:, None]).sum(axis=1).max())
            pick = np.argpartition(-scores, most - 1, axis=1)[:, :most] if most < scores.shape[1] else np.broadcast_to(np.arange(most), scores.shape)
        else:
            pick = np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
        s = np.concatenate((self.score[q], np.take_along_axis(scores, pick, axis=1)), axis=1)
        i = np.concatenate((self.id[q], ids[pick]), axis=1)
        r = np.concatenate((self.row[q], rows[pick]), axis=1)
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score[q], self.id[q], self.row[q] = (np.take_along_axis(x, order, axis=1) for x in (s, i, r))

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        return np.where(np.isfinite(self.score), self.id, -1), self.score


def shard_rows(n: int) -> int:
    return min(max(SHARD_ROWS, n // MOST_SHARDS), LARGEST_SHARD)


def shard_count(n: int) -> int:
    return max(1, -(-n // shard_rows(n)))


def spooled(rows: DataFrame) -> tuple[DataFrame, int]:
    """rows of the commonest dimension, written out, and their number."""
    d = dimension(rows)
    kept = spool(rows.where(F.size("v") == d), "vectors")
    return kept, kept.count()


