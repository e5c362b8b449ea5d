"""Exact top-k of integer vectors by inner product: a pivot-distance index.

With M the longest norm, one more component sqrt(M^2 - |x|^2) makes all vectors equally long: the largest inner products with q are the
smallest distances from (q, 0). Each vector is keyed by its nearest pivot and its distance from it. Sorted by that key, vectors form annuli:
stretches of one pivot's vectors between distances lo and hi. None of them is nearer to q than max(d(q, p) - hi, lo - d(q, p)). A query
expands the annuli of a shard in the order of these bounds, and stops at the first whose bound rules out a score in its k best.
Pivots are a bounded sample of rows; every row is indexed.
"""

from __future__ import annotations

import math
import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import spool, tidied
from .vectors import Best, matrix, shard_count, shard_rows, sharded_search, spooled, usable

PIVOTS = 64
ANNULUS = 96
#: The largest long, and less its smallest.
MOST = (1 << 63) - 1


class Annuli:
    """A shard's rows sorted by pivot and distance, cut into annuli."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, top: float, seeds: tuple[np.ndarray, np.ndarray]):
        x = vectors
        size = (x * x).sum(axis=1)
        lift = np.sqrt(np.maximum(top - size, 0))
        p_size = (pivots * pivots).sum(axis=1)
        p_lift = np.sqrt(np.maximum(top - p_size, 0))
        d = np.sqrt(np.maximum(size[:, None] + p_size[None, :] - 2 * (x @ pivots.T) + (lift[:, None] - p_lift[None, :]) ** 2, 0))
        home = d.argmin(axis=1)
        far = d[np.arange(len(x)), home]
        order = np.lexsort((ids, far, home))
        self.ids, self.x, self.top, self.pivots, self.seeds = ids[order], x[order], top, pivots, seeds
        home, far = home[order], far[order]
        since = np.arange(len(home)) - np.searchsorted(home, home)
        start = np.flatnonzero(since % ANNULUS == 0)
        self.cut = np.append(start, len(home))
        self.compared = 0  # pairs of a query and a row so far
        self.pivot, self.lo, self.hi = home[start], far[start], far[self.cut[1:] - 1]

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        size = (queries * queries).sum(axis=1)
        dq = np.sqrt(np.maximum(size[:, None] + self.top - 2 * (queries @ self.pivots.T), 0))[:, self.pivot]
        bound = np.maximum(np.maximum(dq - self.hi, self.lo - dq), 0)
        most = (size[:, None] + self.top - bound**2) / 2 + 1e-6 * (1 + self.top)  # no score in the annulus is higher
        # The k-th score among the pivots (rows of the table themselves) is one that the k-th best can't be under.
        seed_ids, seed = self.seeds[0], queries @ self.seeds[1].T
        seed = np.where(seed_ids[None, :] == query_ids[:, None], -np.inf, seed)
        floor = np.partition(seed, -k, axis=1)[:, -k] if len(seed_ids) > k else np.full(len(queries), -np.inf)
        best = Best(query_ids, k, floor)
        order = np.argsort(-most, axis=1, kind="stable")
        active = np.arange(len(queries))
        for turn in range(order.shape[1]):
            at = order[active, turn]
            go = most[active, at] >= best.kth()[active]
            active, at = active[go], at[go]
            if not len(active):
                break
            for a in np.unique(at).tolist():
                q = active[at == a]
                rows = np.arange(self.cut[a], self.cut[a + 1])
                best.add(q, self.ids[rows], rows, queries[q] @ self.x[rows].T)
        self.compared += best.compared
        return best.result()


class Wide:
    """Rows of any size, or for queries of any size: doubles propose, Python's integers decide. Scores beyond a long are held at its limits."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, scale: int):
        self.ids, self.x, self.scale = ids, vectors, scale

    def whole(self, x: np.ndarray) -> list[int]:
        return [math.floor(v * self.scale) if abs(v) < 2.0**53 else int(v) * self.scale for v in x.tolist()]

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        found, score = np.full((len(queries), k), -1), np.zeros((len(queries), k), dtype=np.int64)
        wide = max(np.abs(self.x).max(initial=0), np.abs(queries).max(initial=0)) > 2.0**400  # whose products no double holds
        if not wide:
            x, q = (np.where(np.abs(v) < 2.0**53, np.floor(v * self.scale), v * self.scale) for v in (self.x, queries))
            near = q @ x.T
            error = (x.shape[1] + 4) * 2.0**-52 * np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((x * x).sum(axis=1))[None, :]
        for i, own in enumerate(query_ids.tolist()):
            rows = np.flatnonzero(self.ids != own)
            if not wide and len(rows) > k:
                low = near[i, rows] - error[i, rows]
                rows = rows[near[i, rows] + error[i, rows] >= np.partition(low, -k)[-k]]
            mine = self.whole(queries[i])
            exact = [sum(map(operator.mul, mine, self.whole(self.x[r]))) for r in rows.tolist()]
            held = sorted((-max(-MOST, min(MOST, e)), int(self.ids[r])) for e, r in zip(exact, rows.tolist(), strict=True))[:k]
            found[i, : len(held)], score[i, : len(held)] = [h[1] for h in held], [-h[0] for h in held]
        return found, score


def top_k(df: DataFrame, query_every: int = 20, k: int = 20, scale: int = 64, pivots: int = PIVOTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score long): exactly the k highest inner products of floor(scale * x), for rows whose id is divisible by query_every.

    Vectors that are null, of another length than most, or hold null or non-finite components take no part; zero vectors do. Ties go to smaller
    ids. A pivot with more rows than a shard holds is split over several shards. Rows so long that products could exceed 2 ** 53, the
    integers a double holds exactly, stay out of the index: they are held against every query, and as queries against every row, in
    Python's integers; scores beyond a long are held at its limits and tie there. Repeated ids are each found, none by its own id. An empty table gives no rows.
    """
    given, n = spooled(usable(df, id_col, vector_col, allow_zero=True))
    is_query = F.pmod("vec_id", F.lit(query_every)) == 0
    reach = F.aggregate("v", F.lit(0.0), lambda a, x: a + (F.abs(x) * scale + 1) * (F.abs(x) * scale + 1))
    wide = given.where(reach >= 2.0**53)
    n_wide = wide.count()
    found = _indexed(given.where(reach < 2.0**53) if n_wide else given, n - n_wide, is_query, k, scale, pivots)
    if n_wide:
        index = lambda ids, vectors: Wide(ids, vectors, scale)
        for rows, many, queries in ((given, n, wide.where(is_query)), (wide, n_wide, given.where(is_query & (reach < 2.0**53)))):
            shards = shard_count(many)
            data = rows.select(F.pmod(F.xxhash64("vec_id", F.lit(17)), F.lit(shards)).cast("int").alias("shard"), "vec_id", "v")
            found = found.unionByName(sharded_search(data, queries, shards, k, index, "long"))
        best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("least"), "vec_id"))), 1, k)  # of at most 2 k rows
        found = found.groupBy("query_id").agg(best.alias("found")).select("query_id", F.posexplode("found").alias("at", "f"))
        found = found.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), (-F.col("f.least")).alias("score"))
    return found


def _indexed(given: DataFrame, n: int, is_query: Column, k: int, scale: int, pivots: int) -> DataFrame:
    """top_k of rows whose products are exact in doubles."""
    spark = given.sparkSession
    whole = F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("double"))
    rows = spool(given.select("vec_id", whole.alias("v")), "integers")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    top = rows.agg(F.max(square)).first()[0] or 0.0
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(11)), "vec_id").limit(pivots).collect()  # the pivots: a fixed number
    at = np.array([r["v"] for r in sample], dtype=np.float64) if sample else np.zeros((1, 1))
    seeds = (np.array([r["vec_id"] for r in sample], dtype=np.int64), at)
    p_size = (at * at).sum(axis=1)
    p_lift = np.sqrt(np.maximum(top - p_size, 0))

    def keyed(batches):
        for batch in batches:
            x = matrix(batch.column(1))
            size = (x * x).sum(axis=1)
            d = size[:, None] + p_size[None, :] - 2 * (x @ at.T) + (np.sqrt(np.maximum(top - size, 0))[:, None] - p_lift[None, :]) ** 2
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d.argmin(axis=1).astype(np.int32))], names=["vec_id", "v", "pivot"])

    shards = shard_count(n)
    pinned = rows.mapInArrow(tidied(keyed), "vec_id long, v array<double>, pivot int")
    counts = {r["pivot"]: r["count"] for r in pinned.groupBy("pivot").count().collect()}  # a row a pivot
    # Pivots get as many shards as they fill; small ones share. A place is (first shard, how many).
    place, used = {}, 0.0
    for p in range(max(1, len(sample))):
        need = counts.get(p, 0) / shard_rows(n)
        place[p] = (int(used) % shards, max(1, -(-counts.get(p, 0) // shard_rows(n))))
        used += max(need, 0.0) if need < 1 else place[p][1]
    first, many = (F.array(*(F.lit(place[p][i]) for p in sorted(place))) for i in (0, 1))
    spread = F.pmod(F.xxhash64("vec_id", F.lit(13)), F.element_at(many, F.col("pivot") + 1))
    data = pinned.select(F.pmod(F.element_at(first, F.col("pivot") + 1) + spread, F.lit(shards)).cast("int").alias("shard"), "vec_id", "v")
    return sharded_search(data, rows.where(is_query), shards, k, lambda ids, vectors: Annuli(ids, vectors, at, top, seeds), "long")


def op2(spark, sf_dir: str) -> DataFrame:
    from .shared import table

    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, e.vec_id, CAST(list_dot_product(q.v, e.v) AS BIGINT) AS score
  FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
