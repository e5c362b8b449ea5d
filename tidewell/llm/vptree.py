"""Approximate nearest neighbours by largest inner product: a vantage-point tree per shard.

A shard's rows are banded by norm, each band's longest norm M being at most twice its shortest, and each band has a tree; the longest are searched first.
One more component sqrt(M^2 - |x|^2) makes a band's vectors equally long, and the nearest to (q, 0)
in Euclidean distance are those with the largest inner product with q. A node splits its points at the median distance
from its vantage point. A subtree whose points lie between lo and hi from the vantage point, at dq from the query, has none nearer than
max(dq - hi, lo - dq), so no score above some s; nor one above |q| R, with R its longest norm. It is left out where `relax` squared times |q| R - s exceeds
|q| R less the k-th score so far: gaps that don't grow with M (with unit vectors, half the squared distances). relax = 1 is exact search.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import Best, shard_count, sharded_search, spooled, usable

LEAF = 256
#: On unit vectors recall stays 1 up to 3; where norms vary widely it falls below 0.9 past 1.25.
RELAX = 1.2


class Tree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, relax: float = RELAX, leaf: int = LEAF):
        self.ids, self.x, self.relax, self.leaf = ids, np.ascontiguousarray(vectors, dtype=np.float64), relax, leaf
        self.norm = np.einsum("nd,nd->n", self.x, self.x)
        self.lift = np.zeros(len(ids))
        self.bands = []
        self.compared = 0  # pairs of a query and a row so far
        rows = np.argsort(-self.norm, kind="stable")
        while len(rows):
            top = float(self.norm[rows[0]])
            n = int((self.norm[rows] >= top / 4).sum())
            band, rows = np.sort(rows[:n]), rows[n:]
            self.lift[band] = np.sqrt(np.maximum(top - self.norm[band], 0))
            self.bands.append((top, self._build(band)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        v, rest = rows[len(rows) // 2], np.delete(rows, len(rows) // 2)
        d = np.sqrt(((self.x[rest] - self.x[v]) ** 2).sum(axis=1) + (self.lift[rest] - self.lift[v]) ** 2)
        order = np.argsort(d, kind="stable")
        half = len(rest) // 2
        near, far = order[:half], order[half:]
        return v, float(d[far[0]]), [(float(d[p].min()), float(d[p].max()), float(self.norm[rest[p]].max()), self._build(rest[p])) for p in (near, far)]

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        best = Best(query_ids, k + 4)
        size = np.einsum("qd,qd->q", queries, queries)
        for top, root in self.bands:
            go = np.flatnonzero(np.sqrt(size * top) >= best.kth() - 1e-9 * (size + top))
            if len(go):
                self._visit(root, go, queries, size, best, top)
        self.compared += best.compared
        # Scores once more, by one rule for every pair, so that equal vectors have equal scores in all shards.
        found, rows = best.result()[0], np.maximum(best.row, 0)
        score = np.where(found >= 0, (queries[:, None, :] * self.x[rows]).sum(axis=2), -np.inf)
        order = np.lexsort((best.id, -score), axis=1)[:, :k]
        return np.take_along_axis(found, order, axis=1), np.take_along_axis(score, order, axis=1)

    def _visit(self, node, q: np.ndarray, queries: np.ndarray, size: np.ndarray, best: Best, top: float) -> None:
        if isinstance(node, np.ndarray):
            best.add(q, self.ids[node], node, queries[q] @ self.x[node].T)
            return
        v, middle, (near, far) = node
        score = queries[q] @ self.x[v]
        best.add(q, self.ids[v : v + 1], np.array([v]), score[:, None])
        d = np.sqrt(np.maximum(size[q] + top - 2 * score, 0))
        inside = d < middle
        for first, second, side in ((near, far, inside), (far, near, ~inside)):
            for lo, hi, longest, child in (first, second):
                mine = np.flatnonzero(side)
                own = size[q[mine]]
                bound = np.maximum(np.maximum(d[mine] - hi, lo - d[mine]), 0)
                most = np.sqrt(own * longest)
                gap = np.maximum(most - (own + top - bound**2) / 2, 0) * self.relax**2
                go = mine[gap <= most - best.kth()[q[mine]] + 1e-9 * (own + top)]
                if len(go):
                    self._visit(child, q[go], queries, size, best, top)


def nearest(df: DataFrame, query_every: int = 20, k: int = 20, relax: float = RELAX, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by query_every, the k rows of largest inner product found among the others.

    Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part. Rows are spread
    over shards by hash, so equal or crowded vectors make no shard larger. Ties go to smaller ids; of repeated ids each row is found, none by its own id.
    An empty table gives no rows; other columns are not looked at.
    """
    rows, n = spooled(usable(df, id_col, vector_col, allow_zero=False))
    shards = shard_count(n)
    data = rows.select(F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(shards)).cast("int").alias("shard"), "vec_id", "v")
    queries = rows.where(F.pmod("vec_id", F.lit(query_every)) == 0)
    return sharded_search(data, queries, shards, k, lambda ids, vectors: Tree(ids, vectors, relax))


def op1(spark, sf_dir: str) -> DataFrame:
    from .shared import table

    return nearest(table(spark, sf_dir, "embeddings"))
