"""Connected components by alternating stars, each round written to the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import spool, spool_counted, tidied

#: Pieces of a node with very many neighbours.
SALTS = 256
#: Edges of a task that are thinned out at once.
AT_ONCE = 1 << 19


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _with_least(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) with `m`, the smallest v of its u. A u with many pairs is met in up to SALTS pieces: minima by piece, then by u, which go back to the pieces that u has."""
    salted = pairs.withColumn("_s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    least = salted.groupBy("u", "_s").agg(F.min("v").alias("m")).groupBy("u").agg(F.min("m").alias("m"), F.collect_list("_s").alias("_s"))
    return salted.join(least.select("u", "m", F.explode("_s").alias("_s")), ["u", "_s"]).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the smallest of it and its neighbours."""
    met = _with_least(_both(edges)).where("v > u")
    return met.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hands itself and its smaller neighbours to the smallest of them."""
    met = _with_least(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    moved = met.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").distinct()


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the given ones connect: each node but the smallest of its component with that one."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, up = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(up[a], up[b]), np.maximum(up[a], up[b])
        apart = low < high
        a, b = a[apart], b[apart]
        np.minimum.at(up, high[apart], low[apart])
        while (up[up] != up).any():
            up = up[up]
    own = np.flatnonzero(up != np.arange(len(nodes)))
    return nodes[own], nodes[up[own]]


def _thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of a task by AT_ONCE: no more than they have nodes, however densely these are linked."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out() -> pa.RecordBatch:
        u, v = stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        if sum(len(u) for u, _ in held) >= AT_ONCE:
            yield out()
    if held:
        yield out()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node on an edge. edges: (u long, v long), any direction, repeats allowed.

    Null ends and loops are left out; no edges give no rows. Edges are thinned out where they are before any meet, which does most in a table of few pieces: a group linked
    at many anchors has some hundred edges a node. Only one count and one checksum a round, observed as it is written, come to the driver.
    """
    given = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v")
    edges = spool(given.mapInArrow(tidied(_thinned), "u long, v long").distinct(), "edges", small=True)
    before = None
    for _ in range(max_rounds):
        edges, now = spool_counted(_small_star(_large_star(edges)), "edges", F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"), small=True)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
