"""Ranked lexical search on dual-sorted wavelet trees, one a shard of documents.

A shard's posting lists stand one behind the other, each by falling impact (what the term adds to a document's score, but for its weight). The sequence of document
numbers this makes is kept as a wavelet tree: a level a bit, highest first, each level parting the one before into documents with bit 0 and with bit 1, in their
order. So a list is navigable both ways: a term's part of a node is a range whose first element has the term's largest impact there, and
its parts of the children follow from two ranks. Nodes are stretches of document numbers, and numbers ascend with doc_id.

A query's terms are intersected with the tree best first: a node's bound is the sum over terms of weight times impact of the first element, and at a leaf, which is one
document, it is the score. Nodes are expanded from the largest bound until none can still bring a document among the k best.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import Writer, read_ranges
from .shared import CHUNK_BYTES, fresh_path, partitions, spool, table, text_chunks, texts_of, tidied

#: Bytes of text in a shard, about (a longer document is a shard).
SHARD_BYTES = 8 << 20
#: Queries that a task takes along a tree at once, and those of a block; nodes of a query expanded together, at least.
TOGETHER, BLOCK, BEAM = 32, 256, 8
#: Pieces in which a term's shards meet its queries.
SALTS = 16
#: Fixed values of the ranking: bytes of terms (in UTF-8 all bytes from 80 on are), and parameters in thousandths, hundredths and as scale.
TERM_BYTES = [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]
SCALE, SATURATION, MILLI, LENGTH_SHARE, WHOLE = 1_000_000_000, 8, 1000, 75, 100

_LOW = np.zeros(256, dtype=np.uint8)
_LOW[TERM_BYTES] = [b + 32 if 0x41 <= b <= 0x5A else b for b in TERM_BYTES]


def terms(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The terms of the texts in order, A-Z lower-cased, and the text each belongs to."""
    raw = _LOW[np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)]
    on = raw != 0
    edge = np.flatnonzero(np.diff(on, prepend=False))
    start, size = edge[0::2], edge[1::2] - edge[0::2]
    ends = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
    data = raw[on]
    offsets = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    found = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    return found, np.searchsorted(offsets, start, side="right")


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (SCALE * tf.astype(np.int64)) // (MILLI * tf.astype(np.int64) + SATURATION * m)


def length_parts(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of documents of n terms; in Python's integers where 64 bits don't hold the product."""
    if LENGTH_SHARE * int(n.max(initial=0)) * n_docs >= 1 << 63:
        n = n.astype(object)
    return (WHOLE - LENGTH_SHARE + (LENGTH_SHARE * n * n_docs) // n_terms).astype(np.int64)


class Tree:
    """A shard: doc_ids ascending, m of each, and the levels. Postings are in list order at level 0, and parted by one more bit at each next level."""

    def __init__(self, doc_ids: np.ndarray, m: np.ndarray, bits: np.ndarray, counts: np.ndarray, tf: np.ndarray):
        """bits (level, posting); counts: postings of each document; tf in the order below the last level."""
        self.doc_ids, self.levels, self.n = doc_ids, len(bits), bits.shape[1]
        self.rank = np.zeros((self.levels, self.n + 1), dtype=np.int32)  # ones before
        np.cumsum(bits, axis=1, out=self.rank[:, 1:], dtype=np.int32)
        self.zeros = self.n - self.rank[:, -1]
        # Below the last level documents stand by their number read backwards.
        number = np.arange(len(doc_ids))
        backwards = sum((((number >> i) & 1) << (self.levels - 1 - i) for i in range(self.levels)), np.zeros_like(number))
        order = np.argsort(backwards, kind="stable")
        self.impact = np.empty((self.levels + 1, self.n), dtype=np.int32)
        self.impact[-1] = impacts(tf, np.repeat(m[order], counts[order]))
        place = np.arange(self.n, dtype=np.int32)
        for level in reversed(range(self.levels)):
            ones = self.rank[level, :-1]
            self.impact[level] = self.impact[level + 1][np.where(bits[level], self.zeros[level] + ones, place - ones)]

    @staticmethod
    def pack(doc_ids: np.ndarray, m: np.ndarray, term: np.ndarray, doc: np.ndarray, tf: np.ndarray) -> bytes:
        """The tree of postings (term, doc, tf), which come by term and then document, as bytes."""
        levels = max(1, (len(doc_ids) - 1).bit_length())
        order = np.argsort((term.astype(np.int64) << 21) - impacts(tf, m[doc]), kind="stable")  # impacts are below 2 ** 20
        doc, tf = doc[order].astype(np.int32), tf[order].astype(np.int32)
        counts = np.bincount(doc, minlength=len(doc_ids)).astype("<i4")
        planes = []
        for level in range(levels):
            bit = ((doc >> (levels - 1 - level)) & 1).astype(bool)
            planes.append(np.packbits(bit).tobytes())
            doc, tf = (np.concatenate((x[~bit], x[bit])) for x in (doc, tf))
        head = struct.pack("<qqq", len(doc_ids), len(doc), levels)
        return zstandard.ZstdCompressor(level=1).compress(head + doc_ids.astype("<i8").tobytes() + m.astype("<i8").tobytes() + counts.tobytes() + tf.astype("<i4").tobytes() + b"".join(planes))

    @classmethod
    def unpack(cls, data: bytes) -> Tree:
        raw = zstandard.ZstdDecompressor().decompress(data)
        docs, n, levels = struct.unpack_from("<qqq", raw)
        at, parts = 24, []
        for kind, size in (("<i8", docs), ("<i8", docs), ("<i4", docs), ("<i4", n)):
            parts.append(np.frombuffer(raw, dtype=kind, count=size, offset=at))
            at += parts[-1].nbytes
        planes = np.frombuffer(raw, dtype=np.uint8, offset=at).reshape(levels, -1)
        doc_ids, m, counts, tf = parts
        return cls(doc_ids, m, np.unpackbits(planes, axis=1, count=n), counts, tf)

    def search(self, query: np.ndarray, start: np.ndarray, n: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, document number, score) of the k best of each query; a row of the arguments is a term of a query: its list, and its weight. Queries come together."""
        best = _Best(k)
        if not len(query):
            return best.found()
        ids, own = np.unique(query, return_inverse=True)
        for first in range(0, len(ids), TOGETHER):
            on = (own >= first) & (own < first + TOGETHER)
            self._walk(ids[first : first + TOGETHER], own[on] - first, start[on], n[on], weight[on], best)
        return best.found()

    def _walk(self, ids: np.ndarray, q: np.ndarray, start: np.ndarray, n: np.ndarray, weight: np.ndarray, best: _Best) -> None:
        order = np.argsort(q, kind="stable")
        q, start, n, weight = q[order], start[order], n[order], weight[order]
        pool = _Pool()
        top = _Top(len(ids), best.k)
        sizes = np.bincount(q, minlength=len(ids))
        bound = np.bincount(q, weights=weight * self.impact[0][start], minlength=len(ids)).astype(np.int64)
        # A node: its query, level, number of the first bits, bound, and its ranges in the pool.
        front = [np.arange(len(ids)), np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=np.int64), bound, pool.add(start, start + n, weight, sizes), sizes]
        while len(front[0]):
            by = np.lexsort((front[2] << (self.levels - front[1]), -front[3], front[0]))
            front = [x[by] for x in front]
            many = np.bincount(front[0], minlength=len(ids))
            place = np.arange(len(by)) - (np.cumsum(many) - many)[front[0]]
            now = place < np.maximum(BEAM, many >> 2)[front[0]]
            made = self._expand([x[now] for x in front], pool, top)
            front = [np.concatenate((x[~now], y)) for x, y in zip(front, made, strict=True)]
            alive = top.lets(front[0], front[3], front[2] << (self.levels - front[1]))
            front = [x[alive] for x in front]
        best.add(ids, top)

    def _expand(self, nodes: list[np.ndarray], pool: _Pool, top: _Top) -> list[np.ndarray]:
        """The children of nodes that can still bring something; those that are leaves go to `top`."""
        q, level, prefix, _, at, size = nodes
        s, e, w = pool.get(at, size)
        node = np.repeat(np.arange(len(q)), size)
        deep = level[node]
        row = deep * (self.n + 1)
        ones_s, ones_e = self.rank.ravel()[row + s], self.rank.ravel()[row + e]
        zeros = self.zeros[deep]
        child = np.concatenate((node, node + len(q)))
        s, e, w, deep = np.concatenate((s - ones_s, zeros + ones_s)), np.concatenate((e - ones_e, zeros + ones_e)), np.concatenate((w, w)), np.concatenate((deep, deep)) + 1
        on = e > s
        child, s, e, w, deep = child[on], s[on], e[on], w[on], deep[on]
        bound = np.bincount(child, weights=w * self.impact.ravel()[deep * self.n + s], minlength=2 * len(q)).astype(np.int64)  # sums below 2 ** 53
        size = np.bincount(child, minlength=2 * len(q))
        q, level = np.tile(q, 2), np.tile(level, 2) + 1
        prefix = np.concatenate((prefix * 2, prefix * 2 + 1))
        keep = (bound > 0) & top.lets(q, bound, prefix << (self.levels - level))
        leaf = keep & (level == self.levels)
        if leaf.any():
            top.add(q[leaf], prefix[leaf], bound[leaf])
        keep &= ~leaf
        held = keep[child]
        return [q[keep], level[keep], prefix[keep], bound[keep], pool.add(s[held], e[held], w[held], size[keep]), size[keep]]


class _Pool:
    """The ranges of nodes, one after the other."""

    def __init__(self):
        self.held, self.n = np.empty((3, 1024), dtype=np.int64), 0

    def add(self, s: np.ndarray, e: np.ndarray, w: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Where each node's ranges begin."""
        while self.n + len(s) > self.held.shape[1]:
            self.held = np.concatenate((self.held, np.empty_like(self.held)), axis=1)
        self.held[:, self.n : self.n + len(s)] = s, e, w
        at = self.n + np.cumsum(sizes) - sizes
        self.n += len(s)
        return at

    def get(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        return self.held[:, np.repeat(at - (np.cumsum(size) - size), size) + np.arange(size.sum())]


class _Top:
    """The k best (score, document) of each query so far: higher scores first, ties to smaller numbers."""

    def __init__(self, queries: int, k: int):
        self.score = np.zeros((queries, k), dtype=np.int64)
        self.doc = np.full((queries, k), np.iinfo(np.int64).max)

    def lets(self, q: np.ndarray, bound: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Whether a node of that bound, whose documents begin at `first`, can still bring one."""
        bar = self.score[q, -1]
        return (bound > bar) | ((bound == bar) & (first <= self.doc[q, -1]))

    def add(self, q: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        order = np.lexsort((doc, -score, q))
        q, doc, score = q[order], doc[order], score[order]
        many = np.bincount(q, minlength=len(self.score))
        place = np.arange(len(q)) - (np.cumsum(many) - many)[q]
        width = self.score.shape[1]
        on = place < width
        s, d = np.zeros_like(self.score), np.full_like(self.doc, np.iinfo(np.int64).max)
        s[q[on], place[on]], d[q[on], place[on]] = score[on], doc[on]
        s, d = np.concatenate((self.score, s), axis=1), np.concatenate((self.doc, d), axis=1)
        by = np.lexsort((d, -s), axis=1)[:, :width]
        self.score, self.doc = np.take_along_axis(s, by, axis=1), np.take_along_axis(d, by, axis=1)


class _Best:
    def __init__(self, k: int):
        self.k, self.parts = k, []

    def add(self, ids: np.ndarray, top: _Top) -> None:
        q, at = np.nonzero(top.score > 0)
        self.parts.append((ids[q], top.doc[q, at], top.score[q, at]))

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        none = np.zeros(0, dtype=np.int64)
        return tuple(np.concatenate(x) for x in zip((none, none, none), *self.parts, strict=True))


@dataclass
class Index:
    """lexicon (shard, term, start, n, file, at, size): a row a term of a shard, with its list and where the shard's tree is; n_docs with a term, and all n_terms."""

    path: str
    lexicon: DataFrame
    n_docs: int
    n_terms: int


_LEXICON = "shard long, term binary, start long, n long, file string, at long, size long"


def write_index(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> Index:
    """Index every row. A null text has no terms, and a text without terms counts nowhere; rows with a null id are left out; rows that repeat an id are
    documents of their own. An empty table gives an empty index; other columns are not looked at. Texts are read twice (lengths come first) and never moved: a task makes
    trees of what it reads, in a file of its own.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "wavelet")
    given = texts_of(docs.where(F.col(id_col).isNotNull()), id_col, text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_chunks(batches):
            found = np.bincount(terms(texts)[1], minlength=len(texts))
            yield pa.RecordBatch.from_arrays([pa.array([int((found > 0).sum())]), pa.array([int(found.sum())])], names=["docs", "terms"])

    n_docs, n_terms = (int(x or 0) for x in given.mapInArrow(tidied(count), "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, shard = None, TaskContext.get().partitionId() << 32
        for ids, texts in _shards(batches, shard_bytes):
            order = np.argsort(ids, kind="stable")
            ids, texts = ids[order], [texts[i] for i in order]
            found, doc = terms(texts)
            if not len(found):
                continue
            coded = found.dictionary_encode()
            n = np.bincount(doc, minlength=len(texts))
            code, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(texts) + doc, return_counts=True)
            term, doc = code // len(texts), code % len(texts)
            if out is None:
                out = Writer(path, "trees")
            at, size = out.write(Tree.pack(ids, length_parts(n, n_docs, n_terms), term, doc, tf))
            lists = np.bincount(term)
            names = coded.dictionary.cast(pa.binary())
            for i in range(0, len(lists), 10_000):
                m = len(lists[i : i + 10_000])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(m, shard)), names[i : i + m], pa.array((np.cumsum(lists) - lists)[i : i + m]), pa.array(lists[i : i + m]), pa.repeat(out.uri, m), pa.array(np.full(m, at)), pa.array(np.full(m, size))], names=[c.split()[0] for c in _LEXICON.split(", ")]
                )
            shard += 1
        if out is not None:
            out.close()

    return Index(path, spool(given.mapInArrow(tidied(build), _LEXICON), "lexicon"), n_docs, n_terms)


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    ids, texts, held = [], [], 0
    for part, own in text_chunks(batches, min(CHUNK_BYTES, most)):
        size = sum(map(len, own))
        if texts and held + size > most:
            yield np.concatenate(ids), texts
            ids, texts, held = [], [], 0
        ids.append(part.column(0).to_numpy())
        texts += own
        held += size
    if texts:
        yield np.concatenate(ids), texts


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(query, item, term, times), written: query numbers the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches):
            found, row = terms(texts)
            if len(found):
                rows = pa.table([pa.array(row), found.cast(pa.binary())], names=["row", "term"]).group_by(["row", "term"]).aggregate([([], "count_all")])
                at = rows["row"].combine_chunks()
                yield pa.RecordBatch.from_arrays([part.column(2).take(at), part.column(0).take(at), rows["term"].combine_chunks(), rows["count_all"].combine_chunks()], names=["query", "item", "term", "times"])

    given = texts_of(queries.where(F.col(id_col).isNotNull()), id_col, text_col, [F.monotonically_increasing_id().alias("query")])
    return spool(given.mapInArrow(tidied(run), "query long, item long, term binary, times long"), "query-terms")


def search(index: Index, queries: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best documents of each query, exactly, best first, equal scores by doc_id; only scores above 0.

    A query without terms, or with unknown ones only, has no rows, and one with a null id is left out; rows that repeat an id are queries each. Every query meets
    every shard that has a term of it, in blocks of queries: what is sent to a shard are lists and weights.
    """
    spark = queries.sparkSession
    asked = query_terms(queries, id_col, text_col)
    known = spool(index.lexicon.join(asked.select("term").distinct(), "term"), "lists")
    weight = F.floor(1000 * F.log((2.0 * index.n_docs + 2.0) / (2.0 * F.sum("n") + 1.0))).cast("long")
    weights = known.groupBy("term").agg(weight.alias("weight"))
    block = F.pmod(F.xxhash64("query"), F.lit(max(1, -(-asked.select("query").distinct().count() // BLOCK)))).cast("int")
    dealt = asked.join(weights, "term").where("weight > 0").groupBy(block.alias("block"), "term").agg(F.collect_list(F.struct("query", (F.col("times") * F.col("weight")).alias("weight"))).alias("queries"))
    dealt = dealt.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = known.withColumn("salt", F.pmod(F.xxhash64("shard"), F.lit(SALTS)).cast("int")).join(dealt, ["term", "salt"])
    met = met.select("shard", "block", "start", "n", "file", "at", "size", F.col("queries.query").alias("query"), F.col("queries.weight").alias("weight"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, now = None, None
        for rows in _groups(batches):
            shard, file, at, size = (rows.column(i)[0].as_py() for i in (0, 4, 5, 6))
            if shard != now:
                tree = Tree.unpack(next(data for _, data in read_ranges([(file, at, size, None)])))
                now = shard
            many = pc.list_value_length(rows.column(7)).to_numpy()
            start, n = (np.repeat(rows.column(i).to_numpy(), many) for i in (2, 3))
            q, doc, score = tree.search(pc.list_flatten(rows.column(7)).to_numpy(), start, n, pc.list_flatten(rows.column(8)).to_numpy(), k)
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.full(len(q), TaskContext.get().partitionId(), dtype=np.int32)), pa.array(tree.doc_ids[doc]), pa.array(score)], names=["query", "part", "doc_id", "score"])

    width = partitions(spark)
    best = met.repartition(width, "shard").sortWithinPartitions("shard", "block").mapInArrow(tidied(run), "query long, part int, doc_id long, score long")
    found = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "doc_id")))
    best = best.groupBy("query", "part").agg(F.slice(found, 1, k).alias("found"))
    while width > 1:  # a merge takes in 64 tasks of a query at most
        best = best.groupBy("query", F.floor(F.col("part") / 64).cast("int").alias("part")).agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("found"))
        width = -(-width // 64)
    items = asked.select("query", F.col("item").alias("item_id")).distinct()
    ranked = best.join(items, "query").select("item_id", F.posexplode("found").alias("place", "f"))
    return ranked.select("item_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("f.doc_id").alias("doc_id"), (-F.col("f.less")).alias("score"))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each (shard, block), which come together."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        shard, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(shard) != 0) | (np.diff(block) != 0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                if held and last != (shard[a], block[a]):
                    yield pa.concat_batches(held)
                    held = []
                last = (shard[a], block[a])
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.concat_batches(held)


def op11(spark, sf_dir: str) -> DataFrame:
    return search(write_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), 10)


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = rf"""
WITH w AS (SELECT doc_id, row_number() OVER () AS row, unnest({_TERMS}) AS term FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
p AS (SELECT row, doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
c AS (SELECT count(DISTINCT row) AS n_docs, count(*) AS n_terms FROM w),
d AS (SELECT row, 100 - 75 + (75 * count(*) * any_value(n_docs)) // any_value(n_terms) AS m FROM w, c GROUP BY row),
t AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(n_docs) + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS weight FROM p, c GROUP BY term),
q AS (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark),
s AS (SELECT item_id, p.row, any_value(doc_id) AS doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
      FROM q JOIN t USING (term) JOIN p USING (term) JOIN d ON d.row = p.row GROUP BY item_id, p.row)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
