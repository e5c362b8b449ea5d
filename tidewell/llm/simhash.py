"""SimHash near-duplicates by anchor-point covering.

Two fingerprints that differ in at most T bits differ in at most T // B bits in one of B equal blocks. In each block the anchors
are the words of a covering code: the [15, 11] Hamming code (covering radius 1) times the block's free bits. A fingerprint lies
within 1 of its home anchor, and goes to every anchor within 1 + T // B; so the two meet at the home of either. At an anchor,
the fingerprints that came are compared with those at home there. Fewer, longer blocks have more anchors, for more data.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import SALTS, connected_components, stars
from .kernels import mix
from .shared import partitions, spool, text_chunks, texts_of, tidied

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
_AT_ONCE = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text: A-Z lower-cased, words split at ASCII white space, word shingles with repeats, XXH64, majority by bit."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - shingle + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(joined, seed)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(size + 1) - 1
    first, last = (end - size)[:n].tolist(), end[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _AT_ONCE):
        part = zip(first[at : at + _AT_ONCE], last[at : at + _AT_ONCE], strict=True)
        h = np.fromiter((digest(joined[a:b], seed) for a, b in part), dtype=np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp long): a row per document. A null or wordless text has fingerprint 0; a shorter text is one shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches):
            fp = np.array([fingerprint(t, shingle, seed) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return texts_of(docs, id_col, text_col).mapInArrow(tidied(run), "doc_id long, fp long")


class Code:
    """A covering code on `bits` bits: the [15, 11] Hamming code on the low 15, all words on the rest. Covering radius 1."""

    radius = 1

    def __init__(self, bits: int, within: int):
        """within: how far from an anchor a fingerprint may be to be sent there."""
        assert bits >= 15, "a block is shorter than the code"
        self.mask = np.uint64((1 << bits) - 1)
        columns = np.array([*range(1, 16)] + [0] * (bits - 15))  # of the parity check
        low = np.zeros(1 << 15, dtype=np.uint8)
        for i in range(15):
            low[(np.arange(1 << 15) >> i) & 1 == 1] ^= i + 1
        self.syndromes = low
        flips: dict[int, list[int]] = {s: [] for s in range(16)}
        for weight in range(within + 1):
            for places in combinations(range(bits), weight):
                flips[int(np.bitwise_xor.reduce(columns[list(places)])) if places else 0].append(sum(1 << i for i in places))
        self.flips = [np.array(flips[s], dtype=np.uint64) for s in range(16)]
        self.home_flip = np.array([0, *(1 << (s - 1) for s in range(1, 16))], dtype=np.uint64)

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        return self.syndromes[(x & np.uint64(0x7FFF)).astype(np.int64)]

    def home(self, x: np.ndarray) -> np.ndarray:
        return x ^ self.home_flip[self.syndrome(x)]

    def near(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index into x and anchor, for every anchor within reach."""
        s = self.syndrome(x)
        index, anchor = [], []
        for k in range(16):
            rows = np.flatnonzero(s == k)
            index.append(np.repeat(rows, len(self.flips[k])))
            anchor.append((x[rows][:, None] ^ self.flips[k][None, :]).ravel())
        return np.concatenate(index), np.concatenate(anchor)


@lru_cache(maxsize=8)
def blocks_of(n_blocks: int, block_bits: int) -> tuple[tuple[int, Code], ...]:
    """(shift, code) of each block of a 64-bit word; block_bits: how far apart two fingerprints may be in a block where they meet."""
    width, rest = divmod(64, n_blocks)
    out, shift = [], 0
    for i in range(n_blocks):
        bits = width + (i < rest)
        out.append((shift, Code(bits, Code.radius + block_bits)))
        shift += bits
    return tuple(out)


class _Bucket:
    """Compares what comes to one anchor with what is at home there, and keeps only a forest of the links found between roots; nodes of one root are linked already."""

    def __init__(self, fp: np.ndarray, node: np.ndarray, root: np.ndarray):
        self.fp, self.node = fp, node
        label, self.first, at = np.unique(root, return_index=True, return_inverse=True)
        self.parent = self.first[at]
        self.met = dict(zip(label.tolist(), self.first.tolist(), strict=True))

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return up
            self.parent = up

    def probe(self, fp: np.ndarray, node: np.ndarray, label: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Links (root of a probe, node of a home), one for each root that has not met any yet; homes that a probe links, or probes of one root, are joined."""
        apart = np.bitwise_count(fp[:, None, 0] ^ self.fp[None, :, 0]).astype(np.uint16 if fp.shape[1] > 3 else np.uint8)
        for k in range(1, fp.shape[1]):
            apart += np.bitwise_count(fp[:, None, k] ^ self.fp[None, :, k])
        links = apart <= max_bits
        some = np.flatnonzero(links.any(axis=1))
        if not len(some):
            return node[:0], node[:0]
        links = links[some]
        root = self.roots()
        none = len(root)
        while True:
            least = np.where(links, root[None, :], none).min(axis=1)
            new = np.minimum(root, np.where(links, least[:, None], none).min(axis=0))
            if (new == root).all():
                break
            for a, b in set(zip(root[new != root].tolist(), new[new != root].tolist(), strict=True)):
                self._join(a, b)
            root = self.roots()
        found = []
        other = node[some] != self.node[least]
        for own, home in sorted(set(zip(label[some[other]].tolist(), least[other].tolist(), strict=True))):
            if own in self.met:
                self._join(self.met[own], home)
            else:
                self.met[own] = home
                found.append((own, self.node[home]))
        u, v = np.array(found, dtype=np.int64).reshape(-1, 2).T
        return u, v

    def _join(self, a: int, b: int) -> None:
        while self.parent[a] != a:
            a = self.parent[a]
        while self.parent[b] != b:
            b = self.parent[b]
        self.parent[max(a, b)] = min(a, b)

    def own(self) -> tuple[np.ndarray, np.ndarray]:
        root = self.roots()[self.first]
        keep = root != self.first
        return self.node[self.first[keep]], self.node[root[keep]]


def _roots_at_hand(fp: np.ndarray, codes: Sequence[tuple[int, int, Code]], compared: int, max_bits: int) -> np.ndarray:
    """For each of some fingerprints the first that it is known to be linked with, the same one for those linked with each other; itself where none is known.

    In each block the fingerprints of one home are compared with the first of them, what is left with the first of the rest, _LEADERS times. All that is found so would be found
    at that home, so groups stay what they are; but a group of very many near copies, most of which share a home in some block, has few roots.
    """
    u, v = [], []
    for w, shift, code in codes:
        home, left = code.home((fp[:, w] >> np.uint64(shift)) & code.mask), np.arange(len(fp))
        for _ in range(_LEADERS):
            _, first, at = np.unique(home[left], return_index=True, return_inverse=True)
            lead = left[first][at]
            near = np.bitwise_count(fp[left, :compared] ^ fp[lead, :compared]).sum(axis=1, dtype=np.int64) <= max_bits
            u.append(left[near])
            v.append(lead[near])
            left = left[~near]
    own, up = stars(np.concatenate(u), np.concatenate(v))
    root = np.arange(len(fp))
    root[own] = up
    return root


#: Where the number of a block begins in the key of an anchor: blocks are shorter than this.
_BLOCK_AT = np.uint64(40)
#: Fingerprints known to all tasks, those of a task whose links at hand are looked for at once, comparisons of each with others of its home, and places of the links found so.
_KNOWN, _HELD, _LEADERS, _PLACES = 1 << 12, 1 << 16, 4, 1 << 12


def links(
    fingerprints: DataFrame, max_bits: int = MAX_BITS, words: Sequence[str] = ("fp",), compared: int | None = None, n_blocks: int | None = None, block_bits: int | None = None, home_rows: int = 2000, probe_rows: int = 50_000
) -> DataFrame:
    """(u, v): a forest of nodes that connects what the links found connect. fingerprints: (node long, words... long), a row a node.

    A fingerprint is the 64-bit `words` together. Two are linked if they meet at an anchor, being at most block_bits apart in one of the n_blocks blocks of a
    word, and differ in at most max_bits of the first `compared` words. With the defaults (one word; max_bits // n_blocks apart in a block) that finds
    every pair of at most max_bits differing bits. An anchor with more than home_rows at home, or more than about probe_rows coming, is dealt out
    over several tasks, in pieces that meet pairwise; where the hot ones are is a list no longer than there are anchors. Of fingerprints that are known to be
    linked before they are dealt out, by others of their task or by the _KNOWN that every task has, an anchor gives one link only: so a large group of near copies
    does not give one for each of its nodes at each of its anchors. What is known so decides only which links are told again, not what is connected.
    """
    spark = fingerprints.sparkSession
    if n_blocks is None:
        n_blocks = 4 if fingerprints.count() <= 1 << 22 else 3
    block_bits = max_bits // n_blocks if block_bits is None else block_bits
    assert block_bits <= 3
    compared = compared or len(words)
    codes = [(w, *c) for w in range(len(words)) for c in blocks_of(n_blocks, block_bits)]
    far = int(sum(len(f) for f in codes[0][2].flips) / 16)
    given = fingerprints.select("node", *words)
    kept = list(words[:compared])

    def columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return batch.column(0).to_numpy(), np.stack([batch.column(1 + w).to_numpy().view(np.uint64) for w in range(len(words))], axis=1)

    def home_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = columns(batch)[1]
            for b, (w, shift, code) in enumerate(codes):
                at, n = np.unique(code.home((fp[:, w] >> np.uint64(shift)) & code.mask) | np.uint64(b) << _BLOCK_AT, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), pa.array(n)], names=["anchor", "n"])

    hot_rows = given.mapInArrow(tidied(home_keys), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") > home_rows).collect()
    hot_rows = sorted((r["anchor"], -(-r["n"] // home_rows), max(1, r["n"] * far // probe_rows)) for r in hot_rows)
    hot = spark.sparkContext.broadcast(np.array(hot_rows, dtype=np.int64).reshape(-1, 3))
    some = np.array([tuple(r) for r in given.orderBy(F.xxhash64("node")).limit(_KNOWN).collect()], dtype=np.int64).reshape(-1, 1 + len(words))
    known = spark.sparkContext.broadcast((some[:, 0].copy(), some[:, 1:].copy().view(np.uint64)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "piece", "probe", "node", "root", *kept]
        n_known = len(known.value[0])
        first = np.flatnonzero(_roots_at_hand(known.value[1], codes, compared, max_bits) == np.arange(n_known))
        for held in _gathered(map(columns, batches)):
            nodes, fps = (np.concatenate(x) for x in zip(known.value, held, strict=True))
            roots = nodes[_roots_at_hand(fps, codes, compared, max_bits)]
            # A task's own nodes with their roots, and roots of what all tasks know where its own nodes link them.
            told = np.concatenate([first, np.arange(n_known, len(nodes))])
            told = told[nodes[told] != roots[told]]
            none = pa.array(np.zeros(len(told), dtype=np.int64))
            place = -1 - (mix(nodes[told].view(np.uint64)) % np.uint64(_PLACES)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(place), none.cast(pa.int32()), none.cast(pa.bool_()), pa.array(nodes[told]), pa.array(roots[told]), *[none] * compared], names=names)
            for at in range(n_known, len(nodes), 4096):
                node, fp, root = (x[at : at + 4096] for x in (nodes, fps, roots))
                spread = (mix(node.view(np.uint64)) >> np.uint64(1)).astype(np.int64)
                for b, (w, shift, code) in enumerate(codes):
                    x = (fp[:, w] >> np.uint64(shift)) & code.mask
                    for probe, (i, a) in ((False, (np.arange(len(fp)), code.home(x))), (True, code.near(x))):
                        i, a, piece = _replicate(i, (a | np.uint64(b) << _BLOCK_AT).view(np.int64), probe, spread, hot.value)
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(piece), pa.array(np.full(len(i), probe)), pa.array(node[i]), pa.array(root[i]), *(pa.array(fp[i, k].view(np.int64)) for k in range(compared))], names=names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, bucket = None, [], None

        def out(u, v):
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for whole in batches:
            anchor, piece, probe, node, root = (whole.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            told = int(np.searchsorted(anchor, 0))  # links, not fingerprints
            if told:
                yield out(node[:told], root[:told])
                whole = whole.slice(told)
                anchor, piece, probe, node, root = (x[told:] for x in (anchor, piece, probe, node, root))
            fps = np.stack([whole.column(5 + k).to_numpy().view(np.uint64) for k in range(compared)], axis=1)
            same = (anchor[1:] == anchor[:-1]) & (piece[1:] == piece[:-1]) & (probe[1:] == probe[:-1])
            cuts = [0, *(np.flatnonzero(~same) + 1).tolist(), whole.num_rows] if whole.num_rows else []
            found = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                now = int(anchor[a]), int(piece[a])
                if now != key:
                    if bucket:
                        found.append(bucket.own())
                    key, held, bucket = now, [], None
                if not probe[a]:
                    held.append((fps[a:b], node[a:b], root[a:b]))
                elif held or bucket:
                    if bucket is None:
                        bucket, held = _Bucket(*(np.concatenate(x) for x in zip(*held, strict=True))), []
                    found += [bucket.probe(*(x[i : min(i + 512, b)] for x in (fps, node, root)), max_bits) for i in range(a, b, 512)]
            if found:
                u, v = (np.concatenate(x) for x in zip(*found, strict=True))
                if len(u):
                    yield out(u, v)
        if bucket:
            yield out(*bucket.own())

    schema = "anchor long, piece int, probe boolean, node long, root long, " + ", ".join(f"{c} long" for c in kept)
    dealt = given.repartition(partitions(spark)).mapInArrow(tidied(deal), schema)
    met = dealt.repartition(partitions(spark), "anchor", "piece").sortWithinPartitions("anchor", "piece", "probe")
    return met.mapInArrow(tidied(compare), "u long, v long").where("u <> v")


def _gathered(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(nodes, fingerprints) of a task, some _HELD at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for part in parts:
        held.append(part)
        if sum(len(node) for node, _ in held) >= _HELD:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held = []
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _replicate(i: np.ndarray, anchor: np.ndarray, probe: bool, spread: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A home goes to its row of the grid of pieces, a probe to its column: each pair meets in one piece. hot: anchor, rows, columns, by anchor."""
    if not len(hot):
        return i, anchor, np.zeros(len(i), dtype=np.int32)
    at = np.minimum(np.searchsorted(hot[:, 0], anchor), len(hot) - 1)
    grid = np.where((hot[at, 0] == anchor)[:, None], hot[at, 1:], 1)
    rows, cols = grid[:, 0], grid[:, 1]
    times = rows if probe else cols
    index = np.repeat(np.arange(len(i)), times)
    k = np.arange(len(index)) - np.repeat(np.cumsum(times) - times, times)
    own = spread[i[index]]
    piece = k * cols[index] + own % cols[index] if probe else (own % rows[index]) * cols[index] + k
    return i[index], anchor[index], piece.astype(np.int32)


def component_ids(nodes: DataFrame, joined: DataFrame) -> DataFrame:
    """(node, component_id): the smallest rep of each node's component. nodes: (node, rep); joined: (node, component) of the nodes on links."""
    # A component with very many nodes meets its least rep in pieces; nodes on no link are not moved for that.
    linked = nodes.join(joined, "node").withColumn("_s", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    least = linked.groupBy("component", "_s").agg(F.min("rep").alias("m")).groupBy("component").agg(F.min("m").alias("component_id"), F.collect_list("_s").alias("_s"))
    named = linked.join(least.withColumn("_s", F.explode("_s")), ["component", "_s"]).select("node", "component_id")
    return nodes.join(named, "node", "left").select("node", F.coalesce("component_id", "rep").alias("component_id"))


def numbered(each: DataFrame, nodes: DataFrame, joined: DataFrame, node: str = "node") -> DataFrame:
    """each (doc_id, node, ...) with component_id. nodes: (node, rep, salts), as by_node() gives. A node of very many documents meets them in pieces."""
    named = component_ids(nodes.select("node", "rep"), joined).join(nodes.select("node", "salts"), "node").withColumn("_s", F.explode("salts")).select(F.col("node").alias(node), "_s", "component_id")
    return each.withColumn("_s", _piece()).join(named, [node, "_s"]).drop("_s")


def by_node(each: DataFrame, node: str, *kept: Column) -> DataFrame:
    """(node, rep, salts, kept...): a row a node, with its smallest doc_id and the pieces in which it has documents; added up by piece first."""
    parts = each.groupBy(F.col(node).alias("node"), _piece().alias("_s")).agg(F.min("doc_id").alias("rep"), *kept)
    again = [F.first(c).alias(c) for c in parts.columns[3:]]
    return parts.groupBy("node").agg(F.min("rep").alias("rep"), F.collect_list("_s").alias("salts"), *again)


def _piece() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS, seed: int = SEED, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id): documents whose fingerprints chain by links of at most max_bits differing bits share the smallest doc_id.

    Equal fingerprints are one node, so copies never meet pairwise. A null text counts as empty; empty texts have fingerprint 0 and link like any
    other. Rows with a null id are left out. Repeated ids keep their rows, and an id does not link the fingerprints of its rows. An
    empty table gives no rows; other columns are not looked at.
    """
    each = spool(fingerprints(docs.where(F.col(id_col).isNotNull()), id_col, text_col, shingle, seed), "fingerprints")
    nodes = spool(by_node(each, "fp"), "nodes")
    joined = connected_components(spool(links(nodes.withColumn("fp", F.col("node")), max_bits), "links"))
    return numbered(each, nodes, joined, "fp").select("doc_id", "fp", "component_id")


def op9(spark, sf_dir: str) -> DataFrame:
    from .shared import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
