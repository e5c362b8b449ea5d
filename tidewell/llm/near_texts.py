"""Near copies by Jaccard similarity of word shingles: wide SimHash fingerprints propose through anchors, the shingle sets themselves decide.

A set of shingles gives a SimHash of 256 bits, in 16 blocks of 16. Two sets of similarity s differ in a bit with probability
acos(2 s / (1 + s)) / pi, 0.15 at 0.8, so a block differs in at most one bit with probability 0.28, and one of 16 blocks with 0.995 (0.9995 at 0.85).
Such a block meets at an anchor of the covering code (see simhash); there all 256 bits are compared: those of a pair at 0.8 differ
in 39 on average with a deviation of 6, of one at 0.4 in 78 with one of 7, so APART tells them apart. Equal sets are one node, so copies never meet.

What the anchors link forms groups of candidates. In a group each set is compared with a few of the others (hubs), eight times as many each round,
until all pairs of a group that are not too far apart were compared or are known to be in one component; so a group of near copies costs about a comparison a member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .kernels import mix
from .shared import partitions, spool, spool_counted, text_chunks, texts_of, tidied, without_ids
from .simhash import by_node, links, numbered

SHINGLE_WORDS = 5
LEAST = 0.8
SEED = 42
#: Words of 64 bits of a fingerprint, blocks of a word, and bits in which a block may differ where two meet.
WORDS, BLOCKS, BLOCK_BITS = ("w0", "w1", "w2", "w3"), 4, 1
#: Most differing bits of the 256: some three deviations over the average of a pair at LEAST.
APART = 55
#: Hubs of the first round, and rounds of eight times as many each: enough for 8 ** 12 sets in a group.
_HUBS, _MORE, _MOST_ROUNDS = 4, 8, 12
#: Pieces in which a group with very many members is dealt out.
_SALTS = 64
_TURNS = np.array([0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
_AT_ONCE = 1 << 16


def shingles(text: bytes, shingle: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct XXH64 of a text's word shingles: A-Z lower-cased, words split at ASCII white space. A shorter text is one shingle, a wordless one has none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined, n = b" ".join(words), len(words) - shingle + 1
    if n <= 1:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(size + 1) - 1
    digest = xxhash.xxh64_intdigest
    part = zip((end - size)[:n].tolist(), end[shingle - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in part), dtype=np.uint64, count=n))


def name_of(hashes: np.ndarray) -> int:
    digest = xxhash.xxh64_intdigest(hashes.tobytes(), SEED)
    return digest - (digest >> 63 << 64)


def wide_fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, 4) words: by word and bit, the majority of the hashes scrambled for that word, a tie going by the least hash; of no hashes 0."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    ends = np.cumsum(size)
    hashes = np.concatenate([*sets, np.zeros(0, dtype=np.uint64)])
    ones = np.zeros((len(sets), len(WORDS), 64), dtype=np.int64)
    at = 0
    while at < len(hashes):  # stretches of hashes, which may begin and end inside a set
        to = min(at + _AT_ONCE, len(hashes))
        first, last = np.searchsorted(ends, [at, to - 1], side="right")
        whom = np.flatnonzero(size[first : last + 1]) + first
        starts = np.maximum(ends[whom] - size[whom], at) - at
        for k, turn in enumerate(_TURNS):
            x = mix(hashes[at:to] ^ turn)
            bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[whom, k] += np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        at = to
    least = np.array([s[0] if len(s) else 0 for s in sets], dtype=np.uint64)
    ties = np.stack([np.unpackbits(mix(mix(least ^ turn)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") for turn in _TURNS], axis=1)
    majority = (ones * 2 + (ties & (size > 0)[:, None, None].astype(np.uint8)) > size[:, None, None]).astype(np.uint8)
    return np.packbits(majority, axis=2, bitorder="little").view("<u8").reshape(len(sets), len(WORDS))


def _sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(doc_id, node long, n long, words...): the name of the whole set of shingles, its size, and its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches):
            sets = [shingles(t, shingle) for t in texts]
            fp = wide_fingerprints(sets).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([name_of(s) for s in sets], type=pa.int64()), pa.array([len(s) for s in sets], type=pa.int64()), *(pa.array(np.ascontiguousarray(fp[:, k])) for k in range(len(WORDS)))], names=["doc_id", "node", "n", *WORDS])

    return texts_of(docs, id_col, text_col).mapInArrow(tidied(run), "doc_id long, node long, n long, " + ", ".join(f"{w} long" for w in WORDS))


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(node long, shingles binary): a row a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_chunks(batches, rows=256):
            sets = [shingles(t, shingle) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array([name_of(s) for s in sets], type=pa.int64()), pa.array([s.tobytes() for s in sets], type=pa.binary())], names=["node", "shingles"])

    return texts.mapInArrow(tidied(run), "node long, shingles binary")


def _against_hubs(members: DataFrame, hubs: DataFrame, least: float) -> DataFrame:
    """(u, v): each hub of a group and the members of another component whose sets have a similarity of `least` or more.

    members, hubs: (key, node, component, n, words..., shingles). A group meets its hubs in up to _SALTS pieces: a member's set is moved once however
    many hubs there are, a hub's once a piece. A task holds the hubs of one piece, and members stream past them.
    """
    columns = ["key", "_s", "is_hub", "node", "component", "n", *WORDS, "shingles"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, stacked = None, [], None
        for batch in batches:
            found: tuple[list, list] = ([], [])
            plain = [batch.column(i).to_pylist() for i in range(6)]
            words = np.stack([batch.column(6 + k).to_numpy().view(np.uint64) for k in range(len(WORDS))], axis=1)
            for i, (key, salt, is_hub, node, component, n) in enumerate(zip(*plain, strict=True)):
                if (key, salt) != now:
                    now, held, stacked = (key, salt), [], None
                own = np.frombuffer(batch.column(10)[i].as_buffer(), dtype=np.uint64)
                if is_hub:  # sorted before the members
                    held.append((node, component, n, words[i].copy(), own.copy()))
                    continue
                if stacked is None:
                    stacked = tuple(np.array([h[k] for h in held]) for k in (1, 2, 3))
                near = (stacked[0] != component) & (np.minimum(stacked[1], n) >= np.maximum(stacked[1], n) * (least - 1e-9))
                near &= np.bitwise_count(stacked[2] ^ words[i]).sum(axis=1, dtype=np.int64) <= APART
                for h in np.flatnonzero(near).tolist():
                    both = np.concatenate((held[h][4], own))
                    both.sort(kind="stable")
                    common = int((both[1:] == both[:-1]).sum())
                    if common >= least * (len(both) - common):
                        found[0].append(held[h][0])
                        found[1].append(node)
            yield pa.RecordBatch.from_arrays([pa.array(found[0], type=pa.int64()), pa.array(found[1], type=pa.int64())], names=["u", "v"])

    salted = members.withColumn("_s", F.pmod(F.xxhash64("node"), F.lit(_SALTS)).cast("int")).withColumn("is_hub", F.lit(False))
    sent = hubs.withColumn("is_hub", F.lit(True)).join(salted.select("key", "_s").distinct(), "key")
    rows = salted.select(columns).unionByName(sent.select(columns)).repartition(partitions(members.sparkSession), "key", "_s").sortWithinPartitions("key", "_s", F.desc("is_hub"))
    return rows.mapInArrow(tidied(run), "u long, v long")


def _verified(docs: DataFrame, nodes: DataFrame, groups: DataFrame, shingle: int, least: float, id_col: str, text_col: str) -> DataFrame | None:
    """(node, component) by pairs of similarity `least` or more inside each candidate group; None where there are no groups. nodes: (node, rep, n, words...); groups: (node, component)."""
    state = groups.withColumnRenamed("component", "key").withColumn("component", F.col("node"))
    sets = joined = None
    for i in range(_MOST_ROUNDS):
        mixed = state.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("key")
        state, seen = spool_counted(state.join(mixed, "key", "left_semi"), "groups", small=True)
        if not seen["rows"]:
            return joined
        if sets is None:
            whom = nodes.join(state.select("node"), "node", "left_semi")
            texts = texts_of(docs, id_col, text_col).join(whom.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
            # Of a repeated id only the texts asked for, and of equal texts under one id one.
            sets = spool(_sets(texts, shingle).dropDuplicates(["node"]).join(whom.drop("rep"), "node"), "shingles")
        first = F.min("node").alias("node")
        hubs = state.groupBy("key", F.pmod(F.xxhash64("node", F.lit(i)), F.lit(_HUBS * _MORE**i)).alias("part")).agg(first).select("node")
        hubs = spool(hubs, "hubs", small=True)
        members = state.join(sets, "node")
        found = spool(_against_hubs(members, members.join(hubs, "node", "left_semi"), least), "similar", small=True)
        # What was joined before comes as an edge a node, not as all that was found.
        joined = connected_components(found if joined is None else joined.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(found))
        left = state.drop("component").join(hubs, "node", "left_anti")  # a hub has met all in its group
        state = left.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    raise RuntimeError(f"groups were not compared in {_MOST_ROUNDS} rounds")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS, least: float = LEAST) -> DataFrame:
    """(doc_id, component_id): documents that chain by pairs of Jaccard similarity `least` or more share the smallest doc_id.

    A null text counts as empty; wordless texts are equal to each other. Rows with a null id are left out; repeated ids keep their rows, each
    in the group of its text. An empty table gives no rows; other columns are not looked at.
    """
    each = spool(_sketches(docs.where(F.col(id_col).isNotNull()), id_col, text_col, shingle), "sketches")
    nodes = spool(by_node(each, "node", *(F.first(w).alias(w) for w in ("n", *WORDS))), "nodes")
    candidates = connected_components(spool(links(nodes, APART, WORDS, n_blocks=BLOCKS, block_bits=BLOCK_BITS), "links"))
    joined = _verified(docs, nodes.drop("salts"), candidates, shingle, least, id_col, text_col)
    none = candidates.where("false") if joined is None else joined
    return numbered(each.select("doc_id", "node"), nodes, none).select("doc_id", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those in a group of near copies that has a smaller id. Rows with a null id stay; those of a repeated id go only if all of them have to."""
    gone = similar_groups(docs, id_col, text_col).groupBy(F.col("doc_id").alias(id_col)).agg(F.min(F.col("doc_id") != F.col("component_id")).alias("_gone")).where("_gone")
    return without_ids(docs, spool(gone.select(id_col), "gone", small=True), id_col)
