"""A content-addressed store of token ids.

A rolling hash over the last ids cuts each document's ids into chunks, so equal stretches of ids are cut alike. A chunk's address
is the BLAKE2b digest of its ids; each address is stored once, in one of the pack files. A recipe lists the addresses of a
document's chunks in order and where its ids start in the stream of all documents by ascending doc_id; its Merkle root, the packs' roots
and one root over all of them (the manifest) tell whether what is read back is what was written. Every reader checks them: the root when a store is
opened, a pack's root over the chunks found in it, each chunk against its address, and a recipe's root against its addresses; what is missing is an error.

Folder: packs/, rows/ (Parquet: index and packs), recipes/ (Parquet) and root/ (Parquet, one row, written last: without it there is no store).

Pack file: 8 bytes "TWPACK1\\n", then the chunks, which the index addresses by offset and length. Each is a byte, 2 or 4, and a Zstandard
frame of the ids as little-endian integers of so many bytes, split into byte planes (all lowest bytes first).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import Writer, read_ranges
from .kernels import mix
from .ranges import running_start
from .shared import fresh_path, partitions, text_chunks, texts_of, tidied
from .tokens import encoder

#: Fixed value: what a pack starts with.
MAGIC = b"TWPACK1\n"
#: A cut falls where the rolling hash of WINDOW ids has CUT_BITS low zero bits, LEAST ids after the last one or later, and MOST ids after it in any case.
WINDOW, CUT_BITS, LEAST, MOST = 16, 10, 512, 8192
DIGEST = 16
END_ID = 1


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one document's ids."""
    n = len(ids)
    if n <= LEAST:
        return [n]
    h = mix(ids.astype(np.uint64))
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(h)))
    turn = total[WINDOW:] - total[:-WINDOW]  # of the WINDOW ids that end at WINDOW, WINDOW + 1, ...
    marks = np.flatnonzero((mix(turn) & np.uint64((1 << CUT_BITS) - 1)) == 0) + WINDOW
    out, last = [], 0
    for m in [*marks.tolist(), n]:
        while m - last > MOST:
            last += MOST
            out.append(last)
        if m - last >= LEAST and m < n:
            out.append(m)
            last = m
    return [*out, n] if not out or out[-1] != n else out


@lru_cache(maxsize=1)
def _zstd() -> tuple:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def press(ids: np.ndarray) -> bytes:
    """Chunk payload: width, then byte planes of the ids, compressed."""
    width = 2 if ids.max(initial=0) < 1 << 16 else 4
    return bytes([width]) + _zstd()[0].compress(ids.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes())


def unpress(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(_zstd()[1].decompress(data[1:]), dtype=np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype("<u4")


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of a binary tree of digests (an odd one moves up as it is); of no leaves, the digest of nothing."""
    if not leaves:
        return blake2b(b"", digest_size=DIGEST).digest()
    while len(leaves) > 1:
        leaves = [blake2b(b"".join(leaves[i : i + 2]), digest_size=DIGEST).digest() if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0]


@lru_cache(maxsize=1)
def _zero_tables() -> np.ndarray:
    """For k from 0: four byte tables of the map "a CRC-32, then 2 ** k zero bytes" (a matrix over GF(2), squared again and again)."""
    odd = np.array([0xEDB88320, *(1 << i for i in range(31))], dtype=np.uint64)  # one zero bit

    def times(m: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = np.zeros_like(v)
        for i in range(32):
            out ^= np.where((v >> np.uint64(i)) & np.uint64(1) == 1, m[i], np.uint64(0))
        return out

    step = odd
    for _ in range(3):
        step = times(step, step)  # 2, 4, 8 zero bits: one byte
    tables = []
    byte = np.arange(256, dtype=np.uint64)
    for _ in range(48):
        tables.append(np.stack([times(step, byte << np.uint64(8 * j)) for j in range(4)]))
        step = times(step, step)
    return np.stack(tables)


def crc_shift(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """CRC-32s as they enter the CRC-32 of a longer text in which n_bytes follow: crc(a + b) = crc_shift(crc(a), len(b)) ^ crc(b)."""
    tables, crc = _zero_tables(), crc.astype(np.uint64)
    for k in range(int(n_bytes.max(initial=0)).bit_length()):
        on = np.flatnonzero((n_bytes >> k) & 1)
        c = crc[on].astype(np.int64)
        t = tables[k]
        crc[on] = t[0][c & 255] ^ t[1][(c >> 8) & 255] ^ t[2][(c >> 16) & 255] ^ t[3][c >> 24]
    return crc.astype(np.int64)


@dataclass
class Store:
    """index (address, pack, at, size, n_ids), recipes (doc_id, row, n_ids, start, root, addresses, ends), manifest (pack, root, n_chunks); root: over the packs."""

    path: str
    index: DataFrame
    recipes: DataFrame
    manifest: DataFrame
    root: bytes


_RECIPE = "doc_id long, row long, n_ids long, root binary, addresses binary, ends array<long>"


def write_store(docs: DataFrame, tokenizer: str, end_id: int = END_ID, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> Store:
    """Encode every text, append end_id, and store the ids. A null text is empty: its ids are end_id alone. Repeated ids keep a recipe a row; among
    equal ids the order in the stream is any. A null id comes first. An empty table gives an empty store. Other columns are not looked at.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "store")
    schema = "to long, address binary, data binary, n_ids long, recipe struct<" + _RECIPE.replace(" ", ":").replace(",:", ",") + ">"
    recipe_type = pa.struct([("doc_id", pa.int64()), ("row", pa.int64()), ("n_ids", pa.int64()), ("root", pa.binary()), ("addresses", pa.binary()), ("ends", pa.list_(pa.int64()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sent = encoder(tokenizer), set()
        for part, texts in text_chunks(batches, rows=512):
            chunks, recipes = [], []
            for d, row, ids in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), own.encode([t.decode("utf-8", "replace") for t in texts]), strict=True):
                ids = np.append(ids, np.uint32(end_id))
                ends, at, addresses = cuts(ids), 0, []
                for end in ends:
                    chunk = ids[at:end]
                    address = blake2b(chunk.astype("<u4").tobytes(), digest_size=DIGEST).digest()
                    addresses.append(address)
                    if address not in sent:  # a task sends a chunk once
                        sent.add(address)
                        chunks.append((address, press(chunk), end - at))
                    at = end
                recipes.append({"doc_id": d, "row": row, "n_ids": len(ids), "root": merkle_root(addresses), "addresses": b"".join(addresses), "ends": ends})
            n, m = len(chunks), len(recipes)
            to = [int.from_bytes(c[0][:8], "little", signed=True) for c in chunks] + [r["row"] for r in recipes]
            yield pa.RecordBatch.from_arrays(
                [pa.array(to, type=pa.int64()), pa.array([c[0] for c in chunks] + [None] * m, type=pa.binary()), pa.array([c[1] for c in chunks] + [None] * m, type=pa.binary()), pa.array([c[2] for c in chunks] + [None] * m, type=pa.int64()), pa.array([None] * n + recipes, type=recipe_type)],
                names=["to", "address", "data", "n_ids", "recipe"],
            )

    out_schema = "address binary, pack string, at long, size long, n_ids long, recipe struct<" + _RECIPE.replace(" ", ":").replace(",:", ",") + ">, pack_root binary, n_chunks long"

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks come sorted by address; equal ones, from different tasks, follow one another."""
        out, last, leaves = None, None, []
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            recipes = []
            for address, data, n, recipe in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
                if recipe is not None:
                    recipes.append(recipe)
                elif address != last:
                    if out is None:
                        out = Writer(f"{path}/packs", "pack")
                        out.write(MAGIC)
                    last = address
                    leaves.append(address)
                    for column, x in zip(rows, (address, out.uri, *out.write(data), n), strict=True):
                        column.append(x)
            m = len(recipes)
            kinds = (pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.array(c + [None] * m, type=k) for c, k in zip(rows, kinds, strict=True)), pa.array([None] * len(rows[0]) + recipes, type=recipe_type), pa.nulls(len(rows[0]) + m, pa.binary()), pa.nulls(len(rows[0]) + m, pa.int64())], names=["address", "pack", "at", "size", "n_ids", "recipe", "pack_root", "n_chunks"])
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.binary()), pa.array([out.uri]), *(pa.nulls(1, pa.int64()) for _ in range(3)), pa.nulls(1, recipe_type), pa.array([merkle_root(leaves)], type=pa.binary()), pa.array([len(leaves)], type=pa.int64())], names=["address", "pack", "at", "size", "n_ids", "recipe", "pack_root", "n_chunks"])

    given = texts_of(docs, id_col, text_col, [F.monotonically_increasing_id().alias("row")])
    dealt = given.mapInArrow(tidied(encode), schema).repartition(partitions(spark), F.hash("to")).sortWithinPartitions("address")
    dealt.mapInArrow(tidied(store), out_schema).write.parquet(f"{path}/rows")
    made = spark.read.parquet(f"{path}/rows")
    recipes = running_start(made.where("recipe is not null").select("recipe.*"), "doc_id", "n_ids", "start", tie="row")
    recipes.select("doc_id", "row", "n_ids", "start", "root", "addresses", "ends").write.parquet(f"{path}/recipes")
    packs = made.where("pack_root is not null").select("pack", F.col("pack_root").alias("root"), "n_chunks")
    stated = _stated(packs, spark.read.parquet(f"{path}/recipes"))
    spark.createDataFrame([stated], _ROOT).write.parquet(f"{path}/root")
    return open_store(spark, path)


_ROOT = "root binary, n_packs long, n_recipes long, recipes_sum decimal(38,0)"


def _stated(packs: DataFrame, recipes: DataFrame) -> tuple:
    """What the root row states. A row a pack, of which there are as many as tasks, comes to the driver; of the recipes only a count and a sum of hashes."""
    roots = sorted(bytes(r["root"]) for r in packs.select("root").collect())
    n, total = recipes.agg(F.count("*"), F.sum(F.xxhash64("doc_id", "row", "n_ids", "start", "root").cast("decimal(38,0)"))).first()
    return merkle_root(roots), len(roots), n, total


def open_store(spark: SparkSession, path: str) -> Store:
    """A store written before. Packs or recipes other than those its root row states are an error."""
    made = spark.read.parquet(f"{path}/rows")
    index = made.where("address is not null").select("address", "pack", "at", "size", "n_ids")
    packs = made.where("pack_root is not null").select("pack", F.col("pack_root").alias("root"), "n_chunks")
    recipes = spark.read.parquet(f"{path}/recipes")
    said = spark.read.parquet(f"{path}/root").first()
    stated = (bytes(said["root"]), *said[1:])
    if _stated(packs, recipes) != stated:
        raise ValueError(f"the packs or recipes of {path} are not those that its root states")
    return Store(path, index, recipes, packs, stated[0])


def _read_chunks(store: Store, with_data: bool) -> DataFrame:
    """(address, n_ids, crc[, data]) of every stored chunk, read from the packs in coalesced ranges.

    A chunk whose ids don't give its address, and a pack whose chunks don't give its root, are errors.
    """
    spark = store.index.sparkSession
    packs = spark.sparkContext.broadcast({r["pack"]: (bytes(r["root"]), r["n_chunks"]) for r in store.manifest.collect()})  # a row a pack: as many as tasks

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ranges():
            for batch in batches:
                for pack, at, size, address in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 0)), strict=True):
                    yield pack, at, size, (pack, address)

        held: list[tuple] = []
        now, leaves = None, []

        def out():
            a, n, c, d = zip(*held, strict=True)
            held.clear()
            arrays = [pa.array(a, type=pa.binary()), pa.array(n, type=pa.int64()), pa.array(c, type=pa.int64())] + ([pa.array(d, type=pa.binary())] if with_data else [])
            return pa.RecordBatch.from_arrays(arrays, names=["address", "n_ids", "crc", "data"][: len(arrays)])

        def close():
            if now is not None and packs.value.get(now) != (merkle_root(leaves), len(leaves)):
                raise ValueError(f"the index of pack {now} is not what its root states")

        for (pack, address), data in read_ranges(ranges()):
            if pack != now:
                close()
                now, leaves = pack, []
            leaves.append(address)
            raw = unpress(data).tobytes()
            if blake2b(raw, digest_size=DIGEST).digest() != address:
                raise ValueError(f"chunk {address.hex()} is damaged")
            held.append((address, len(raw) // 4, zlib.crc32(raw), raw if with_data else None))
            if len(held) >= 256:
                yield out()
        close()
        if held:
            yield out()

    dealt = store.index.repartition(partitions(spark), "pack").sortWithinPartitions("pack", "at")
    return dealt.mapInArrow(tidied(read), "address binary, n_ids long, crc long" + ", data binary" * with_data)


def _uses(store: Store) -> DataFrame:
    """(row, k, address, n, after) of each chunk of each recipe; after: the ids behind it in its document. A recipe whose addresses don't give its root is an error."""

    names = ["row", "k", "address", "n", "after"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one = pc.and_(pc.equal(pc.binary_length(batch.column(3)), DIGEST), pc.equal(pc.list_value_length(batch.column(4)), 1))
            short, batch = batch.filter(one), batch.filter(pc.invert(one))
            if short.num_rows:  # of one chunk, whose address is the root
                row, n_ids, root, address, ends = short.columns
                if not (address.equals(root) and pc.list_flatten(ends).equals(n_ids)):
                    raise ValueError("a recipe differs from its root")
                zero = np.zeros(len(row), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([row, pa.array(zero.astype(np.int32)), address, n_ids, pa.array(zero)], names=names)
            out: tuple[list, ...] = ([], [], [], [], [])
            for row, n_ids, root, addresses, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = [addresses[i : i + DIGEST] for i in range(0, len(addresses), DIGEST)]
                if merkle_root(own) != root or len(own) != len(ends) or ends[-1] != n_ids:
                    raise ValueError(f"recipe {row} differs from its root")
                for k, (address, end) in enumerate(zip(own, ends, strict=True)):
                    for column, x in zip(out, (row, k, address, end - (ends[k - 1] if k else 0), n_ids - end), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=names)

    return store.recipes.select("row", "n_ids", "root", "addresses", "ends").mapInArrow(tidied(run), "row long, k int, address binary, n long, after long")


def _met(store: Store, with_data: bool) -> DataFrame:
    """(row, k, n, after, address, crc[, data]) of each use of a chunk; one that no pack holds is an error. The uses of a chunk of very many documents are
    the left side of an outer join, which Spark splits where it is skewed (spark.sql.adaptive.skewJoin).
    """
    met = _uses(store).join(_read_chunks(store, with_data).withColumnRenamed("n_ids", "_n"), "address", "left")
    whole = F.col("_n").isNotNull() & (F.col("_n") == F.col("n"))
    lost = F.raise_error(F.concat(F.lit("a chunk of recipe "), F.col("row").cast("string"), F.lit(" is missing or of another length")))
    crc = F.when(whole, F.col("crc")).otherwise(lost.cast("long"))
    return met.select("row", "k", "n", "after", "address", crc.alias("crc"), *(["data"] if with_data else []))


def checksums(store: Store) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) by document, from the files: each pack is read once, and the chunks' checksums are put together by the recipes.

    Only checksums travel, not ids: of a + b the CRC-32 is that of a moved past len(b) bytes, xor that of b. What is damaged or missing is an error.
    """

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, n, crc, after = (batch.column(i).to_numpy() for i in range(4))
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(n), pa.array(crc_shift(crc, after * 4))], names=["row", "n", "crc"])

    parts = _met(store, False).select("row", "n", "crc", "after").mapInArrow(tidied(move), "row long, n long, crc long")
    by_row = parts.groupBy("row").agg(F.sum("n").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"))
    return store.recipes.join(by_row, "row", "left").select("doc_id", "start", "n_tokens", "ids_crc32")


def read_documents(store: Store, in_order: bool = False) -> DataFrame:
    """(doc_id, start, ids binary): whole documents, put together from their chunks; in_order: by ascending start, the order of the stream.

    What is damaged or missing is an error, also a document whose chunks don't give its Merkle root. A document is put together in one task.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = []
            for root, parts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if merkle_root([blake2b(p["data"], digest_size=DIGEST).digest() for p in parts]) != root:
                    raise ValueError("a document differs from its recipe")
                ids.append(b"".join(p["data"] for p in parts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, type=pa.binary())], names=["doc_id", "start", "ids"])

    parts = _met(store, True).where("crc is not null").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("k", "data"))).alias("parts"))
    found = store.recipes.join(parts, "row", "left").select("doc_id", "start", "root", "parts").mapInArrow(tidied(check), "doc_id long, start long, ids binary")
    return found.orderBy("start") if in_order else found


def op10(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .shared import table

    return checksums(write_store(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
