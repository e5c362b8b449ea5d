"""Substring deduplication by recompression.

A text is a row of words. Each round replaces neighbours by one symbol: first runs of one word, then pairs whose left symbol falls
on one side of a random split of the symbols and whose right one falls on the other. Whether two neighbours join depends on them
alone, so equal substrings get equal symbols except near their ends, where each round can spoil one symbol. A symbol's name is
a fingerprint of what it stands for, so names are the same in every task, and a Spark round over all names tells the shared ones.

With runs of at most RUN words, symbols of at most REACH words and ROUNDS pair rounds, at most MARGIN words at either end of a
substring are spoilt; what is left of a window of 50 words always holds the start of an unspoilt symbol. Each window is keyed by one
of these (the least name), extended to a higher symbol that spans MARGIN words either side. Windows with equal words have
equal keys. Keys seen in one document only are dropped; windows under shared keys are told apart by a second 64-bit fingerprint of their
words, so that two different windows pass for equal only where both fingerprints, 128 bits, agree. Words themselves are not compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import Words, mix, words
from .shared import partitions, spool, text_chunks, texts_of, tidied

WINDOW = 50
RUN, REACH, ROUNDS = 3, 6, 3
MARGIN = RUN + RUN + REACH + REACH
STARTS = WINDOW - 2 * MARGIN - REACH + 1
assert STARTS >= REACH
GROUP = 32
#: Fewest and most bits of a set that is sent to the executors (64 MB at most, however large the input); a false hit costs time only.
LEAST_BITS, MOST_BITS = 1 << 22, 1 << 29

_BASE = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


def _powers(n: int) -> np.ndarray:
    p = np.empty(n, dtype=np.uint64)
    p[0] = 1
    p[1:] = _BASE
    return np.multiply.accumulate(p)


def _inverse_powers(n: int) -> np.ndarray:
    p = np.empty(n, dtype=np.uint64)
    p[0] = 1
    p[1:] = pow(int(_BASE), -1, 1 << 64)
    return np.multiply.accumulate(p)


def spans(prefix: np.ndarray, inverse: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of word ranges [at, end) from prefix sums of name * base ** place."""
    return mix((prefix[end] - prefix[at]) * inverse[at])


def symbol_starts(name: np.ndarray, doc: np.ndarray, prefix: np.ndarray, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where symbols start after all rounds, and their names."""
    n = len(name)
    at = np.arange(n)
    new = np.ones(n, dtype=bool)
    new[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, n))
    keep = new | np.repeat(size > RUN, size)  # runs of up to RUN words become one symbol
    at = at[keep]
    for turn in range(ROUNDS):
        end = np.append(at[1:], n)
        symbol = spans(prefix, inverse, at, end)
        side = (mix(symbol ^ _U(0xA5A5 + 977 * turn)) >> _U(63)).astype(bool)
        joins = ~side[:-1] & side[1:] & (end[1:] - at[:-1] <= REACH) & (doc[at[1:]] == doc[at[:-1]])
        kept = np.ones(len(at), dtype=bool)
        kept[1:] = ~joins
        at = at[kept]
    return at, spans(prefix, inverse, at, np.append(at[1:], n))


def keyed_windows(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of WINDOW words within one text: its first word, its key, and its fingerprint."""
    n = len(w.name)
    if n < WINDOW:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    inverse = _inverse_powers(n + 1)
    prefix = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(w.name * _powers(n))))
    at, name = symbol_starts(w.name, w.doc, prefix, inverse)
    none = _U(2**64 - 1)
    rank = np.full(n, none)
    rank[at] = mix(name) & _U(2**64 - 2)
    window = np.flatnonzero(w.doc[WINDOW - 1 :] == w.doc[: n - WINDOW + 1])
    if not len(window):
        return window, np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    least, width = rank, 1  # over `width` places from each
    while width * 2 <= STARTS:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (STARTS - width)], least[STARTS - width :]) if width < STARTS else least
    low = window + MARGIN
    goal = least[low]
    anchor = low.copy()
    for j in range(STARTS - 1, -1, -1):
        hit = rank[low + j] == goal
        anchor[hit] = low[hit] + j
    key = spans(prefix, inverse, anchor - MARGIN, anchor + MARGIN)
    return window, key, spans(prefix, inverse, window, window + WINDOW)


def _groups(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Starts of the runs of consecutive windows under one key, cut after GROUP windows: a row's flags are bits of a long."""
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(new)
    since = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
    return np.flatnonzero(since % GROUP == 0)


def shared_keys(docs: DataFrame) -> DataFrame:
    """(key, n): keys that occur in more than one document, with their number of occurrences, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches):
            ids = part.column(0).to_numpy()
            w = words(texts)
            window, key, _ = keyed_windows(w)
            g = _groups(key, window)
            yield pa.RecordBatch.from_arrays([pa.array(key[g].view(np.int64)), pa.array(ids[w.doc[window[g]]])], names=["key", "doc_id"])

    named = docs.mapInArrow(tidied(run), "key long, doc_id long").groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n"))
    return spool(named.where("a <> b").select("key", "n"), "shared-keys", small=True)


def bit_set(df: DataFrame, value: str) -> np.ndarray:
    """A set of bits with those of the longs in column `value` (their low bits): 32 to 64 bits a value within the bounds, built by Spark, small on the driver."""
    n = df.count()
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (32 * n).bit_length()))
    bit = df.select(F.col(value).bitwiseAND(F.lit(size - 1)).alias("bit"))
    found = bit.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros(size // 8, dtype=np.uint8)
    for r in found.collect():  # 64 MB at most
        at = (r["bucket"] - 1) * 4096  # Spark's bucket 1 holds bits 1 to 32768; bit 0 lies before it and needs no place
        if at >= 0:
            got = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
            out[at : at + len(got)] |= got[: len(out) - at]
    return out


def _has(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Membership of keys: Spark puts value v at bit (v - 1) % 32768 of bucket 1 + (v - 1) // 32768. Value 0 always passes."""
    v = (key & _U(8 * len(bits) - 1)).astype(np.int64) - 1
    return (v < 0) | ((bits[v >> 3] >> (v & 7).astype(np.uint8)) & 1).astype(bool)


def repeated_windows(docs: DataFrame, hot_rows: int = 256, hot_keys: int = 1 << 16) -> DataFrame:
    """(doc_id, body, at, bits): words at + k of the document start a repeated window where bit k is set. docs: (doc_id, text bytes).

    body is a fingerprint of the whole text, which tells rows that share an id apart. A key with over hot_rows occurrences (and at
    most hot_keys keys are taken so) is dealt out by window instead of by key, and each task sends of equal windows under
    it only those in smaller documents than it has seen; the others are known to be repeated.
    """
    spark = docs.sparkSession
    known = shared_keys(docs)
    total = known.agg(F.sum("n")).first()[0] or 0
    often = max(hot_rows, total // hot_keys)
    hot = np.sort(np.array([r["key"] for r in known.where(F.col("n") > often).select("key").collect()], dtype=np.int64).view(np.uint64))
    shared = spark.sparkContext.broadcast((bit_set(known, "key"), hot))
    names = ["key", "piece", "doc_id", "body", "at", "marks", "bits"]
    schema = "key long, piece int, doc_id long, body long, at int, marks binary, bits long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hot = shared.value
        least: dict[bytes, int] = {}
        for part, texts in text_chunks(batches):
            ids = part.column(0).to_numpy()
            w = words(texts)
            window, key, mark = keyed_windows(w)
            keep = _has(bits, key)
            window, key, mark = window[keep], key[keep], mark[keep]
            if not len(window):
                continue
            first = np.searchsorted(w.doc, np.arange(len(texts)))
            body = bodies(w, len(texts))
            g = _groups(key, window)
            ends = np.append(g[1:], len(key))
            raw, doc, at = mark.tobytes(), w.doc[window[g]], (window[g] - first[w.doc[window[g]]]).astype(np.int32)
            place = np.searchsorted(hot, key[g])
            is_hot = np.zeros(len(g), dtype=bool) if not len(hot) else hot[np.minimum(place, len(hot) - 1)] == key[g]
            cold = np.flatnonzero(~is_hot)
            marks = [raw[8 * a : 8 * b] for a, b in zip(g[cold].tolist(), ends[cold].tolist(), strict=True)]
            zero = np.zeros(len(cold), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key[g[cold]].view(np.int64)), pa.array(zero.astype(np.int32)), pa.array(ids[doc[cold]]), pa.array(body[doc[cold]]), pa.array(at[cold]), pa.array(marks, type=pa.binary()), pa.array(zero)], names=names)
            rows = []
            for i in np.flatnonzero(is_hot).tolist():
                d, done = int(ids[doc[i]]), 0
                name = key[g[i]].tobytes()
                for j, a in enumerate(range(int(g[i]), int(ends[i]))):
                    m = raw[8 * a : 8 * a + 8]
                    if least.get(name + m, d) < d:
                        done |= 1 << j
                    else:
                        least[name + m] = d
                        rows.append((int(key[g[i]].view(np.int64)), int.from_bytes(m[:3], "little"), d, int(body[doc[i]]), int(at[i]) + j, m, 0))
                if done:
                    rows.append((int(body[doc[i]]) ^ int(at[i]), -1, d, int(body[doc[i]]), int(at[i]), b"", done))
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=_arrow(schema))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key, piece and doc_id; held are the windows that smaller documents have under the key at hand."""
        now, seen, doc_now, fresh = None, set(), None, []
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for k, p, d, b, a, m, bits in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if (k, p) != now:
                    now, seen, doc_now, fresh = (k, p), set(), d, []
                elif d != doc_now:
                    seen.update(fresh)
                    doc_now, fresh = d, []
                for i in range(0, len(m), 8):
                    x = m[i : i + 8]
                    if x in seen:
                        bits |= 1 << (i >> 3)
                    else:
                        fresh.append(x)
                if bits:
                    for column, x in zip(out, (d, b, a, bits), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], type=pa.int64()), pa.array(out[1], type=pa.int64()), pa.array(out[2], type=pa.int32()), pa.array(out[3], type=pa.int64())], names=["doc_id", "body", "at", "bits"])

    rows = docs.mapInArrow(tidied(run), schema).repartition(partitions(spark), "key", "piece").sortWithinPartitions("key", "piece", "doc_id")
    return rows.mapInArrow(tidied(verify), "doc_id long, body long, at int, bits long")


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(n, kinds[t]) for n, t in (c.split() for c in schema.split(", "))])


def bodies(w: Words, n_texts: int) -> np.ndarray:
    """A fingerprint of each whole text's words."""
    n = len(w.name)
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mix(w.name ^ mix((np.arange(n) - np.searchsorted(w.doc, w.doc)).astype(np.uint64))))))
    edge = np.searchsorted(w.doc, np.arange(n_texts + 1))
    return mix(total[edge[1:]] - total[edge[:-1]]).view(np.int64)


def _cut(w: Words, a: int, b: int, text: bytes, offset: int, flagged: list) -> tuple[bytes, int, bytes]:
    """Of words a to b without those that flagged windows cover: the text left, how many went, and the SHA-256 of the words left."""
    n = b - a
    gone = np.zeros(n + 1, dtype=np.int64)
    for at, bits in flagged:
        for k in range(bits.bit_length()):
            if bits >> k & 1:
                gone[at + k] += 1
                gone[min(n, at + k + WINDOW)] -= 1
    kept = np.cumsum(gone[:n]) == 0
    edge = np.flatnonzero(np.diff(np.concatenate(([False], kept, [False])).astype(np.int8)))
    start, end = w.start[a:b], w.end[a:b]
    pieces = []
    for i, j in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
        left = 0 if i == 0 else int(start[i]) - offset
        pieces.append(text[left : len(text) if j == n else int(end[j - 1]) - offset])
    left = text if n and kept.all() else b" ".join(pieces)
    return left, int(n - kept.sum()), hashlib.sha256(b" ".join(left.split())).hexdigest().encode()


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = True) -> DataFrame:
    """Remove every word that lies in a window of WINDOW words whose words also start in a document with a smaller id.

    Windows are judged on the input. Returns (doc_id, text, n_words, n_removed, kept_sha256) and, with carry, `row`: a struct of
    the other columns, so that no name can clash, in which `_` tells whether there was a text. Text without removals comes back byte for byte; else the kept stretches, joined
    by one space. A null text has no words and comes back empty; a row with a null id is left as it is and no witness for others;
    of repeated ids each row is judged by smaller ids only; an empty table gives no rows.
    """
    spark = docs.sparkSession
    given = texts_of(docs.where(F.col(id_col).isNotNull()), id_col, text_col)
    flags = spool(repeated_windows(given), "flags", small=True)
    touched = spark.sparkContext.broadcast(bit_set(flags.select(F.xxhash64("doc_id").alias("h")).distinct(), "h"))
    extra = [F.struct(F.col(text_col).isNotNull().alias("_"), *(F.col(c) for c in docs.columns if c != text_col)).alias("row")] if carry else []
    hashed = texts_of(docs, id_col, text_col, [F.xxhash64(F.col(id_col).cast("long")).alias("h"), *extra])
    row = f", row {docs.select(*extra).schema['row'].dataType.simpleString()}" if carry else ""
    tail = ["row"] if carry else []

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(_pick(batches, touched.value, False)):
            split = [t.split() for t in texts]
            digest = [hashlib.sha256(b" ".join(s)).hexdigest() for s in split]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, type=pa.binary()), pa.array([len(s) for s in split], type=pa.int64()), pa.array([0] * len(split), type=pa.int64()), pa.array(digest), *part.columns[3:]], names=["doc_id", "text", "n_words", "n_removed", "kept_sha256", *tail])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(_pick(batches, touched.value, True)):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, type=pa.binary()), pa.array(bodies(words(texts), len(texts))), *part.columns[3:]], names=["doc_id", "text", "body", *tail])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches, rows=512):
            w = words(texts)
            edge = np.searchsorted(w.doc, np.arange(len(texts) + 1)).tolist()
            offset, out = 0, []
            for i, (t, marks) in enumerate(zip(texts, part.column(2).to_pylist(), strict=True)):
                out.append((*_cut(w, edge[i], edge[i + 1], t, offset, [(m["at"], m["bits"]) for m in marks or []]), edge[i + 1] - edge[i]))
                offset += len(t) + 1
            text, gone, digest, n = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(text, type=pa.binary()), pa.array(n, type=pa.int64()), pa.array(gone, type=pa.int64()), pa.array([x.decode() for x in digest]), *part.columns[3:]], names=["doc_id", "text", "n_words", "n_removed", "kept_sha256", *tail])

    result = "doc_id long, text binary, n_words long, n_removed long, kept_sha256 string" + row
    marks = flags.groupBy("doc_id", "body").agg(F.collect_list(F.struct("at", "bits")).alias("marks"))
    candidates = hashed.mapInArrow(tidied(named), "doc_id long, text binary, body long" + row)
    joined = candidates.join(marks, ["doc_id", "body"], "left").select("doc_id", "text", "marks", *tail)
    both = hashed.mapInArrow(tidied(clean), result).unionByName(joined.mapInArrow(tidied(cut), result))
    return both.withColumn("text", F.col("text").cast("string"))


def _pick(batches: Iterator[pa.RecordBatch], bits: np.ndarray, inside: bool) -> Iterator[pa.RecordBatch]:
    """Rows whose hash (column 2) is in the set, or is not."""
    for batch in batches:
        got = _has(bits, batch.column(2).to_numpy().view(np.uint64)) == inside
        if got.any():
            yield batch.filter(pa.array(got))


def op4(spark, sf_dir: str) -> DataFrame:
    from .shared import table

    return deduplicate(table(spark, sf_dir, "documents"), carry=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with the same columns, repeated passages cut from the texts; n_chars, where there is one, counts the text left. A null text that stays so is null again."""
    done = deduplicate(docs)
    text = F.when(F.col("row._"), F.col("text"))
    anew = {"text": text.alias("text"), "n_chars": F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("row.n_chars")).alias("n_chars") if "n_chars" in docs.columns else None}
    return done.select(*(anew[c] if c in anew else F.col("row")[c].alias(c) for c in docs.columns))
