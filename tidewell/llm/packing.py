"""Best-fit packing by bin completion.

Documents become pieces of at most `capacity` tokens. What packing needs to know is how many pieces there are of each length: at
most `capacity` numbers, however large the corpus. The search runs on these counts: around the largest length left it enumerates
the undominated fillings of a bin, uses one as often as counts allow, and branches; the waste so far bounds the number of bins from below
and prunes; the best-fit-decreasing packing is the first incumbent. Parts of the packing found are searched once more, a bin at a time. Pieces of one length are alike, so the plan is a short
list "rank r to r + n of length l go to sequences s to s + n at offset o", by which each piece finds its place.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import spool, text_chunks, texts_of, tidied
from .tokens import encoder

CAPACITY = 1024
END_ID = 2
#: The search on counts: choices made, after which the best packing so far stands, and fillings tried at a node.
MAX_STEPS, FILLINGS = 3_000, 3
#: The search in parts: bins of a part, fillings tried at a node, steps of a round, rounds without a gain after which it ends.
REPACK_BINS, REPACK_FILLINGS, REPACK_STEPS, REPACK_ROUNDS = 80, 8, 200, 8
#: Steps of a round where the part is all there is.
WHOLE_STEPS = 20_000
#: Totals of fillings that all searches in parts try together, a second or two of work.
MOST_WORK = 60_000
#: The relaxation: share of bins above the waste bound beyond which it is asked, and exchanges of a pattern it may make.
RELAX_GAP, RELAX_ROUNDS = 0.002, 1_500

Pattern = tuple[tuple[int, ...], int]


def waste_bound(counts: np.ndarray, capacity: int) -> int:
    """A lower bound on bins (Martello and Toth): pieces over half need a bin each, and what the others add beyond the room left."""
    sizes = np.arange(len(counts))
    best = -(-int((counts * sizes).sum()) // capacity)
    for k in range(capacity // 2 + 1):
        big = int(counts[sizes > capacity - k].sum())
        mid = (sizes > capacity / 2) & (sizes <= capacity - k)
        small = (sizes <= capacity / 2) & (sizes >= max(k, 1))
        room = int((counts[mid] * (capacity - sizes[mid])).sum())
        rest = int((counts[small] * sizes[small]).sum())
        best = max(best, big + int(counts[mid].sum()) + max(0, -(-(rest - room) // capacity)))
    return best


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best-fit decreasing on counts: bins with equal contents are one entry."""
    open_bins: dict[int, dict[tuple[int, ...], int]] = {}  # room -> contents -> bins
    for size in range(len(counts) - 1, 0, -1):
        left = int(counts[size])
        while left:
            room = next((r for r in range(size, capacity + 1) if open_bins.get(r)), None)
            if room is None:
                fit = capacity // size
                if left >= fit:
                    open_bins.setdefault(capacity - fit * size, {})[(size,) * fit] = left // fit
                if left % fit:
                    k = left % fit
                    open_bins.setdefault(capacity - k * size, {})[(size,) * k] = 1
                left = 0
                continue
            contents, n = open_bins[room].popitem()
            fit = room // size
            if left < fit:
                uses, fit = 1, left
            else:
                uses = min(n, left // fit)
            if n > uses:
                open_bins[room][contents] = n - uses
            new = contents + (size,) * fit
            at = open_bins.setdefault(room - fit * size, {})
            at[new] = at.get(new, 0) + uses
            left -= uses * fit
    return [(c, n) for bins in open_bins.values() for c, n in bins.items()]


def dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the pieces of b, falling, can be put into those of a, so that a bin with a leaves no more behind than one with b."""

    def put(room: list[int], k: int) -> bool:
        return k == len(b) or any(put([*room[:i], r - b[k], *room[i + 1 :]], k + 1) for i, r in enumerate(room) if r >= b[k] and r not in room[:i])

    return put(list(a), 0)


def all_fillings(counts: np.ndarray, room: int) -> list[tuple[int, ...]]:
    """Every undominated filling of `room`, of any number of pieces, fullest first."""
    sizes = [int(s) for s in np.flatnonzero(counts[: room + 1])[::-1] if s]
    found: list[tuple[int, ...]] = []

    def extend(at: int, left: int, held: tuple[int, ...]) -> None:
        if at == len(sizes):
            if not any(s <= left and held.count(s) < counts[s] for s in sizes):  # nothing more fits
                found.append(held)
            return
        s = sizes[at]
        for k in range(min(int(counts[s]), left // s), -1, -1):
            extend(at + 1, left - k * s, held + (s,) * k)

    extend(0, room, ())
    found.sort(key=lambda f: (-sum(f), len(f)))
    kept: list[tuple[int, ...]] = []
    for f in found:
        if not any(dominates(k, f) for k in kept):
            kept.append(f)
    return kept


def _fillings(counts: np.ndarray, room: int, most: int, each: int = 1, slack: int | None = None, meter: list[int] | None = None) -> list[tuple[int, ...]]:
    """Up to `most` fillings of `room` that waste at most slack, fullest first; of each total up to `each`, with the fewest pieces that give it, three at most.

    A filling is dominated by one that holds a single piece as large as all of it, so fewer pieces come first. Where three of the largest piece don't fill the
    room, the largest go in first. meter: adds up the totals that were tried, which is what a call costs.
    """
    have = np.flatnonzero(counts[: room + 1])
    have = have[have > 0]
    if not len(have):
        return [()] if slack is None or room <= slack else []
    largest = int(have[-1])
    if room > 3 * largest:
        n = max(0, min(int(counts[largest]), room // largest - 2))
        if n:
            after = counts.copy()
            after[largest] -= n
            return [(largest,) * n + f for f in _fillings(after, room - n * largest, most, each, slack, meter)]
    found: list[tuple[int, ...]] = []
    there = np.zeros(room + 1, dtype=bool)
    there[have] = True
    for total in range(room, max(0, -1 if slack is None else room - slack - 1), -1):
        if meter is not None:
            meter[0] += 1
        own = [(total,)] if there[total] else []
        if len(own) < each:
            low = have[have <= total // 2]
            pairs = low[there[total - low] & ((total - low != low) | (counts[low] >= 2))]
            own += [(total - a, a) for a in pairs[: each - len(own)].tolist()]
        if not own:
            for a in have[have <= total // 3].tolist():
                rest = total - a
                b = have[(have >= a) & (have <= rest // 2)]
                c = rest - b
                for x, y in zip(b[there[c]].tolist(), c[there[c]].tolist(), strict=True):
                    three = (y, x, a)
                    if all(counts[s] >= three.count(s) for s in three):
                        own.append(three)
                        break
                if len(own) >= each:
                    break
        found += own
        if len(found) >= most:
            break
    return found[:most] or ([()] if slack is None else [])


def exact(counts: np.ndarray, capacity: int, best: list[Pattern], goal: int) -> list[Pattern]:
    """The fewest bins there are: every undominated filling around the largest piece, one bin at a time, pruned by waste bounds. For small instances."""
    held, least = best, sum(n for _, n in best)
    total = int((counts * np.arange(len(counts))).sum())
    seen: dict[bytes, int] = {}

    def branch(left: np.ndarray, used: list[Pattern], waste: int) -> None:
        nonlocal held, least
        sizes = np.flatnonzero(left)
        if not len(sizes):
            if len(used) < least:
                held, least = used, len(used)
            return
        if least <= goal or -(-(total + waste) // capacity) >= least or len(used) + waste_bound(left, capacity) >= least or seen.get(left.tobytes(), least) <= len(used):
            return
        seen[left.tobytes()] = len(used)
        big = int(sizes[-1])
        after = left.copy()
        after[big] -= 1
        for f in all_fillings(after, capacity - big):
            rest = after.copy()
            for s in f:
                rest[s] -= 1
            branch(rest, [*used, ((big, *f), 1)], waste + capacity - big - sum(f))

    branch(counts.copy(), [], 0)
    return held


def relaxed(counts: np.ndarray, capacity: int, rounds: int) -> tuple[list[tuple[tuple[int, ...], float]], float | None]:
    """Patterns with how often each is used, in fractions, in the linear relaxation of packing by whole bins; and its bound on the bins, None if `rounds` were not enough to reach it.

    Prices of the lengths follow from the patterns in use; the filling that is worth most at these prices (a knapsack of the capacity) comes in for one of them, until none is worth more than a bin.
    """
    sizes = np.flatnonzero(counts)
    use = np.diag(capacity // sizes).astype(float)
    amount = counts[sizes] / (capacity // sizes)
    for _ in range(rounds):
        price = np.linalg.solve(use.T, np.ones(len(sizes)))
        worth, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for room in range(int(sizes[0]), capacity + 1):
            fits = sizes[: np.searchsorted(sizes, room, side="right")]
            gain = worth[room - fits] + price[: len(fits)]
            top = int(gain.argmax())
            worth[room], pick[room] = (gain[top], top) if gain[top] > worth[room - 1] + 1e-12 else (worth[room - 1], -1)
        if worth[capacity] <= 1 + 1e-9:
            return [(tuple(np.repeat(sizes, use[:, k].astype(int))[::-1].tolist()), float(x)) for k, x in enumerate(amount) if x > 1e-9], float(amount.sum())
        column, room = np.zeros(len(sizes)), capacity
        while room > 0:
            if pick[room] < 0:
                room -= 1
            else:
                column[pick[room]] += 1
                room -= int(sizes[pick[room]])
        turn = np.linalg.solve(use, column)
        on = np.flatnonzero(turn > 1e-9)
        if not len(on):
            break
        ratio = amount[on] / turn[on]
        out = on[int(ratio.argmin())]
        step = max(0.0, float(ratio.min()))
        amount = np.maximum(amount - step * turn, 0.0)
        amount[out], use[:, out] = step, column
    return [(tuple(np.repeat(sizes, use[:, k].astype(int))[::-1].tolist()), float(x)) for k, x in enumerate(amount) if x > 1e-9], None


def rounded(counts: np.ndarray, capacity: int, patterns: list[tuple[tuple[int, ...], float]]) -> list[Pattern]:
    """Whole numbers of the relaxation's patterns, the largest fractions rounded up while pieces last, and the search on counts for what is left."""
    left, used = counts.copy(), Counter()

    def take(p: tuple[int, ...], n: int) -> None:
        need = np.bincount(p, minlength=len(counts))
        on = need > 0
        n = min(n, int((left[on] // need[on]).min()))
        if n > 0:
            left[on] -= n * need[on]
            used[p] += n

    for p, x in patterns:
        take(p, int(x + 1e-9))
    for p, _ in sorted(patterns, key=lambda t: t[1] % 1, reverse=True):
        take(p, 1)
    rest = best_fit(left, capacity) if left.any() else []
    if rest:
        rest = _on_counts(left, capacity, rest, waste_bound(left, capacity), MAX_STEPS // 10, FILLINGS)
    return [*used.items(), *rest]


def repacked(counts: np.ndarray, capacity: int, bins: int, max_steps: int, rng: np.random.Generator | None, meter: list[int], most: int) -> list[Pattern] | None:
    """A packing into `bins` bins, or None where max_steps find none, or `most` on the meter is used up: bin completion that may waste only what is left over by so many bins."""
    steps = 0

    def branch(left: np.ndarray, slack: int) -> list[Pattern] | None:
        nonlocal steps
        sizes = np.flatnonzero(left)
        if not len(sizes):
            return []
        steps += 1
        big = int(sizes[-1])
        after = left.copy()
        after[big] -= 1
        options = _fillings(after, capacity - big, REPACK_FILLINGS, REPACK_FILLINGS, slack, meter)
        if rng is not None:
            rng.shuffle(options)
        for f in options:
            if steps >= max_steps or meter[0] > most:
                return None
            rest = after.copy()
            for s in f:
                rest[s] -= 1
            found = branch(rest, slack - (capacity - big - sum(f)))
            if found is not None:
                return [((big, *f), 1), *found]
        return None

    return branch(counts.copy(), bins * capacity - int((counts * np.arange(len(counts))).sum()))


def complete(counts: np.ndarray, capacity: int = CAPACITY, max_steps: int | None = MAX_STEPS, fillings: int = FILLINGS, repack_steps: int = REPACK_STEPS, whole_steps: int = WHOLE_STEPS, relax_rounds: int = RELAX_ROUNDS, most_work: int = MOST_WORK) -> list[Pattern]:
    """The fewest bins found for counts[l] pieces of each length l: a list of (lengths in a bin, how many such bins). Never more than best-fit decreasing gives.

    First the search on counts: up to `fillings` fillings a node, each taken as often as counts allow, max_steps choices. Where that ends more than RELAX_GAP above the waste bound, fillings are used as often as
    the linear relaxation says (relax_rounds at most), if that is better. What is left above the bounds is searched again in parts (see repacked): the bins with room and as many others, REPACK_BINS at most, in rounds of
    repack_steps steps (whole_steps where a part is all there is), REPACK_ROUNDS without a gain in a row, and in all as far as most_work fillings' totals go. max_steps None: the exact search instead, for instances of some 30 pieces.
    """
    counts = np.array(counts, dtype=np.int64)
    counts[0] = 0
    goal = waste_bound(counts, capacity)
    best = best_fit(counts, capacity)
    if max_steps is None:
        return exact(counts, capacity, best, goal)
    best = _on_counts(counts, capacity, best, goal, max_steps, fillings)
    if sum(n for _, n in best) > goal + max(2, RELAX_GAP * goal):
        patterns, bound = relaxed(counts, capacity, relax_rounds)
        made = rounded(counts, capacity, patterns)
        best = min(best, made, key=lambda b: sum(n for _, n in b))
        goal = max(goal, math.ceil(bound - 1e-6)) if bound is not None else goal
    rng, missed, meter = np.random.default_rng(0), 0, [0]
    while sum(n for _, n in best) > goal and missed < REPACK_ROUNDS and meter[0] <= most_work:
        alike = Counter()  # bins filled alike come from several searches; as one entry, none is taken apart twice
        for p, n in best:
            alike[p] += n
        best = list(alike.items())
        open_bins = sorted(((capacity - sum(p), p, n) for p, n in best if sum(p)), key=lambda x: -x[0])
        freed: list[tuple[int, ...]] = []
        for room, p, n in open_bins:
            freed += [p] * min(n, REPACK_BINS // 2 - len(freed)) if room else []
        pool = [p for p, n in best for _ in range(min(n, REPACK_BINS) - freed.count(p))]
        freed += [pool[i] for i in rng.permutation(len(pool))[: REPACK_BINS - len(freed)].tolist()]
        taken = Counter(freed)
        full = [(p, n - taken[p]) for p, n in best]
        part = np.bincount([s for p in freed for s in p], minlength=len(counts))
        steps = repack_steps if any(n > 0 for _, n in full) else whole_steps
        found = repacked(part, capacity, len(freed) - 1, steps, None if missed == 0 else rng, meter, most_work)
        if found is None:
            missed += 1
        else:
            best, missed = [(p, n) for p, n in full if n > 0] + found, 0
    return best


def _on_counts(counts: np.ndarray, capacity: int, best: list[Pattern], goal: int, max_steps: int, fillings: int) -> list[Pattern]:
    least = sum(n for _, n in best)
    total = int((counts * np.arange(len(counts))).sum())
    steps = 0
    # Depth first; an entry is the state before a choice: counts, patterns so far, bins, waste, the fillings left to try.
    stack: list[list] = [[counts, [], 0, 0, None]]
    while stack and least > goal and steps < max_steps:
        state = stack[-1]
        left, used, bins, waste, options = state
        if options is None:
            sizes = np.flatnonzero(left)
            if not len(sizes):
                if bins < least:
                    best, least = used, bins
                stack.pop()
                continue
            big = int(sizes[-1])
            after = left.copy()
            after[big] -= 1
            options = state[4] = [(big, *f) for f in _fillings(after, capacity - big, fillings)]
        if not options:
            stack.pop()
            continue
        pattern = options.pop(0)
        steps += 1
        n = min(int(left[s]) // pattern.count(s) for s in set(pattern))
        lost = waste + n * (capacity - sum(pattern))
        if -(-(total + lost) // capacity) >= least:
            continue
        rest = left.copy()
        for s in pattern:
            rest[s] -= n
        stack.append([rest, [*used, (pattern, n)], bins + n, lost, None])
    return best


def plan(counts: np.ndarray, capacity: int = CAPACITY, max_steps: int | None = MAX_STEPS) -> np.ndarray:
    """Rows (length, first rank, count, first sequence, offset), by length and rank, that place every piece. max_steps: as complete() has it."""
    rows, taken, sequence = [], np.zeros(len(counts), dtype=np.int64), 0
    for pattern, n in complete(counts, capacity, max_steps):
        offset = 0
        for size in pattern:
            rows.append((size, int(taken[size]), n, sequence, offset))
            taken[size] += n
            offset += size
        sequence += n
    assert (taken[1:] == np.asarray(counts)[1:]).all()
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids with end_id, cut where longer than capacity (the first piece takes the odd length)."""
    extra = ", ids binary" if carry else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for part, texts in text_chunks(batches, rows=512):
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for d, ids in zip(part.column(0).to_pylist(), own.encode([t.decode("utf-8", "replace") for t in texts]), strict=True):
                raw = memoryview(np.append(ids, np.uint32(end_id)).astype("<u4").tobytes())
                n = len(ids) + 1
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    piece = raw[4 * a : 4 * b]
                    for column, x in zip(out, (d, k, a, b - a, zlib.crc32(piece), bytes(piece) if carry else None), strict=True):
                        column.append(x)
            arrays = [pa.array(c, type=t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays[: 6 if carry else 5], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 6 if carry else 5])
        own.reset(whole=True)

    return texts_of(docs, id_col, text_col).mapInArrow(tidied(run), "doc_id long, piece int, start long, length long, ids_crc32 long" + extra)


def pack(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", carry: bool = False, rows_per_bucket: int = 512, max_steps: int | None = MAX_STEPS) -> DataFrame:
    """pieces() with sequence_id and offset: which sequence each piece lies in, and where; no sequence is longer than capacity. max_steps: of the search (see complete(); None is the exact one, for few pieces).

    A null text is empty: its document is end_id alone. Repeated ids and texts are packed as separate rows, a null id too. Very
    long texts are cut; an empty table gives no rows. Other columns of docs are not looked at.
    """
    spark = docs.sparkSession
    cut = spool(pieces(docs, tokenizer, end_id, capacity, id_col, text_col, carry), "pieces")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in cut.groupBy("length").count().collect():  # at most `capacity` rows
        counts[r["length"]] = r["count"]
    placed = spark.sparkContext.broadcast(plan(counts, capacity, max_steps))
    # A length with many pieces is ranked in buckets of about rows_per_bucket, and the buckets' sizes are added up.
    buckets = F.element_at(F.array(*(F.lit(int(n) // rows_per_bucket + 1) for n in counts)), (F.col("length") + 1).cast("int"))
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), buckets).cast("int"))
    size = dealt.groupBy("length", "bucket").count()  # a row a bucket
    first = size.select("length", "bucket", F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    row = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    columns = cut.columns
    ranked = dealt.withColumn("row", row).join(first, ["length", "bucket"]).select(*columns, (F.col("first") + F.col("row")).cast("long").alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = placed.value
        wide = np.int64(1) << 40
        key = rows[:, 0] * wide + rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            i = np.searchsorted(key, length * wide + rank, side="right") - 1
            sequence = rows[i, 3] + rank - rows[i, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(rows[i, 4])], names=[*columns, "sequence_id", "offset"])

    schema = ", ".join(f"{c} {t}" for c, t in cut.dtypes) + ", sequence_id long, offset long"
    return ranked.mapInArrow(tidied(place), schema.replace("bigint", "long"))


def op5(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .shared import table

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
