"""Toxicity behind obfuscation, as a noisy channel.

What was written is seen through a channel that swaps letters for look-alikes, repeats them, and puts spaces or marks between them. Each
stretch that such a channel may have touched becomes a lattice of readings; the Viterbi path under a character trigram model of the corpus
and the channel's costs is put in its place. Words the channel can't have touched have one reading and stay. The restored text is then
scored: each distinct word gives the evidence of the class counts of the word or of its first letters, and the strongest few
words of a text enter a logistic model, so that a long text is not toxic for its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import words
from .labelled import fit_logistic, fold, logistic, training_docs
from .shared import as_before, others, spool, table, text_chunks, texts_of, tidied

#: Documented bound of the sample of labelled rows that evidence is counted on.
MOST_ROWS = 20_000
#: A text is called toxic from this score on.
THRESHOLD = 0.3
#: First letters (bytes) of a word that stand for it where they tell more.
PREFIXES = (4, 5, 6, 7)
STRONGEST = 4

# ---- fixed values: the channel

#: Letters that a mark or digit may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l", "¢": "c",
}
#: Costs, as negative natural logarithms: a look-alike, a letter's repeats dropped to one or two, a mark or space dropped or kept between single letters.
COST_SWAP, COST_ONCE, COST_TWICE, COST_DROP, COST_KEEP = 2.0, 0.7, 1.2, 0.5, 3.0
#: A digit, $ or @ at an end that is no letter (other marks cost COST_DROP there).
COST_END = 9.0
_TRIPLE = re.compile(r"(.)\1\1", re.S)
#: Most runs of one character in a stretch read as one disguised word; longer ones with digits are codes, not words.
LONGEST = 40

_SWAPS = re.escape("".join(LOOKALIKES))
_SEPARATORS = " .-_*~"
_APART = rf"(?:[^\W_]|[{_SWAPS}])(?:[{re.escape(_SEPARATORS)}]+(?:[^\W_]|[{_SWAPS}])){{2,}}"
_spaced = re.compile(_APART).fullmatch
#: Stretches with more than one reading, from their first character on: single letters or look-alikes set apart by separators, however many; a word with look-alikes before, between or (two at
#: most, of those that seldom end a word) after its letters; a word that repeats a letter three times or more.
DISGUISED = re.compile(
    rf"{_APART}(?!\w)"
    rf"|(?:[{_SWAPS}]*[^\W\d_]+)?[{_SWAPS}]+[^\W\d_](?:[^\W_]|[{_SWAPS}](?=[^\W_{_SWAPS}]|[{_SWAPS}][^\W_]))*(?:[$@\d]{{1,2}}(?![{_SWAPS}]))?"
    rf"|[^\W\d_]+[$@]{{1,2}}(?![{_SWAPS}])"
    rf"|[^\W_]+"
)
_LETTER, _SWAP, _SEP, _SPACE, _WORD = 1, 2, 4, 8, 16
_KIND = np.zeros(0x250, dtype=np.uint8)
for _o in range(0x250):
    _KIND[_o] = _LETTER * chr(_o).isalpha() + _SWAP * (chr(_o) in LOOKALIKES) + _SEP * (chr(_o) in _SEPARATORS) + _SPACE * chr(_o).isspace() + _WORD * chr(_o).isalnum()


def suspects(text: str) -> np.ndarray:
    """Where words start that a disguise may have touched (a superset), for a text in lower case; found without looking at words one by one."""
    points = np.frombuffer(f"\n{text}\n".encode("utf-32-le", "replace"), dtype=np.uint32)
    kind = np.where(points < len(_KIND), _KIND[np.minimum(points, len(_KIND) - 1)], _LETTER + _WORD).astype(np.uint8)
    letter, swap, sep, word = ((kind & k) > 0 for k in (_LETTER, _SWAP, _SEP, _WORD))
    hot = np.zeros(len(kind), dtype=bool)
    hot[1:] |= letter[1:] & swap[:-1]
    hot[1:] |= ((points[1:] == ord("$")) | (points[1:] == ord("@"))) & letter[:-1]
    hot[2:] |= letter[2:] & (points[2:] == points[1:-1]) & (points[1:-1] == points[:-2])
    single = (word | swap)[1:-1] & ~word[:-2] & ~word[2:]
    apart = np.flatnonzero(single) + 1
    if len(apart) > 2:
        others = np.append(0, np.cumsum(~sep))
        joined = (others[apart[1:]] == others[apart[:-1] + 1]) & (np.diff(apart) > 1)  # only separators between
        three = np.flatnonzero(joined[:-1] & joined[1:])  # from the first of three
        if len(three):  # in stretches, of which those with a letter count
            first = np.flatnonzero(np.diff(three, prepend=-9) != 1)
            end = apart[three[np.append(first[1:], len(three)) - 1] + 2] + 1
            letters = np.append(0, np.cumsum(letter))
            with_letter = letters[end] > letters[apart[three[first]]]
            hot[apart[three[np.repeat(with_letter, np.diff(np.append(first, len(three))))]]] = True
    at = np.flatnonzero(hot)
    if not len(at):
        return at
    begin = np.flatnonzero((kind[1:] & _SPACE == 0) & (kind[:-1] & _SPACE > 0))  # already without the line end put before
    return begin[np.unique(np.searchsorted(begin, at - 1, side="right") - 1)]


# ---- the character model

SYMBOLS = 64
_CODE = np.full(0x250, 0, dtype=np.uint8)  # 0: what parts words
for _i, _ch in enumerate("abcdefghijklmnopqrstuvwxyz"):
    _CODE[ord(_ch)] = _CODE[ord(_ch.upper())] = _i + 1
for _o in range(0xC0, 0x250):
    if chr(_o).isalpha():
        _CODE[_o] = 27 + ord(chr(_o).lower()[0]) % (SYMBOLS - 28)


def codes(text: str) -> np.ndarray:
    """Symbols of a text: a to z, further Latin letters in classes, other letters in one, and 0 for all else."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    return np.where(points < len(_CODE), _CODE[np.minimum(points, len(_CODE) - 1)], SYMBOLS - 1).astype(np.int64)


def trigram_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Counts of symbol trigrams over all whole texts: SYMBOLS ** 3 numbers, added up by Spark from one row a task and trigram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, dtype=np.int64)
        for _, texts in text_chunks(batches):
            c = codes(b"\n\n".join([b"", *texts, b""]).decode("utf-8", "replace"))
            total += np.bincount((c[:-2] * SYMBOLS + c[1:-1]) * SYMBOLS + c[2:], minlength=SYMBOLS**3)
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(total[on])], names=["gram", "n"])

    got = texts_of(docs, id_col, text_col).mapInArrow(tidied(run), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(SYMBOLS**3)
    for r in got:
        out[r["gram"]] = r["n"]
    return out.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


def character_costs(counts: np.ndarray) -> np.ndarray:
    """-log P(c | a, b), trigrams smoothed by bigrams and those by single symbols."""
    one = counts.sum((0, 1)) + 1
    one /= one.sum()
    two = counts.sum(0) + 5 * one
    two /= two.sum(1, keepdims=True)
    three = counts + 5 * two[None]
    return -np.log(three / three.sum(2, keepdims=True)).astype(np.float32)


class Decoder:
    def __init__(self, costs: np.ndarray):
        self.costs = costs
        self.known: dict[str, str] = {}

    def restore(self, text: str) -> str:
        """The text with each disguised stretch replaced by its likeliest reading. Expects lower case."""
        starts = suspects(text).tolist()
        if not starts:
            return text
        out, done = [], 0
        for start in starts:
            at = max(start, done)
            while at < len(text) and not text[at].isspace():  # the stretches of one word
                found = DISGUISED.match(text, at)
                if not found:
                    at += 1
                    continue
                out += [text[done:at], self._read(found.group())]
                at = done = found.end()
        out.append(text[done:])
        return "".join(out)

    def _read(self, seen: str) -> str:
        spaced = bool(_spaced(seen))
        if (not spaced and _runs(seen) > LONGEST) or (spaced and not any(c.isalpha() for c in seen)) or (not spaced and seen.isalpha() and not _TRIPLE.search(seen)) or seen.isdigit():
            return seen
        got = self.known.get(seen)
        if got is None:
            if len(self.known) > 50_000:
                self.known.clear()
            got = self.known[seen] = self.decode(seen)
        return got

    def decode(self, seen: str) -> str:
        """Viterbi over the lattice of readings; a state is the last two symbols of what was written."""
        spaced = bool(_spaced(seen))
        states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for options in _lattice(seen, spaced):
            new: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (cost, path) in states.items():
                for written, channel in options:
                    x, y, c = a, b, cost + channel
                    for z in _symbols(written):
                        c += float(self.costs[x, y, z])
                        x, y = y, z
                    if (x, y) not in new or c < new[x, y][0]:
                        new[x, y] = (c, (path, written))
            states = new
        best = min(((c + float(self.costs[a, b, 0]), path) for (a, b), (c, path) in states.items()), key=lambda s: s[0])[1]
        out = []
        while best:
            best, written = best
            out.append(written)
        return "".join(reversed(out))


@lru_cache(maxsize=4096)
def _symbols(written: str) -> tuple[int, ...]:
    return tuple(codes(written).tolist())


def _runs(seen: str) -> int:
    return len(seen) if len(seen) <= LONGEST else 1 + sum(a != b for a, b in zip(seen, seen[1:], strict=False))


def _lattice(seen: str, spaced: bool) -> Iterator[list[tuple[str, float]]]:
    """For each run of one character, the readings (what was written, cost of seeing it so)."""
    i = 0
    while i < len(seen):
        c, n = seen[i], 1
        while i + n < len(seen) and seen[i + n] == c:
            n += 1
        at, i = i, i + n
        if spaced and c in _SEPARATORS:
            yield [("", COST_DROP), (" ", COST_KEEP)]
            continue
        letters = [(c, 0.0)] if c.isalpha() else [(x, COST_SWAP) for x in LOOKALIKES.get(c, "")]
        if not c.isalpha() and (at == 0 or i == len(seen)):
            letters.append(("", COST_END if c in "$@" or c.isdigit() else COST_DROP))  # a mark at an end may be no letter
        if not letters:
            letters = [(c, 0.0)]
        options = []
        for x, cost in letters:
            if n == 1 or not x:
                options.append((x, cost))
            else:
                options += [(x, cost + COST_ONCE), (x * 2, cost + (COST_TWICE if n > 2 else 0.0))]
                if 2 < n <= LONGEST and c.isalpha():
                    options.append((x * n, cost + COST_TWICE))
        yield options


# ---- evidence

_PART = bytes(c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def _lower(text: bytes) -> str:
    return text.decode("utf-8", "replace").lower()


def terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each word of all texts: its text, and names of the word and of its first letters (0 where it is no longer than those)."""
    w = words([t.encode("utf-8", "replace").translate(_PART) for t in texts])
    n = len(w.start)
    if not n:
        return w.doc, np.zeros((0, 1 + len(PREFIXES)), dtype=np.uint64)
    names = np.zeros((n, 1 + len(PREFIXES)), dtype=np.uint64)
    names[:, 0] = w.name
    raw = np.frombuffer(w.buf, dtype=np.uint8)
    name = np.zeros(n, dtype=np.uint64)
    size = w.end - w.start
    last = len(raw) - 1
    for k in range(max(PREFIXES)):
        name = (name ^ raw[np.minimum(w.start + k, last)]) * np.uint64(0x100000001B3) + np.uint64(k + 1)
        if k + 1 in PREFIXES:
            j = 1 + PREFIXES.index(k + 1)
            names[:, j] = np.where(size > k + 1, name ^ (name >> np.uint64(29)) ^ np.uint64(k + 1 << 56), 0)
    return w.doc, names


@dataclass
class Evidence:
    """Class counts of the terms seen in two positive training texts or more, and the logistic weights."""

    name: np.ndarray
    pos: np.ndarray
    neg: np.ndarray
    n_pos: int
    n_neg: int
    scale: np.ndarray

    def __post_init__(self):
        self.bits = np.zeros(1 << 22, dtype=bool)
        self.bits[(self.name & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def strongest(self, texts: list[str], label: np.ndarray | None = None) -> np.ndarray:
        """The STRONGEST largest evidences of distinct words of each text; with labels, without what the text itself adds to the counts."""
        out = np.zeros((len(texts), STRONGEST))
        doc, names = terms(texts)
        if not len(self.name) or not len(doc):
            return out
        hit = self.bits[(names & np.uint64((1 << 22) - 1)).astype(np.int64)]
        rows = np.flatnonzero(hit.any(axis=1))
        if not len(rows):
            return out
        names, doc = names[rows], doc[rows]
        at = np.minimum(np.searchsorted(self.name, names), len(self.name) - 1)
        there = (self.name[at] == names) & (names != 0)
        pos, neg = self.pos[at].astype(float), self.neg[at].astype(float)
        if label is not None:
            own = label[doc][:, None]
            pos, neg = pos - (own > 0), neg - (own == 0)
        # Smoothed towards the classes' shares of texts: a term seen once tells little.
        share = self.n_pos / max(self.n_pos + self.n_neg, 1)
        weight = np.log((pos + 4 * share + 1e-9) / (self.n_pos + 4)) - np.log((neg + 4 * (1 - share) + 1e-9) / (self.n_neg + 4))
        weight = np.where(there & (pos > 0), weight, 0).max(axis=1)
        order = np.lexsort((names[:, 0], doc))
        doc, word, weight = doc[order], names[order, 0], weight[order]
        first = np.ones(len(doc), dtype=bool)
        first[1:] = (doc[1:] != doc[:-1]) | (word[1:] != word[:-1])
        doc, weight = doc[first], weight[first]
        order = np.lexsort((-weight, doc))
        doc, weight = doc[order], weight[order]
        rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
        keep = (rank < STRONGEST) & (weight > 0)
        out[doc[keep], rank[keep]] = weight[keep]
        return out


@dataclass
class Model:
    costs: np.ndarray
    evidence: Evidence

    def scores(self, texts: list[bytes]) -> np.ndarray:
        decoder = _decoder(self)
        return logistic(self.evidence.strongest([decoder.restore(_lower(t)) for t in texts]), self.evidence.scale)


_HELD: list = [None, None]


def _decoder(model: Model) -> Decoder:
    if _HELD[0] is not model:
        _HELD[:] = [model, Decoder(model.costs)]
    return _HELD[1]


def train(docs: DataFrame, labels: DataFrame, label_col: str, rows: Column, most: int = MOST_ROWS) -> Model:
    """The character model from all texts; evidence and logistic weights from at most `most` labelled ones. Counts and three numbers a training text come to the driver."""
    spark = docs.sparkSession
    costs = character_costs(trigram_counts(docs))
    sent = spark.sparkContext.broadcast(costs)  # 1 MB

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(sent.value)
        for part, texts in text_chunks(batches, rows=256):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([decoder.restore(_lower(t)) for t in texts]), part.column(2)], names=["doc_id", "text", "label"])

    sample = spool(training_docs(docs, labels, label_col, rows, most).mapInArrow(tidied(restore), "doc_id long, text string, label int"), "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                doc, names = terms(part.column(1).to_pylist())
                label = part.column(2).to_numpy()
                pair = np.stack((np.repeat(doc, names.shape[1]).astype(np.uint64), names.ravel()), axis=1)
                pair = pair[pair[:, 1] != 0]
                order = np.lexsort((pair[:, 1], pair[:, 0]))
                pair = pair[order]
                new = np.ones(len(pair), dtype=bool)
                new[1:] = (pair[1:] != pair[:-1]).any(axis=1)
                pair = pair[new]
                y = label[pair[:, 0].astype(np.int64)] > 0
                name, at = np.unique(pair[:, 1], return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(np.bincount(at, weights=y, minlength=len(name)).astype(np.int64)), pa.array(np.bincount(at, weights=~y, minlength=len(name)).astype(np.int64))], names=["name", "pos", "neg"])

    # Bounded by the words of the sample's positive texts.
    got = sample.mapInArrow(tidied(count), "name long, pos long, neg long").groupBy("name").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("pos >= 2 and pos * 2 > neg").toArrow()
    name = got["name"].to_numpy().view(np.uint64)
    order = np.argsort(name)
    size = {r["label"]: r["count"] for r in sample.groupBy((F.col("label") > 0).cast("int").alias("label")).count().collect()}
    evidence = Evidence(name[order], got["pos"].to_numpy()[order], got["neg"].to_numpy()[order], size.get(1, 0), size.get(0, 0), np.zeros(STRONGEST + 1))
    known = spark.sparkContext.broadcast(evidence)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                x = known.value.strongest(part.column(1).to_pylist(), part.column(2).to_numpy())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *(pa.array(np.ascontiguousarray(x[:, j])) for j in range(STRONGEST))], names=["doc_id", "label", *(f"e{j}" for j in range(STRONGEST))])

    seen = sample.mapInArrow(tidied(measure), "doc_id long, label int, " + ", ".join(f"e{j} double" for j in range(STRONGEST))).toArrow().sort_by("doc_id")
    x = np.column_stack([seen[f"e{j}"].to_numpy() for j in range(STRONGEST)])
    evidence.scale = fit_logistic(x, (seen["label"].to_numpy() > 0).astype(float))
    return Model(costs, evidence)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """(doc_id, score[, text bytes, row]): how likely the whole text is toxic, 0 to 1, for every row; with carry, also the text as it was and `row`, a struct of the other columns.

    A null text is empty. A text without evidence, so an empty one, gets the model's answer to none. Without labelled rows of
    both classes every score is that of no evidence. Null or repeated ids are scored like others; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    extra = [others(docs, text_col)] if carry else []
    schema = "doc_id long, score double" + (f", text binary, row {docs.select(*extra).schema['row'].dataType.simpleString()}" if carry else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches, rows=256):
            more = part.columns[1:] if carry else []
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sent.value.scores(texts)), *more], names=["doc_id", "score", "text", "row"][: 2 + len(more)])

    return texts_of(docs, id_col, text_col, extra).mapInArrow(tidied(run), schema)


def op7(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), "toxic", fold("doc_id", 4) != 2)
    return score(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those scored threshold or more; the model learns from all labels (at most MOST_ROWS of them)."""
    model = train(docs, labels, "toxic", F.lit(True))
    return as_before(score(docs, model, carry=True).where(F.col("score") < threshold), docs.columns)
