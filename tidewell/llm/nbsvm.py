"""Text quality by Naive Bayes support vectors.

A text becomes symbols: a word's shape (lower, upper, capitalised, digits, and whether it repeats the word before), each stretch of
punctuation with its characters, and each line end. Features are indicators of the hashed n-grams of symbols, and of words. They are scaled by the log-count
ratios of the classes (Wang and Manning 2012); a linear model with hinge loss is fitted by dual coordinate descent (Hsieh et al. 2008), and its margins
are calibrated on labelled rows it was not fitted on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import Words, mix, words
from .labelled import fit_logistic, fold, logistic, training_docs
from .shared import table, text_chunks, texts_of, tidied

BITS = 18
ORDERS = (1, 2, 3)
#: Documented bound of the sample of labelled rows that the model is fitted on.
MOST_ROWS = 8_000
COST, EPOCHS, ALPHA = 0.5, 20, 1.0

_U = np.uint64
_CLASS = np.zeros(256, dtype=np.uint64)  # other bytes (of letters outside ASCII): lower
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
for _c in range(33, 127):
    if not chr(_c).isalnum():
        _CLASS[_c] = _c + 1
_CLASS[10] = 4


def symbols(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, in order, and where in the bytes each lies."""
    raw = np.frombuffer(w.buf, dtype=np.uint8)
    kind = _CLASS[raw]
    new = np.ones(len(kind), dtype=bool)
    new[1:] = kind[1:] != kind[:-1]
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(kind)))
    symbol = kind[at] * _U(8)
    marks = kind[at] > 4
    symbol[marks] += np.minimum(size[marks], 4).astype(np.uint64)  # of punctuation: how many, up to four
    again = np.zeros(len(w.name), dtype=bool)
    again[1:] = (w.name[1:] == w.name[:-1]) & (w.doc[1:] == w.doc[:-1])
    if again.any():
        first = np.searchsorted(at, w.start[again])
        first = first[(first < len(at))]
        symbol[first[np.isin(at[first], w.start[again])]] += _U(1 << 12)
    keep = kind[at] != 3  # spaces only part words
    return symbol[keep], at[keep]


def features(texts: list[bytes]) -> list[np.ndarray]:
    """The distinct feature numbers of each text."""
    w = words(texts)
    symbol, at = symbols(w)
    edge = np.cumsum([len(t) + 1 for t in texts])
    cut = np.searchsorted(at, np.concatenate(([0], edge)))
    at_word = np.searchsorted(w.doc, np.arange(len(texts) + 1))
    h = mix(symbol + _U(1))
    grams = [h]
    for n in ORDERS[1:]:
        longer = np.zeros(len(h), dtype=np.uint64)
        longer[: max(len(h) - n + 1, 0)] = mix(grams[-1][: max(len(h) - n + 1, 0)] * _U(31) + h[n - 1 :])
        grams.append(longer)
    mask = _U((1 << BITS) - 1)
    grams = [(g & mask).astype(np.int32) for g in grams]
    word = (mix(w.name ^ _U(0x5EED)) & mask).astype(np.int32)
    seen = np.zeros(1 << BITS, dtype=np.int32)
    out = []
    for i in range(len(texts)):
        a, b = cut[i], max(cut[i], cut[i + 1] - 1)  # without the line end put between texts
        f = np.concatenate([*(g[a : max(a, b - n)] for n, g in enumerate(grams)), word[at_word[i] : at_word[i + 1]]])
        place = np.arange(len(f), dtype=np.int32)
        seen[f] = place
        out.append(f[seen[f] == place])
    return out


def fit_dual(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights over features (already times ratio) and bias, for y of -1 and 1, by dual coordinate descent on the hinge loss; classes weigh alike."""
    w, bias = np.zeros(len(ratio)), 0.0
    alpha = np.zeros(len(y))
    x = [ratio[f] for f in rows]
    scale = np.array([1 / max(np.sqrt((v * v).sum()), 1e-9) for v in x])
    top = np.where(y > 0, cost * len(y) / max(2 * (y > 0).sum(), 1), cost * len(y) / max(2 * (y < 0).sum(), 1))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            margin = y[i] * (scale[i] * (w[rows[i]] @ x[i]) + bias) - 1
            new = min(max(alpha[i] - margin / 2, 0.0), top[i])  # squared length of a row with its bias: 2
            step = (new - alpha[i]) * y[i]
            if step:
                w[rows[i]] += step * scale[i] * x[i]
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


@dataclass
class Model:
    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    scale: np.ndarray

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.empty(len(rows))
        for i, f in enumerate(rows):
            r = self.ratio[f]
            out[i] = self.bias + (self.weight[f] @ r) / max(np.sqrt((r * r).sum()), 1e-9)
        return out

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return logistic(self.margins(rows)[:, None], self.scale)


def fit(rows: list[np.ndarray], label: np.ndarray) -> Model:
    """Four fifths give the weights, one fifth the calibration. Without rows of both classes the model gives the smoothed share of label 1."""
    n = 1 << BITS
    y = np.where(label > 0, 1.0, -1.0)
    part = np.arange(len(y)) % 5 != 0
    counts = [np.full(n, ALPHA) for _ in range(2)]
    for f, v in zip(rows, y, strict=True):
        counts[int(v > 0)][f] += 1
    size = [max((y < 0).sum(), 1) + 2 * ALPHA, max((y > 0).sum(), 1) + 2 * ALPHA]
    ratio = np.log(counts[1] / size[1]) - np.log(counts[0] / size[0])
    if len(set(y[part].tolist())) < 2:
        share = (float((y > 0).sum()) + 1) / (len(y) + 2)
        return Model(ratio, np.zeros(n), 0.0, np.array([0.0, np.log(share / (1 - share))]))
    weight, bias = fit_dual([f for f, p in zip(rows, part, strict=True) if p], y[part], ratio)
    model = Model(ratio, weight, bias, np.zeros(2))
    held = [f for f, p in zip(rows, part, strict=True) if not p]
    model.scale = fit_logistic(model.margins(held)[:, None], (y[~part] > 0).astype(float))
    return model


def train(docs: DataFrame, labels: DataFrame, label_col: str, rows: Column, most: int = MOST_ROWS) -> Model:
    """Fit on at most `most` labelled documents. Their feature numbers, not their texts, come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches, rows=256):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([f.tobytes() for f in features(texts)], type=pa.binary())], names=["doc_id", "label", "f"])

    got = training_docs(docs, labels, label_col, rows, most).mapInArrow(tidied(run), "doc_id long, label int, f binary").toArrow().sort_by("doc_id")
    return fit([np.frombuffer(x, dtype=np.int32) for x in got["f"].to_pylist()], got["label"].to_numpy())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): how likely label 1 is, 0 to 1, of every row. A null text is empty; an empty one has no features and gets the model's answer to none."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size, by BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches, rows=256):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sent.value.scores(features(texts)))], names=["doc_id", "score"])

    return texts_of(docs, id_col, text_col).mapInArrow(tidied(run), "doc_id long, score double")


def op3(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), "quality", fold("doc_id", 5) != 0)
    return score(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
