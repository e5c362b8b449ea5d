"""Change detection inside a stream: keyed state of bucketed histograms, so that drift leaves the stream itself and what is no longer needed is dropped."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from datetime import date, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.binning import ABS_TOL, DECIMALS, INTEGER_CAP, N_BINS, REL_TOL
from ..operators.detect import JS_THRESHOLD

DAY_MS = 86_400_000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which keyed map state and timers need; the session's setting is as before afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


# ---- histograms of counted values (as functions.binning has them for rows)


def quantile_of(values: np.ndarray, counts: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Linearly interpolated quantiles of ascending values with counts."""
    upto = np.cumsum(counts)
    at = marks * (upto[-1] - 1)
    low, high = (values[np.searchsorted(upto, f(at), side="right")] for f in (np.floor, np.ceil))
    return low + (high - low) * (at - np.floor(at))


def edges_of(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Adaptive edges: unit bins up to a cap for integers of a small range, else quantile bins."""
    if not len(values):
        return np.array([0.0, 1.0])
    q = quantile_of(values, counts, np.append(np.arange(N_BINS + 1) / N_BINS, 0.99))
    whole = np.rint(values)
    cap = max(1, int(np.floor(q[-1])))
    if cap <= INTEGER_CAP and (np.abs(values - whole) <= ABS_TOL + REL_TOL * np.abs(whole)).all():
        edges = np.arange(cap + 2, dtype=float)
        if values[-1] > cap + 1:
            edges = np.append(edges, values[-1] + 1)
    else:
        edges = np.unique(np.round(q[:-1], DECIMALS))
    return edges if len(edges) > 1 else np.array([values[0], values[-1] + 1])


def shares(values: np.ndarray, counts: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Counts by bin; values beyond the edges are left out."""
    on = (values >= edges[0]) & (values <= edges[-1])
    return np.bincount(np.searchsorted(edges[1:-1], values[on], side="right"), weights=counts[on], minlength=len(edges) - 1)


def divergence_of(ref: np.ndarray, cur: np.ndarray) -> tuple[float, float]:
    """Jensen-Shannon divergence (base 2) and largest difference of two histograms; 0 where one is empty."""
    if not ref.sum() or not cur.sum():
        return 0.0, 0.0 if not ref.sum() and not cur.sum() else 1.0
    p, q = ref / ref.sum(), cur / cur.sum()
    m = (p + q) / 2
    part = lambda x: float(np.sum(x[x > 0] * np.log2(x[x > 0] / m[x > 0])))
    return (part(p) + part(q)) / 2, float(np.abs(p - q).max())


def merged(buckets: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Histograms put together: each bucket once, ascending."""
    found, at = np.unique(buckets, return_inverse=True)
    return found, np.bincount(at, weights=n, minlength=len(found)).astype(np.int64)


# ---- growing windows


class GrowingWindow(StatefulProcessor):
    """Of each key a histogram a day: buckets, how often each, and rows without a value. When the watermark closes a window of min_days, min_days + step_days ... days, its halves are compared; the first that differ are reported, and
    the key's state is dropped but for a flag. State is bounded by days and buckets, not rows, and counts of tasks or restarts add up.
    """

    def __init__(self, start: date, min_days: int, max_days: int, step_days: int, threshold: float, least_rows: int, decimals: int):
        self.start, self.sizes = start, list(range(min_days, max_days + 1, step_days))
        self.threshold, self.least, self.scale = threshold, least_rows, 10.0**decimals

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("histograms", "day int", "buckets binary, n binary, without long")
        self.checked = handle.getValueState("checked", "days int")  # the longest window compared; -1 after a change

    def _end(self, days: int) -> int:
        return ((self.start - date(1970, 1, 1)).days + days) * DAY_MS

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        checked = self.checked.get()[0] if self.checked.exists() else None
        if checked == -1:
            return
        if checked is None:
            self.checked.update((0,))
            for days in self.sizes:
                self.handle.registerTimer(self._end(days))
        for part in rows:
            part = part[(part["day"] >= 0) & (part["day"] < self.sizes[-1])]
            for day, own in part.groupby("day"):
                x = own["x"].dropna().to_numpy()
                new = np.unique(np.rint(x * self.scale).astype(np.int64), return_counts=True)
                old = self._histogram(self.counts.getValue((int(day),))) if self.counts.containsKey((int(day),)) else None
                buckets, n = new if old is None else merged(*(np.concatenate(pair) for pair in zip(old[:2], new, strict=True)))
                self.counts.updateValue((int(day),), (buckets.tobytes(), n.tobytes(), len(own) - len(x) + (old[2] if old else 0)))
        yield from ()

    @staticmethod
    def _histogram(held: tuple) -> tuple[np.ndarray, np.ndarray, int]:
        return np.frombuffer(held[0], dtype=np.int64), np.frombuffer(held[1], dtype=np.int64), int(held[2])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All windows that are closed by now, shortest first, whichever timer comes first."""
        checked = self.checked.get()[0]
        closed = [d for d in self.sizes if self._end(d) <= timerValues.getCurrentWatermarkInMs() and d > checked]
        if checked == -1 or not closed:
            return
        held = {k[0]: self._histogram(v) for k, v in self.counts.iterator()}
        for days in closed:
            js = self._compare({d: h for d, h in held.items() if d < days}, days)
            if js is not None and js > self.threshold:
                self.counts.clear()
                self.checked.update((-1,))
                for d in self.sizes:
                    if self._end(d) > timerValues.getCurrentWatermarkInMs():
                        self.handle.deleteTimer(self._end(d))
                yield pd.DataFrame({"key": [key[0]], "window_days": pd.array([days], dtype="int32"), "change_point": [self.start + timedelta(days // 2)], "js": [js]})
                return
        self.checked.update((closed[-1],))

    def _compare(self, own: dict[int, tuple[np.ndarray, np.ndarray, int]], days: int) -> float | None:
        none = np.zeros(0, dtype=np.int64)
        sides = [[h for d, h in own.items() if (d < days // 2) == ref] for ref in (True, False)]
        if min(sum(h[1].sum() + h[2] for h in side) for side in sides) < self.least:
            return None
        ref, cur = (merged(np.concatenate([none, *(h[0] for h in side)]), np.concatenate([none, *(h[1] for h in side)])) for side in sides)
        both = merged(np.concatenate((ref[0], cur[0])), np.concatenate((ref[1], cur[1])))
        edges = edges_of(both[0] / self.scale, both[1])
        return divergence_of(*(shares(b / self.scale, n, edges) for b, n in (ref, cur)))[0]

    def close(self) -> None:
        pass


def growing_windows(events: DataFrame, ts: str, key: str, value: str, start: str, min_days: int = 7, max_days: int = 90, step_days: int = 7, threshold: float = JS_THRESHOLD, least_rows: int = 20, late: str = "1 day", decimals: int = 2) -> DataFrame:
    """key, window_days, change_point, js: of each key the first growing window from `start` whose halves differ, as soon as the watermark closes it.

    Values are counted to `decimals` decimals; where they have no more, results are those of the batch scan over the closed windows. Rows without a time are left out, rows
    without a value count for the size of a window only, a null key is a key. Rows behind the watermark are too late and dropped. Start the stream inside rocksdb().
    """
    day = F.datediff(F.to_date(ts), F.lit(start).cast("date"))
    rows = events.where(F.col(ts).isNotNull()).withWatermark(ts, late).select(F.col(key).cast("string").alias("key"), ts, day.alias("day"), F.col(value).cast("double").alias("x"))
    process = GrowingWindow(date.fromisoformat(start), min_days, max_days, step_days, threshold, least_rows, decimals)
    return rows.groupBy("key").transformWithStateInPandas(process, "key string, window_days int, change_point date, js double", "Append", "EventTime")


# ---- rolling reference


class RollingReference(StatefulProcessor):
    """Of each key the histogram of the last closed window, which the next one is compared with and then takes the place of."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getMapState("last", "bin string", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Rows are counts of closed windows, each of which comes whole."""
        given = pd.concat(list(rows))
        last = {k[0]: v[0] for k, v in self.last.iterator()}
        out = []
        for start, own in given.groupby("start", sort=True):
            now = dict(zip(own["bin"], own["n"].astype(int), strict=True))
            if last:
                bins = sorted({*last, *now})
                out.append((key[0], start, *divergence_of(*(np.array([h.get(b, 0) for b in bins], dtype=float) for h in (last, now)))))
            last = now
        self.last.clear()
        for b, n in last.items():
            self.last.updateValue((b,), (n,))
        yield pd.DataFrame(out, columns=["key", "start", "js", "l_inf"])

    def close(self) -> None:
        pass


def rolling_reference(events: DataFrame, ts: str, by: str, length: str, key: str | None = None, late: str = "1 day") -> DataFrame:
    """key, start, js, l_inf: of each key (one for all without it) every closed window's mix of `by` against that of the closed window before it, from the stream itself.

    Windows are counted first, a row a window and value, so what meets in a key is that and not the events; nulls of `by` are left out, windows without rows are none, and late
    rows of a closed window are dropped. Start the stream inside rocksdb().
    """
    name = F.lit("all") if key is None else F.coalesce(F.col(key).cast("string"), F.lit(""))
    rows = events.where(F.col(by).isNotNull()).withWatermark(ts, late)
    counts = rows.groupBy(F.window(ts, length).alias("w"), name.alias("key"), F.col(by).cast("string").alias("bin")).agg(F.count("*").alias("n"))
    return counts.select("key", F.col("w.start").alias("start"), "bin", "n").groupBy("key").transformWithStateInPandas(RollingReference(), "key string, start timestamp, js double, l_inf double", "Append", "None")
