"""Early stopping over rows that arrive in any order within a delay.

A row waits in keyed state until nothing can come before it: until the watermark has
passed its time, which a timer reports, or, where evaluations come at a known distance,
until the one before it is done. State is on disk (RocksDB) and holds the rows of one
delay, those of neighbouring indices together: a call to the state moves many rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.operators.telemetry import METRIC_MODES

PROGRESS = "last bigint, best double, evals bigint, bad_streak bigint, should_stop boolean, wake bigint, parts bigint"
#: Pandas can't tell NULL from NaN, so NULL has columns of its own.
TAKEN = (
    "run string, metric string, tune_index bigint, value double, value_missing boolean, best double, "
    "best_missing boolean, evals bigint, bad_streak bigint, should_stop boolean"
)
ROWS = np.dtype([("tune_index", "<i8"), ("at", "<i8"), ("value", "<f8"), ("missing", "?")])

#: Indices (steps of ``every``, where it is known) whose waiting rows are kept together.
WIDTH = 1 << 16
#: Rows of a key that are put into the state at a time, and that leave it at a time.
SLICE, OUT = 1 << 17, 1 << 13


def early_stop_any_order(
    metrics: DataFrame,
    patience: int,
    min_evals: int = 1,
    modes: Mapping[str, str] | None = None,
    event_time: str = "ts",
    delay: str = "1 hour",
    every: int | None = None,
) -> DataFrame:
    """Rows of ``early_stop`` per (run, metric), whatever order its rows come in.

    ``metrics`` has (run, metric, tune_index, value) and ``event_time``, in whose order a
    key's indices rise. Rows may be up to ``delay`` behind the newest time of all; later
    ones are left out and counted by ``late_rows``. ``every``: distance of a key's indices;
    the row that follows the last one then doesn't wait for the watermark.

    As in the batch form, NaN beats every number, and a NULL value lengthens the streak
    without being one to stop at. The first row of a waiting index counts and its repeats
    don't; the rows of a micro-batch wait until all of them are there. A row
    without time or index, a metric without known direction and a row whose index is not
    beyond what was emitted stop the stream: what was emitted can't be taken back.

    Append mode. The query has to start with the RocksDB state store (``drain`` does so
    with ``rocksdb=True``).
    """
    if patience <= 0:
        raise ValueError("patience must be > 0")
    signs = {m: {"max": 1.0, "min": -1.0}[mode] for m, mode in (METRIC_MODES if modes is None else modes).items()}
    layout, width, slice_rows, out_rows = ROWS, WIDTH * (every or 1), SLICE, OUT

    # Inside the function, so that it travels by value and executors need no package.
    class Stopping(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.progress = handle.getValueState("progress", PROGRESS)
            # Rows by bucket of the index and by part, which counts what was put in; the first time of each.
            self.waiting = handle.getMapState("waiting", "bucket bigint, part bigint", "rows binary")
            self.soonest = handle.getMapState("soonest", "bucket bigint, part bigint", "at bigint")

        def _load(self) -> list:
            return list(self.progress.get()) if self.progress.exists() else [None, None, 0, 0, False, None, 0]

        def _firsts(self, parts: list) -> np.ndarray:
            """The first row of each index, by index."""
            rows = np.concatenate(parts)
            return rows[np.unique(rows["tune_index"], return_index=True)[1]]

        def _in_order(self, key: tuple, p: list, rows: np.ndarray) -> None:
            if p[0] is not None and rows["tune_index"][0] <= p[0]:
                raise RuntimeError(f"tune_index {rows['tune_index'][0]} of {key} arrived after {p[0]}")

        def _wait(self, p: list, rows: np.ndarray) -> int:
            """Puts rows, by index, into the state; returns their first time."""
            buckets = rows["tune_index"] // width
            for some in np.split(rows, np.flatnonzero(np.diff(buckets)) + 1):
                place = (int(some["tune_index"][0] // width), p[6])
                self.waiting.updateValue(place, (some.tobytes(),))
                self.soonest.updateValue(place, (int(some["at"].min()),))
            p[6] += 1
            return int(rows["at"].min())

        def _take(self, key: tuple, p: list, rows: np.ndarray) -> pd.DataFrame:
            self._in_order(key, p, rows)

            def before(ufunc, start, column):
                return ufunc.accumulate(np.concatenate(([start], column)))[:-1]

            sign, best, value, there = signs[key[1]], p[1], rows["value"], ~rows["missing"]
            nan = there & np.isnan(value)
            score = np.where(there & ~nan, sign * value, -np.inf)
            known = best is not None
            over = known and bool(np.isnan(best))
            top = before(np.maximum, sign * best if known and not over else -np.inf, score)
            beaten = ~before(np.logical_or, over, nan) & (nan | (score > top))
            gained = ~before(np.logical_or, known, there) | (there & beaten)
            n = np.arange(1, len(rows) + 1)
            gain = np.maximum.accumulate(np.where(gained, n, 0))
            streak = np.where(gain > 0, n - gain, p[3] + n)
            evals = p[2] + n
            stop = np.logical_or.accumulate(~gained & there & (evals >= min_evals) & (streak >= patience)) | p[4]
            source = np.maximum.accumulate(np.where(gained & there, n, 0))
            bests = np.where(source > 0, value[source - 1], best if known else np.nan)
            unknown = (source == 0) & (not known)
            p[0], p[2], p[3], p[4] = int(rows["tune_index"][-1]), int(evals[-1]), int(streak[-1]), bool(stop[-1])
            p[1] = None if unknown[-1] else float(bests[-1])
            columns = {
                "run": key[0], "metric": key[1], "tune_index": rows["tune_index"], "value": value, "value_missing": ~there,
                "best": bests, "best_missing": unknown, "evals": evals, "bad_streak": streak, "should_stop": stop,
            }
            return pd.DataFrame(columns)

        def _release(self, key: tuple, p: list, passed: int) -> Iterator[pd.DataFrame]:
            """Takes the rows whose time has passed and those that follow the last one."""
            places: dict[int, list] = {}
            for (bucket, part), (at,) in list(self.soonest.iterator()):
                places.setdefault(bucket, []).append((part, at))
            left = []
            for bucket, parts in sorted(places.items()):
                follows = every and p[0] is not None and (p[0] + every) // width == bucket
                first = min(at for _, at in parts)
                if first > passed and not follows:
                    left.append(first)
                    continue
                stored = [(bucket, part) for part, _ in sorted(parts)]
                rows = self._firsts([np.frombuffer(self.waiting.getValue(place)[0], layout) for place in stored])
                ready = rows["at"] <= passed
                last = p[0]
                for i, index in enumerate(rows["tune_index"].tolist() if every else ()):
                    if ready[i] or (last is not None and index == last + every):
                        ready[i], last = True, index
                for place in stored:
                    self.waiting.removeKey(place)
                    self.soonest.removeKey(place)
                if not ready.all():
                    left.append(self._wait(p, rows[~ready]))
                taken = rows[ready]
                for at in range(0, len(taken), out_rows):
                    yield self._take(key, p, taken[at : at + out_rows])
            self._wake_at(p, min(left, default=None))

        def _wake_at(self, p: list, at: int | None) -> None:
            """One timer a key, at the time of the first row that waits."""
            if at != p[5]:
                if p[5] is not None:
                    self.handle.deleteTimer(p[5])
                if at is not None:
                    self.handle.registerTimer(at)
                p[5] = at

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            p = self._load()
            soonest, held, size = p[5], [], 0

            def put() -> None:
                nonlocal soonest
                some = self._firsts(held)
                self._in_order(key, p, some)
                first = self._wait(p, some)
                soonest = first if soonest is None else min(soonest, first)

            for frame in rows:
                if key[1] not in signs or frame["tune_index"].isna().any() or frame["at"].isna().any():
                    raise RuntimeError(f"row of {key} without an index, a time or a direction")
                part = np.empty(len(frame), layout)
                for name in layout.names:
                    part[name] = frame[name]
                held.append(part)
                size += len(part)
                if size >= slice_rows:
                    put()
                    held, size = [], 0
            if size:
                put()
            self._wake_at(p, soonest)
            if every and p[0] is not None:
                yield from self._release(key, p, np.iinfo(np.int64).min)
            self.progress.update(tuple(p))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            p = self._load()
            if p[5] == expiredTimerInfo.getExpiryTimeInMs():
                p[5] = None  # it has fired and is gone
            yield from self._release(key, p, timerValues.getCurrentWatermarkInMs())
            self.progress.update(tuple(p))

    # A timer counts whole milliseconds; what comes within one goes when it is over.
    at = F.ceil(F.unix_micros(F.col(event_time)) / 1000).cast("bigint")
    timed = metrics.withWatermark(event_time, delay).withColumns({"at": at, "missing": F.col("value").isNull()})
    taken = (
        timed.select("run", "metric", "tune_index", "value", "missing", "at", event_time)
        .groupBy("run", "metric")
        .transformWithStateInPandas(Stopping(), TAKEN, "append", "EventTime")
    )
    number = {c: F.when(~F.col(f"{c}_missing"), F.coalesce(c, F.lit(float("nan")))) for c in ("value", "best")}
    return taken.withColumns(number).drop("value_missing", "best_missing")
