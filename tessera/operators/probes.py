"""Logistic regressions of many overlapping splits, fitted together.

A sample is stored once, with the numbers of the splits that train or test on it. A
pass over the samples gives every unfinished fit its loss and gradient at one trial
point, summed per split in the tasks. Where the curvature is small enough to be summed
too, the tasks also solve for the Newton step; else the driver proposes a step from
the last gradients (limited-memory BFGS). The driver holds weights and gradients of
the splits, never samples, and each fit says how flat it ended.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.arrays import to_doubles
from tessera.operators.agreement import sorted_codes
from tessera.operators.ranking import salted_join
from tessera.session import materialize

SIDES = ("train", "id_test", "ood_test")
#: Most parameters of a fit whose curvature is summed.
NEWTON_WIDTH = 256
#: Steps that limited-memory BFGS remembers.
MEMORY = 10
TOLERANCE = 1e-7


@dataclass
class Fit:
    """State of one split's fit: the mean loss of its rows plus |w|^2 / (2 C n)."""

    rep: int
    split_id: int
    level: float
    rows: int
    point: np.ndarray
    value: float = np.inf
    gradient: np.ndarray | None = None
    step: np.ndarray | None = None
    scale: float = 1.0
    passes: int = 0
    done: bool = False
    history: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    @property
    def trial(self) -> np.ndarray:
        return self.point if self.step is None else self.point + self.scale * self.step

    @property
    def flatness(self) -> float:
        """Largest entry of the gradient."""
        return float(np.abs(self.gradient).max())

    def take(self, value: float, gradient: np.ndarray, newton: np.ndarray | None) -> None:
        """Go to the trial point if that lowers the objective enough, else halve the step."""
        self.passes += 1
        if self.step is not None and not value <= self.value + 1e-4 * self.scale * float(self.gradient @ self.step) + 1e-15:
            self.scale /= 2
            self.done = self.scale < 1e-12
            return
        if self.step is not None:
            moved, turned = self.scale * self.step, gradient - self.gradient
            if moved @ turned > 1e-14:
                self.history = [*self.history[-MEMORY + 1 :], (moved, turned)]
        self.point, self.value, self.gradient = self.trial, value, gradient
        self.done = self.flatness <= TOLERANCE
        self.step, self.scale = newton if newton is not None else self._remembered(), 1.0

    def _remembered(self) -> np.ndarray:
        """Two-loop recursion of limited-memory BFGS."""
        q, used = -self.gradient, []
        for s, y in reversed(self.history):
            a = (s @ q) / (s @ y)
            used.append(a)
            q = q - a * y
        if not self.history:
            return q / max(1.0, float(np.linalg.norm(q)))
        s, y = self.history[-1]
        q = q * ((s @ y) / (y @ y))
        for (s, y), a in zip(self.history, reversed(used), strict=True):
            q = q + (a - (y @ q) / (s @ y)) * s
        return q


def probe_rows(splits: DataFrame, features: DataFrame, feature: str = "feature") -> tuple[DataFrame, list[tuple[int, int, float, int]], int]:
    """Samples with their feature, class code and the split numbers of each side (written);
    (rep, split_id, level, training rows) of every split, by number; and the number of classes.

    All three partitions must be there. As many rows reach the driver as there are splits.
    """
    spark = splits.sparkSession
    memberships = splits.join(features.select("sample_id"), "sample_id", "left_semi")
    counts = memberships.groupBy("rep", "split_id").agg(
        F.max("correlation_level").alias("level"), *[F.count_if(F.col("partition") == p).alias(p) for p in SIDES]
    )
    found = counts.orderBy("rep", "split_id").collect()
    if not found:
        raise RuntimeError("no splits to probe")
    for r in found:
        if not all(r[p] for p in SIDES):
            raise RuntimeError(f"split {r['split_id']} of repetition {r['rep']} lacks a partition")
    known = [(r["rep"], r["split_id"], r["level"], r["train"]) for r in found]
    numbers = spark.createDataFrame([(r[0], r[1], k) for k, r in enumerate(known)], "rep bigint, split_id bigint, number int")
    codes = materialize(sorted_codes(memberships, "label"), "codes")
    sides = [F.collect_list(F.when(F.col("partition") == p, F.col("number"))).alias(p) for p in SIDES]
    grouped = memberships.join(numbers, ["rep", "split_id"]).groupBy("sample_id", "label").agg(*sides)
    coded = salted_join(grouped, codes, ["label"], ["sample_id"])
    rows = coded.join(features.select("sample_id", to_doubles(F.col(feature)).alias("feature")), "sample_id").select("code", "feature", *SIDES)
    return materialize(rows, "probe-rows"), known, codes.count()


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column("feature").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return np.c_[x, np.ones(len(x))]


def _by_split(batch: pa.RecordBatch, side: str) -> Iterator[tuple[int, np.ndarray]]:
    """(split, rows of the batch) on one side."""
    lists = batch.column(side)
    split, row = lists.flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
    order = np.argsort(split, kind="stable")
    split, row = split[order], row[order]
    cuts = np.flatnonzero(np.r_[True, split[1:] != split[:-1]][: len(split)])
    for a, b in zip(cuts, [*cuts[1:], len(split)], strict=False):
        yield int(split[a]), row[a:b]


def _margins(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A column per class with weights of its own (one for two classes)."""
    return x @ weights.reshape(-1, x.shape[1]).T


def loss_of(x: np.ndarray, code: np.ndarray, weights: np.ndarray, curvature: bool) -> tuple[float, np.ndarray, np.ndarray | None]:
    """Sum of the losses, their gradient, and with two classes the matrix of second derivatives."""
    z = _margins(x, weights)
    if z.shape[1] == 1:
        z = z[:, 0]
        p = 1 / (1 + np.exp(-z))
        second = (x * (p * (1 - p))[:, None]).T @ x if curvature else None
        return float((np.logaddexp(0, z) - code * z).sum()), x.T @ (p - code), second
    top = z.max(axis=1, keepdims=True)
    log_sum = top[:, 0] + np.log(np.exp(z - top).sum(axis=1))
    p = np.exp(z - log_sum[:, None])
    p[np.arange(len(x)), code] -= 1
    return float((log_sum - z[np.arange(len(x)), code]).sum()), (p.T @ x).ravel(), None


def _pass(rows: DataFrame, fits: list[Fit], c: float, width: int, curvature: bool) -> dict[int, tuple[float, np.ndarray, np.ndarray | None]]:
    """Objective, gradient and Newton step of each open fit at its trial point."""
    trials = {k: (f.trial, f.rows) for k, f in enumerate(fits) if not f.done}

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            x, code = _matrix(batch), batch.column("code").to_numpy()
            for split, own in _by_split(batch, "train"):
                if split in trials:
                    value, gradient, second = loss_of(x[own], code[own], trials[split][0], curvature)
                    held = sums.setdefault(split, [0.0, 0.0, 0.0])
                    held[0], held[1] = held[0] + value, held[1] + gradient
                    held[2] = held[2] + second if curvature else None
        if sums:
            values, gradients, seconds = zip(*sums.values(), strict=True)
            yield pa.RecordBatch.from_pydict({
                "split": pa.array(list(sums), pa.int32()), "value": pa.array(values, pa.float64()), "gradient": pa.array([g.tobytes() for g in gradients], pa.binary()),
                "second": pa.array([s.tobytes() if curvature else None for s in seconds], pa.binary()),
            })

    def total(key, parts: pd.DataFrame) -> pd.DataFrame:
        point, n = trials[int(key[0])]
        penalised = np.tile(np.r_[np.ones(width - 1), 0.0], len(point) // width) / (c * n)
        add = lambda column: np.sum([np.frombuffer(p) for p in parts[column]], axis=0)
        gradient = add("gradient") / n + penalised * point
        step = []
        if curvature:
            second = add("second").reshape(len(point), -1) / n + np.diag(penalised + 1e-12)
            step = -np.linalg.solve(second, gradient)
        return pd.DataFrame({"split": [key[0]], "value": [parts["value"].sum() / n + 0.5 * float(penalised @ (point * point))], "gradient": [gradient.tolist()], "step": [list(step)]})

    parts = rows.select("code", "feature", "train").mapInArrow(partial, "split int, value double, gradient binary, second binary")
    sums = parts.groupBy("split").applyInPandas(total, "split int, value double, gradient array<double>, step array<double>").collect()
    return {r["split"]: (r["value"], np.array(r["gradient"]), np.array(r["step"]) if curvature else None) for r in sums}


def fit_probes(rows: DataFrame, splits: Sequence[tuple[int, int, float, int]], classes: int, c: float = 1.0, max_iter: int = 1000) -> list[Fit]:
    """Fits of all splits after passes until each is flat, or ``max_iter`` of them."""
    first = rows.select(F.size("feature").alias("d")).first()
    width = first["d"] + 1
    fits = [Fit(*s, point=np.zeros(width * (1 if classes <= 2 else classes))) for s in splits]
    curvature = classes <= 2 and width <= NEWTON_WIDTH
    for _ in range(max_iter):
        if all(f.done for f in fits):
            break
        for k, found in _pass(rows, fits, c, width, curvature).items():
            fits[k].take(*found)
    return fits


def probe_accuracy(rows: DataFrame, fits: list[Fit]) -> DataFrame:
    """(rep, split_id, correlation_level, acc_id, acc_ood, gradient, passes) of every split."""
    weights = [f.point for f in fits]

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(weights), 4), np.int64)
        for batch in batches:
            x, code = _matrix(batch), batch.column("code").to_numpy()
            for k, side in enumerate(SIDES[1:]):
                for split, own in _by_split(batch, side):
                    z = _margins(x[own], weights[split])
                    predicted = z[:, 0] > 0 if z.shape[1] == 1 else z.argmax(axis=1)
                    counts[split, 2 * k : 2 * k + 2] += len(own), np.count_nonzero(predicted == code[own])
        yield pa.RecordBatch.from_pydict({"split": pa.array(range(len(weights)), pa.int32())} | {n: pa.array(counts[:, k]) for k, n in enumerate(("n_id", "right_id", "n_ood", "right_ood"))})

    sums = rows.select("code", "feature", *SIDES[1:]).mapInArrow(tally, "split int, n_id long, right_id long, n_ood long, right_ood long").groupBy("split")
    totals = sums.agg(*[F.sum(n).alias(n) for n in ("n_id", "right_id", "n_ood", "right_ood")])
    known = rows.sparkSession.createDataFrame(
        [(k, f.rep, f.split_id, f.level, f.flatness, f.passes) for k, f in enumerate(fits)],
        "split int, rep bigint, split_id bigint, correlation_level double, gradient double, passes int",
    )
    share = lambda side: (F.col(f"right_{side}") / F.col(f"n_{side}")).alias(f"acc_{side}")
    return known.join(totals, "split").select("rep", "split_id", "correlation_level", share("id"), share("ood"), "gradient", "passes")


def linear_models(fits: list[Fit], width: int) -> list[tuple[int, int, list[list[float]], list[float]]]:
    """(rep, split_id, weights per class, intercepts) of each fit."""
    shaped = [(f, f.point.reshape(-1, width)) for f in fits]
    return [(f.rep, f.split_id, w[:, :-1].tolist(), w[:, -1].tolist()) for f, w in shaped]
