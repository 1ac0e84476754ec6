"""Streaming rollups and stateful operators on run logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.telemetry import METRIC_MODES, image_window, throughput_aggregates
from tessera.sources.logs import METRIC_KEY


def step_log_rollup(log: DataFrame, interval: int, anchor_count: int, images_in_step: str | int) -> DataFrame:
    """Throughput per image-count window (update mode). State holds one row of
    partial aggregates per window.

    ``images_in_step`` is the column with the images of a step (the last step of a
    budget has fewer), or their number where all steps are alike.
    """
    images = F.col(images_in_step) if isinstance(images_in_step, str) else F.lit(images_in_step)
    windowed = log.withColumn("prev_images", F.col("images_seen") - images).withColumn(
        "window_id", image_window(F.col("prev_images"), interval)
    )
    return windowed.groupBy("window_id").agg(*throughput_aggregates(anchor_count))


def dedupe_metrics(log: DataFrame) -> DataFrame:
    """First row of each metric key. State grows with the number of evaluations,
    not with the rows of the log."""
    return log.dropDuplicates(METRIC_KEY)


def latest_metrics(log: DataFrame) -> DataFrame:
    """Newest value per metric (update mode); repeated rows change nothing."""
    return log.groupBy("plugin", "dataset", "metric").agg(
        F.max_by("value", "tune_index").alias("value"), F.max("tune_index").alias("tune_index")
    )


STOP_SCHEMA = (
    "run string, metric string, tune_index bigint, value double, best double, evals bigint, "
    "bad_streak bigint, should_stop boolean"
)
STOP_STATE = "last bigint, best double, evals bigint, bad_streak bigint, should_stop boolean"


#: Rows of a key that become Python objects at a time.
SLICE = 8192


def _in_order(chunks: Iterator[pd.DataFrame], order: str, last: int | None, key: tuple) -> Iterator[pd.DataFrame]:
    """A key's rows of one micro-batch in order, in parts of ``SLICE`` rows; a row that
    comes after a later one of an earlier micro-batch is an error, for what was emitted
    can't be taken back. Chunks should hold numbers alone: all of them wait for the sort."""
    rows = pd.concat(list(chunks), ignore_index=True).sort_values(order)
    if last is not None and len(rows) and rows[order].iloc[0] <= last:
        raise RuntimeError(f"{order} {rows[order].iloc[0]} of {key} arrived after {last}")
    for at in range(0, len(rows), SLICE):
        yield rows.iloc[at : at + SLICE]


def early_stop_stream(metrics: DataFrame, patience: int, min_evals: int = 1, modes=None) -> DataFrame:
    """Stateful early stopping per (run, metric); five numbers of state per key.

    Rows of a key are taken in ``tune_index`` order within a micro-batch, and
    micro-batches have to follow that order: a row that arrives late stops the stream
    instead of giving another result than the same rows in one batch.
    """
    modes = dict(METRIC_MODES if modes is None else modes)

    def advance(key, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, metric = key
        sign = {"max": 1.0, "min": -1.0}[modes[metric]]
        last, best, evals, streak, stopped = state.get if state.exists else (None, None, 0, 0, False)
        columns = ["run", "metric", "tune_index", "value", "best", "evals", "bad_streak", "should_stop"]
        for rows in _in_order((c[["tune_index", "value"]] for c in chunks), "tune_index", last, key):
            out = []
            for index, value in zip(rows["tune_index"], rows["value"]):
                evals += 1
                if best is None or sign * value > sign * best:
                    best, streak = float(value), 0
                else:
                    streak += 1
                    stopped = stopped or (evals >= min_evals and streak >= patience)
                last = int(index)
                out.append((run, metric, last, float(value), best, evals, streak, stopped))
            yield pd.DataFrame(out, columns=columns)
        state.update((last, best, evals, streak, stopped))

    return (
        metrics.select("run", "metric", "tune_index", "value")
        .groupBy("run", "metric")
        .applyInPandasWithState(
            advance, STOP_SCHEMA, STOP_STATE, "append", GroupStateTimeout.NoTimeout
        )
    )


QUEUE_SCHEMA = "run string, seq bigint, tune_index bigint, outcome string, queue_depth bigint, dropped_total bigint"
QUEUE_STATE = "last bigint, pending array<bigint>, dropped_total bigint"


def bounded_queue_stream(events: DataFrame, max_pending: int, fail_on_backlog: bool = False) -> DataFrame:
    """Bounded queue per run that keeps the newest jobs.

    Events are (run, seq, tune_index, kind) with kind 'submit' or 'take', replayed
    in ``seq`` order; one that arrives after a later one stops the stream. Emits 'kept'
    and 'dropped' for submissions, 'taken' for takes.
    """
    if max_pending <= 0:
        raise ValueError("max_pending must be > 0")

    def advance(key, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (run,) = key
        last, pending, dropped_total = state.get if state.exists else (None, [], 0)
        pending = list(pending)
        columns = ["run", "seq", "tune_index", "outcome", "queue_depth", "dropped_total"]
        slim = (c[["seq", "tune_index"]].assign(take=c["kind"] == "take") for c in chunks)
        for rows in _in_order(slim, "seq", last, key):
            out = []
            for seq, index, take in zip(rows["seq"], rows["tune_index"], rows["take"]):
                last = int(seq)
                if take:
                    if pending:
                        out.append((run, seq, pending.pop(0), "taken", len(pending), dropped_total))
                    continue
                while len(pending) >= max_pending:
                    if fail_on_backlog:
                        raise RuntimeError(f"backlog limit reached for {run}: {max_pending} pending jobs")
                    dropped_total += 1
                    out.append((run, seq, pending.pop(0), "dropped", len(pending), dropped_total))
                pending.append(int(index))
                out.append((run, seq, int(index), "kept", len(pending), dropped_total))
            yield pd.DataFrame(out, columns=columns)
        state.update((last, pending, dropped_total))

    return events.groupBy("run").applyInPandasWithState(
        advance, QUEUE_SCHEMA, QUEUE_STATE, "append", GroupStateTimeout.NoTimeout
    )
