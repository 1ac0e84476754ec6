"""Run telemetry: image-count windows, meters, early stopping, budgets, queues.

Progress is measured in images seen. Everything ordered goes through the
two-level helpers, so one run holding most of the log is no bottleneck.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranking import (
    BUCKET,
    _attach,
    bucketed_row_number,
    fixed_width_bucket,
    previous_value,
    running,
    salted_join,
)
from tessera.session import materialize

ORDER_BUCKET = 1 << 16
# Whether a larger or a smaller value of a metric counts as better.
METRIC_MODES = {
    "ri": "max",
    "clustering_score": "max",
    "apd_id": "min",
    "apd_ood": "min",
    "apd_avg": "min",
}
SLOW_STEP_MS = 250.0  # fixed values: default alert thresholds
SLOW_WAIT_MS = 50.0


def images_seen(log: DataFrame, keys: Sequence[str], order: str, batch: str, budget: int) -> DataFrame:
    """Running image counter capped at the budget, and images of the step itself."""
    total = running(
        log,
        keys,
        [order],
        fixed_width_bucket(F.col(order), ORDER_BUCKET),
        {"__sum": ("sum", batch, True)},
    )
    cap = F.lit(int(budget))
    return (
        total.withColumn("images_seen", F.least(cap, F.col("__sum")))
        .withColumn(
            "images_processed", F.col("images_seen") - F.least(cap, F.col("__sum") - F.col(batch))
        )
        .drop("__sum")
    )


def with_previous_images(log: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Adds ``prev_images``: images seen after the previous step, 0 at the start."""
    return previous_value(
        log, keys, order, fixed_width_bucket(F.col(order), ORDER_BUCKET), "images_seen", "__prev"
    ).withColumn("prev_images", F.coalesce("__prev", F.lit(0))).drop("__prev")


def crossed_thresholds(log: DataFrame, interval: int, out: str = "threshold") -> DataFrame:
    """One row per multiple of ``interval`` in (prev_images, images_seen]."""
    if interval <= 0:
        raise ValueError("interval must be > 0")
    first = F.floor(F.col("prev_images") / interval).cast("bigint") + 1
    last = F.floor(F.col("images_seen") / interval).cast("bigint")
    return (
        log.withColumn("__first", first)
        .withColumn("__last", last)
        .where("__first <= __last")
        .withColumn(out, F.explode(F.sequence("__first", "__last")))
        .withColumn(out, F.col(out) * F.lit(interval))
        .withColumn("next_threshold", (F.col("__last") + 1) * F.lit(interval))
        .drop("__first", "__last")
    )


def image_window(prev_images: Column, interval: int) -> Column:
    """Log window of a step: it closes with the step that crosses its threshold."""
    return F.floor(prev_images / interval).cast("bigint")


def _per_second(amount: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, amount / seconds).otherwise(F.lit(0.0))


def throughput_aggregates(anchor_count: int, order: str = "iteration") -> list[Column]:
    seconds = F.greatest(F.lit(0.0), F.sum("iteration_time_ms") / 1000.0)
    images = F.sum(F.col("images_seen") - F.col("prev_images"))
    return [
        images.alias("images"),
        F.count(F.lit(1)).alias("iterations"),
        seconds.alias("seconds"),
        _per_second(images, seconds).alias("images_per_sec"),
        _per_second(F.count(F.lit(1)), seconds).alias("iterations_per_sec"),
        F.avg("loss").alias("loss_avg"),
        F.min("loss").alias("loss_min"),
        F.max("loss").alias("loss_max"),
        F.avg("context_keep_tokens").alias("context_keep_tokens_avg"),
        F.avg("target_predict_tokens").alias("target_predict_tokens_avg"),
        F.avg("iteration_time_ms").alias("iteration_time_ms_avg"),
        F.max_by("learning_rate", order).alias("lr"),
        F.max_by("weight_decay", order).alias("wd"),
        F.max("images_seen").alias("last_images_seen"),
        (F.max("images_seen") / F.lit(float(max(1, anchor_count)))).alias("anchor_passes_seen"),
    ]


def throughput_window(log: DataFrame, interval: int, anchor_count: int, keys: Sequence[str] = ()) -> DataFrame:
    """Loss, speed and token averages per image-count window."""
    windowed = log.withColumn("window_id", image_window(F.col("prev_images"), interval))
    return windowed.groupBy(*keys, "window_id").agg(*throughput_aggregates(anchor_count))


def pass_summary(log: DataFrame, anchor_count: int, keys: Sequence[str] = ()) -> DataFrame:
    """The same rollup per pass over the anchors."""
    return log.groupBy(*keys, "pass_index").agg(*throughput_aggregates(anchor_count))


PHASES = {
    "loop": "iteration_time_ms",
    "data_wait": "data_wait_ms",
    "h2d": "host_to_device_ms",
    "compute": "compute_ms",
    "tune_poll": "tune_poll_ms",
    "overhead": "overhead_ms",
}


def with_overhead(log: DataFrame) -> DataFrame:
    """Loop time not accounted for by the measured phases, never negative."""
    known = (
        F.col("data_wait_ms")
        + F.col("host_to_device_ms")
        + F.greatest(F.lit(0.0), F.col("compute_ms"))
        + F.col("tune_poll_ms")
    )
    return log.withColumn(
        "overhead_ms", F.greatest(F.lit(0.0), F.col("iteration_time_ms") - known)
    )


def perf_window(log: DataFrame, interval: int, keys: Sequence[str] = ()) -> DataFrame:
    """Average and maximum of each phase and reader-cache ratios per window."""
    windowed = with_overhead(log).withColumn(
        "window_id", image_window(F.col("prev_images"), interval)
    )
    samples = F.greatest(F.lit(1), F.sum(F.col("cache_hits") + F.col("cache_misses")))
    return windowed.groupBy(*keys, "window_id").agg(
        *[
            stat(column).alias(f"{name}_{kind}")
            for name, column in PHASES.items()
            for kind, stat in (("avg", F.avg), ("max", F.max))
        ],
        (F.sum("cache_hits") / samples).alias("cache_hit_ratio"),
        (F.sum("cache_misses") / samples).alias("cache_miss_ratio"),
        F.sum("cache_evictions").alias("cache_evictions"),
        F.coalesce(
            F.avg(F.when(F.col("cache_hits") + F.col("cache_misses") > 0, F.col("cache_open_slides"))),
            F.lit(0.0),
        ).alias("cache_open_slides_avg"),
    )


def perf_spikes(log: DataFrame, slow_step_ms: float = SLOW_STEP_MS, slow_wait_ms: float = SLOW_WAIT_MS) -> DataFrame:
    return log.where(
        (F.col("iteration_time_ms") >= slow_step_ms) | (F.col("data_wait_ms") >= slow_wait_ms)
    )


def non_finite(log: DataFrame, column: str = "loss") -> DataFrame:
    """Rows whose value is NaN or infinite; they are reported whatever the cadence."""
    value = F.col(column)
    return log.where(F.isnan(value) | (F.abs(value) == F.lit(float("inf"))))


def reader_cache_counters(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    samples = F.sum(F.col("cache_hits") + F.col("cache_misses"))
    return log.groupBy(*keys).agg(
        F.sum("cache_hits").alias("hits"),
        F.sum("cache_misses").alias("misses"),
        F.sum("cache_evictions").alias("evictions"),
        F.when(samples > 0, F.sum("cache_misses") / samples).otherwise(F.lit(0.0)).alias("miss_ratio"),
        F.avg("cache_open_slides").alias("open_slides"),
    )


def running_counters(log: DataFrame, keys: Sequence[str], order: str, counters: Sequence[str]) -> DataFrame:
    """Cumulative value of each counter."""
    return running(
        log,
        keys,
        [order],
        fixed_width_bucket(F.col(order), ORDER_BUCKET),
        {f"total_{c}": ("sum", c, True) for c in counters},
    )


def cache_events(visits: DataFrame, keys: Sequence[str], order: str, slide: str) -> DataFrame:
    """Hit/miss flag per visit of a reader holding its last slide only.

    Larger caches depend on the whole visit history of a worker and belong to the
    reader; their counters enter through the step log.
    """
    seen = previous_value(
        visits, keys, order, fixed_width_bucket(F.col(order), ORDER_BUCKET), slide, "__before"
    )
    hit = F.coalesce(F.col("__before") == F.col(slide), F.lit(False))
    return (
        seen.withColumn("hit", hit.cast("int"))
        .withColumn("miss", (~hit).cast("int"))
        .withColumn("eviction", (~hit & F.col("__before").isNotNull()).cast("int"))
        .drop("__before")
    )


def meter(df: DataFrame, value: str, order: str, weight: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Last, weighted average, extremes, sum and count of a series."""
    w = F.col(weight) if weight else F.lit(1)
    return df.groupBy(*keys).agg(
        F.max_by(value, order).alias("last"),
        (F.sum(F.col(value) * w) / F.sum(w)).alias("avg"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.sum(F.col(value) * w).alias("total"),
        F.sum(w).cast("bigint").alias("count"),
    )


def grad_norm_stats(norms: DataFrame, step: str, order: Column, name: str, norm: str) -> DataFrame:
    """Per step: mean and extremes over weight matrices, and the first and last
    attention projection (0 where a step has none). Biases are left out."""
    weights = norms.where(~F.col(name).endswith(".bias"))
    is_qkv = F.col(name).contains("qkv")
    ends = [
        F.coalesce(pick(F.when(is_qkv, F.col(norm)), F.when(is_qkv, order)), F.lit(0.0)).alias(out)
        for pick, out in ((F.min_by, "first_layer"), (F.max_by, "last_layer"))
    ]
    return weights.groupBy(step).agg(
        F.avg(norm).alias("avg"), F.min(norm).alias("min"), F.max(norm).alias("max"), *ends
    )


def early_stop(
    metrics: DataFrame,
    keys: Sequence[str],
    order: str,
    patience: int,
    min_evals: int = 1,
    mode: Column | str | None = None,
) -> DataFrame:
    """Best value so far, evaluations since, and the sticky stop flag per row.

    ``mode`` is 'max', 'min' or a column of these; by default it follows the
    ``metric`` column.
    """
    if patience <= 0:
        raise ValueError("patience must be > 0")
    judged = materialize(best_so_far(metrics, keys, order, mode), "judged")
    stops = ~F.col("improved") & (F.col("evals") >= min_evals) & (F.col("bad_streak") >= patience)
    first = judged.groupBy(*keys).agg(F.min(F.when(stops, F.col("evals"))).alias("__stop"))
    known = salted_join(judged, first, keys, ["evals"])
    return known.withColumn("should_stop", F.coalesce(F.col("evals") >= F.col("__stop"), F.lit(False))).drop("__stop")


def best_so_far(metrics: DataFrame, keys: Sequence[str], order: str, mode: Column | str | None = None) -> DataFrame:
    """Per row: evals (its place from 1), best, improved, and bad_streak, the rows since the last improvement.

    A bucket of rows sums up as its size, its best value and where that came first. From
    these follow the best and the last improvement before each bucket, and from them
    everything inside a bucket, by windows of one exchange.
    """
    if mode is None:
        table = F.create_map(*[F.lit(x) for pair in METRIC_MODES.items() for x in pair])
        mode = F.element_at(table, F.col("metric"))
    elif isinstance(mode, str):
        if mode not in ("min", "max"):
            raise ValueError(f"unsupported mode: {mode}")
        mode = F.lit(mode)
    sign = (
        F.when(mode == "max", F.lit(1.0))
        .when(mode == "min", F.lit(-1.0))
        .otherwise(F.raise_error(F.lit("metric has no known direction")).cast("double"))
    )
    bucket = fixed_width_bucket(F.col(order), ORDER_BUCKET)
    scored = metrics.withColumn("__sign", sign).withColumn("__v", F.col("value") * F.col("__sign"))
    inside = Window.partitionBy(*keys, BUCKET).orderBy(order)
    earlier = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    rows = scored.withColumn(BUCKET, bucket).withColumn("__at", F.row_number().over(inside))
    sums = rows.groupBy(*keys, BUCKET).agg(
        F.count(F.lit(1)).alias("__n"), F.max("__v").alias("__top"), F.min_by("__at", F.struct(F.col("__v").isNull().alias("none"), (-F.col("__v")).alias("v"), "__at")).alias("__first")
    )
    carried = sums.select(
        *keys, BUCKET, "__top", "__first", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset"), F.max("__top").over(earlier).alias("__best_before")
    )
    gained = F.col("__best_before").isNull() | (F.col("__top") > F.col("__best_before"))
    place = F.when(gained, F.col("__offset") + F.col("__first") - 1)
    carried = carried.withColumn("__last_before", F.max(place).over(earlier)).drop("__top", "__first")
    placed = _attach(rows, carried, keys).withColumn("__pos", F.col("__offset") + F.col("__at") - 1)
    before = F.greatest("__best_before", F.max("__v").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    marked = placed.withColumn("__before", before).withColumn("improved", F.col("__before").isNull() | (F.col("__v") > F.col("__before")))
    own_last = F.max(F.when(F.col("improved"), F.col("__pos"))).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        marked.withColumn("bad_streak", F.col("__pos") - F.greatest("__last_before", own_last))
        .withColumn("evals", F.col("__pos") + 1)
        .withColumn("best", F.greatest("__before", "__v") * F.col("__sign"))
        .drop("__sign", "__v", "__at", "__pos", "__before", "__offset", "__best_before", "__last_before", BUCKET)
    )


def anchor_pass_budget(
    counts: DataFrame,
    budget: Column,
    interval: Column,
    baseline: bool,
    low: float = 1.0,
    high: float = 5.0,
    anchors: str = "anchors",
) -> DataFrame:
    """Passes, first-pass coverage, reuse and expected evaluations per row."""
    n = F.when(F.col(anchors) <= 0, F.raise_error(F.lit("anchor count must be > 0"))).otherwise(
        F.col(anchors)
    )
    passes = budget / n.cast("double")
    return (
        counts.withColumn("anchor_passes_total", passes)
        .withColumn("coverage_first_pass", F.least(F.lit(1.0), F.col("anchor_passes_total")))
        .withColumn("mean_anchor_reuse", F.greatest(F.lit(0.0), F.col("anchor_passes_total") - 1))
        .withColumn(
            "expected_tune_events",
            F.floor(budget / interval).cast("bigint") + F.lit(1 if baseline else 0),
        )
        .withColumn(
            "warning",
            F.when(F.col("anchor_passes_total") < low, "low")
            .when(F.col("anchor_passes_total") > high, "high")
            .otherwise(""),
        )
    )


def job_latency(jobs: DataFrame, images_now: Column) -> DataFrame:
    """Queue latency, worker time and how many images late a result arrives."""
    return (
        jobs.withColumn("latency_seconds", F.col("finished_at_s") - F.col("enqueued_at_s"))
        .withColumn("worker_seconds", F.col("finished_at_s") - F.col("started_at_s"))
        .withColumn("lag_images", F.greatest(F.lit(0), images_now - F.col("images_seen")))
    )


def match_jobs(submitted: DataFrame, completed: DataFrame, dropped: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fate of every job; results without a submission stay visible."""
    merged = (
        submitted.select(*keys, F.lit(1).alias("s"))
        .join(completed.select(*keys, F.lit(1).alias("c")), list(keys), "full_outer")
        .join(dropped.select(*keys, F.lit(1).alias("d")), list(keys), "full_outer")
    )
    fate = (
        F.when(F.col("s").isNull(), "unknown")
        .when(F.col("c").isNotNull(), "completed")
        .when(F.col("d").isNotNull(), "dropped")
        .otherwise("pending")
    )
    return merged.select(*keys, fate.alias("fate"))


def keep_last_n(df: DataFrame, keys: Sequence[str], order: str, n: int) -> DataFrame:
    """Marks the newest ``n`` rows of each key; the others are ``expired``."""
    if n < 0:
        raise ValueError("n must be >= 0")
    ranked = bucketed_row_number(
        df, keys, [order], fixed_width_bucket(F.col(order), ORDER_BUCKET), "__pos", total="__total"
    )
    return ranked.withColumn("expired", F.col("__pos") < F.col("__total") - n).drop("__pos", "__total")


def due(index: Column, every_n: Column, enabled: Column = None) -> Column:
    """Cadence test: enabled, a positive interval, and a multiple of it."""
    on = F.lit(True) if enabled is None else enabled
    return on & (every_n > 0) & (F.pmod(index, F.nullif(every_n, F.lit(0))) == 0)


def append_defaults(rows: DataFrame, plugin: str, tune_index: int, images: int) -> DataFrame:
    """Metric rows with missing plugin, tune_index and images_seen filled in."""
    defaults = {"plugin": F.lit(plugin), "tune_index": F.lit(tune_index), "images_seen": F.lit(images)}
    for name, value in defaults.items():
        current = F.col(name) if name in rows.columns else F.lit(None)
        rows = rows.withColumn(name, F.coalesce(current, value))
    return rows


def select_metric(metrics: DataFrame, plugin: str, dataset: str, metric: str) -> DataFrame:
    """Value of the metric that drives selection; an event without it is an error."""
    mode = METRIC_MODES.get(metric)
    if mode is None:
        raise ValueError(f"metric {metric!r} has no known direction")
    wanted = (
        (F.col("plugin") == plugin) & (F.col("dataset") == dataset) & (F.col("metric") == metric)
    )
    value = F.max(F.when(wanted, F.col("value")))
    per_event = metrics.groupBy("tune_index").agg(value.alias("__v"))
    return per_event.select(
        "tune_index",
        F.when(
            F.col("__v").isNull(),
            F.raise_error(F.lit(f"{plugin}/{dataset}/{metric} was not emitted in an evaluation")),
        )
        .otherwise(F.col("__v"))
        .alias("metric_value"),
        F.lit(mode).alias("mode"),
    )
