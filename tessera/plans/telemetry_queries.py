"""Run-telemetry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import telemetry as Y
from tessera.plans.index_queries import ANCHOR_CTES, anchors
from tessera.plans.oracle_ctes import CTES
from tessera.plans.registry import query, with_ctes
from tessera.sources import fixtures as X


def _log(spark, sf):
    """Step log with the previous image count (64 images per step)."""
    return X.step_log(spark, sf).withColumn("prev_images", F.col("images_seen") - 64)


@query(
    "images_seen",
    """SELECT run, event_id, least(20000, s) AS images_seen, least(20000, s) - least(20000, s - b) AS images_processed
       FROM (SELECT user_id % 10 AS run, event_id, 1 + event_id % 64 AS b, sum(1 + event_id % 64) OVER (PARTITION BY user_id % 10 ORDER BY event_id)::BIGINT AS s FROM events)""",
)
def images_seen(spark, sf):
    e = F.col("event_id")
    log = X.table(spark, sf, "events").select(
        (F.col("user_id") % 10).alias("run"), "event_id", (1 + e % 64).alias("batch")
    )
    return Y.images_seen(log, ["run"], "event_id", "batch", 20000).drop("batch")


@query(
    "crossed_thresholds",
    """SELECT run, event_id, m * 3000 AS threshold, (images // 3000 + 1) * 3000 AS next_threshold
       FROM (SELECT *, unnest(range(prev // 3000 + 1, images // 3000 + 1)) AS m
             FROM (SELECT user_id % 10 AS run, event_id, 64 * (event_id + 1) AS images,
                     coalesce(lag(64 * (event_id + 1)) OVER (PARTITION BY user_id % 10 ORDER BY event_id), 0) AS prev FROM events))""",
)
def crossed_thresholds(spark, sf):
    e = F.col("event_id")
    log = X.table(spark, sf, "events").select(
        (F.col("user_id") % 10).alias("run"), "event_id", (64 * (e + 1)).alias("images_seen")
    )
    crossed = Y.crossed_thresholds(Y.with_previous_images(log, ["run"], "event_id"), 3000)
    return crossed.select("run", "event_id", "threshold", "next_threshold")


THROUGHPUT = """count(*) * 64 AS images, count(*) AS iterations, round(sum(iteration_time_ms) / 1000, 6) AS seconds,
  round(CASE WHEN sum(iteration_time_ms) > 0 THEN count(*) * 64 / (sum(iteration_time_ms) / 1000) ELSE 0 END, 6) AS images_per_sec,
  round(CASE WHEN sum(iteration_time_ms) > 0 THEN count(*) / (sum(iteration_time_ms) / 1000) ELSE 0 END, 6) AS iterations_per_sec,
  round(avg(loss), 6) AS loss_avg, min(loss) AS loss_min, max(loss) AS loss_max,
  round(avg(context_keep_tokens), 6) AS context_keep_tokens_avg, round(avg(target_predict_tokens), 6) AS target_predict_tokens_avg,
  round(avg(iteration_time_ms), 6) AS iteration_time_ms_avg, round(arg_max(learning_rate, iteration), 9) AS lr,
  round(arg_max(weight_decay, iteration), 9) AS wd, max(images_seen) AS last_images_seen, round(max(images_seen) / 1500.0::DOUBLE, 6) AS anchor_passes_seen"""


def _rounded(df):
    nine = {"lr", "wd"}
    return df.select(
        *[
            F.round(c, 9 if c in nine else 6).alias(c) if t == "double" else F.col(c)
            for c, t in df.dtypes
        ]
    )


@query(
    "throughput_window",
    with_ctes(CTES, "steps", f"SELECT rank, (images_seen - 64) // 10000 AS window_id, {THROUGHPUT} FROM steps GROUP BY ALL"),
)
def throughput_window(spark, sf):
    return _rounded(Y.throughput_window(_log(spark, sf), 10000, 1500, ["rank"]))


@query(
    "pass_summary",
    with_ctes(CTES, "steps", f"SELECT pass_index, {THROUGHPUT} FROM steps GROUP BY ALL"),
)
def pass_summary(spark, sf):
    return _rounded(Y.pass_summary(_log(spark, sf), 1500))


@query(
    "perf_window",
    with_ctes(
        CTES,
        "steps",
        """SELECT (images_seen - 64) // 10000 AS window_id,
             round(avg(iteration_time_ms), 6) AS loop_avg, max(iteration_time_ms) AS loop_max, round(avg(data_wait_ms), 6) AS data_wait_avg, max(data_wait_ms) AS data_wait_max,
             round(avg(host_to_device_ms), 6) AS h2d_avg, max(host_to_device_ms) AS h2d_max, round(avg(compute_ms), 6) AS compute_avg, max(compute_ms) AS compute_max,
             round(avg(tune_poll_ms), 6) AS tune_poll_avg, max(tune_poll_ms) AS tune_poll_max,
             round(avg(greatest(0, iteration_time_ms - data_wait_ms - host_to_device_ms - compute_ms - tune_poll_ms)), 6) AS overhead_avg,
             max(greatest(0, iteration_time_ms - data_wait_ms - host_to_device_ms - compute_ms - tune_poll_ms)) AS overhead_max,
             round(sum(cache_hits) / greatest(1, sum(cache_hits + cache_misses)), 6) AS cache_hit_ratio,
             round(sum(cache_misses) / greatest(1, sum(cache_hits + cache_misses)), 6) AS cache_miss_ratio, sum(cache_evictions)::BIGINT AS cache_evictions,
             round(coalesce(avg(cache_open_slides) FILTER (cache_hits + cache_misses > 0), 0), 6) AS cache_open_slides_avg
           FROM steps GROUP BY ALL""",
    ),
)
def perf_window(spark, sf):
    return _rounded(Y.perf_window(_log(spark, sf), 10000))


@query(
    "perf_spikes",
    with_ctes(CTES, "steps", "SELECT iteration, iteration_time_ms, data_wait_ms FROM steps WHERE iteration_time_ms >= 250 OR data_wait_ms >= 50"),
)
def perf_spikes(spark, sf):
    return Y.perf_spikes(_log(spark, sf)).select("iteration", "iteration_time_ms", "data_wait_ms")


@query(
    "non_finite_losses",
    "SELECT event_id, event_id % 14 = 0 AS is_nan FROM events WHERE event_id % 7 = 0",
)
def non_finite_losses(spark, sf):
    e = F.col("event_id")
    bad = F.when(e % 14 == 0, F.lit(float("nan"))).when(e % 7 == 0, F.lit(float("-inf")))
    log = X.table(spark, sf, "events").select("event_id", F.coalesce(bad, "value").alias("loss"))
    return Y.non_finite(log).select("event_id", F.isnan("loss").alias("is_nan"))


@query(
    "reader_cache_counters",
    with_ctes(
        CTES,
        "steps",
        """SELECT pass_index, sum(cache_hits)::BIGINT AS hits, sum(cache_misses)::BIGINT AS misses, sum(cache_evictions)::BIGINT AS evictions,
             round(sum(cache_misses) / sum(cache_hits + cache_misses), 6) AS miss_ratio, round(avg(cache_open_slides), 6) AS open_slides FROM steps GROUP BY 1""",
    ),
)
def reader_cache_counters(spark, sf):
    return _rounded(Y.reader_cache_counters(_log(spark, sf), ["pass_index"]))


@query(
    "running_counters",
    with_ctes(
        CTES,
        "steps",
        """SELECT rank, iteration, sum(cache_hits) OVER w::BIGINT AS total_cache_hits, sum(cache_misses) OVER w::BIGINT AS total_cache_misses
           FROM steps WINDOW w AS (PARTITION BY rank ORDER BY iteration)""",
    ),
)
def running_counters(spark, sf):
    counted = Y.running_counters(_log(spark, sf), ["rank"], "iteration", ["cache_hits", "cache_misses"])
    return counted.select("rank", "iteration", "total_cache_hits", "total_cache_misses")


@query(
    "cache_events",
    """SELECT run, sum(CASE WHEN prev IS NOT DISTINCT FROM slide THEN 1 ELSE 0 END)::BIGINT AS hits, sum(CASE WHEN prev IS DISTINCT FROM slide THEN 1 ELSE 0 END)::BIGINT AS misses,
         sum(CASE WHEN prev IS DISTINCT FROM slide AND prev IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS evictions
       FROM (SELECT user_id % 10 AS run, event_type AS slide, lag(event_type) OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS prev FROM events) GROUP BY run""",
)
def cache_events(spark, sf):
    visits = X.table(spark, sf, "events").select(
        (F.col("user_id") % 10).alias("run"), "event_id", F.col("event_type").alias("slide")
    )
    return Y.cache_events(visits, ["run"], "event_id", "slide").groupBy("run").agg(
        F.sum("hit").alias("hits"), F.sum("miss").alias("misses"), F.sum("eviction").alias("evictions")
    )


@query(
    "meter",
    """SELECT event_type, arg_max(value, event_id) AS last, round(sum(value * (1 + user_id % 5)) / sum(1 + user_id % 5), 6) AS avg, min(value) AS min, max(value) AS max,
         round(sum(value * (1 + user_id % 5)), 6) AS total, sum(1 + user_id % 5)::BIGINT AS count FROM events GROUP BY 1""",
)
def meter(spark, sf):
    events = X.table(spark, sf, "events").withColumn("w", 1 + F.col("user_id") % 5)
    return _rounded(Y.meter(events, "value", "event_id", "w", ["event_type"]))


@query(
    "grad_norm_stats",
    """SELECT step, round(avg(norm), 9) AS avg, round(min(norm), 9) AS min, round(max(norm), 9) AS max,
         round(coalesce(arg_min(norm, o) FILTER (l_linenumber % 3 = 0), 0), 9) AS first_layer, round(coalesce(arg_max(norm, o) FILTER (l_linenumber % 3 = 0), 0), 9) AS last_layer
       FROM (SELECT l_orderkey AS step, l_linenumber, l_extendedprice / 1000 AS norm, (l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS o FROM lineitem WHERE l_linenumber % 3 <> 2)
       GROUP BY step""",
)
def grad_norm_stats(spark, sf):
    n = F.col("l_linenumber")
    kind = F.when(n % 3 == 0, "attn.qkv.weight").when(n % 3 == 1, "mlp.fc1.weight").otherwise("mlp.fc1.bias")
    norms = X.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("step"),
        F.concat(F.lit("blocks."), n.cast("string"), F.lit("."), kind).alias("name"),
        (F.col("l_extendedprice") / 1000).alias("norm"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("o"),
    )
    stats = Y.grad_norm_stats(norms, "step", F.col("o"), "name", "norm")
    return stats.select("step", *[F.round(c, 9).alias(c) for c in stats.columns if c != "step"])


@query(
    "early_stop",
    with_ctes(
        CTES,
        "metrics",
        """, m AS (SELECT *, CASE WHEN metric IN ('ri', 'clustering_score') THEN value ELSE -value END AS v,
             row_number() OVER (PARTITION BY run, metric ORDER BY tune_index) AS n FROM metrics),
           b AS (SELECT *, max(v) OVER (PARTITION BY run, metric ORDER BY tune_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
             max(v) OVER (PARTITION BY run, metric ORDER BY tune_index) AS top FROM m),
           i AS (SELECT *, before IS NULL OR v > before AS improved FROM b),
           s AS (SELECT *, n - max(CASE WHEN improved THEN n END) OVER (PARTITION BY run, metric ORDER BY tune_index) AS bad_streak FROM i)
           SELECT run, metric, tune_index, CASE WHEN metric IN ('ri', 'clustering_score') THEN top ELSE -top END AS best, improved, bad_streak, n AS evals,
             bool_or(NOT improved AND n >= 3 AND bad_streak >= 20) OVER (PARTITION BY run, metric ORDER BY tune_index) AS should_stop FROM s""",
    ),
)
def early_stop(spark, sf):
    stopped = Y.early_stop(X.metric_log(spark, sf), ["run", "metric"], "tune_index", 20, 3)
    return stopped.select(
        "run", "metric", "tune_index", "best", "improved", "bad_streak", "evals", "should_stop"
    )


@query(
    "anchor_pass_budget",
    with_ctes(
        CTES,
        ANCHOR_CTES,
        """SELECT stratum_id, anchors, round(1000.0::DOUBLE / anchors, 6) AS anchor_passes_total, round(least(1, 1000.0::DOUBLE / anchors), 6) AS coverage_first_pass,
             round(greatest(0, 1000.0::DOUBLE / anchors - 1), 6) AS mean_anchor_reuse, 6::BIGINT AS expected_tune_events,
             CASE WHEN 1000.0::DOUBLE / anchors < 1 THEN 'low' WHEN 1000.0::DOUBLE / anchors > 5 THEN 'high' ELSE '' END AS warning
           FROM (SELECT stratum_id, count(*) AS anchors FROM anchors GROUP BY 1)""",
    ),
)
def anchor_pass_budget(spark, sf):
    counts = anchors(spark, sf).groupBy("stratum_id").agg(F.count(F.lit(1)).alias("anchors"))
    return _rounded(Y.anchor_pass_budget(counts, F.lit(1000.0), F.lit(200), True))


@query(
    "job_lag",
    with_ctes(
        CTES,
        "jobs",
        """SELECT run, tune_index, round(finished_at_s - enqueued_at_s, 3) AS latency_seconds, round(finished_at_s - started_at_s, 3) AS worker_seconds,
             greatest(0, 64 * (tune_index + tune_index % 45) - images_seen) AS lag_images FROM jobs WHERE NOT dropped""",
    ),
)
def job_lag(spark, sf):
    t = F.col("tune_index")
    lagged = Y.job_latency(X.job_log(spark, sf).where("NOT dropped"), 64 * (t + t % 45))
    return lagged.select(
        "run",
        "tune_index",
        F.round("latency_seconds", 3).alias("latency_seconds"),
        F.round("worker_seconds", 3).alias("worker_seconds"),
        "lag_images",
    )


@query(
    "match_jobs",
    with_ctes(
        CTES,
        "jobs",
        """SELECT run, tune_index, CASE WHEN tune_index % 13 = 5 THEN 'unknown' WHEN dropped THEN 'dropped' WHEN tune_index % 4 <> 3 THEN 'completed' ELSE 'pending' END AS fate
           FROM jobs WHERE tune_index % 13 <> 5 OR (NOT dropped AND tune_index % 4 <> 3) OR dropped""",
    ),
)
def match_jobs(spark, sf):
    jobs = X.job_log(spark, sf)
    return Y.match_jobs(
        jobs.where("tune_index % 13 <> 5"),
        jobs.where("NOT dropped AND tune_index % 4 <> 3"),
        jobs.where("dropped"),
        ["run", "tune_index"],
    )


@query(
    "keep_last_n",
    with_ctes(CTES, "jobs", "SELECT run, tune_index, row_number() OVER (PARTITION BY run ORDER BY tune_index DESC) > 2 AS expired FROM jobs"),
)
def keep_last_n(spark, sf):
    return Y.keep_last_n(X.job_log(spark, sf), ["run"], "tune_index", 2).select("run", "tune_index", "expired")


@query(
    "cadence_filter",
    "SELECT event_id, event_id % 5 = 0 AS apd_due, CASE WHEN user_id % 4 > 0 THEN event_id % (user_id % 4) = 0 ELSE false END AS custom_due FROM events",
)
def cadence_filter(spark, sf):
    every = F.col("user_id") % 4
    return X.table(spark, sf, "events").select(
        "event_id",
        Y.due(F.col("event_id"), F.lit(5)).alias("apd_due"),
        F.coalesce(Y.due(F.col("event_id"), every), F.lit(False)).alias("custom_due"),
    )


@query(
    "scaled_cadence",
    """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size::BIGINT WHEN p_size % 10 = 0 THEN 0 ELSE greatest(1, round_even(100000.0::DOUBLE * ((p_size % 10) / 10.0::DOUBLE), 0))::BIGINT END AS every_images,
         greatest(1, round_even((1 + p_partkey) * 1000.0::DOUBLE / (p_size * 20), 0))::BIGINT AS poll_steps FROM part""",
)
def scaled_cadence(spark, sf):
    even = F.col("p_partkey") % 2 == 0
    count = F.when(even, F.col("p_size"))
    share = F.when(~even, (F.col("p_size") % 10) / 10.0)
    return X.table(spark, sf, "part").select(
        "p_partkey",
        text.scaled_cadence(count, share, F.lit(100000)).alias("every_images"),
        text.poll_interval((1 + F.col("p_partkey")) * 1000, F.col("p_size")).alias("poll_steps"),
    )


@query(
    "metric_selection",
    with_ctes(
        CTES,
        "metrics",
        """SELECT tune_index // 500 AS tune_index, round(max(value) FILTER (dataset = 'd1' AND metric = 'ri'), 6) AS metric_value, 'max' AS mode
           FROM metrics GROUP BY 1 HAVING count(*) FILTER (dataset = 'd1' AND metric = 'ri') > 0""",
    ),
)
def metric_selection(spark, sf):
    events = X.metric_log(spark, sf).withColumn("tune_index", F.floor(F.col("tune_index") / 500))
    return _rounded(Y.select_metric(events, "robustness", "d1", "ri"))
