import pytest
from pyspark.sql import functions as F

from tessera.operators import telemetry as Y
from tessera.sources import fixtures as X
from tessera.sources import logs as G
from tests.conftest import one


def test_thresholds_between_two_steps(spark):
    log = spark.createDataFrame([(900_000, 2_300_000)], "prev_images bigint, images_seen bigint")
    rows = Y.crossed_thresholds(log, 1_000_000).orderBy("threshold").collect()
    assert [r["threshold"] for r in rows] == [1_000_000, 2_000_000]
    assert {r["next_threshold"] for r in rows} == {3_000_000}


def test_images_are_capped_at_the_budget(spark):
    log = spark.createDataFrame([("r", i, 40) for i in range(4)], "run string, step bigint, batch bigint")
    rows = Y.images_seen(log, ["run"], "step", "batch", 100).orderBy("step").collect()
    assert [(r["images_seen"], r["images_processed"]) for r in rows] == [(40, 40), (80, 40), (100, 20), (100, 0)]


def metrics(spark, values, metric="ri"):
    rows = [("r", metric, i, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "run string, metric string, tune_index bigint, value double")


def stop(spark, values, patience=2, **kw):
    out = Y.early_stop(metrics(spark, values), ["run", "metric"], "tune_index", patience, **kw)
    return [(r["best"], r["bad_streak"], r["should_stop"]) for r in out.orderBy("tune_index").collect()]


def test_early_stop(spark):
    assert stop(spark, [0.1, 0.09, 0.08]) == [(0.1, 0, False), (0.1, 1, False), (0.1, 2, True)]
    # an equal value is no improvement; the flag stays set after a later improvement
    assert [s[2] for s in stop(spark, [0.1, 0.1, 0.1, 0.5])] == [False, False, True, True]
    assert [s[2] for s in stop(spark, [0.1, 0.09, 0.08, 0.07], min_evals=4)] == [False, False, False, True]
    assert stop(spark, [3, 2, 1], mode="min")[-1] == (1.0, 0, False)


def test_early_stop_settings(spark):
    with pytest.raises(ValueError):
        stop(spark, [1], patience=0)
    with pytest.raises(ValueError):
        stop(spark, [1], mode="best")
    with pytest.raises(Exception, match="no known direction"):
        Y.early_stop(metrics(spark, [1], "other"), ["run", "metric"], "tune_index", 1).collect()


@pytest.mark.parametrize(
    "anchors,budget,expected", [(400, 1000, (2.5, 1.0, 1.5, 6)), (1000, 400, (0.4, 0.4, 0.0, 2))]
)
def test_pass_budget(spark, anchors, budget, expected):
    counts = spark.createDataFrame([(anchors,)], "anchors bigint")
    baseline = anchors == 400
    row = one(Y.anchor_pass_budget(counts, F.lit(float(budget)), F.lit(200), baseline))
    assert (row["anchor_passes_total"], row["coverage_first_pass"], row["mean_anchor_reuse"], row["expected_tune_events"]) == expected
    assert row["warning"] == ("" if anchors == 400 else "low")


def test_cache_events(spark):
    visits = spark.createDataFrame([(1, i, s) for i, s in enumerate("aab")], "w bigint, i bigint, s string")
    row = one(Y.cache_events(visits, ["w"], "i", "s").agg(F.sum("hit"), F.sum("miss"), F.sum("eviction")))
    assert tuple(row) == (1, 2, 1)


def test_throughput_without_time_is_zero(spark, sf):
    log = X.step_log(spark, sf).withColumn("prev_images", F.col("images_seen") - 64).withColumn("iteration_time_ms", F.lit(0.0))
    row = Y.throughput_window(log, 10**9, 0).first()
    assert row["images_per_sec"] == 0.0 and row["iterations_per_sec"] == 0.0 and row["anchor_passes_seen"] == row["last_images_seen"]


def test_unfinished_unknown_and_dropped_jobs(spark):
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "tune_index bigint")
    fates = {r["tune_index"]: r["fate"] for r in Y.match_jobs(ids(1, 2, 3), ids(1, 9), ids(2), ["tune_index"]).collect()}
    assert fates == {1: "completed", 2: "dropped", 3: "pending", 9: "unknown"}


def test_keep_last(spark):
    df = spark.createDataFrame([("r", i) for i in range(5)], "run string, i bigint")
    kept = Y.keep_last_n(df, ["run"], "i", 2).where("NOT expired").collect()
    assert sorted(r["i"] for r in kept) == [3, 4]
    assert Y.keep_last_n(df, ["run"], "i", 0).where("NOT expired").isEmpty()


def test_cadence(spark):
    df = spark.range(6).select("id", Y.due(F.col("id"), F.lit(5)).alias("d"), F.coalesce(Y.due(F.col("id"), F.lit(0)), F.lit(False)).alias("z"))
    assert [r["id"] for r in df.where("d").collect()] == [0, 5] and df.where("z").isEmpty()


def test_selection_must_be_emitted(spark):
    rows = spark.createDataFrame([("robustness", "d", "ri", 0, 0.5), ("robustness", "d", "apd_id", 1, 0.1)], "plugin string, dataset string, metric string, tune_index bigint, value double")
    assert one(Y.select_metric(rows.where("tune_index = 0"), "robustness", "d", "ri"))["mode"] == "max"
    with pytest.raises(Exception, match="was not emitted"):
        Y.select_metric(rows, "robustness", "d", "ri").collect()


def test_metric_rows_are_stored_with_their_event(spark, tmp_path):
    rows = spark.createDataFrame([("ri", 0.4)], "metric string, value double")
    for event in (3, 4):
        G.append_metrics(rows, str(tmp_path), "robustness", event, event * 100)
    stored = G.read_metric_log(spark, str(tmp_path / "all_metrics")).orderBy("tune_index").collect()
    assert [(r["plugin"], r["tune_index"], r["images_seen"]) for r in stored] == [("robustness", 3, 300), ("robustness", 4, 400)]
    assert (tmp_path / "tune_0003").exists()


def test_metric_sink_ignores_a_replayed_batch(spark, tmp_path):
    rows = spark.createDataFrame([("p", "d", "ri", 1, 10, 0.5, 0.0, 1, "{}")], Y_SCHEMA)
    sink = G.idempotent_metric_sink(str(tmp_path / "m"))
    for epoch in (0, 0, 1):
        sink(rows.unionByName(rows), epoch)
    assert G.stored_metrics(spark, str(tmp_path / "m")).count() == 1


from tessera.schemas import METRIC_ROW as Y_SCHEMA  # noqa: E402


def test_early_stop_over_many_buckets(spark, monkeypatch):
    """Buckets of three rows: the carried best, last improvement and stop against a plain loop."""
    import random

    monkeypatch.setattr(Y, "ORDER_BUCKET", 3)
    rng = random.Random(9)
    values = {r: [rng.randint(0, 12 + k // 4) / 4 for k in range(60)] for r in ("a", "b", "c")}
    df = spark.createDataFrame([(r, "ri", k, v) for r, own in values.items() for k, v in enumerate(own)], "run string, metric string, tune_index bigint, value double")
    got = {(r["run"], r["tune_index"]): (r["best"], r["bad_streak"], r["improved"], r["should_stop"]) for r in Y.early_stop(df, ["run", "metric"], "tune_index", 9, 2).collect()}
    for run, own in values.items():
        best, streak, stop = None, 0, False
        for k, v in enumerate(own):
            better = best is None or v > best
            best, streak = (v, 0) if better else (best, streak + 1)
            stop = stop or (not better and k + 1 >= 2 and streak >= 9)
            assert got[run, k] == (best, streak, better, stop)


def test_hot_run_never_meets_in_one_window(spark, sf):
    """Windows are keyed by (run, bucket), never by the run alone."""
    plan = Y.best_so_far(X.metric_log(spark, sf), ["run", "metric"], "tune_index")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line and "__n" not in line and "__t_" not in line]
    assert windows and all("__bucket" in line for line in windows)
