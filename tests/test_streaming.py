import random

import pytest
from pyspark.sql import functions as F

from tessera.operators.telemetry import early_stop
from tessera.sources import fixtures as X
from tessera.streaming.anchors import stream_anchors
from tessera.streaming.events import late_rows, tumbling_windows
from tessera.streaming.metrics import bounded_queue_stream, early_stop_stream, step_log_rollup
from tessera.streaming.run import drain, rocksdb_state
from tessera.streaming.stopping import early_stop_any_order


def batches(spark, df, path, parts):
    """A file stream of ``parts`` ordered micro-batches."""
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(str(path))
    reader = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1)
    return reader.parquet(str(path))


def test_stop_state_carries_over_batches(spark, sf, tmp_path):
    df = X.metric_log(spark, sf).select("run", "metric", "tune_index", "value")
    parts = [df.where((F.col("tune_index") >= a) & (F.col("tune_index") < a + 400)) for a in (0, 400, 800)]
    streamed = drain(early_stop_stream(batches(spark, df, tmp_path, parts), 5, 2), "stop")
    columns = ["run", "metric", "tune_index", "best", "evals", "bad_streak", "should_stop"]
    batch = early_stop(df, ["run", "metric"], "tune_index", 5, 2).select(*columns)
    streamed = streamed.select(*columns)
    assert streamed.exceptAll(batch).isEmpty() and batch.exceptAll(streamed).isEmpty()


EVENTS = [(0, 1, "submit"), (1, 2, "submit"), (2, 3, "submit"), (3, 0, "take"), (4, 4, "submit"), (5, 5, "submit"), (6, 0, "take"), (7, 0, "take"), (8, 0, "take")]
QUEUE = "run string, seq bigint, tune_index bigint, kind string"


def test_queue_keeps_the_newest(spark, tmp_path):
    df = spark.createDataFrame([("r", *e) for e in EVENTS], QUEUE)
    parts = [df.where("seq < 3"), df.where("seq >= 3")]
    out = drain(bounded_queue_stream(batches(spark, df, tmp_path, parts), 2), "queue")
    rows = [(r["tune_index"], r["outcome"]) for r in out.where("outcome <> 'kept'").orderBy("seq").collect()]
    assert rows == [(1, "dropped"), (2, "taken"), (3, "dropped"), (4, "taken"), (5, "taken")]
    assert out.agg(F.max("queue_depth")).first()[0] == 2


def test_queue_can_fail_on_backlog(spark, tmp_path):
    df = spark.createDataFrame([("r", *e) for e in EVENTS], QUEUE)
    with pytest.raises(Exception, match="backlog"):
        drain(bounded_queue_stream(batches(spark, df, tmp_path, [df]), 2, fail_on_backlog=True), "queue")
    with pytest.raises(ValueError):
        bounded_queue_stream(df, 0)


def test_rows_that_arrive_late_stop_the_stream(spark, tmp_path):
    rows = [("r", "ri", i, v) for i, v in enumerate([0.1, 0.5, 0.4, 0.3])]
    df = spark.createDataFrame(rows, "run string, metric string, tune_index bigint, value double")
    parts = [df.where("tune_index >= 2"), df.where("tune_index < 2")]
    with pytest.raises(Exception, match="arrived after"):
        drain(early_stop_stream(batches(spark, df, tmp_path / "a", parts), 2), "late")
    events = spark.createDataFrame([("r", *e) for e in EVENTS], QUEUE)
    with pytest.raises(Exception, match="arrived after"):
        drain(bounded_queue_stream(batches(spark, events, tmp_path / "b", [events.where("seq >= 3"), events.where("seq < 3")]), 2), "late")


def test_last_step_of_a_budget_has_fewer_images(spark, tmp_path):
    log = spark.createDataFrame(
        [(i, 64 * (i + 1) if i < 3 else 200, 64 if i < 3 else 8, 1.0, 10, 10, 5.0, 0.1, 0.1) for i in range(4)],
        "iteration long, images_seen long, images_processed long, loss double, context_keep_tokens long, target_predict_tokens long, iteration_time_ms double, learning_rate double, weight_decay double",
    )
    rolled = step_log_rollup(log, 100, 10, "images_processed").collect()
    assert sum(r["images"] for r in rolled) == 200


def test_late_events_are_left_out_and_counted(spark, tmp_path):
    rows = [("u", f"2024-01-01 00:{m:02d}:00", 1.0) for m in (0, 1, 30, 31)] + [("u", "2024-01-01 00:02:00", 5.0), ("u", "2024-01-01 00:50:00", 1.0), ("u", "2024-01-01 01:30:00", 1.0)]
    df = spark.createDataFrame(rows, "user string, t string, value double").select("user", F.to_timestamp("t").alias("ts"), "value")
    # A batch's rows are late by the watermark that the batch before it started with.
    parts = [df.where("minute(ts) in (0, 1, 30, 31) and hour(ts) = 0"), df.where("minute(ts) = 50"), df.where("minute(ts) = 2"), df.where("hour(ts) = 1")]
    stream = tumbling_windows(batches(spark, df, tmp_path / "in", parts), "10 minutes", "5 minutes", ["user"])
    query = (
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = {r["window_start"].minute: (r["events"], r["total"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: (2, 2.0), 30: (2, 2.0), 50: (1, 1.0)}
    assert late_rows(query) == 1


STOP_COLUMNS = ["run", "metric", "tune_index", "best", "evals", "bad_streak", "should_stop"]


def timed(spark, rows):
    df = spark.createDataFrame(rows, "run string, metric string, tune_index bigint, value double")
    return df.withColumn("ts", F.timestamp_seconds(1_700_000_000 + F.col("tune_index") * 60))


def test_rows_in_any_order_stop_as_in_order(spark, tmp_path):
    values = [0.1, 0.5, 0.4, None, 0.6, 0.5, 0.5, float("nan"), 0.9, 0.2, 0.1, 0.3]
    df = timed(spark, [(run, m, i, v) for run in ("a", "b") for m in ("ri", "apd_avg") for i, v in enumerate(values)])
    # Each part is in falling order and its rows are up to four minutes behind the part before; the last one only moves time on.
    end = timed(spark, [("end", "ri", 100, 1.0)])
    order = [(0, 3, 4), (1, 2, 6), (5, 7, 8), (9, 10, 11)]
    parts = [df.where(F.col("tune_index").isin(*o)).orderBy(F.desc("tune_index")) for o in order] + [end]
    stream = early_stop_any_order(batches(spark, df, tmp_path, parts), 2, 2, delay="5 minutes")
    got = drain(stream, "any-order", rocksdb=True).select(*STOP_COLUMNS)
    batch = early_stop(df, ["run", "metric"], "tune_index", 2, 2).select(*STOP_COLUMNS)
    assert sorted(map(str, got.collect())) == sorted(map(str, batch.collect()))


def test_known_distance_needs_no_watermark(spark, tmp_path):
    df = timed(spark, [("r", "ri", i, v) for i, v in [(0, 0.1), (5, 0.5), (10, 0.4), (15, 0.3), (20, 0.2), (30, 0.9)]])
    late = timed(spark, [("other", "ri", 40, 1.0)])
    parts = [df.where("tune_index = 0"), late, df.where("tune_index in (10, 15, 20)"), df.where("tune_index in (5, 30)"), df.where("tune_index = 10")]
    stream = early_stop_any_order(batches(spark, df, tmp_path, parts[:4]), 2, delay="36 minutes", every=5)
    got = {r["tune_index"]: (r["evals"], r["should_stop"]) for r in drain(stream, "distance", rocksdb=True).where("run = 'r'").collect()}
    # 0 goes by the watermark of 40; then 5 frees 10 to 20, and 30 waits for 25 or the time.
    assert got == {0: (1, False), 5: (2, False), 10: (3, False), 15: (4, True), 20: (5, True)}


def test_what_was_emitted_is_final(spark, tmp_path):
    df = timed(spark, [("r", "ri", i, 0.1) for i in (0, 1, 2)])
    wrong = df.where("tune_index = 0").withColumn("ts", F.timestamp_seconds(F.lit(1_700_007_200)))
    ahead = timed(spark, [("end", "ri", 60, 1.0)])
    parts = [df.where("tune_index > 0"), ahead, ahead.withColumn("tune_index", F.lit(61).cast("bigint")), wrong]
    with pytest.raises(Exception, match="arrived after"):
        drain(early_stop_any_order(batches(spark, df, tmp_path, parts), 2, delay="1 minute"), "final", rocksdb=True)
    with pytest.raises(ValueError):
        early_stop_any_order(df, 0)


@pytest.mark.parametrize("every", [None, 1])
def test_waiting_rows_go_in_any_parts(spark, tmp_path, monkeypatch, every):
    """Buckets, parts and frames of a few rows each, repeats, NULL and NaN; the result is that of the batch form."""
    from tessera.streaming import stopping

    for name, few in (("WIDTH", 7), ("SLICE", 20), ("OUT", 3)):
        monkeypatch.setattr(stopping, name, few)
    dice = random.Random(5)
    values = {m: [dice.choice([None, float("nan"), -0.0, 0.0, dice.random(), dice.random()]) if i > 40 else dice.choice([None, round(dice.random(), 1)]) for i in range(200)] for m in ("ri", "apd_avg")}
    rows = [("r", m, i, values[m][i]) for m in values for i in range(200)]
    dealt = sorted(rows, key=lambda r: r[2] + 30 * dice.random())
    parts = [dealt[i : i + 100] + dealt[i : i + 10] for i in range(0, 400, 100)] + [[("end", "ri", 900, 1.0)]]
    df = timed(spark, rows)
    stream = batches(spark, df, tmp_path, [timed(spark, p) for p in parts])
    got = drain(early_stop_any_order(stream, 3, 2, delay="40 minutes", every=every), "parts", rocksdb=True).select(*STOP_COLUMNS)
    batch = early_stop(df, ["run", "metric"], "tune_index", 3, 2).select(*STOP_COLUMNS)
    assert sorted(map(str, got.collect())) == sorted(map(str, batch.collect()))


def test_rows_wait_together(spark, tmp_path):
    """The state has few entries, however many rows wait: a call for each row took most of the time."""
    df = timed(spark, [("r", "ri", i, float(i % 7)) for i in range(3000)])
    stream = early_stop_any_order(batches(spark, df, tmp_path / "in", [df]), 3, delay="100 days")
    with rocksdb_state(spark):
        query = (
            stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
            .outputMode("append").trigger(availableNow=True).start()
        )
    query.awaitTermination()
    assert 0 < max(op["numRowsUpdated"] for p in query.recentProgress for op in p["stateOperators"]) < 50


def test_a_key_is_worked_off_in_parts(spark, tmp_path, monkeypatch):
    """Frames of few rows leave the function, whatever the rows of a key; the result is the same."""
    import pandas as pd

    from tessera.streaming import metrics

    chunks = [pd.DataFrame({"seq": range(i, 3 * metrics.SLICE, 2)}) for i in (1, 0)]
    parts = list(metrics._in_order(iter(chunks), "seq", None, ("r",)))
    assert [len(p) for p in parts] == [metrics.SLICE] * 3 and pd.concat(parts)["seq"].tolist() == list(range(3 * metrics.SLICE))
    monkeypatch.setattr(metrics, "SLICE", 2)
    df = spark.createDataFrame([("r", *e) for e in EVENTS], QUEUE)
    out = drain(bounded_queue_stream(batches(spark, df, tmp_path, [df]), 2), "queue")
    rows = [(r["tune_index"], r["outcome"]) for r in out.where("outcome <> 'kept'").orderBy("seq").collect()]
    assert rows == [(1, "dropped"), (2, "taken"), (3, "dropped"), (4, "taken"), (5, "taken")]


def test_anchor_stream_lists_its_stratum_only(spark, tmp_path):
    """A batch for each file of the stratum, and none for another's; names are escaped as in folders."""
    name = "a/b=c [x]*"
    rows = spark.createDataFrame([(f"{s}{i}", s, i) for s in (name, name[:-1], "other") for i in range(3)], "anchor_id string, stratum_id string, i int")
    root = f"{tmp_path}/anchors"
    rows.repartitionByRange(3, "i").write.partitionBy("stratum_id", "i").parquet(root)
    seen = []
    stream = stream_anchors(spark, str(tmp_path), spark.read.parquet(root).schema, name[:-1], max_files=1)
    run = stream.writeStream.foreachBatch(lambda batch, epoch: seen.append({r["anchor_id"] for r in batch.collect()})).option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    assert set().union(*seen) == {f"{name[:-1]}{i}" for i in range(3)}
    assert len(seen) <= 6  # of nine files; a name that begins alike is filtered
