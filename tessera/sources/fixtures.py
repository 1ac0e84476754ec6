"""Domain frames derived from the driver tables.

The engine takes slides, masks, embeddings and logs as tables. These functions
derive such tables, row by row, from the relational test tables, so every
operator can be run - and checked in SQL - at any scale factor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


GRID_PX = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    k = F.col("s_suppkey")
    base = (
        table(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    spacing = F.when(k % 2 == 0, F.lit(0.25)).otherwise(F.lit(0.5))
    mask_w = (160 + 16 * (k % 9)).cast("bigint")
    mask_h = (128 + 16 * (k % 7)).cast("bigint")
    return (
        base.select(
            k.alias("k"),
            F.concat(F.lit("S"), k.cast("string")).alias("slide_id"),
            F.concat(F.lit("/w/S"), k.cast("string"), F.lit(".tif")).alias("wsi_path"),
            F.when(k % 13 != 12, F.concat(F.lit("/m/"), k.cast("string"))).alias("mask_path"),
            F.when(k % 19 == 18, F.lit("failed")).otherwise(F.lit("ok")).alias("status"),
            F.create_map(
                F.lit("organ"), F.col("r_name"), F.lit("site"), F.col("n_name")
            ).alias("metadata"),
            spacing.alias("wsi_level0_spacing_mpp"),
            F.lit(8.0).alias("mask_level0_spacing_mpp"),
            mask_w.alias("mask_level0_width"),
            mask_h.alias("mask_level0_height"),
        )
        .withColumn(
            "wsi_level0_width",
            (F.col("mask_level0_width") * 8.0 / F.col("wsi_level0_spacing_mpp")).cast("bigint"),
        )
        .withColumn(
            "wsi_level0_height",
            (F.col("mask_level0_height") * 8.0 / F.col("wsi_level0_spacing_mpp")).cast("bigint"),
        )
        .withColumn(
            "wsi_spacings_mpp",
            F.when(
                F.col("k") % 2 == 0,
                F.transform(
                    F.array(F.lit(1.0), F.lit(4.0), F.lit(16.0)),
                    lambda m: m * F.col("wsi_level0_spacing_mpp"),
                ),
            ).otherwise(
                F.transform(
                    F.array(F.lit(1.0), F.lit(2.0), F.lit(8.0)),
                    lambda m: m * F.col("wsi_level0_spacing_mpp"),
                )
            ),
        )
        .withColumn("mask_spacings_mpp", F.array(F.lit(8.0)))
        .withColumn("mask_to_wsi_scale_x", F.col("wsi_level0_width") / F.col("mask_level0_width"))
        .withColumn("mask_to_wsi_scale_y", F.col("wsi_level0_height") / F.col("mask_level0_height"))
    )


def mask_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disjoint tissue rectangles: one band of 16 mask rows each."""
    k, b = F.col("k"), F.col("b")
    x0 = GRID_PX * ((7 * k + 3 * b) % 5)
    return (
        slides(spark, sf_dir)
        .select("k", "slide_id", "mask_level0_width", "mask_level0_height")
        .withColumn(
            "b",
            F.explode(F.sequence(F.lit(0), (F.col("mask_level0_height") / GRID_PX - 1).cast("int"))),
        )
        .select(
            "slide_id",
            (GRID_PX * b).cast("bigint").alias("y0"),
            (GRID_PX * b + GRID_PX).cast("bigint").alias("y1"),
            x0.cast("bigint").alias("x0"),
            F.least(
                (x0 + GRID_PX * (2 + (k + 5 * b) % 8)).cast("bigint"), F.col("mask_level0_width")
            ).alias("x1"),
        )
    )


ID_CENTERS = ("C0", "C1")
OOD_CENTERS = ("C2", "C3", "C4")


def eval_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One evaluation row per embedding, with its vector; ``row_idx`` is the
    manifest order."""
    v = F.col("vec_id")
    label = F.when(F.col("label") % 2 == 0, F.lit("normal")).otherwise(F.lit("tumor"))
    center = F.concat(F.lit("C"), (v % 5).cast("string"))
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("s"), F.lpad(v.cast("string"), 9, "0")).alias("sample_id"),
        v.alias("row_idx"),
        label.alias("label"),
        center.alias("medical_center"),
        F.concat_ws("_", center, label, (F.floor(v / 5) % 8).cast("string")).alias("slide_id"),
        F.concat(F.lit("/e/"), v.cast("string"), F.lit(".png")).alias("image_path"),
        F.lit("tiles").alias("dataset"),
        (F.col("label") % 3).cast("bigint").alias("cluster"),
        "embedding",
    )


def eval_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eval_features(spark, sf_dir).drop("embedding")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id").cast("string")
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("s"), F.lpad(v, 9, "0")).alias("sample_id"), "embedding"
    )


def step_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training step log: one row per event, 64 images per step."""
    e = F.col("event_id")
    images = 64 * (e + 1)
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 2).alias("rank"),
        e.alias("iteration"),
        images.alias("images_seen"),
        F.floor(images / 10000).cast("bigint").alias("pass_index"),
        F.col("value").alias("loss"),
        (100 + e % 50).cast("double").alias("context_keep_tokens"),
        (64 + e % 17).cast("double").alias("target_predict_tokens"),
        ((e * 37) % 400).cast("double").alias("iteration_time_ms"),
        ((e * 13) % 90).cast("double").alias("data_wait_ms"),
        ((e * 7) % 20).cast("double").alias("host_to_device_ms"),
        ((e * 11) % 120).cast("double").alias("compute_ms"),
        ((e * 5) % 6).cast("double").alias("tune_poll_ms"),
        ((e * 3) % 5).cast("bigint").alias("cache_hits"),
        (e % 4).cast("bigint").alias("cache_misses"),
        (e % 3).cast("bigint").alias("cache_evictions"),
        (1 + e % 8).cast("double").alias("cache_open_slides"),
        (1e-3 / (1 + e % 10)).alias("learning_rate"),
        (0.04 + 0.001 * (e % 5)).alias("weight_decay"),
    )


def metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric history of ten runs; ``tune_index`` orders a run's evaluations."""
    e = F.col("event_id")
    names = {
        "view": "ri",
        "click": "clustering_score",
        "purchase": "apd_avg",
        "signup": "apd_id",
        "error": "apd_ood",
    }
    metric = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("run"), (F.col("user_id") % 10).cast("string")).alias("run"),
        metric[F.col("event_type")].alias("metric"),
        F.lit("robustness").alias("plugin"),
        F.concat(F.lit("d"), (F.col("user_id") % 3).cast("string")).alias("dataset"),
        e.alias("tune_index"),
        (64 * (e + 1)).alias("images_seen"),
        (F.col("value") / 100.0).alias("value"),
    )


def job_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation jobs with queue times in epoch seconds."""
    e = F.col("event_id")
    enqueued = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    started = enqueued + (e % 60)
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("run"), (F.col("user_id") % 10).cast("string")).alias("run"),
        e.alias("tune_index"),
        (64 * (e + 1)).alias("images_seen"),
        enqueued.alias("enqueued_at_s"),
        started.alias("started_at_s"),
        (started + (e % 45)).alias("finished_at_s"),
        (e % 11 == 0).alias("dropped"),
    )


def split_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probe accuracy per (rep, split) from order statistics: rep and split come
    from the keys, accuracy is the share of large orders."""
    o = table(spark, sf_dir, "orders")
    return (
        o.groupBy(
            (F.col("o_orderkey") % 3).alias("rep"),
            (1 + F.floor(F.col("o_orderkey") / 3) % 8).cast("bigint").alias("split_id"),
        )
        .agg(
            F.avg((F.col("o_totalprice") > 100000).cast("double")).alias("acc_id"),
            F.avg((F.col("o_totalprice") > 200000).cast("double")).alias("acc_ood"),
        )
        .withColumn("correlation_level", F.bround((F.col("split_id") - 1) / 7.0, 2))
    )


def labelled_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        d.alias("row_idx"),
        F.concat(F.lit("/d/"), d.cast("string")).alias("image_path"),
        F.col("lang").alias("label"),
        F.col("source").alias("medical_center"),
        F.concat_ws("_", "source", (d % 7).cast("string")).alias("slide_id"),
    )


def target_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four 128-px boxes per sample in a 512-px context, batches of 32."""
    k = F.col("p_partkey")

    def one(t: int):
        x0 = ((k * 17 + 37 * t) % 384).cast("double")
        y0 = ((k * 29 + 53 * t) % 384).cast("double")
        return F.struct(
            x0.alias("x0"), y0.alias("y0"), (x0 + 128).alias("x1"), (y0 + 128).alias("y1")
        )

    return table(spark, sf_dir, "part").select(
        k.alias("sample_idx"),
        F.floor(k / 32).cast("bigint").alias("batch_id"),
        F.array(*[one(t) for t in range(4)]).alias("boxes"),
    )


def raw_slide_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slide manifest as a CSV would deliver it: all strings, some ids missing."""
    s = slides(spark, sf_dir)
    return s.select(
        F.when(F.col("k") % 5 != 0, F.col("slide_id")).alias("slide_id"),
        F.when(F.col("k") % 3 != 0, F.col("wsi_path")).alias("wsi_path"),
        F.when(F.col("k") % 3 == 0, F.col("wsi_path")).alias("slide_path"),
        F.coalesce("mask_path", F.lit("")).alias("mask_path"),
        F.when(F.col("k") % 4 != 0, F.element_at("metadata", "organ")).otherwise("").alias("organ"),
        F.element_at("metadata", "site").alias("site"),
    )


