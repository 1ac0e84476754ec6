"""Round trips through the stored forms, and inference over stored embeddings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.sqlfunctions import register_sql_functions
from tessera.operators import index as I
from tessera.operators import splits as S
from tessera.operators import telemetry as Y
from tessera.operators.learning import embed
from tessera.plans.index_queries import ANCHOR_CTES, P, anchors
from tessera.plans.oracle_ctes import CTES
from tessera.plans.registry import ORACLES, query, with_ctes
from tessera.plans.split_queries import C_CTES, CUSTOM_LEVELS, FRACTION, REPS, SEED, _custom_splits, _splits_sql
from tessera.session import materialize, scratch_dir
from tessera.sources import catalog as C
from tessera.sources import fixtures as X
from tessera.sources import logs as G
from tessera.sources import manifests as M


@query("source_slide_manifest", ORACLES["slide_manifest"])
def source_slide_manifest(spark, sf):
    path = scratch_dir(spark, "slide-manifest")
    X.raw_slide_manifest(spark, sf).write.option("header", True).csv(path)
    return M.read_slide_manifest(spark, path).select(
        "slide_id",
        "wsi_path",
        "mask_path",
        F.element_at("metadata", "organ").alias("organ"),
        F.element_at("metadata", "site").alias("site"),
        F.size("metadata").cast("bigint").alias("extras"),
    )


@query(
    "source_slide_index",
    with_ctes(
        CTES,
        "slides",
        """SELECT slide_id, status, wsi_level0_width, mask_level0_height, wsi_spacings_mpp[2] AS second_spacing, organ AS organ, error FROM
           (SELECT *, CASE WHEN status = 'failed' THEN 'unreadable' END AS error FROM slides)""",
    ),
)
def source_slide_index(spark, sf):
    path = scratch_dir(spark, "slide-index")
    slides = X.slides(spark, sf).withColumn(
        "error", F.when(F.col("status") == "failed", F.lit("unreadable"))
    )
    C.write_slide_index(slides, path)
    return C.read_slide_index(spark, path).select(
        "slide_id",
        "status",
        "wsi_level0_width",
        "mask_level0_height",
        F.element_at("wsi_spacings_mpp", 2).alias("second_spacing"),
        F.element_at("metadata", "organ").alias("organ"),
        "error",
    )


@query(
    "source_build_report",
    with_ctes(CTES, "slides", "SELECT slide_id, wsi_path, mask_path, status FROM slides"),
)
def source_build_report(spark, sf):
    path = scratch_dir(spark, "report")
    C.write_build_report(
        X.slides(spark, sf).select("slide_id", "wsi_path", "mask_path", "status"), path
    )
    schema = "slide_id string, wsi_path string, mask_path string, status string"
    return spark.read.schema(schema).option("header", True).csv(path)


@query(
    "source_anchor_catalog",
    with_ctes(
        CTES,
        ANCHOR_CTES,
        "SELECT anchor_id, slide_id, stratum_id, center_x_level0, anchor_idx // 8 AS shard_index, anchor_idx % 8 AS row_in_shard FROM anchors",
    ),
)
def source_anchor_catalog(spark, sf):
    path = scratch_dir(spark, "anchor-catalog")
    C.write_anchor_catalog(anchors(spark, sf), path, P, rows_per_shard=8)
    return C.read_anchor_catalog(spark, path).select(
        "anchor_id", "slide_id", "stratum_id", "center_x_level0", "shard_index", "row_in_shard"
    )


@query(
    "anchor_shard_files",
    with_ctes(CTES, ANCHOR_CTES, "SELECT slide_id, anchor_idx // 8 AS shard_index, 1::BIGINT AS files, count(*) AS rows, max(stratum_id) AS stratum_id, count(*) AS counted FROM anchors GROUP BY ALL"),
)
def anchor_shard_files(spark, sf):
    """One stored file per slide's shard, with its rows per stratum."""
    path = scratch_dir(spark, "anchor-catalog")
    C.write_anchor_catalog(anchors(spark, sf), path, P, rows_per_shard=8)
    shards = C.catalog_shards(spark, path)
    own_slides = shards.groupBy("path").agg(F.count(F.lit(1)).alias("shards"))
    entry = shards.join(own_slides.where("shards = 1"), "path").select("*", F.explode("stratum_counts").alias("stratum", "counted"))
    return entry.groupBy("slide_id", "shard_index").agg(
        F.countDistinct("path").alias("files"), F.sum("rows").alias("rows"), F.max("stratum").alias("stratum_id"), F.sum("counted").alias("counted")
    )


@query(
    "source_anchor_document",
    with_ctes(CTES, ANCHOR_CTES, "SELECT anchor_id, slide_id, tissue_fraction, (SELECT count(*) FROM anchors) AS total_anchors FROM anchors WHERE stratum_id = 'EUROPE'"),
)
def source_anchor_document(spark, sf):
    """Anchors of one stratum by way of a single-document manifest: other shards aren't opened."""
    path = scratch_dir(spark, "anchor-catalog")
    C.write_anchor_catalog(anchors(spark, sf), path, P, rows_per_shard=8)
    C.catalog_document(spark, path).coalesce(1).write.json(f"{path}/manifest")
    total = spark.read.schema("total_anchors bigint").option("multiLine", True).json(f"{path}/manifest")
    found = C.read_manifest_anchors(spark, f"{path}/manifest", "EUROPE").select("anchor_id", "slide_id", "tissue_fraction")
    return found.withColumn("one", F.lit(1)).join(total.withColumn("one", F.lit(1)), "one").drop("one")


@query(
    "stratum_anchors",
    with_ctes(CTES, ANCHOR_CTES, "SELECT anchor_id, tissue_fraction FROM anchors WHERE stratum_id = 'EUROPE'"),
)
def stratum_anchors(spark, sf):
    """One stratum of a stored catalog: only its directory is read."""
    path = scratch_dir(spark, "anchor-catalog")
    C.write_anchor_catalog(anchors(spark, sf), path, P)
    return C.read_anchor_catalog(spark, path, "EUROPE").select("anchor_id", "tissue_fraction")


@query(
    "anchor_catalog_summary",
    with_ctes(
        CTES,
        ANCHOR_CTES,
        "SELECT stratum_id, count(*) AS anchors, (SELECT count(*) FROM anchors) AS total_anchors FROM anchors GROUP BY 1",
    ),
)
def anchor_catalog_summary(spark, sf):
    path = scratch_dir(spark, "anchor-catalog")
    C.write_anchor_catalog(anchors(spark, sf), path, P)
    summary = spark.read.schema("total_anchors bigint, stratum_counts map<string,bigint>").json(
        f"{path}/summary"
    )
    return summary.select(
        F.explode("stratum_counts").alias("stratum_id", "anchors"), "total_anchors"
    )


@query(
    "source_eval_manifest",
    """SELECT 'tiles_' || lpad(vec_id::VARCHAR, 9, '0') AS sample_id, CASE WHEN label % 2 = 0 THEN 'normal' ELSE 'tumor' END AS label,
         'C' || (vec_id % 5) AS medical_center, '/e/' || vec_id || '.png' AS image_path, 'tiles' AS dataset FROM embeddings""",
)
def source_eval_manifest(spark, sf):
    path = scratch_dir(spark, "eval-manifest")
    rows = X.eval_manifest(spark, sf)
    rows.withColumn("label", F.concat(F.lit(" "), "label")).orderBy("row_idx").select(
        "image_path", "label", "medical_center", "slide_id"
    ).write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    return M.read_eval_manifest(spark, path, "tiles").select(
        "sample_id", "label", "medical_center", "image_path", "dataset"
    )


@query(
    "source_splits",
    with_ctes(
        CTES,
        C_CTES,
        _splits_sql("c_alloc", "tiles").split("SELECT sample_id, label, medical_center, slide_id, partition, rho AS")[0]
        + " SELECT rep::BIGINT AS rep, split_id::BIGINT AS split_id, partition, count(*) AS n, count(DISTINCT slide_id) AS slides FROM allrows GROUP BY ALL",
        recursive=True,
    ),
)
def source_splits(spark, sf):
    path = scratch_dir(spark, "splits")
    S.write_splits(_custom_splits(spark, sf), path)
    stored = S.read_splits(spark, path)
    return stored.groupBy("rep", "split_id", "partition").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("slide_id").alias("slides")
    )


@query("source_split_files", ORACLES["source_splits"])
def source_split_files(spark, sf):
    """Splits kept as one CSV per repetition and split."""
    splits = materialize(_custom_splits(spark, sf), "splits")
    root = scratch_dir(spark, "split-files")
    for r in splits.select("rep", "split_id").distinct().collect():  # a folder per split
        own = splits.where((F.col("rep") == r["rep"]) & (F.col("split_id") == r["split_id"])).drop("rep", "split_id", "dataset")
        own.write.option("header", True).csv(f"{root}/rep_{r['rep']:02d}/split_{r['split_id']:02d}.csv")
    return S.read_split_files(spark, root, "tiles").groupBy("rep", "split_id", "partition").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("slide_id").alias("slides")
    )


@query(
    "split_cache_reuse",
    with_ctes(
        CTES,
        C_CTES,
        _splits_sql("c_alloc", "tiles").split("\n      SELECT sample_id, label, medical_center, slide_id, partition, rho AS")[0]
        + """
        SELECT step, reused, CASE WHEN step <> 'other seed' THEN (SELECT count(*) FROM allrows JOIN sp USING (split_id)) END AS n
        FROM (VALUES ('first', false), ('again', true), ('shared', true), ('other seed', false)) AS v(step, reused)""",
        recursive=True,
    ),
)
def split_cache_reuse(spark, sf):
    """Made once, found again, found below a shared root, and made anew for other parameters."""
    manifest = X.eval_manifest(spark, sf)
    own, other = scratch_dir(spark, "split-cache"), scratch_dir(spark, "split-cache")
    given = {"id_centers": X.ID_CENTERS, "ood_centers": X.OOD_CENTERS, "levels": CUSTOM_LEVELS, "repetitions": REPS, "id_test_fraction": FRACTION, "mode": "custom"}
    rows = []
    for step, root, shared, seed in (("first", own, (), SEED), ("again", own, (), SEED), ("shared", other, (own,), SEED), ("other seed", other, (own,), SEED + 1)):
        found, reused = S.cached_splits(manifest, "tiles", root, shared, seed=seed, **given)
        rows.append(found.agg(F.lit(step).alias("step"), F.lit(reused).alias("reused"), F.when(F.lit(seed == SEED), F.count(F.lit(1))).alias("n")))
    return reduce(DataFrame.unionByName, rows)


STEP_COLUMNS = (
    "images_seen", "pass_index", "iteration", "loss", "context_keep_tokens",
    "target_predict_tokens", "iteration_time_ms", "learning_rate", "weight_decay",
)


def step_log_files(spark, sf) -> str:
    """The step log as one CSV folder per rank."""
    path = scratch_dir(spark, "step-log")
    log = X.step_log(spark, sf)
    for rank in (0, 1):
        log.where(F.col("rank") == rank).select(*STEP_COLUMNS).repartition(4).write.option(
            "header", True
        ).csv(f"{path}/train_r{rank}.csv")
    return path


@query(
    "source_step_log",
    with_ctes(CTES, "steps", "SELECT rank, iteration, images_seen, loss, learning_rate FROM steps"),
)
def source_step_log(spark, sf):
    log = G.read_step_log(spark, step_log_files(spark, sf))
    return log.select("rank", "iteration", "images_seen", "loss", "learning_rate")


@query(
    "source_metric_log",
    with_ctes(
        CTES,
        "metrics",
        "SELECT plugin, dataset, metric, tune_index, images_seen, value FROM metrics",
    ),
)
def source_metric_log(spark, sf):
    path = scratch_dir(spark, "metric-log")
    X.metric_log(spark, sf).drop("run").write.json(path)
    return G.read_metric_log(spark, path).select(
        "plugin", "dataset", "metric", "tune_index", "images_seen", "value"
    )


@query(
    "metric_sink",
    with_ctes(CTES, "metrics", "SELECT plugin, dataset, metric, tune_index, images_seen, value, 1::BIGINT AS copies FROM metrics"),
)
def metric_sink(spark, sf):
    """A stream of metric rows into the keyed sink, with every second batch written twice."""
    path, stored = scratch_dir(spark, "metric-log"), scratch_dir(spark, "metric-sink")
    X.metric_log(spark, sf).drop("run").repartition(4).write.json(path)
    sink = G.idempotent_metric_sink(stored)

    def with_replays(batch, epoch: int) -> None:
        for _ in range(1 + epoch % 2):
            sink(batch, epoch)

    stream = G.stream_metric_log(spark, path, max_files=1).writeStream.foreachBatch(with_replays)
    run = stream.option("checkpointLocation", scratch_dir(spark, "metric-sink-progress")).trigger(availableNow=True).start()
    run.awaitTermination()
    copies = spark.read.parquet(stored).groupBy("plugin", "dataset", "metric", "tune_index").agg(F.count(F.lit(1)).alias("copies"))
    rows = G.stored_metrics(spark, stored).select("plugin", "dataset", "metric", "tune_index", "images_seen", "value")
    return rows.join(copies, ["plugin", "dataset", "metric", "tune_index"])


@query(
    "source_mask_runs",
    with_ctes(CTES, "slides runs", "SELECT slide_id, y0, y1, x0, x1 FROM runs"),
)
def source_mask_runs(spark, sf):
    path = scratch_dir(spark, "mask-runs")
    X.mask_runs(spark, sf).write.parquet(path)
    return C.read_mask_runs(spark, path)


@query(
    "source_embeddings",
    "SELECT vec_id::VARCHAR AS sample_id, len(embedding) AS dim, embedding[1]::DOUBLE AS first FROM embeddings",
)
def source_embeddings(spark, sf):
    stored = C.read_embeddings(spark, f"{sf}/embeddings.parquet", id_col="vec_id")
    return stored.select(
        "sample_id",
        F.size("embedding").cast("bigint").alias("dim"),
        F.element_at("embedding", 1).cast("double").alias("first"),
    )


@query(
    "dataset_profile_json",
    with_ctes(
        CTES,
        "images",
        """SELECT 'center' AS facet, medical_center AS value, count(*) AS samples, (SELECT count(*) FROM images) AS total FROM images GROUP BY 2
           UNION ALL SELECT 'label', label, count(*), (SELECT count(*) FROM images) FROM images GROUP BY 2
           UNION ALL SELECT 'centers', list(DISTINCT medical_center ORDER BY medical_center)::VARCHAR, NULL, count(*) FROM images
           UNION ALL SELECT 'labels', list(DISTINCT label ORDER BY label)::VARCHAR, NULL, count(*) FROM images""",
    ),
)
def dataset_profile_json(spark, sf):
    document = M.dataset_profile_json(M.dataset_profile(X.labelled_images(spark, sf)))
    schema = "total_samples bigint, centers array<string>, labels array<string>, samples_per_center map<string,bigint>, samples_per_label map<string,bigint>"
    parsed = document.select(F.from_json("profile", schema).alias("d"))

    def facet(name: str, column: str):
        return parsed.select(
            F.lit(name).alias("facet"),
            F.explode(f"d.{column}").alias("value", "samples"),
            F.col("d.total_samples").alias("total"),
        )

    def listed(name: str):
        value = F.concat(F.lit("["), F.array_join(f"d.{name}", ", "), F.lit("]"))
        return parsed.select(F.lit(name).alias("facet"), value.alias("value"), F.lit(None).cast("bigint").alias("samples"), F.col("d.total_samples").alias("total"))

    counts = facet("center", "samples_per_center").unionByName(facet("label", "samples_per_label"))
    return counts.unionByName(listed("centers")).unionByName(listed("labels"))


@query(
    "metric_rows",
    with_ctes(
        CTES,
        "metrics",
        "SELECT coalesce(CASE WHEN tune_index % 2 = 0 THEN plugin END, 'fallback') AS plugin, metric, tune_index, images_seen, value FROM metrics",
    ),
)
def metric_rows(spark, sf):
    rows = X.metric_log(spark, sf).withColumn(
        "plugin", F.when(F.col("tune_index") % 2 == 0, F.col("plugin"))
    )
    return Y.append_defaults(rows, "fallback", 0, 0).select(
        "plugin", "metric", "tune_index", "images_seen", "value"
    )


@query(
    "sql_functions",
    """SELECT p_partkey, CASE WHEN s - lo <= hi - s THEN lo ELSE hi END AS snapped, CAST(round_even(p_size * 1.0::DOUBLE / 0.24::DOUBLE, 0) AS BIGINT) AS level0_px,
         CAST(round_even(p_partkey * 0.25::DOUBLE / 0.5::DOUBLE, 0) AS BIGINT) AS spacing_px, CAST('0x' || substr(md5(p_name), 1, 8) AS BIGINT) % 11 AS part
       FROM (SELECT *, greatest(16, s // 16 * 16) AS lo, greatest(16, (s + 15) // 16 * 16) AS hi FROM (SELECT *, greatest(1, p_partkey % 700) AS s FROM part))""",
)
def sql_functions(spark, sf):
    register_sql_functions(spark)
    X.table(spark, sf, "part").createOrReplaceTempView("tessera_part")
    return spark.sql(
        """SELECT p_partkey, snap_to_multiple(p_partkey % 700, 16) AS snapped,
             spacing_to_level0_px(p_size, 1.0, 0.24) AS level0_px,
             level0_to_spacing_px(p_partkey, 0.5, 0.25) AS spacing_px,
             hash_partition(p_name, 11) AS part FROM tessera_part"""
    )


def _token_model():
    """Stand-in for an encoder: the vector seen as four tokens of 16 values."""
    return lambda batch: batch.reshape(len(batch), 4, 16)


@query(
    "embedded_features",
    """SELECT vec_id, round(p1 / n, 4) AS first, round(p16 / n, 4) AS last FROM (
         SELECT vec_id, p[1] AS p1, p[16] AS p16, sqrt(list_dot_product(p, p)) + 1e-12 AS n
         FROM (SELECT vec_id, list_transform(range(1, 17), lambda i: (e[i] + e[i + 16] + e[i + 32] + e[i + 48]) / 4) AS p
               FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)))""",
)
def embedded_features(spark, sf):
    out = embed(X.table(spark, sf, "embeddings").drop("label"), _token_model, "embedding", (64,), out="f")
    return out.select(
        "vec_id",
        F.round(F.element_at("f", 1).cast("double"), 4).alias("first"),
        F.round(F.element_at("f", 16).cast("double"), 4).alias("last"),
    )
