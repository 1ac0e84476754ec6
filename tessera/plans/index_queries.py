"""Slide index, anchor catalog and geometry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import arrays, geometry as G, text
from tessera.operators import index as I
from tessera.plans.oracle_ctes import CTES
from tessera.plans.registry import query, with_ctes
from tessera.sources import fixtures as X
from tessera.sources import manifests as M

P = I.DEFAULT_PROFILE
ANCHOR_CTES = "slides runs candidates tissue anchors"


def anchors(spark, sf):
    return I.anchor_catalog(X.slides(spark, sf), X.mask_runs(spark, sf), P)


ANCHOR_COLUMNS = [
    "anchor_id", "slide_id", "stratum_id", "wsi_path", "mask_path", "center_x_level0",
    "center_y_level0", "center_x_mask", "center_y_mask", "tissue_fraction", "wsi_level0_spacing_mpp",
]


@query(
    "anchor_catalog",
    with_ctes(CTES, ANCHOR_CTES, f"SELECT {', '.join(ANCHOR_COLUMNS)} FROM anchors"),
)
def anchor_catalog(spark, sf):
    return anchors(spark, sf).select(*ANCHOR_COLUMNS)


@query(
    "anchor_counts_by_stratum",
    with_ctes(
        CTES,
        ANCHOR_CTES,
        """SELECT stratum_id, count(*) AS anchors, count(DISTINCT slide_id) AS slides,
             round(avg(tissue_fraction), 6) AS mean_tissue FROM anchors GROUP BY stratum_id""",
    ),
)
def anchor_counts_by_stratum(spark, sf):
    return (
        anchors(spark, sf)
        .groupBy("stratum_id")
        .agg(
            F.count(F.lit(1)).alias("anchors"),
            F.countDistinct("slide_id").alias("slides"),
            F.round(F.avg("tissue_fraction"), 6).alias("mean_tissue"),
        )
    )


@query(
    "window_tissue",
    with_ctes(
        CTES,
        "slides runs candidates tissue",
        "SELECT slide_id, cx, cy, round_even(fraction, 6) AS fraction FROM tissue",
    ),
)
def window_tissue(spark, sf):
    slides = I.grid_geometry(
        I.slide_eligibility(X.slides(spark, sf), P).where("build_status = 'ok'"), P
    )
    tissue = I.window_tissue(slides, X.mask_runs(spark, sf), include_empty=True)
    return tissue.select(
        "slide_id",
        (F.col("ix") * 32 + 32).alias("cx"),
        (F.col("iy") * 32 + 32).alias("cy"),
        F.bround(F.col("tissue_px") / 4096.0, 6).alias("fraction"),
    )


@query(
    "anchor_build_report",
    with_ctes(
        CTES,
        ANCHOR_CTES,
        """SELECT s.slide_id,
             CASE WHEN status <> 'ok' OR mask_path IS NULL THEN 'skipped' WHEN coalesce(n, 0) = 0 THEN 'failed' ELSE 'ok' END AS status,
             CASE WHEN status <> 'ok' THEN 'slide_status_not_ok' WHEN mask_path IS NULL THEN 'missing_mask_path'
               WHEN coalesce(n, 0) = 0 THEN 'no_valid_anchors' ELSE '' END AS reason,
             coalesce(n, 0) AS anchors
           FROM slides s LEFT JOIN (SELECT slide_id, count(*) AS n FROM anchors GROUP BY 1) a USING (slide_id)""",
    ),
)
def anchor_build_report(spark, sf):
    return I.build_report(X.slides(spark, sf), anchors(spark, sf), P)


@query(
    "anchor_build_summary",
    with_ctes(
        CTES,
        ANCHOR_CTES,
        """SELECT count(*) FILTER (status = 'ok' AND mask_path IS NOT NULL AND n > 0) AS slides_ok,
             count(*) FILTER (NOT coalesce(status = 'ok' AND mask_path IS NOT NULL AND n > 0, false)) AS slides_not_ok,
             sum(coalesce(n, 0))::BIGINT AS anchors
           FROM slides s LEFT JOIN (SELECT slide_id, count(*) AS n FROM anchors GROUP BY 1) a USING (slide_id)""",
    ),
)
def anchor_build_summary(spark, sf):
    return I.build_summary(anchor_build_report(spark, sf))


@query(
    "anchor_stratum_rollup",
    with_ctes(
        CTES,
        ANCHOR_CTES,
        """SELECT 'total' AS level, NULL AS stratum_id, NULL AS slide_id, NULL::BIGINT AS shard_index, count(*) AS anchors FROM anchors
           UNION ALL SELECT 'stratum', stratum_id, NULL, NULL, count(*) FROM anchors GROUP BY stratum_id
           UNION ALL SELECT 'shard', stratum_id, slide_id, anchor_idx // 8, count(*) FROM anchors GROUP BY 2, 3, 4""",
    ),
)
def anchor_stratum_rollup(spark, sf):
    return I.stratum_shard_counts(I.with_shards(anchors(spark, sf), rows_per_shard=8))


@query(
    "qc_anchors",
    with_ctes(
        CTES,
        ANCHOR_CTES,
        """SELECT slide_id, anchor_id, greatest(0, center_x_mask - 32) AS x0, greatest(0, center_y_mask - 32) AS y0,
             least(mask_level0_width - 1, center_x_mask + 32) AS x1, least(mask_level0_height - 1, center_y_mask + 32) AS y1,
             anchor_idx % 2 AS color_parity
           FROM anchors WHERE anchor_idx < 5""",
    ),
)
def qc_anchors(spark, sf):
    return I.qc_anchors(anchors(spark, sf), X.slides(spark, sf), 5, P)


@query(
    "lookup_anchors",
    with_ctes(
        CTES,
        ANCHOR_CTES,
        "SELECT anchor_id, stratum_id, center_x_level0 FROM anchors WHERE slide_id || '_0000000' = anchor_id",
    ),
)
def lookup_anchors(spark, sf):
    catalog = anchors(spark, sf)
    wanted = (
        anchor_build_report(spark, sf)
        .where("anchors > 0")
        .select(F.concat("slide_id", F.lit("_0000000")).alias("anchor_id"))
    )
    return I.lookup_anchors(catalog, wanted).select("anchor_id", "stratum_id", "center_x_level0")


@query(
    "slide_manifest",
    """SELECT 'S' || s_suppkey AS slide_id, '/w/S' || s_suppkey || '.tif' AS wsi_path,
         CASE WHEN s_suppkey % 13 <> 12 THEN '/m/' || s_suppkey END AS mask_path,
         CASE WHEN s_suppkey % 4 <> 0 THEN r_name END AS organ, n_name AS site,
         CASE WHEN s_suppkey % 4 <> 0 THEN 2 ELSE 1 END::BIGINT AS extras
       FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def slide_manifest(spark, sf):
    return M.slide_manifest(X.raw_slide_manifest(spark, sf)).select(
        "slide_id",
        "wsi_path",
        "mask_path",
        F.element_at("metadata", "organ").alias("organ"),
        F.element_at("metadata", "site").alias("site"),
        F.size("metadata").cast("bigint").alias("extras"),
    )


@query(
    "slide_resume_merge",
    with_ctes(
        CTES,
        "slides",
        """SELECT slide_id, wsi_path, CASE WHEN k % 3 = 0 THEN status END AS status,
             CASE WHEN k % 3 = 0 THEN mask_level0_width END AS mask_level0_width, k % 3 = 0 AS reused FROM slides""",
    ),
)
def slide_resume_merge(spark, sf):
    slides = X.slides(spark, sf)
    existing = slides.where("k % 3 = 0").select("slide_id", "status", "mask_level0_width")
    return I.resume_merge(slides.select("slide_id", "wsi_path"), existing)


@query(
    "slide_build_summary",
    with_ctes(
        CTES,
        "slides",
        "SELECT status, count(*) AS slides, count(mask_path) AS with_mask FROM slides GROUP BY status",
    ),
)
def slide_build_summary(spark, sf):
    return X.slides(spark, sf).groupBy("status").agg(
        F.count(F.lit(1)).alias("slides"), F.count("mask_path").alias("with_mask")
    )


@query(
    "mask_scale",
    with_ctes(
        CTES,
        "slides",
        """SELECT slide_id, CASE WHEN mask_path IS NOT NULL THEN mask_scale END AS scale_x,
             CASE WHEN mask_path IS NOT NULL THEN mask_scale END AS scale_y,
             round(wsi_level0_spacing_mpp / mask_level0_spacing_mpp, 9) AS spacing_scale FROM slides""",
    ),
)
def mask_scale(spark, sf):
    return I.with_mask_scale(X.slides(spark, sf)).select(
        "slide_id",
        F.col("mask_to_wsi_scale_x").alias("scale_x"),
        F.col("mask_to_wsi_scale_y").alias("scale_y"),
        F.round(
            G.wsi_to_mask_spacing_scale("wsi_level0_spacing_mpp", "mask_level0_spacing_mpp"), 9
        ).alias("spacing_scale"),
    )


@query(
    "profile_geometry",
    """SELECT p_partkey, ctx AS context_px, tgt AS target_px, greatest(m, tgt // 2) AS margin_px,
         ctx > 2 * greatest(m, tgt // 2) AS valid
       FROM (SELECT p_partkey, CAST(round_even((256 + p_size * 8) / mpp, 0) AS BIGINT) AS ctx,
               CAST(round_even((64 + p_size * 5) / mpp, 0) AS BIGINT) AS tgt,
               CAST(round_even((p_partkey % 200) / mpp, 0) AS BIGINT) AS m
             FROM (SELECT *, 0.5::DOUBLE + (p_partkey % 4) * 0.25::DOUBLE AS mpp FROM part))""",
)
def profile_geometry(spark, sf):
    mpp = 0.5 + (F.col("p_partkey") % 4) * 0.25
    context = G.round_px((256 + F.col("p_size") * 8) / mpp)
    target = G.round_px((64 + F.col("p_size") * 5) / mpp)
    margin = F.greatest(G.round_px((F.col("p_partkey") % 200) / mpp), G.half(target))
    return X.table(spark, sf, "part").select(
        "p_partkey",
        context.alias("context_px"),
        target.alias("target_px"),
        margin.alias("margin_px"),
        (context > 2 * margin).alias("valid"),
    )


@query(
    "spacing_conversion",
    """SELECT p_partkey, CAST(round_even(p_size * 1.0::DOUBLE / 0.24::DOUBLE, 0) AS BIGINT) AS level0_px,
         CAST(round_even(p_partkey * 0.25::DOUBLE / 0.5::DOUBLE, 0) AS BIGINT) AS spacing_px FROM part""",
)
def spacing_conversion(spark, sf):
    return X.table(spark, sf, "part").select(
        "p_partkey",
        G.spacing_to_level0_px("p_size", 1.0, 0.24).alias("level0_px"),
        G.level0_to_spacing_px("p_partkey", 0.5, 0.25).alias("spacing_px"),
    )


@query(
    "center_boxes",
    """SELECT p_partkey, x - s // 2 AS x0, y - s // 2 AS y0, x - s // 2 + s AS x1, y - s // 2 + s AS y1,
         x - s // 2 >= 0 AND y - s // 2 >= 0 AND x - s // 2 + s <= 5000 AND y - s // 2 + s <= 4000 AS in_bounds
       FROM (SELECT p_partkey, (p_partkey * 31) % 5000 AS x, (p_partkey * 17) % 4000 AS y,
               CAST(round_even((100 + p_size) * 1.0::DOUBLE / 0.5::DOUBLE, 0) AS BIGINT) AS s FROM part)""",
)
def center_boxes(spark, sf):
    x, y = (F.col("p_partkey") * 31) % 5000, (F.col("p_partkey") * 17) % 4000
    b = G.context_box_level0(x, y, 100 + F.col("p_size"), 1.0, 0.5)
    return X.table(spark, sf, "part").select(
        "p_partkey",
        *[b[c].alias(c) for c in ("x0", "y0", "x1", "y1")],
        G.center_in_bounds(x, y, 100 + F.col("p_size"), 1.0, 0.5, 5000, 4000).alias("in_bounds"),
    )


@query(
    "snap_sizes",
    """SELECT p_partkey, CASE WHEN s - lo <= hi - s THEN lo ELSE hi END AS snapped,
         round((s * 0.5::DOUBLE) / CASE WHEN s - lo <= hi - s THEN lo ELSE hi END, 9) AS mpp
       FROM (SELECT p_partkey, s, greatest(16, s // 16 * 16) AS lo, greatest(16, (s + 15) // 16 * 16) AS hi
             FROM (SELECT p_partkey, greatest(1, p_partkey % 700) AS s FROM part))""",
)
def snap_sizes(spark, sf):
    size = F.greatest(F.lit(1), F.col("p_partkey") % 700)
    return X.table(spark, sf, "part").select(
        "p_partkey",
        G.snap_to_multiple(F.col("p_partkey") % 700, 16).alias("snapped"),
        F.round(G.effective_mpp(size * 0.5, 0.5, 16), 9).alias("mpp"),
    )


CHOOSE_SQL = """
  SELECT slide_id, mpp, CASE WHEN abs(nearest - mpp) / mpp <= 0.05 THEN nearest WHEN finer IS NOT NULL THEN finer ELSE coarser END AS spacing,
    CASE WHEN abs(nearest - mpp) / mpp <= 0.05 THEN 'native_or_close' WHEN finer IS NOT NULL THEN 'fallback_from_finer'
      ELSE 'fallback_from_coarser' END AS mode
  FROM (SELECT slide_id, mpp, list_max(list_filter(sp, lambda s: s < mpp)) AS finer,
          list_min(list_filter(sp, lambda s: s > mpp)) AS coarser,
          list_reduce(list_sort(sp), lambda a, s: CASE WHEN abs(s - mpp) < abs(a - mpp) THEN s ELSE a END) AS nearest
        FROM (SELECT slide_id, wsi_spacings_mpp AS sp, unnest([0.2::DOUBLE, 0.51, 0.75, 1.0, 2.5, 9.0]) AS mpp FROM slides))
"""


@query("choose_source_spacing", with_ctes(CTES, "slides", CHOOSE_SQL))
def choose_source_spacing(spark, sf):
    wanted = F.array(*[F.lit(v) for v in (0.2, 0.51, 0.75, 1.0, 2.5, 9.0)])
    return (
        X.slides(spark, sf)
        .withColumn("mpp", F.explode(wanted))
        .withColumn("c", G.choose_source_spacing(F.col("wsi_spacings_mpp"), "mpp", 0.05))
        .select("slide_id", "mpp", "c.spacing", "c.mode")
    )


@query(
    "best_level",
    with_ctes(
        CTES,
        "slides",
        """SELECT slide_id, mpp, (CASE WHEN ok THEN lead ELSE near END)::BIGINT AS level,
             ok OR abs(sp[near + 1] - mpp) / mpp <= 0.1 AS within_tolerance
           FROM (SELECT *, abs(sp[lead + 1] - mpp) / mpp <= 0.1 AS ok,
                   list_position(list_transform(sp, lambda s: abs(s - mpp)), list_min(list_transform(sp, lambda s: abs(s - mpp)))) - 1 AS near
                 FROM (SELECT slide_id, mpp, sp, greatest(0, len(list_filter(sp, lambda s: s <= mpp)) - 1) AS lead
                       FROM (SELECT slide_id, wsi_spacings_mpp AS sp, unnest([0.2::DOUBLE, 0.51, 0.75, 1.0, 2.5, 9.0]) AS mpp FROM slides)))""",
    ),
)
def best_level(spark, sf):
    wanted = F.array(*[F.lit(v) for v in (0.2, 0.51, 0.75, 1.0, 2.5, 9.0)])
    return (
        X.slides(spark, sf)
        .withColumn("mpp", F.explode(wanted))
        .withColumn("c", G.best_level_for_spacing(F.col("wsi_spacings_mpp"), "mpp", 0.1))
        .select("slide_id", "mpp", "c.level", "c.within_tolerance")
    )


@query(
    "thumbnail_boxes",
    with_ctes(
        CTES,
        ANCHOR_CTES + " ".join([""]),
        """SELECT anchor_id, round(cx0, 6) AS x0, round(cy0, 6) AS y0,
             round(least(greatest(x1, cx0 + 1), 256), 6) AS x1, round(least(greatest(y1, cy0 + 1), 256), 6) AS y1
           FROM (SELECT *, least(greatest(x0, 0), 255) AS cx0, least(greatest(y0, 0), 255) AS cy0
                 FROM (SELECT anchor_id, (a.center_x_level0 - h) * sx AS x0, (a.center_y_level0 - h) * sy AS y0,
                         (a.center_x_level0 - h + z) * sx AS x1, (a.center_y_level0 - h + z) * sy AS y1
                       FROM (SELECT *, CAST(round_even(512 / wsi_level0_spacing_mpp, 0) AS BIGINT) AS z,
                               CAST(round_even(512 / wsi_level0_spacing_mpp, 0) AS BIGINT) // 2 AS h FROM anchors) a
                       JOIN (SELECT slide_id, 256.0::DOUBLE / wsi_level0_width AS sx, 256.0::DOUBLE / wsi_level0_height AS sy FROM slides) s
                         USING (slide_id)))""",
    ),
)
def thumbnail_boxes(spark, sf):
    slides = X.slides(spark, sf).select("slide_id", "wsi_level0_width", "wsi_level0_height")
    a = anchors(spark, sf).join(slides, "slide_id")
    b = G.context_box_level0(
        "center_x_level0", "center_y_level0", "context_size_px", "context_mpp", "wsi_level0_spacing_mpp"
    )
    t = G.thumbnail_box(b, "wsi_level0_width", "wsi_level0_height", 256, 256)
    return a.select("anchor_id", *[F.round(t[c], 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query(
    "display_names",
    with_ctes(
        CTES,
        ANCHOR_CTES,
        """SELECT anchor_id, 'A' || CASE WHEN anchor_idx + 1 < 1000 THEN lpad((anchor_idx + 1)::VARCHAR, 3, '0') ELSE (anchor_idx + 1)::VARCHAR END AS name,
             's' || CASE WHEN anchor_idx < 1000 THEN lpad(anchor_idx::VARCHAR, 3, '0') ELSE anchor_idx::VARCHAR END || '_' || slide_id || '_A' ||
               CASE WHEN anchor_idx + 1 < 1000 THEN lpad((anchor_idx + 1)::VARCHAR, 3, '0') ELSE (anchor_idx + 1)::VARCHAR END AS stem
           FROM anchors""",
    ),
)
def display_names(spark, sf):
    return anchors(spark, sf).select(
        "anchor_id",
        text.display_anchor_name(F.col("anchor_id")).alias("name"),
        text.output_stem(F.col("anchor_idx"), F.col("slide_id"), F.col("anchor_id")).alias("stem"),
    )


@query(
    "sanitized_names",
    """SELECT page_id, replace(replace(url, '/', '_'), ' ', '_') AS slide_name,
         coalesce(nullif(trim(regexp_replace(regexp_replace(trim(url), '[^A-Za-z0-9._-]+', '-', 'g'), '-{2,}', '-', 'g'), '-'), ''), 'x') AS token,
         regexp_replace(trim(url), '[^A-Za-z0-9._-]+', '-', 'g') AS run_id
       FROM pages""",
)
def sanitized_names(spark, sf):
    return X.table(spark, sf, "pages").select(
        "page_id",
        text.sanitize_slide_id(F.col("url")).alias("slide_name"),
        text.sanitize_token(F.col("url")).alias("token"),
        text.sanitize_run_id(F.col("url")).alias("run_id"),
    )


@query(
    "normalized_strings",
    """SELECT o_orderkey, o_orderpriority AS label, o_orderstatus AS medical_center FROM orders""",
)
def normalized_strings(spark, sf):
    padded = X.table(spark, sf, "orders").select(
        "o_orderkey",
        F.concat(F.lit("  "), "o_orderpriority", F.lit(" ")).alias("label"),
        F.concat("o_orderstatus", F.lit("   ")).alias("medical_center"),
    )
    return text.trim_columns(padded, "label", "medical_center")


@query(
    "threshold_schedule",
    """SELECT p_brand, pos, threshold FROM (
         SELECT p_brand, unnest([1, 2, 3, 4]) AS pos, unnest([0.25::DOUBLE, 0.2, 0.15, 0.1]) AS threshold
         FROM (SELECT DISTINCT p_brand FROM part))""",
)
def threshold_schedule(spark, sf):
    brands = X.table(spark, sf, "part").select("p_brand").distinct()
    return brands.select(
        "p_brand", F.posexplode(arrays.threshold_schedule(0.25, 0.10, 0.05)).alias("i", "threshold")
    ).select("p_brand", (F.col("i") + 1).alias("pos"), "threshold")


@query(
    "stratum_values",
    "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'unknown' ELSE p_brand END AS stratum FROM part",
)
def stratum_values(spark, sf):
    size = F.col("p_size")
    organ = F.when(size % 6 == 0, F.lit("")).when(size % 3 != 0, F.col("p_brand"))
    return X.table(spark, sf, "part").select(
        "p_partkey", text.stratum_value(F.create_map(F.lit("organ"), organ), "organ").alias("stratum")
    )


@query(
    "labelled_image_manifest",
    with_ctes(
        CTES,
        "images",
        """SELECT 'docs_' || lpad(row_idx::VARCHAR, 9, '0') AS sample_id, image_path, label, medical_center, slide_id, 'docs' AS dataset FROM images""",
    ),
)
def labelled_image_manifest(spark, sf):
    return M.manifest_from_labelled_images(
        X.labelled_images(spark, sf), dataset="docs", order_col="row_idx"
    )


@query(
    "dataset_profile",
    with_ctes(
        CTES,
        "images",
        """SELECT 'center' AS facet, medical_center AS value, count(*) AS samples FROM images GROUP BY 2
           UNION ALL SELECT 'label', label, count(*) FROM images GROUP BY 2
           UNION ALL SELECT 'slide', slide_id, count(*) FROM images GROUP BY 2
           UNION ALL SELECT 'total', NULL, count(*) FROM images""",
    ),
)
def dataset_profile(spark, sf):
    return M.dataset_profile(X.labelled_images(spark, sf))


@query(
    "hash_partition",
    """SELECT p, count(*) AS anchors FROM (
         SELECT CAST('0x' || substr(md5('P' || p_partkey), 1, 8) AS BIGINT) % 17 AS p FROM part) GROUP BY p""",
)
def hash_partition(spark, sf):
    from tessera.functions.hashing import hash_partition as partition_of

    key = F.concat(F.lit("P"), F.col("p_partkey").cast("string"))
    return (
        X.table(spark, sf, "part")
        .select(partition_of(key, 17).alias("p"))
        .groupBy("p")
        .agg(F.count(F.lit(1)).alias("anchors"))
    )


@query("stable_partition_blake2b")
def stable_partition_blake2b(spark, sf):
    from tessera.functions.hashing import blake_partition

    key = F.concat(F.lit("P"), F.col("p_partkey").cast("string"))
    return (
        X.table(spark, sf, "part")
        .select(blake_partition(key, 17).alias("p"))
        .groupBy("p")
        .agg(F.count(F.lit(1)).alias("anchors"))
    )
