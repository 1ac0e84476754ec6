"""Slide index and anchor catalog.

The catalog is the exhaustive grid of sampling sites whose window holds enough
tissue. Every tissue run knows by arithmetic which grid windows it touches, so
the grid is never materialised and no spatial join is needed: runs are exploded
onto window ids and clipped areas are summed with map-side combine.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.functions.text import stratum_value
from tessera.operators.ranking import bucketed_row_number, salted_join


@dataclass(frozen=True)
class SamplingProfile:
    """Geometry of one sampling profile."""

    profile_id: str
    context_mpp: float
    target_mpp: float
    context_fov_um: float
    target_fov_um: float
    targets_per_context: int
    min_tissue_fraction: float
    anchor_stride_fraction: float
    target_margin_um: float
    spacing_tolerance: float

    @classmethod
    def from_mapping(cls, values: dict) -> "SamplingProfile":
        missing = [name for name in cls.__dataclass_fields__ if name not in values]
        if missing:
            raise ValueError(f"missing required profile keys: {missing}")
        return cls(**{name: values[name] for name in cls.__dataclass_fields__})

    def as_strings(self) -> dict[str, str]:
        return {k: str(v) for k, v in asdict(self).items()}


DEFAULT_PROFILE = SamplingProfile(
    profile_id="ctx1p0_tgt0p5_fov512um_k4",
    context_mpp=1.0,
    target_mpp=0.5,
    context_fov_um=512.0,
    target_fov_um=128.0,
    targets_per_context=4,
    min_tissue_fraction=0.2,
    anchor_stride_fraction=0.5,
    target_margin_um=16.0,
    spacing_tolerance=0.05,
)


def resume_merge(manifest: DataFrame, existing: DataFrame, retry_failed: bool = False) -> DataFrame:
    """Index rows to keep and rows still to be computed, tagged by ``reused``.

    ``existing`` rows win by slide id, failed ones too unless ``retry_failed``.
    Manifest rows missing from it come with NULL index columns.
    """
    known = existing.where("status = 'ok'") if retry_failed else existing
    known = known.dropDuplicates(["slide_id"])
    index_columns = [c for c in known.columns if c != "slide_id"]
    reuse = known.select(
        "slide_id", F.struct(*index_columns).alias("__existing"), F.lit(True).alias("__hit")
    )
    keep = [c for c in manifest.columns if c not in index_columns]
    joined = manifest.join(reuse, "slide_id", "left")
    shared = [c for c in manifest.columns if c in index_columns]
    return joined.select(
        *keep,
        *[
            F.when(F.col("__hit"), F.col(f"__existing.{c}")).otherwise(F.col(c)).alias(c)
            for c in shared
        ],
        *[F.col(f"__existing.{c}").alias(c) for c in index_columns if c not in shared],
        F.coalesce("__hit", F.lit(False)).alias("reused"),
    )


def with_mask_scale(slides: DataFrame) -> DataFrame:
    """Level-0 scale of the mask per axis, NULL where there is no mask."""
    has_mask = F.col("mask_path").isNotNull()
    return slides.withColumns(
        {
            f"mask_to_wsi_scale_{axis}": F.when(
                has_mask, G.mask_to_wsi_scale(f"wsi_level0_{side}", f"mask_level0_{side}")
            )
            for axis, side in (("x", "width"), ("y", "height"))
        }
    )


def profile_geometry(profile: SamplingProfile) -> dict[str, Column]:
    """Context, target and margin in requested context pixels, and validity."""
    context = G.round_px(G.num(profile.context_fov_um) / G.num(profile.context_mpp))
    target = G.round_px(G.num(profile.target_fov_um) / G.num(profile.context_mpp))
    margin = F.greatest(
        G.round_px(G.num(profile.target_margin_um) / G.num(profile.context_mpp)), G.half(target)
    )
    return {
        "context_size_px": context,
        "target_size_context_px": target,
        "target_margin_context_px": margin,
        "geometry_valid": context > 2 * margin,
    }


def slide_eligibility(slides: DataFrame, profile: SamplingProfile) -> DataFrame:
    """Adds ``build_status``/``reason``; rows to be processed have status ``ok``."""
    valid = profile_geometry(profile)["geometry_valid"]
    not_ok = ~F.col("status").eqNullSafe("ok")
    no_mask = F.coalesce(F.col("mask_path"), F.lit("")) == ""
    reason = (
        F.when(not_ok, F.lit("slide_status_not_ok"))
        .when(no_mask, F.lit("missing_mask_path"))
        .when(~valid, F.lit("invalid_profile_geometry"))
        .otherwise(F.lit(""))
    )
    status = (
        F.when(not_ok | no_mask, F.lit("skipped")).when(~valid, F.lit("failed")).otherwise(F.lit("ok"))
    )
    return slides.withColumn("build_status", status).withColumn("reason", reason)


def grid_geometry(slides: DataFrame, profile: SamplingProfile) -> DataFrame:
    """Window size, stride and last window index per axis, on the mask raster."""
    size = F.greatest(
        F.lit(1), G.round_px(G.num(profile.context_fov_um) / F.col("mask_level0_spacing_mpp"))
    )
    stride = F.greatest(
        F.lit(1), G.round_px(F.col("grid_size") * F.lit(float(profile.anchor_stride_fraction)))
    )
    out = slides.withColumn("grid_size", size).withColumn("grid_stride", stride)
    for axis, side in (("x", "width"), ("y", "height")):
        dim = F.col(f"mask_level0_{side}")
        c, s = F.col("grid_size"), F.col("grid_stride")
        # Centres run over half, half+stride, ... below max(half+1, dim-half);
        # window i starts at i*stride and has to end inside the mask.
        scanned = F.ceil(F.greatest(F.lit(1), dim - 2 * G.half(c)) / s) - 1
        inside = F.floor((dim - c) / s)
        out = out.withColumn(f"grid_last_{axis}", F.least(scanned, inside).cast("bigint"))
    return out


def _touched(lo: Column, hi: Column, last: Column) -> tuple[Column, Column]:
    """First and last window index whose span meets [lo, hi)."""
    c, s = F.col("grid_size"), F.col("grid_stride")
    first = F.greatest(F.lit(0), F.floor((lo - c) / s) + 1).cast("bigint")
    final = F.least(last, F.ceil(hi / s) - 1).cast("bigint")
    return first, final


def window_tissue(slides: DataFrame, mask_runs: DataFrame, include_empty: bool = False) -> DataFrame:
    """Tissue pixels per grid window: (slide_id, iy, ix, tissue_px).

    ``slides`` needs the columns of ``grid_geometry``. Runs of a slide must be
    disjoint. Windows without tissue appear only with ``include_empty``.
    """
    geometry = slides.select("slide_id", "grid_size", "grid_stride", "grid_last_x", "grid_last_y")
    runs = salted_join(
        mask_runs.select("slide_id", "y0", "y1", "x0", "x1"), geometry, ["slide_id"], ["y0", "x0"]
    )
    for axis in ("y", "x"):
        first, final = _touched(F.col(f"{axis}0"), F.col(f"{axis}1"), F.col(f"grid_last_{axis}"))
        runs = (
            runs.withColumn("__a", first)
            .withColumn("__b", final)
            .where("__a <= __b")
            .withColumn(f"i{axis}", F.explode(F.sequence("__a", "__b")))
        )

    def clipped(axis: str) -> Column:
        start = F.col(f"i{axis}") * F.col("grid_stride")
        return F.least(F.col(f"{axis}1"), start + F.col("grid_size")) - F.greatest(
            F.col(f"{axis}0"), start
        )

    pieces = runs.select("slide_id", "iy", "ix", (clipped("y") * clipped("x")).alias("px"))
    if include_empty:
        pieces = pieces.unionByName(
            geometry.where("grid_last_x >= 0 AND grid_last_y >= 0")
            .withColumn("iy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("grid_last_y"))))
            .withColumn("ix", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("grid_last_x"))))
            .select("slide_id", "iy", "ix", F.lit(0).cast("bigint").alias("px"))
        )
    return pieces.groupBy("slide_id", "iy", "ix").agg(F.sum("px").alias("tissue_px"))


def anchor_catalog(
    slides: DataFrame,
    mask_runs: DataFrame,
    profile: SamplingProfile = DEFAULT_PROFILE,
    stratum_key: str = "organ",
) -> DataFrame:
    """All anchors of the eligible slides, with dense per-slide ids in scan order.

    Ids are numbered per grid row first, so a slide holding most anchors never
    lands in one task.
    """
    eligible = grid_geometry(
        slide_eligibility(slides, profile).where("build_status = 'ok'"), profile
    )
    tissue = window_tissue(eligible, mask_runs, include_empty=profile.min_tissue_fraction <= 0)
    px = profile_geometry(profile)
    fraction = F.col("tissue_px") / (F.col("grid_size") * F.col("grid_size")).cast("double")
    slide_columns = eligible.select(
        "slide_id",
        "wsi_path",
        "mask_path",
        stratum_value(F.col("metadata"), stratum_key).alias("stratum_id"),
        "wsi_level0_spacing_mpp",
        "wsi_level0_width",
        "wsi_level0_height",
        "mask_to_wsi_scale_x",
        "mask_to_wsi_scale_y",
        "grid_size",
        "grid_stride",
    )
    kept = (
        salted_join(tissue, slide_columns, ["slide_id"], ["iy", "ix"])
        .withColumn("fraction", fraction)
        .where(F.col("fraction") >= F.lit(float(profile.min_tissue_fraction)))
    )
    for axis in ("x", "y"):
        kept = kept.withColumn(
            f"center_{axis}_mask", F.col(f"i{axis}") * F.col("grid_stride") + G.half(F.col("grid_size"))
        ).withColumn(
            f"center_{axis}_level0",
            G.round_px(F.col(f"center_{axis}_mask") * F.col(f"mask_to_wsi_scale_{axis}")),
        )
    in_bounds = G.center_in_bounds(
        "center_x_level0",
        "center_y_level0",
        px["context_size_px"],
        profile.context_mpp,
        "wsi_level0_spacing_mpp",
        "wsi_level0_width",
        "wsi_level0_height",
    )
    numbered = bucketed_row_number(
        kept.where(in_bounds), ["slide_id"], ["ix"], F.col("iy"), "anchor_idx"
    )
    number = F.col("anchor_idx").cast("string")
    padded = F.when(F.length(number) >= 7, number).otherwise(F.lpad(number, 7, "0"))
    return numbered.select(
        F.concat_ws("_", "slide_id", padded).alias("anchor_id"),
        "slide_id",
        F.lit(profile.profile_id).alias("profile_id"),
        "stratum_id",
        "wsi_path",
        "mask_path",
        "center_x_level0",
        "center_y_level0",
        "center_x_mask",
        "center_y_mask",
        F.bround("fraction", 6).alias("tissue_fraction"),
        F.lit(1).alias("is_in_bounds"),
        "wsi_level0_spacing_mpp",
        F.lit(profile.context_mpp).alias("context_mpp"),
        F.lit(profile.target_mpp).alias("target_mpp"),
        F.lit(profile.context_fov_um).alias("context_fov_um"),
        F.lit(profile.target_fov_um).alias("target_fov_um"),
        F.lit(profile.targets_per_context).alias("targets_per_context"),
        F.lit(profile.target_margin_um).alias("target_margin_um"),
        px["target_margin_context_px"].alias("target_margin_context_px"),
        px["context_size_px"].alias("context_size_px"),
        px["target_size_context_px"].alias("target_size_context_px"),
        F.lit(profile.spacing_tolerance).alias("spacing_tolerance"),
        "anchor_idx",
    )


def with_shards(anchors: DataFrame, rows_per_shard: int = 100_000) -> DataFrame:
    """Shard of each anchor within its slide, and its row in that shard."""
    if rows_per_shard <= 0:
        raise ValueError("rows_per_shard must be > 0")
    shard = F.floor(F.col("anchor_idx") / F.lit(rows_per_shard)).cast("bigint")
    return anchors.withColumn("shard_index", shard).withColumn(
        "row_in_shard", F.col("anchor_idx") - F.col("shard_index") * rows_per_shard
    )


def build_report(slides: DataFrame, anchors: DataFrame, profile: SamplingProfile) -> DataFrame:
    """Status, reason and anchor count of every slide."""
    counts = anchors.groupBy("slide_id").agg(F.count(F.lit(1)).alias("found"))
    joined = slide_eligibility(slides, profile).join(counts, "slide_id", "left")
    found = F.coalesce(F.col("found"), F.lit(0))
    empty = (F.col("build_status") == "ok") & (found == 0)
    return joined.select(
        "slide_id",
        F.when(empty, F.lit("failed")).otherwise(F.col("build_status")).alias("status"),
        F.when(empty, F.lit("no_valid_anchors")).otherwise(F.col("reason")).alias("reason"),
        found.cast("bigint").alias("anchors"),
    )


def build_summary(report: DataFrame) -> DataFrame:
    return report.agg(
        F.count_if(F.col("status") == "ok").alias("slides_ok"),
        F.count_if(F.col("status") != "ok").alias("slides_not_ok"),
        F.sum("anchors").alias("anchors"),
    )


def stratum_shard_counts(sharded: DataFrame) -> DataFrame:
    """Total, per-stratum and per-shard counts in one pass (rollup)."""
    return (
        sharded.rollup("stratum_id", "slide_id", "shard_index")
        .agg(F.count(F.lit(1)).alias("anchors"), F.grouping_id().alias("gid"))
        .where(F.col("gid").isin(0, 3, 7))
        .select(
            F.when(F.col("gid") == 7, "total")
            .when(F.col("gid") == 3, "stratum")
            .otherwise("shard")
            .alias("level"),
            "stratum_id",
            "slide_id",
            "shard_index",
            "anchors",
        )
    )


def qc_anchors(anchors: DataFrame, slides: DataFrame, per_slide: int, profile: SamplingProfile) -> DataFrame:
    """First anchors of each slide with the overlay rectangle on its mask."""
    geometry = grid_geometry(slides, profile).select(
        "slide_id", "mask_level0_width", "mask_level0_height", "grid_size"
    )
    h = G.half(F.col("grid_size"))
    return (
        anchors.where(F.col("anchor_idx") < per_slide)
        .join(geometry, "slide_id")
        .select(
            "slide_id",
            "anchor_id",
            F.greatest(F.lit(0), F.col("center_x_mask") - h).alias("x0"),
            F.greatest(F.lit(0), F.col("center_y_mask") - h).alias("y0"),
            F.least(F.col("mask_level0_width") - 1, F.col("center_x_mask") + h).alias("x1"),
            F.least(F.col("mask_level0_height") - 1, F.col("center_y_mask") + h).alias("y1"),
            (F.col("anchor_idx") % 2).alias("color_parity"),
        )
    )


def lookup_anchors(anchors: DataFrame, wanted: DataFrame) -> DataFrame:
    """Anchor rows for wanted ids; an unknown id is an error."""
    joined = wanted.select("anchor_id").join(
        anchors.withColumn("__found", F.lit(True)), "anchor_id", "left"
    )
    return joined.where(
        F.when(
            F.col("__found").isNull(),
            F.raise_error(F.concat(F.lit("unknown anchor_id "), F.col("anchor_id"))),
        ).otherwise(F.col("__found"))
    ).drop("__found")
