"""Explicit schemas: nothing in the package relies on inference."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()


def _fields(*pairs) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in pairs])


SLIDE_METADATA = _fields(
    ("slide_id", _S),
    ("wsi_path", _S),
    ("mask_path", _S),
    ("status", _S),
    ("error", _S),
    ("traceback", _S),
    ("wsi_level0_width", _L),
    ("wsi_level0_height", _L),
    ("wsi_level0_spacing_mpp", _D),
    ("wsi_shapes", T.ArrayType(T.ArrayType(_L))),
    ("wsi_spacings_mpp", T.ArrayType(_D)),
    ("mask_level0_width", _L),
    ("mask_level0_height", _L),
    ("mask_level0_spacing_mpp", _D),
    ("mask_shapes", T.ArrayType(T.ArrayType(_L))),
    ("mask_spacings_mpp", T.ArrayType(_D)),
    ("mask_to_wsi_scale_x", _D),
    ("mask_to_wsi_scale_y", _D),
    ("metadata", T.MapType(_S, _S)),
)

MASK_RUN = _fields(("slide_id", _S), ("y0", _L), ("y1", _L), ("x0", _L), ("x1", _L))

ANCHOR = _fields(
    ("anchor_id", _S),
    ("slide_id", _S),
    ("profile_id", _S),
    ("stratum_id", _S),
    ("wsi_path", _S),
    ("mask_path", _S),
    ("center_x_level0", _L),
    ("center_y_level0", _L),
    ("center_x_mask", _L),
    ("center_y_mask", _L),
    ("tissue_fraction", _D),
    ("is_in_bounds", _I),
    ("wsi_level0_spacing_mpp", _D),
    ("context_mpp", _D),
    ("target_mpp", _D),
    ("context_fov_um", _D),
    ("target_fov_um", _D),
    ("targets_per_context", _I),
    ("target_margin_um", _D),
    ("target_margin_context_px", _L),
    ("context_size_px", _L),
    ("target_size_context_px", _L),
    ("spacing_tolerance", _D),
)

CATALOG_SHARD = _fields(
    ("path", _S), ("rows", _L), ("stratum_counts", T.MapType(_S, _L))
)
CATALOG_MANIFEST = _fields(
    ("schema_version", _S),
    ("profile", T.MapType(_S, _S)),
    ("slide_index_path", _S),
    ("sampling_stratum_key", _S),
    ("total_anchors", _L),
    ("stratum_counts", T.MapType(_S, _L)),
    ("anchor_shards", T.ArrayType(CATALOG_SHARD)),
)

EVAL_MANIFEST = _fields(
    ("sample_id", _S),
    ("image_path", _S),
    ("label", _S),
    ("medical_center", _S),
    ("slide_id", _S),
    ("dataset", _S),
)

STEP_LOG = _fields(
    ("images_seen", _L),
    ("pass_index", _L),
    ("iteration", _L),
    ("loss", _D),
    ("context_keep_tokens", _D),
    ("target_predict_tokens", _D),
    ("iteration_time_ms", _D),
    ("learning_rate", _D),
    ("weight_decay", _D),
)

METRIC_ROW = _fields(
    ("plugin", _S),
    ("dataset", _S),
    ("metric", _S),
    ("tune_index", _L),
    ("images_seen", _L),
    ("value", _D),
    ("std", _D),
    ("n", _L),
    ("extra", _S),
)

SPLIT_ROW = _fields(
    ("sample_id", _S),
    ("label", _S),
    ("medical_center", _S),
    ("slide_id", _S),
    ("partition", _S),
    ("correlation_level", _D),
    ("cramers_v_target", _D),
    ("cramers_v_realized", _D),
    ("dataset", _S),
    ("rep", _L),
    ("split_id", _L),
)

JOB_EVENT = _fields(
    ("tune_index", _L),
    ("images_seen", _L),
    ("enqueued_at_s", _D),
    ("started_at_s", _D),
    ("finished_at_s", _D),
    ("error", _S),
    ("queue_depth", _L),
)
