"""Pixel/micron geometry as column expressions.

Pixel counts are rounded half to even, as Python's ``round`` does; ``bround``
on a DOUBLE is the matching Spark function.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.control import let

# Names of the ways a pyramid level is chosen.
NATIVE, FROM_FINER, FROM_COARSER = "native_or_close", "fallback_from_finer", "fallback_from_coarser"
MAX_OVERLAP_RATIO = 0.25


def num(value) -> Column:
    """Column name, column or number -> double column."""
    if isinstance(value, Column):
        return value.cast("double")
    if isinstance(value, str):
        return F.col(value).cast("double")
    return F.lit(float(value))


def whole(value) -> Column:
    """Column name, column or number -> bigint column."""
    if isinstance(value, Column):
        return value.cast("bigint")
    if isinstance(value, str):
        return F.col(value).cast("bigint")
    return F.lit(int(value)).cast("bigint")


def round_px(value: Column) -> Column:
    return F.bround(value.cast("double"), 0).cast("bigint")


def half(size: Column) -> Column:
    return F.floor(size / F.lit(2)).cast("bigint")


def floor_div(a: Column, b: Column) -> Column:
    return F.floor(a / b).cast("bigint")


def _positive(value: Column, name: str) -> Column:
    return F.when(value <= 0, F.raise_error(F.lit(f"{name} must be positive"))).otherwise(value)


# --- resolution -----------------------------------------------------------------


def spacing_to_level0_px(size, spacing, spacing0) -> Column:
    return round_px(num(size) * num(spacing) / _positive(num(spacing0), "spacing_at_level0"))


def level0_to_spacing_px(size, spacing, spacing0) -> Column:
    return round_px(num(size) * num(spacing0) / _positive(num(spacing), "spacing"))


def snap_to_multiple(size, patch) -> Column:
    """Nearest multiple of ``patch``, at least one patch; ties go down."""
    p = _positive(whole(patch), "patch_size")
    s = F.greatest(F.lit(1), whole(size))
    lower = F.greatest(p, floor_div(s, p) * p)
    upper = F.greatest(p, floor_div(s + p - 1, p) * p)
    return F.when(s - lower <= upper - s, lower).otherwise(upper)


def requested_px(fov_um, mpp, patch) -> Column:
    return snap_to_multiple(F.greatest(F.lit(1), round_px(num(fov_um) / num(mpp))), patch)


def effective_mpp(fov_um, mpp, patch) -> Column:
    return num(fov_um) / requested_px(fov_um, mpp, patch)


def target_px_in_context(target_fov_um, context_effective_mpp) -> Column:
    return F.greatest(F.lit(1), round_px(num(target_fov_um) / num(context_effective_mpp)))


def source_px(size, effective, source) -> Column:
    return F.greatest(F.lit(1), round_px(num(size) * num(effective) / num(source)))


def nearest_spacing(spacings: Column, mpp: Column) -> Column:
    """Closest entry of an ascending array; the finer one wins a tie."""
    return F.aggregate(
        spacings,
        F.lit(None).cast("double"),
        lambda best, s: F.when(best.isNull() | (F.abs(s - mpp) < F.abs(best - mpp)), s).otherwise(best),
    )


def choose_source_spacing(spacings: Column, mpp, tolerance) -> Column:
    """Struct(spacing, mode) of the pyramid level to read from."""
    wanted, tol = num(mpp), num(tolerance)
    ascending = F.array_sort(spacings)
    nearest = nearest_spacing(ascending, wanted)
    finer = F.array_max(F.filter(ascending, lambda s: s < wanted))
    coarser = F.array_min(F.filter(ascending, lambda s: s > wanted))
    close = F.abs(nearest - wanted) / wanted <= tol
    spacing = F.when(close, nearest).otherwise(F.coalesce(finer, coarser))
    mode = (
        F.when(close, F.lit(NATIVE))
        .when(finer.isNotNull(), F.lit(FROM_FINER))
        .otherwise(F.lit(FROM_COARSER))
    )
    checked = F.when(
        F.size(spacings) < 1, F.raise_error(F.lit("slide exposes no pyramid spacing"))
    ).otherwise(spacing)
    return F.struct(checked.cast("double").alias("spacing"), mode.alias("mode"))


def best_level_for_spacing(spacings: Column, mpp, tolerance) -> Column:
    """Struct(level, within_tolerance): the coarsest leading level not coarser
    than wanted, else the nearest one."""
    wanted, tol = num(mpp), num(tolerance)
    first_coarser = F.array_position(F.transform(spacings, lambda s: s > wanted), F.lit(True))
    leading = F.when(first_coarser == 0, F.size(spacings)).otherwise(first_coarser - 1)
    candidate = F.greatest(leading - 1, F.lit(0)).cast("int")
    candidate_ok = F.abs(F.element_at(spacings, candidate + 1) - wanted) / wanted <= tol
    nearest = nearest_spacing(spacings, wanted)
    level = F.when(candidate_ok, candidate).otherwise(F.array_position(spacings, nearest) - 1)
    within = candidate_ok | (F.abs(nearest - wanted) / wanted <= tol)
    return F.struct(level.cast("bigint").alias("level"), within.alias("within_tolerance"))


def mask_to_wsi_scale(wsi_px, mask_px) -> Column:
    """Shape ratio used by the catalog; NULL without a mask."""
    return num(wsi_px) / num(mask_px)


def wsi_to_mask_spacing_scale(wsi_spacing0, mask_spacing0) -> Column:
    """Spacing ratio used by the sampler (differs from the shape ratio when the
    mask was padded or cropped)."""
    return num(wsi_spacing0) / num(mask_spacing0)


# --- boxes ----------------------------------------------------------------------


def box(x0, y0, x1, y1) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def box_from_center(cx, cy, size) -> Column:
    s = whole(size)
    x0, y0 = whole(cx) - half(s), whole(cy) - half(s)
    return box(x0, y0, x0 + s, y0 + s)


def context_box_level0(cx, cy, size, spacing, spacing0) -> Column:
    return box_from_center(cx, cy, spacing_to_level0_px(size, spacing, spacing0))


def box_within(b: Column, width, height) -> Column:
    return (b["x0"] >= 0) & (b["y0"] >= 0) & (b["x1"] <= num(width)) & (b["y1"] <= num(height))


def center_in_bounds(cx, cy, size, spacing, spacing0, width, height) -> Column:
    return box_within(context_box_level0(cx, cy, size, spacing, spacing0), width, height)


def overlap_area(a: Column, b: Column) -> Column:
    ix = F.greatest(F.lit(0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    iy = F.greatest(F.lit(0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    return ix * iy


def overlaps_too_much(candidate: Column, chosen: Column, size, ratio=MAX_OVERLAP_RATIO) -> Column:
    """Does the candidate cover more than ``ratio`` of a target with any chosen box?"""
    limit = F.lit(float(ratio)) * num(size) * num(size)
    return F.exists(chosen, lambda other: overlap_area(candidate, other) > limit)


def margin_for_anchor(margin_um, context_mpp_effective, target_px, context_px) -> Column:
    wanted = F.greatest(round_px(num(margin_um) / num(context_mpp_effective)), half(whole(target_px)))
    return F.least(wanted, F.greatest(F.lit(1), half(whole(context_px)) - 1))


def aligned_origin_range(margin, context_px, target_px, patch) -> Column:
    """Struct(start, count) of patch-aligned box origins on one axis; count 0 if none."""
    m, c, t, p = whole(margin), whole(context_px), whole(target_px), whole(patch)
    half_size = t.cast("double") * 0.5
    lowest = F.greatest(F.lit(0), F.ceil(m - half_size).cast("bigint"))
    highest = F.least(c - t, F.floor((c - m - 1) - half_size).cast("bigint"))
    start = floor_div(lowest + p - 1, p) * p
    count = F.when((highest < lowest) | (start > highest), F.lit(0)).otherwise(
        floor_div(highest - start, p) + 1
    )
    return F.struct(start.cast("bigint").alias("start"), count.cast("bigint").alias("count"))


def target_center_level0(origin0, box_lo, box_hi, scale) -> Column:
    """Level-0 centre coordinate of a box given in context pixels, on one axis."""
    return round_px(num(origin0) + 0.5 * (num(box_lo) + num(box_hi)) * num(scale))


def clip_box(b: Column, width, height) -> Column:
    """Clip to an image, keeping at least one pixel on each axis."""
    w, h = num(width), num(height)
    x0 = F.least(F.greatest(b["x0"].cast("double"), F.lit(0.0)), w - 1)
    y0 = F.least(F.greatest(b["y0"].cast("double"), F.lit(0.0)), h - 1)
    x1 = F.least(F.greatest(b["x1"].cast("double"), x0 + 1), w)
    y1 = F.least(F.greatest(b["y1"].cast("double"), y0 + 1), h)
    return box(x0, y0, x1, y1)


def thumbnail_box(b: Column, level0_w, level0_h, thumb_w, thumb_h) -> Column:
    """Level-0 box scaled into a thumbnail and clipped."""
    sx, sy = num(thumb_w) / num(level0_w), num(thumb_h) / num(level0_h)
    return clip_box(box(b["x0"] * sx, b["y0"] * sy, b["x1"] * sx, b["y1"] * sy), thumb_w, thumb_h)


# --- token grids ----------------------------------------------------------------


def token_span(lo, hi, patch, grid) -> Column:
    """Struct(first, last_exclusive) of the grid cells a box side touches."""
    p, g = num(patch), whole(grid)
    first = F.greatest(F.lit(0), F.least(g, F.floor(num(lo) / p).cast("bigint")))
    last = F.greatest(F.lit(0), F.least(g, F.ceil(num(hi) / p).cast("bigint")))
    last = F.when(last <= first, F.least(g, first + 1)).otherwise(last)
    return F.struct(first.cast("bigint").alias("first"), last.cast("bigint").alias("last"))


def box_to_tokens(b: Column, grid_w, grid_h, patch) -> Column:
    """Row-major ids of all patch-grid cells a box touches, never empty."""
    xs = token_span(b["x0"], b["x1"], patch, grid_w)
    ys = token_span(b["y0"], b["y1"], patch, grid_h)
    gw = whole(grid_w)
    span = F.struct(
        (ys["first"] * gw + xs["first"]).alias("start"),
        (xs["last"] - xs["first"]).alias("wide"),
        (ys["last"] - ys["first"]).alias("high"),
    )

    def cells(s: Column) -> Column:
        # One sequence of row starts and one per row: no function call for each token.
        starts = F.sequence(s["start"], s["start"] + (s["high"] - 1) * gw, gw)
        rows = F.transform(starts, lambda first: F.sequence(first, first + s["wide"] - 1))
        empty = (s["wide"] <= 0) | (s["high"] <= 0)
        return F.when(empty, F.array(F.lit(0).cast("bigint"))).otherwise(F.flatten(rows))

    return let(span, cells)


def token_offsets(b: Column, patch) -> Column:
    """Box coordinates modulo the patch size: 0 means aligned."""
    p = whole(patch)
    return box(*[F.pmod(F.floor(b[c]).cast("bigint"), p) for c in ("x0", "y0", "x1", "y1")])


def _cell_overlap(token: Column, b: Column, grid_w: Column, p: Column) -> Column:
    cx = F.pmod(token, grid_w) * p
    cy = floor_div(token, grid_w) * p
    ix = F.greatest(F.lit(0.0), F.least(b["x1"], cx + p) - F.greatest(b["x0"], cx))
    iy = F.greatest(F.lit(0.0), F.least(b["y1"], cy + p) - F.greatest(b["y0"], cy))
    return (ix * iy).cast("double")


def coverage_mismatch(b: Column, tokens: Column, grid_w, grid_h, patch) -> Column:
    """Struct(missing, extra) in square pixels: box area without a token, and
    token area outside the box."""
    p, gw, gh = num(patch), whole(grid_w), whole(grid_h)
    covered = F.aggregate(
        tokens, F.lit(0.0), lambda acc, t: acc + _cell_overlap(t, b, gw, p)
    )
    on_grid = F.greatest(
        F.lit(0.0), F.least(b["x1"], gw * p) - F.greatest(b["x0"], F.lit(0.0))
    ) * F.greatest(F.lit(0.0), F.least(b["y1"], gh * p) - F.greatest(b["y0"], F.lit(0.0)))
    return F.struct(
        (on_grid - covered).alias("missing"), (F.size(tokens) * p * p - covered).alias("extra")
    )
