"""Resolution plans and constrained placement of target boxes.

Placement is rejection sampling with a greedy acceptance rule. Each anchor row
carries the tissue rectangles of its own context, so the whole search - seeded
candidates, bounds, overlap, tissue, threshold relaxation - is done where the row is
(``placement``): no candidate is ever materialised as a row and nothing is shuffled
after the rectangles have been attached.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.functions import geometry as G
from tessera.operators.index import SamplingProfile
from tessera.operators.placement import search_together
from tessera.operators.ranking import salted_join, spread

MAX_ATTEMPTS = 4000  # fixed value
BOX_FIELDS = ("x0", "y0", "x1", "y1", "fraction")
BOX_TYPE = T.ArrayType(T.StructType([*(T.StructField(c, T.LongType()) for c in BOX_FIELDS[:4]), T.StructField(BOX_FIELDS[4], T.DoubleType())]))


@dataclass(frozen=True)
class PlacementPolicy:
    """How targets are placed and what happens when too few fit."""

    patch: int = 16
    aligned: bool = False
    min_tissue: float = 0.25
    min_tissue_floor: float = 0.10
    min_tissue_step: float = 0.05
    policy: str = "lower_threshold"
    max_attempts: int = MAX_ATTEMPTS

    def thresholds(self) -> list[float]:
        """The values of ``threshold_schedule``, as numbers known to the plan."""
        if not 0.0 <= self.min_tissue_floor <= self.min_tissue or self.min_tissue_step <= 0:
            raise ValueError("need 0 <= floor <= start and step > 0")
        if self.policy == "skip_anchor":
            return [self.min_tissue]
        if self.policy != "lower_threshold":
            raise ValueError(f"unknown insufficient-target policy: {self.policy!r}")
        steps = math.ceil((self.min_tissue - self.min_tissue_floor - 1e-9) / self.min_tissue_step)
        above = [round(self.min_tissue - i * self.min_tissue_step, 6) for i in range(max(0, steps))]
        return list(dict.fromkeys([*above, round(self.min_tissue_floor, 6)]))


def resolution_plan(slides: DataFrame, profile: SamplingProfile, patch: int) -> DataFrame:
    """Per slide: pyramid spacing, mode and source size for context, target and
    mask crops. Joined to anchors by slide; Catalyst broadcasts it when small."""
    ctx_px = G.requested_px(profile.context_fov_um, profile.context_mpp, patch)
    tgt_px = G.requested_px(profile.target_fov_um, profile.target_mpp, patch)
    ctx_mpp = G.effective_mpp(profile.context_fov_um, profile.context_mpp, patch)
    tgt_mpp = G.effective_mpp(profile.target_fov_um, profile.target_mpp, patch)
    chosen = slides.select(
        "slide_id",
        G.choose_source_spacing(F.col("wsi_spacings_mpp"), ctx_mpp, profile.spacing_tolerance).alias("c"),
        G.choose_source_spacing(F.col("wsi_spacings_mpp"), tgt_mpp, profile.spacing_tolerance).alias("t"),
        F.when(
            F.col("mask_path").isNotNull(),
            G.choose_source_spacing(
                F.col("mask_spacings_mpp"), ctx_mpp, profile.spacing_tolerance
            )["spacing"],
        ).alias("mask_source_mpp"),
        F.col("mask_level0_spacing_mpp"),
    )
    return chosen.select(
        "slide_id",
        F.col("c.spacing").alias("context_source_mpp"),
        F.col("c.mode").alias("context_resolution_mode"),
        G.source_px(ctx_px, ctx_mpp, F.col("c.spacing")).alias("context_source_size_px"),
        F.col("t.spacing").alias("target_source_mpp"),
        F.col("t.mode").alias("target_resolution_mode"),
        G.source_px(tgt_px, tgt_mpp, F.col("t.spacing")).alias("target_source_size_px"),
        "mask_source_mpp",
        G.source_px(ctx_px, ctx_mpp, F.col("mask_source_mpp")).alias("mask_source_size_px"),
        "mask_level0_spacing_mpp",
        ctx_px.alias("context_size_requested_px"),
        tgt_px.alias("target_size_requested_px"),
        G.target_px_in_context(profile.target_fov_um, ctx_mpp).alias("target_size_in_context_px"),
        ctx_mpp.alias("context_effective_mpp"),
        tgt_mpp.alias("target_effective_mpp"),
    )


def with_plan(anchors: DataFrame, plan: DataFrame) -> DataFrame:
    return salted_join(anchors, plan, ["slide_id"], ["anchor_id"])


def context_windows(planned: DataFrame) -> DataFrame:
    """Mask-raster window [mx0, mx0+msize) of each anchor's context."""
    scale = G.wsi_to_mask_spacing_scale("wsi_level0_spacing_mpp", "mask_level0_spacing_mpp")
    size = G.spacing_to_level0_px("mask_source_size_px", "mask_source_mpp", "mask_level0_spacing_mpp")
    out = planned.withColumn("msize", size)
    for axis in ("x", "y"):
        center = G.round_px(F.col(f"center_{axis}_level0") * scale)
        out = out.withColumn(f"m{axis}0", center - G.half(F.col("msize")))
    return out


def attach_context_tissue(planned: DataFrame, mask_runs: DataFrame, bin_px: int = 64) -> DataFrame:
    """Adds ``tissue``: the tissue rectangles inside each anchor's context, in
    context pixels.

    Windows and runs meet in square bins of the mask raster. A pair meeting in
    several bins counts only in the bin of its overlap's upper left corner. Runs
    are disjoint, so both a bin and a context hold a bounded number of them.
    """

    def bins(lo: Column, hi: Column) -> Column:
        edge = F.lit(bin_px)
        return F.explode(
            F.sequence(F.floor(lo / edge).cast("bigint"), F.floor((hi - 1) / edge).cast("bigint"))
        )

    windows = context_windows(planned).select(
        "anchor_id", "slide_id", "mx0", "my0", "msize", "context_size_requested_px"
    )
    windows = windows.where(F.col("msize").isNotNull()).dropDuplicates(["anchor_id"])
    spread = windows.withColumn("by", bins(F.col("my0"), F.col("my0") + F.col("msize"))).withColumn(
        "bx", bins(F.col("mx0"), F.col("mx0") + F.col("msize"))
    )
    runs = mask_runs.where("x1 > x0 AND y1 > y0")
    runs = runs.withColumn("by", bins(F.col("y0"), F.col("y1"))).withColumn(
        "bx", bins(F.col("x0"), F.col("x1"))
    )
    met = spread.join(runs, ["slide_id", "by", "bx"]).where(
        (F.col("x0") < F.col("mx0") + F.col("msize"))
        & (F.col("x1") > F.col("mx0"))
        & (F.col("y0") < F.col("my0") + F.col("msize"))
        & (F.col("y1") > F.col("my0"))
        & (F.floor(F.greatest("x0", "mx0") / bin_px) == F.col("bx"))
        & (F.floor(F.greatest("y0", "my0") / bin_px) == F.col("by"))
    )
    factor = F.col("context_size_requested_px") / F.col("msize").cast("double")

    def scaled(edge: str, origin: str, clip) -> Column:
        inside = clip(F.col(edge) - F.col(origin))
        return inside * factor

    low = lambda v: F.greatest(v, F.lit(0))
    high = lambda v: F.least(v, F.col("msize"))
    pieces = met.select(
        "anchor_id",
        F.struct(
            scaled("x0", "mx0", low).alias("x0"),
            scaled("y0", "my0", low).alias("y0"),
            scaled("x1", "mx0", high).alias("x1"),
            scaled("y1", "my0", high).alias("y1"),
        ).alias("r"),
    )
    grouped = pieces.groupBy("anchor_id").agg(F.sort_array(F.collect_list("r")).alias("__tissue"))
    empty = F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")
    joined = planned.join(grouped, "anchor_id", "left")
    return joined.withColumn(
        "tissue",
        F.when(F.col("mask_source_mpp").isNotNull(), F.coalesce("__tissue", empty)),
    ).drop("__tissue")


def place_targets(
    anchors: DataFrame,
    profile: SamplingProfile,
    policy: PlacementPolicy,
    seed: int = 0,
    key: Column | None = None,
    pass_index: int = 0,
) -> DataFrame:
    """Adds ``targets`` (boxes with tissue fraction, in context pixels) and
    ``effective_threshold``; both NULL where no threshold allows enough boxes.

    Candidates of an anchor are a fixed sequence given by (seed, pass, key); each
    threshold restarts it. Boxes are accepted in that order if they stay inside
    the context, overlap no accepted box by more than a quarter of a target and
    hold enough tissue (tested only where the slide has a mask).
    """
    key = F.col("anchor_id") if key is None else key
    # Hashing the key keeps this exchange apart from one on the key itself, which
    # AQE would coalesce by size.
    anchors = spread(anchors, F.xxhash64(key))
    ctx, size = F.col("context_size_requested_px"), F.col("target_size_in_context_px")
    margin = G.margin_for_anchor(
        F.col("target_margin_um"), F.col("context_effective_mpp"), size, ctx
    )
    ready = anchors.withColumn("__margin", margin).withColumn(
        "__range", G.aligned_origin_range(F.col("__margin"), ctx, size, policy.patch)
    )
    if policy.aligned:
        low, step, count, shift = F.col("__range.start"), F.lit(policy.patch), F.col("__range.count"), F.lit(0)
    else:
        low, step, count, shift = F.col("__margin"), F.lit(1), ctx - 2 * F.col("__margin"), G.half(size)
    wanted, thresholds, attempts = profile.targets_per_context, policy.thresholds(), policy.max_attempts
    numbers = [x.cast("bigint").alias(f"__{n}") for n, x in (("ctx", ctx), ("size", size), ("low", low), ("step", step), ("count", count), ("shift", shift))]
    prefix = F.concat(F.lit(f"{seed}|{pass_index}|"), key.cast("string"), F.lit("|")).alias("__prefix")
    given = ready.select("*", prefix, *numbers).drop("__margin", "__range")
    own = ["__prefix", "__ctx", "__size", "__low", "__step", "__count", "__shift"]
    schema = T.StructType([*anchors.schema.fields, T.StructField("effective_threshold", T.DoubleType()), T.StructField("targets", BOX_TYPE)])
    arrow = to_arrow_schema(schema)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tissue = batch.column("tissue")
            lengths, edges = tissue.value_lengths().to_pylist(), tissue.flatten()
            rectangles = np.stack([edges.field(c).to_numpy(zero_copy_only=False) for c in ("x0", "y0", "x1", "y1")], axis=1)
            ends = np.cumsum([n or 0 for n in lengths])
            mine = [None if n is None else rectangles[end - n : end] for n, end in zip(lengths, ends, strict=True)]
            prefixes, *values = (batch.column(c).to_pylist() for c in own)
            possible = [k for k, v in enumerate(zip(prefixes, *values, strict=True)) if None not in v and v[5] > 0]
            numbers = np.array([[v[k] for v in values] for k in possible], np.int64).reshape(-1, len(values))
            found = [None] * batch.num_rows
            for k, f in zip(possible, search_together([prefixes[k] for k in possible], numbers, [mine[k] for k in possible], thresholds, wanted, attempts), strict=True):
                found[k] = f
            boxes = [None if f is None else [dict(zip(BOX_FIELDS, b, strict=True)) for b in f[0]] for f in found]
            kept = [c for c in batch.schema.names if c not in own]
            columns = [*(batch.column(c) for c in kept), pa.array([f and f[1] for f in found], pa.float64()), pa.array(boxes, arrow.field("targets").type)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return given.mapInArrow(search, schema)


def target_centers(placed: DataFrame) -> DataFrame:
    """One row per target: box, tissue fraction and level-0 centre."""
    size0 = G.spacing_to_level0_px(
        "context_size_requested_px", "context_effective_mpp", "wsi_level0_spacing_mpp"
    )
    scale = F.col("context_effective_mpp") / F.col("wsi_level0_spacing_mpp")
    rows = placed.withColumn("__half0", G.half(size0)).select(
        "*", F.posexplode("targets").alias("target", "b")
    )
    return rows.select(
        *[c for c in placed.columns if c not in ("targets", "tissue")],
        "target",
        *[F.col(f"b.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")],
        F.col("b.fraction").alias("target_tissue"),
        *[
            G.target_center_level0(
                F.col(f"center_{a}_level0") - F.col("__half0"), F.col(f"b.{a}0"), F.col(f"b.{a}1"), scale
            ).alias(f"target_{a}_level0")
            for a in ("x", "y")
        ],
    )
