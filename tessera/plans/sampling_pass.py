"""One sampling pass as a single plan: draws -> anchors -> targets -> masks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.index import SamplingProfile, with_shards
from tessera.operators.masks import footprint_masks
from tessera.operators.ranking import bucketed_row_number, fixed_width_bucket
from tessera.operators.sampling import DRAW_BUCKET, sample_anchors
from tessera.operators.targets import (
    PlacementPolicy,
    attach_context_tissue,
    place_targets,
    resolution_plan,
    with_plan,
)
from tessera.session import materialize


def sampling_plan(
    slides: DataFrame,
    mask_runs: DataFrame,
    anchors: DataFrame,
    draws: DataFrame,
    profile: SamplingProfile,
    policy: PlacementPolicy,
    seed: int = 0,
    pass_index: int = 0,
    partitions: int = 1,
    weights="inverse_frequency",
    strategy: str = "stratified",
    batch_size: int = 8,
    rows_per_shard: int = 100_000,
    min_keep: int = 4,
    bin_px: int = 64,
) -> DataFrame:
    """One row per usable sample: anchor, boxes, effective threshold, token masks.

    Draws come first: context tissue is measured once for each anchor that was drawn, and
    for no other, and joined to its draws. Draws that cannot place all targets are
    dropped, the others fill batches in draw order per reader. ``bin_px`` should be near
    the context size in mask pixels.
    """
    drawn = materialize(
        sample_anchors(with_shards(anchors, rows_per_shard), draws, seed, pass_index, partitions, weights, strategy), "drawn"
    )
    visited = drawn.select(*anchors.columns).dropDuplicates(["anchor_id"])
    contexts = attach_context_tissue(
        with_plan(visited, resolution_plan(slides, profile, policy.patch)), mask_runs, bin_px
    )
    added = [c for c in contexts.columns if c not in anchors.columns]
    drawn = drawn.join(contexts.select("anchor_id", *added), "anchor_id")
    key = F.concat_ws("/", F.col("partition").cast("string"), F.col("draw_idx").cast("string"))
    placed = place_targets(drawn, profile, policy, seed, key, pass_index).where(
        F.col("targets").isNotNull()
    )
    # Numbering reads its rows twice: what was searched is written, not searched again.
    placed = materialize(placed.drop("tissue"), "placed")
    numbered = bucketed_row_number(
        placed,
        ["partition"],
        ["draw_idx"],
        fixed_width_bucket(F.col("draw_idx"), DRAW_BUCKET),
        "sample_idx",
    ).withColumn(
        "batch_id",
        F.concat_ws(
            "/",
            F.col("partition").cast("string"),
            F.floor(F.col("sample_idx") / batch_size).cast("string"),
        ),
    )
    grid = int(round(profile.context_fov_um / profile.context_mpp)) // policy.patch
    return footprint_masks(
        numbered, max(grid, 1), max(grid, 1), policy.patch, boxes="targets", min_keep=min_keep
    )
