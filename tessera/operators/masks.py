"""Token masks on a patch grid: footprints, random splits, multi-block masks.

All set logic is array logic within a row; only the truncation of a batch to a
common length looks at other rows, through a window over the (small) batch. Rows
are spread by batch before lists are built, which is the only shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.functions.arrays import token_complement
from tessera.functions.control import let
from tessera.functions.hashing import hash_hex, hash_u32, hash_unit
from tessera.operators.ranking import spread


def footprint_tokens(
    samples: DataFrame, grid_w: int, grid_h: int, patch: int, boxes: str = "boxes"
) -> DataFrame:
    """Adds ``raw_tokens``: per box the row-major ids of the patches it touches."""
    return samples.withColumn(
        "raw_tokens", F.transform(boxes, lambda b: G.box_to_tokens(b, grid_w, grid_h, patch))
    )


def _shortest(lists: Column) -> Column:
    return F.array_min(F.transform(lists, lambda t: F.size(t)))


def footprint_masks(
    samples: DataFrame,
    grid_w: int,
    grid_h: int,
    patch: int,
    boxes: str = "boxes",
    batch: str = "batch_id",
    encoders: int = 1,
    min_keep: int = 4,
) -> DataFrame:
    """Predictor masks from box footprints, encoder mask from what they leave.

    Within a batch all predictor masks are cut to the shortest one and encoder
    masks to the shortest of theirs, lowest ids kept. The encoder mask excludes
    the *uncut* footprints; where fewer than ``min_keep`` ids are left it falls
    back to the first ids, flagged as ``leak`` if they touch a footprint.
    """
    total = grid_w * grid_h
    in_batch = Window.partitionBy(batch)
    # Shuffle boxes, not the token lists they grow into; the window reuses it.
    tokens = footprint_tokens(spread(samples, batch), grid_w, grid_h, patch, boxes).withColumn(
        "union_tokens", F.sort_array(F.array_distinct(F.flatten("raw_tokens")))
    )
    rest = tokens.withColumn("__rest", token_complement(F.col("union_tokens"), total))
    short = F.size("__rest") < min_keep
    first_ids = F.sequence(F.lit(0).cast("bigint"), F.lit(min(max(min_keep, 1), total) - 1).cast("bigint"))
    masked = (
        rest.withColumn("__enc", F.when(short, first_ids).otherwise(F.col("__rest")))
        .withColumn("leak", short & F.arrays_overlap("__enc", "union_tokens"))
        .withColumn("keep_pred", F.greatest(F.lit(1), F.min(_shortest(F.col("raw_tokens"))).over(in_batch)))
        .withColumn("keep_enc", F.greatest(F.lit(min_keep), F.min(F.size("__enc")).over(in_batch)))
    )
    return (
        masked.withColumn(
            "pred_masks", F.transform("raw_tokens", lambda t: F.slice(t, 1, F.col("keep_pred")))
        )
        .withColumn(
            "enc_masks",
            F.array_repeat(F.slice("__enc", F.lit(1), F.col("keep_enc")), encoders),
        )
        .drop("__rest", "__enc")
    )


def token_accounting(masked: DataFrame) -> DataFrame:
    """Raw, kept and dropped token counts per sample and the target losing most."""
    kept = F.array_distinct(F.flatten("pred_masks"))
    losses = F.zip_with(
        "raw_tokens", "pred_masks", lambda r, p: F.size(F.array_except(r, p)).cast("bigint")
    )
    return masked.withColumn("dropped_per_target", losses).select(
        *masked.columns,
        "dropped_per_target",
        F.size("union_tokens").cast("bigint").alias("raw_union"),
        F.size(kept).cast("bigint").alias("collated_union"),
        F.size(F.array_except("union_tokens", kept)).cast("bigint").alias("dropped_union"),
        (F.array_position("dropped_per_target", F.array_max("dropped_per_target")) - 1).alias(
            "focus_target"
        ),
    )


def coverage(masked: DataFrame, grid_w: int, grid_h: int, patch: int, boxes: str = "boxes") -> DataFrame:
    """One row per target: uncovered box area and token area outside the box."""
    zipped = F.arrays_zip(F.col(boxes).alias("b"), F.col("pred_masks").alias("m"))
    rows = masked.select(
        *[c for c in masked.columns if c not in (boxes, "pred_masks", "raw_tokens", "enc_masks", "union_tokens")],
        F.posexplode(zipped).alias("target", "z"),
    )
    return rows.withColumn(
        "c", G.coverage_mismatch(F.col("z.b"), F.col("z.m"), grid_w, grid_h, patch)
    ).select(
        *[c for c in rows.columns if c != "z"],
        F.col("c.missing").alias("missing_px"),
        F.col("c.extra").alias("extra_px"),
        G.token_offsets(F.col("z.b"), patch).alias("offsets"),
    )


def random_token_split(
    samples: DataFrame,
    tokens: int,
    ratio: tuple[float, float],
    seed: int = 0,
    sample: str = "sample_idx",
    batch: str = "batch_id",
) -> DataFrame:
    """Random visible/predicted split of all tokens; one ratio per batch."""
    low, high = ratio
    drawn = F.lit(low) + hash_unit(seed, "ratio", F.col(batch)) * F.lit(high - low)
    order = F.array_sort(
        F.transform(
            F.sequence(F.lit(0).cast("bigint"), F.lit(tokens - 1).cast("bigint")),
            lambda i: F.struct(hash_hex(seed, F.col(sample), i).alias("h"), i.alias("i")),
        )
    )
    keep = F.floor(F.lit(float(tokens)) * (1.0 - F.col("mask_ratio"))).cast("int")
    return (
        spread(samples, sample)
        .withColumn("mask_ratio", drawn)
        .withColumn("__perm", F.transform(order, lambda e: e["i"]))
        .withColumn("__keep", keep)
        .withColumn("enc_mask", F.slice("__perm", F.lit(1), F.col("__keep")))
        .withColumn("pred_mask", F.slice("__perm", F.col("__keep") + 1, F.lit(tokens)))
        .drop("__perm", "__keep")
    )


def _block_size(u: Column, scale, aspect, height: int, width: int) -> Column:
    """Block height and width from one uniform that sets both area and aspect."""
    area = F.floor(F.lit(float(height * width)) * (F.lit(scale[0]) + u * (scale[1] - scale[0])))
    ratio = F.lit(float(aspect[0])) + u * (aspect[1] - aspect[0])
    h = F.greatest(F.least(F.bround(F.sqrt(area * ratio), 0).cast("bigint"), F.lit(height - 1)), F.lit(0))
    w = F.greatest(F.least(F.bround(F.sqrt(area / ratio), 0).cast("bigint"), F.lit(width - 1)), F.lit(0))
    return F.struct(h.alias("h"), w.alias("w"))


def _inside(token: Column, block: Column, size: Column, width: int) -> Column:
    y, x = F.floor(token / width).cast("bigint"), F.pmod(token, F.lit(width))
    return (
        (y >= block["top"])
        & (y < block["top"] + size["h"])
        & (x >= block["left"])
        & (x < block["left"] + size["w"])
    )


def multiblock_masks(
    samples: DataFrame,
    height: int,
    width: int,
    enc_scale: tuple[float, float] = (0.85, 1.0),
    pred_scale: tuple[float, float] = (0.15, 0.2),
    aspect: tuple[float, float] = (0.75, 1.5),
    encoders: int = 1,
    predictors: int = 4,
    min_keep: int = 10,
    allow_overlap: bool = False,
    seed: int = 0,
    sample: str = "sample_idx",
    batch: str = "batch_id",
    tries: int = 20,
) -> DataFrame:
    """Predictor blocks and encoder blocks that avoid them.

    Block sizes are drawn per batch, positions per sample. An encoder block that
    keeps no more than ``min_keep`` tokens is drawn again; after every ``tries``
    failures one predictor block less is avoided. Batches are cut to a common
    length. A block size that can never keep enough tokens is an error.
    """
    in_batch = Window.partitionBy(batch)
    sized = spread(samples, batch).withColumn(
        "pred_size", _block_size(hash_unit(seed, "pred", F.col(batch)), pred_scale, aspect, height, width)
    ).withColumn(
        "enc_size", _block_size(hash_unit(seed, "enc", F.col(batch)), enc_scale, (1.0, 1.0), height, width)
    )

    def place(size: Column, *parts) -> Column:
        top = F.pmod(hash_u32(seed, *parts, "top"), F.lit(height) - size["h"])
        left = F.pmod(hash_u32(seed, *parts, "left"), F.lit(width) - size["w"])
        return F.struct(top.cast("bigint").alias("top"), left.cast("bigint").alias("left"))

    def tokens_of(block: Column, size: Column) -> Column:
        rows = F.flatten(
            F.transform(
                F.sequence(block["top"], block["top"] + F.greatest(size["h"], F.lit(1)) - 1),
                lambda y: F.transform(
                    F.sequence(block["left"], block["left"] + F.greatest(size["w"], F.lit(1)) - 1), lambda x: y * width + x
                ),
            )
        )
        return F.when((size["h"] > 0) & (size["w"] > 0), rows).otherwise(F.array().cast("array<bigint>"))

    psize, esize = F.col("pred_size"), F.col("enc_size")
    blocks = F.transform(
        F.sequence(F.lit(0), F.lit(predictors - 1)), lambda b: place(psize, "p", F.col(sample), b)
    )
    sized = sized.withColumn("pred_blocks", blocks)

    def encoder(number: int) -> Column:
        def attempt(found: Column, t: Column) -> Column:
            avoid = F.slice("pred_blocks", F.lit(1), F.greatest(F.lit(predictors) - F.floor(t / tries), F.lit(0)).cast("int"))

            def free(block: Column) -> Column:
                all_tokens = tokens_of(block, esize)
                if allow_overlap:
                    return all_tokens
                return F.filter(
                    all_tokens, lambda k: ~F.exists(avoid, lambda p: _inside(k, p, psize, width))
                )

            return F.when(F.size(found) > min_keep, found).otherwise(
                let(place(esize, "e", F.lit(number), F.col(sample), t), free)
            )

        last = tries * (predictors + 1) - 1
        return F.aggregate(
            F.sequence(F.lit(0), F.lit(last)), F.array().cast("array<bigint>"), attempt
        )

    made = sized.withColumn(
        "pred_masks", F.transform("pred_blocks", lambda b: tokens_of(b, psize))
    ).withColumn("enc_masks", F.array(*[encoder(e) for e in range(encoders)]))
    too_small = (_shortest(F.col("enc_masks")) <= min_keep) | (_shortest(F.col("pred_masks")) <= min_keep)
    checked = made.withColumn(
        "pred_masks",
        F.when(too_small, F.raise_error(F.lit("block scale leaves too few tokens"))).otherwise(
            F.col("pred_masks")
        ),
    )
    cut = checked.withColumn("keep_pred", F.min(_shortest(F.col("pred_masks"))).over(in_batch)).withColumn(
        "keep_enc", F.min(_shortest(F.col("enc_masks"))).over(in_batch)
    )
    return cut.withColumn(
        "pred_masks", F.transform("pred_masks", lambda m: F.slice(m, 1, F.col("keep_pred")))
    ).withColumn("enc_masks", F.transform("enc_masks", lambda m: F.slice(m, 1, F.col("keep_enc"))))


def repeat_interleave(df: DataFrame, ordinal: str, block: int, repeat: int) -> DataFrame:
    """Each run of ``block`` rows (by ordinal) ``repeat`` times in a row."""
    o = F.col(ordinal)
    base = F.floor(o / block).cast("bigint")
    return df.withColumn("__r", F.explode(F.sequence(F.lit(0), F.lit(repeat - 1)))).select(
        *[c for c in df.columns if c != ordinal],
        (base * (block * repeat) + F.col("__r") * block + F.pmod(o, F.lit(block))).alias(ordinal),
    )


def mask_major_order(df: DataFrame, sample: str, target: str, batch_size: int, out: str) -> DataFrame:
    """Ordinal of (sample, target) rows when targets vary slowest."""
    return df.withColumn(out, (F.col(target) * batch_size + F.col(sample)).cast("bigint"))
