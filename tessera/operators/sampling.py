"""Stratified, weighted, cyclic draws from an anchor catalog.

The draw sequence is a table: each draw gets its stratum from a seeded uniform,
its visit number within the stratum, and from that the position in the current
shuffled cycle. Positions are resolved through shard row counts, so the catalog
itself is never sorted or ranked - it is joined once, on (shard, row).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.hashing import hash_hex, hash_partition, hash_unit
from tessera.operators.ranking import (
    _join_on,
    bucketed_row_number,
    fixed_width_bucket,
    lookup_interval,
    running,
)

DRAW_BUCKET = 1 << 16
UNIT_BINS = 4096
WORD_BITS = 32
ORDER_DIGITS = 3
ALL_STRATA = "__all__"


#: Weight of a stratum from its number of anchors, by the name of the rule.
WEIGHT_RULES = {
    "uniform": lambda anchors: F.lit(1.0),
    "inverse_frequency": lambda anchors: 1.0 / F.greatest(F.lit(1), anchors).cast("double"),
}


def raw_weight(weights: str | Mapping[str, float]) -> Column:
    """Unnormalised weight of a row (stratum_id, anchors).

    Given is the name of a rule, a map from stratum to weight, or such a map as a JSON
    object. A stratum that a map lacks weighs 0; a negative weight and anything else
    that is given are errors.
    """
    if isinstance(weights, str):
        rule = WEIGHT_RULES.get(weights.strip().lower())
        if rule is not None:
            return rule(F.col("anchors"))
        if not weights.lstrip().startswith("{"):
            raise ValueError(f"{weights!r} is no rule; there are {sorted(WEIGHT_RULES)}, and maps")
        table = F.from_json(F.lit(weights), "map<string,double>", {"mode": "FAILFAST"})
    elif isinstance(weights, Mapping):
        if min(weights.values(), default=0) < 0:
            raise ValueError(f"negative weights: {dict(weights)}")
        table = F.map_from_entries(F.array(*[F.struct(F.lit(str(k)), F.lit(float(v))) for k, v in weights.items()]))
        table = table if weights else F.create_map().cast("map<string,double>")
    else:
        raise ValueError(f"weights are a rule or a map, not {type(weights).__name__}")
    weight = F.coalesce(F.element_at(table, F.col("stratum_id")), F.lit(0.0))
    complain = F.raise_error(F.concat(F.lit("negative weight of stratum "), F.col("stratum_id"))).cast("double")
    return F.when(weight < 0, complain).otherwise(weight)


def stratum_weights(counts: DataFrame, weights="inverse_frequency") -> DataFrame:
    """Normalised weight per stratum from (stratum_id, anchors).

    A stratum missing from a map weighs 0; negative weights are an error; if
    nothing has weight, all strata weigh the same.
    """
    raw = raw_weight(weights)
    everything = Window.partitionBy()
    weighted = counts.withColumn("__raw", raw).withColumn("__sum", F.sum("__raw").over(everything))
    share = F.when(F.col("__sum") > 0, F.col("__raw") / F.col("__sum")).otherwise(
        1.0 / F.count(F.lit(1)).over(everything)
    )
    return weighted.withColumn("weight", share).drop("__raw", "__sum")


def stratum_counts(anchors: DataFrame, strategy: str = "stratified") -> DataFrame:
    if strategy not in ("stratified", "global_uniform"):
        raise ValueError(f"unknown sampling strategy: {strategy!r}")
    if strategy == "global_uniform":
        return anchors.agg(F.count(F.lit(1)).alias("anchors")).select(
            F.lit(ALL_STRATA).alias("stratum_id"), "anchors"
        )
    return anchors.groupBy("stratum_id").agg(F.count(F.lit(1)).alias("anchors"))


def draw_range(spark: SparkSession, draws: int, partitions: int = 1) -> DataFrame:
    """``draws`` draws for each of ``partitions`` readers."""
    flat = spark.range(draws * partitions)
    return flat.select(
        (F.col("id") % partitions).alias("partition"),
        F.floor(F.col("id") / partitions).cast("bigint").alias("draw_idx"),
    )


def partitioned_anchors(anchors: DataFrame, partitions: int) -> DataFrame:
    """Reader partition of each anchor and its row within (shard, partition).

    A shard has at most ``rows_per_shard`` rows, which bounds the window.
    """
    keyed = anchors.withColumn(
        "shard_key", F.concat_ws("#", "slide_id", F.col("shard_index").cast("string"))
    )
    if partitions == 1:
        return keyed.withColumn("partition", F.lit(0).cast("bigint")).withColumn(
            "unit_row", F.col("row_in_shard")
        )
    within = Window.partitionBy("shard_key", "partition").orderBy("row_in_shard")
    return keyed.withColumn("partition", hash_partition(F.col("anchor_id"), partitions)).withColumn(
        "unit_row", (F.row_number().over(within) - 1).cast("bigint")
    )


def sample_anchors(
    anchors: DataFrame,
    draws: DataFrame,
    seed: int = 0,
    pass_index: int = 0,
    partitions: int = 1,
    weights="inverse_frequency",
    strategy: str = "stratified",
) -> DataFrame:
    """One anchor per draw.

    ``anchors`` needs shard_index and row_in_shard (see ``with_shards``), ``draws``
    (partition, draw_idx). Per reader and stratum anchors come in cycles; every
    cycle visits each anchor once, shards in a new order, rows in shard order.
    Strata without anchors in a reader's partition are left out of its weights.
    """
    placed = partitioned_anchors(anchors.where("anchor_id <> ''"), partitions)
    if strategy == "global_uniform":
        placed = placed.withColumn("draw_stratum", F.lit(ALL_STRATA))
    else:
        placed = placed.withColumn("draw_stratum", F.col("stratum_id"))
    shards = placed.groupBy("partition", "draw_stratum", "shard_key").agg(
        F.count(F.lit(1)).alias("rows")
    )
    # As many positions as a shard has rows on average make a bin of the lookup below.
    mean = F.ceil(F.sum("rows") / F.count(F.lit(1)))
    totals = shards.groupBy("partition", "draw_stratum").agg(F.sum("rows").alias("total"), mean.alias("width"))
    by_stratum = totals.groupBy(F.col("draw_stratum").alias("stratum_id")).agg(
        F.sum("total").alias("anchors")
    )
    weighted = stratum_weights(by_stratum, weights).select(
        F.col("stratum_id").alias("draw_stratum"), "weight"
    )
    reader = Window.partitionBy("partition")
    in_order = reader.orderBy("draw_stratum")
    local = totals.join(weighted, "draw_stratum").withColumn(
        "share",
        F.when(F.sum("weight").over(reader) > 0, F.col("weight") / F.sum("weight").over(reader))
        .otherwise(1.0 / F.count(F.lit(1)).over(reader)),
    )
    cumulative = F.sum("share").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    is_last = F.row_number().over(in_order) == F.count(F.lit(1)).over(reader)
    bounds = (
        local.withColumn("__cum", cumulative)
        .withColumn("__hi", F.when(is_last, F.lit(1.0)).otherwise(F.col("__cum")))
        .withColumn("__lo", F.coalesce(F.lag("__cum").over(in_order), F.lit(0.0)))
        .select("partition", "draw_stratum", "total", "width", "__lo", "__hi")
    )
    uniform = draws.withColumn("__u", hash_unit(seed, pass_index, F.col("partition"), F.col("draw_idx")))
    chosen = lookup_interval(
        uniform, "__u", bounds, "__lo", "__hi", 1.0 / UNIT_BINS, ["partition"]
    ).select("partition", "draw_idx", "draw_stratum", "total", "width")
    visited = bucketed_row_number(
        chosen,
        ["partition", "draw_stratum"],
        ["draw_idx"],
        fixed_width_bucket(F.col("draw_idx"), DRAW_BUCKET),
        "visit",
    )
    cycled = visited.withColumn("cycle", F.floor(F.col("visit") / F.col("total")).cast("bigint"))
    cycled = cycled.withColumn("pos", F.col("visit") - F.col("cycle") * F.col("total"))
    depth = cycled.groupBy("partition", "draw_stratum", "width").agg(F.max("cycle").alias("__last"))
    order = shuffled_shards(
        shards.join(depth, ["partition", "draw_stratum"]).withColumn(
            "cycle", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__last")))
        ),
        seed,
        pass_index,
    )
    located = lookup_interval(
        cycled,
        "pos",
        order,
        "shard_lo",
        "shard_hi",
        F.col("width"),
        ["partition", "draw_stratum", "cycle", "width"],
    ).withColumn("unit_row", F.col("pos") - F.col("shard_lo"))
    return _join_on(
        placed,
        located.select("partition", "draw_stratum", "shard_key", "unit_row", "draw_idx", "visit", "cycle"),
        ["partition", "draw_stratum", "shard_key", "unit_row"],
    ).drop("draw_stratum", "unit_row")


def shuffled_shards(shards: DataFrame, seed: int, pass_index: int) -> DataFrame:
    """Row range [shard_lo, shard_hi) of each shard in the shuffled order of its
    cycle. Rows: (partition, draw_stratum, cycle, shard_key, rows); other columns stay.

    The order is that of a hash, so its first digits split a cycle evenly: shards of one
    prefix are added up in a window, prefixes over their totals (at most 16^3 of them).
    A finished cycle has a draw for every row of every shard, so the rows here are fewer
    than the draws but for the last cycle.
    """
    key = hash_hex(seed, pass_index, F.col("partition"), F.col("cycle"), F.col("shard_key"))
    hashed = shards.withColumn("__h", key)
    placed = running(
        hashed,
        ["partition", "draw_stratum", "cycle"],
        ["__h", "shard_key"],
        F.substring("__h", 1, ORDER_DIGITS),
        {"shard_hi": ("sum", "rows", True)},
    )
    return placed.withColumn("shard_lo", F.col("shard_hi") - F.col("rows")).drop("__h", "rows")


def anchor_by_index(
    anchors: DataFrame, requests: DataFrame, usable: str, order: str = "position"
) -> DataFrame:
    """For each requested index the first usable anchor at or after index mod n,
    wrapping around. ``order`` numbers the anchors 0..n-1; no usable anchor at all
    is an error. A request looks up one word of 32 positions (see ``usable_words``),
    and the anchors are joined to the answers only.
    """
    stats = anchors.agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(F.col(usable), F.col(order))).alias("first")
    ).first()
    if not stats["n"] or stats["first"] is None:
        raise ValueError("no anchor can be sampled")
    n, first = int(stats["n"]), int(stats["first"])
    start = F.pmod(F.col("index"), F.lit(n))
    asked = requests.withColumn("__start", start).withColumn("__word", F.floor(F.col("__start") / WORD_BITS).cast("bigint"))
    # Bits before the start are cleared; what is left holds the answer, or a later word does.
    low = F.col("__start") - F.col("__word") * WORD_BITS
    rest = F.col("__bits").bitwiseAND(F.lit(1 << WORD_BITS) - _power(low))
    target = F.when(rest != 0, F.col("__word") * WORD_BITS + _lowest_bit(rest)).otherwise(F.coalesce("__later", F.lit(first)))
    found = asked.join(usable_words(anchors, usable, order), "__word").withColumn("__target", target)
    return found.join(anchors, F.col("__target") == F.col(order)).drop("__start", "__word", "__bits", "__later", "__target")


def _power(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.cast("int"))


def _lowest_bit(word: Column) -> Column:
    """Place of the lowest set bit of a positive number: the bits below it are those
    that are set in the number less one and not in the number."""
    return F.bit_count((word - 1).bitwiseAND(F.bitwise_not(word)))


def usable_words(anchors: DataFrame, usable: str, order: str) -> DataFrame:
    """Successor structure over the positions: (__word, __bits, __later).

    A word is a run of 32 positions with a bit for each usable one; ``__later`` is the
    first usable position behind the word, NULL if there is none. The catalog is
    aggregated once, map-side; everything else sees a thirty-second of its rows.
    """
    word = F.floor(F.col(order) / WORD_BITS).cast("bigint")
    bit = F.when(F.col(usable), _power(F.col(order) - word * WORD_BITS)).otherwise(F.lit(0).cast("bigint"))
    words = anchors.groupBy(word.alias("__word")).agg(F.bit_or(bit).alias("__bits"))
    first = F.when(F.col("__bits") != 0, F.col("__word") * WORD_BITS + _lowest_bit(F.col("__bits")))
    backwards = words.withColumns({"__first": first, "__rev": -F.col("__word")})
    bucket = fixed_width_bucket(F.col("__rev"), DRAW_BUCKET)
    return running(backwards, [], ["__rev"], bucket, {"__later": ("min", "__first", False)}).select("__word", "__bits", "__later")
