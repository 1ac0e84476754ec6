"""Integer allocation of a training total over label x centre cells.

All frames here hold one row per cell and key, so windows over a key are short.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranking import _join_on

# The published 2 x 2 tables by correlation level (rows: sorted labels,
# columns: sorted centres), and the datasets they were published for.
TABULATED = {
    0.00: [[2100, 2100], [2100, 2100]],
    0.14: [[1800, 2400], [2400, 1800]],
    0.29: [[1500, 2700], [2700, 1500]],
    0.43: [[1200, 3000], [3000, 1200]],
    0.57: [[900, 3300], [3300, 900]],
    0.71: [[600, 3600], [3600, 600]],
    0.86: [[300, 3900], [3900, 300]],
    1.00: [[0, 4200], [4200, 0]],
}
TABULATED_DATASETS = ("camelyon", "camelyon16", "camelyon17")


def nearest_design(designs: dict[float, list[list[int]]], level: float) -> list[list[int]]:
    """Design of a level; a level that is not tabulated takes the nearest one."""
    return designs[min(designs, key=lambda known: abs(known - level))]


def water_fill(
    cells: DataFrame, keys: Sequence[str], slack: str, amount: str, idx: str, out: str
) -> DataFrame:
    """Units handed out one by one to the cell with most slack left.

    Handing out ``amount`` units by repeated argmax lowers the fullest cells to a
    common level T, the smallest T >= 0 with ``sum(max(0, slack - T)) <= amount``;
    with cells sorted by slack, that is the largest ``ceil((prefix_j - amount) / j)``.
    What remains goes, one unit each, to the first cells still at level T.
    """
    whole = Window.partitionBy(*keys)
    ranked = whole.orderBy(F.col(slack).desc(), F.col(idx))
    prefix = F.sum(slack).over(ranked.rowsBetween(Window.unboundedPreceding, 0))
    needed = F.ceil((prefix - F.col(amount)) / F.row_number().over(ranked)).cast("bigint")
    levelled = (
        cells.withColumn("__t", needed)
        .withColumn("__t", F.greatest(F.lit(0), F.max("__t").over(whole)))
        .withColumn("__take", F.greatest(F.lit(0), F.col(slack) - F.col("__t")))
        .withColumn("__rest", F.col(amount) - F.sum("__take").over(whole))
        .withColumn("__open", (F.col(slack) >= F.col("__t")) & (F.col("__t") >= 1))
    )
    turn = F.row_number().over(whole.orderBy(F.col("__open").desc(), F.col(idx)))
    one_more = F.col("__open") & (turn <= F.col("__rest"))
    given = F.when(F.col(amount) <= 0, F.lit(0)).otherwise(
        F.col("__take") + F.when(one_more, F.lit(1)).otherwise(F.lit(0))
    )
    return levelled.withColumn(out, given.cast("bigint")).drop("__t", "__take", "__rest", "__open")


def largest_remainder(
    cells: DataFrame, keys: Sequence[str], weight: str, total: str, idx: str, out: str
) -> DataFrame:
    """Split ``total`` in proportion to ``weight``: floor everything, then one more
    to the largest fractions (later cell first on a tie, zero weights never)."""
    whole = Window.partitionBy(*keys)
    scaled = F.col(weight) * (F.col(total) / F.sum(weight).over(whole))
    floored = (
        cells.withColumn("__s", F.coalesce(scaled, F.lit(0.0)))
        .withColumn("__f", F.floor("__s").cast("bigint"))
        .withColumn("__left", F.col(total) - F.sum("__f").over(whole))
        .withColumn(
            "__frac", F.when(F.col(weight) == 0, F.lit(-1.0)).otherwise(F.col("__s") - F.col("__f"))
        )
    )
    turn = F.row_number().over(whole.orderBy(F.col("__frac").desc(), F.col(idx).desc()))
    raised = floored.withColumn(
        "__f",
        F.col("__f")
        + F.when((F.col("__frac") >= 0) & (turn <= F.col("__left")), F.lit(1)).otherwise(F.lit(0)),
    ).withColumn("__excess", F.greatest(F.lit(0), -F.col("__left")))
    shaved = water_fill(raised, keys, "__f", "__excess", idx, "__cut")
    return shaved.withColumn(out, F.col("__f") - F.col("__cut")).drop(
        "__s", "__f", "__left", "__frac", "__excess", "__cut"
    )


def max_association(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``assoc``: each label goes to its preferred centre first, then spills.

    ``cells`` needs columns i, j (label and centre index), avail and base. Label i
    prefers centre ``i mod C``; row and column totals and availability cap each
    step. The fold runs inside one row per key, over its label x centre cells.
    """
    whole = Window.partitionBy(*keys)
    sized = cells.withColumn("__rows", F.max("i").over(whole) + 1).withColumn(
        "__cols", F.max("j").over(whole) + 1
    )
    turn = F.when(F.col("j") == F.col("i") % F.col("__cols"), F.lit(-1)).otherwise(F.col("j"))
    steps = F.array_sort(
        F.collect_list(
            F.struct(
                F.col("i").cast("bigint").alias("i"),
                turn.cast("bigint").alias("turn"),
                F.col("j").cast("bigint").alias("j"),
                F.col("avail").cast("double").alias("avail"),
            )
        )
    )
    grouped = sized.groupBy(*keys).agg(
        steps.alias("__steps"),
        F.max("base").alias("__base"),
        F.max("__rows").alias("__rows"),
        F.max("__cols").alias("__cols"),
    )
    row_total = (F.col("__base") * F.col("__cols")).cast("double")
    col_total = (F.col("__base") * F.col("__rows")).cast("double")
    start = F.struct(
        F.lit(-1).cast("bigint").alias("i"),
        F.lit(0.0).alias("row_left"),
        F.array_repeat(col_total, F.col("__cols").cast("int")).alias("col_left"),
        F.array().cast("array<struct<i:bigint,j:bigint,take:double>>").alias("taken"),
    )

    def step(acc, cell):
        row_left = F.when(acc["i"] == cell["i"], acc["row_left"]).otherwise(row_total)
        take = F.greatest(
            F.lit(0.0),
            F.least(
                row_left, F.element_at(acc["col_left"], (cell["j"] + 1).cast("int")), cell["avail"]
            ),
        )
        return F.struct(
            cell["i"].alias("i"),
            (row_left - take).alias("row_left"),
            F.transform(
                acc["col_left"], lambda v, x: F.when(x == cell["j"], v - take).otherwise(v)
            ).alias("col_left"),
            F.concat(
                acc["taken"],
                F.array(F.struct(cell["i"].alias("i"), cell["j"].alias("j"), take.alias("take"))),
            ).alias("taken"),
        )

    folded = grouped.select(
        *keys, F.explode(F.aggregate("__steps", start, step)["taken"]).alias("__t")
    ).select(*keys, F.col("__t.i").alias("i"), F.col("__t.j").alias("j"), F.col("__t.take").alias("assoc"))
    return _join_on(cells, folded, [*keys, "i", "j"])


def _fit(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cap ``want`` by availability and reconcile the total by water filling."""
    whole = Window.partitionBy(*keys)
    capped = (
        cells.withColumn("want", F.least(F.col("want"), F.col("avail")).cast("bigint"))
        .withColumn("__deficit", F.col("target_total") - F.sum("want").over(whole))
        .withColumn("__slack", F.col("avail") - F.col("want"))
    )
    added = water_fill(capped, keys, "__slack", "__deficit", "idx", "__add")
    surplus = added.withColumn("__surplus", F.greatest(F.lit(0), -F.col("__deficit")))
    cut = water_fill(surplus, keys, "want", "__surplus", "idx", "__cut")
    return cut.withColumn("want", F.col("want") + F.col("__add") - F.col("__cut")).drop(
        "__deficit", "__slack", "__add", "__surplus", "__cut"
    )


def custom_allocation(cells: DataFrame, levels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts per (key, level, cell) between uniform and maximal association.

    ``cells``: key columns, label/centre columns, i, j, idx, avail. ``levels``:
    split_id, correlation_level.
    """
    whole = Window.partitionBy(*keys)
    based = cells.withColumn(
        "base", F.greatest(F.lit(1), F.floor(F.min("avail").over(whole) / 2)).cast("bigint")
    ).withColumn("target_total", F.col("base") * F.count(F.lit(1)).over(whole))
    assoc = max_association(based, keys)
    rho = F.col("correlation_level")
    target = (1.0 - rho) * F.col("base") + rho * F.col("assoc")
    spread = _with_levels(assoc, levels).withColumn("want", F.floor(target).cast("bigint"))
    return _fit(spread, [*keys, "split_id"]).drop("base", "assoc")


def tabulated_allocation(
    cells: DataFrame, levels: DataFrame, keys: Sequence[str], designs: dict[float, list[list[int]]]
) -> DataFrame:
    """Counts per (key, level, cell) from tabulated designs scaled to what is there."""
    spark = cells.sparkSession
    balanced = nearest_design(designs, 0.0)
    known = [
        (float(level), i, j, int(n), int(balanced[i][j]))
        for level, table in designs.items()
        for i, row in enumerate(table)
        for j, n in enumerate(row)
    ]
    design = spark.createDataFrame(
        known, "design_level double, i bigint, j bigint, alloc bigint, balanced bigint"
    )
    full = float(sum(sum(row) for row in balanced))
    whole = Window.partitionBy(*keys)
    grid = cells.join(
        design.where(F.col("design_level") == min(designs, key=abs)).select("i", "j", "balanced"),
        ["i", "j"],
    )
    scale = F.min(F.col("avail") / F.nullif(F.col("balanced"), F.lit(0))).over(whole)
    sized = grid.withColumn(
        "target_total",
        F.greatest(
            F.least(F.bround(F.lit(full) * scale, 0).cast("bigint"), F.sum("avail").over(whole)),
            F.count(F.lit(1)).over(whole),
        ),
    ).drop("balanced")
    nearest = F.element_at(
        F.array_sort(
            F.transform(
                F.array(*[F.lit(float(d)) for d in sorted(designs)]),
                lambda d: F.struct(F.abs(d - F.col("correlation_level")).alias("gap"), d.alias("d")),
            )
        ),
        1,
    )["d"]
    spread = _with_levels(sized, levels.withColumn("design_level", nearest)).join(
        design.select("design_level", "i", "j", "alloc"), ["design_level", "i", "j"]
    )
    scaled = largest_remainder(
        spread, [*keys, "split_id"], "alloc", "target_total", "idx", "want"
    )
    return _fit(scaled, [*keys, "split_id"]).drop("design_level", "alloc")


def _with_levels(cells: DataFrame, levels: DataFrame) -> DataFrame:
    """Each cell once per level; the level list is carried as one array literal."""
    rows = levels.collect()  # as many rows as the caller listed levels
    array = F.array(
        *[F.struct(*[F.lit(r[c]).alias(c) for c in levels.columns]) for r in rows]
    )
    return cells.withColumn("__l", F.explode(array)).select(
        *cells.columns, *[F.col(f"__l.{c}").alias(c) for c in levels.columns]
    )
