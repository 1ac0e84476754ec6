"""Ranking, running aggregates and exact sampling that survive hot keys.

A plain window over ``partitionBy(key)`` sends all rows of a key to one task.
Everything here works in two levels instead: a *bucket* expression that is
monotone in the requested order splits each key, counts or partial aggregates
per (key, bucket) are summed up over the short bucket list, and only rows of
one bucket ever meet in a window.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.hashing import hash_hex

BUCKET = "__bucket"


def _join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that keeps only the left copy of the keys."""
    renamed = right
    for key in keys:
        renamed = renamed.withColumnRenamed(key, f"__r_{key}")
    condition = reduce(lambda a, b: a & b, [left[key] == renamed[f"__r_{key}"] for key in keys])
    return left.join(renamed, condition, how).drop(*[f"__r_{key}" for key in keys])


def _attach(rows: DataFrame, per_bucket: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join per-(key, bucket) values to the rows they were made from.

    The left join keeps the rows' partitioning, so the window that follows needs
    no further shuffle. Every row finds its bucket unless a key is NULL, which is
    reported instead of dropping the row.
    """
    marked = per_bucket.withColumn("__there", F.lit(True))
    joined = _join_on(rows, marked, [*keys, BUCKET], "left")
    loud = F.when(
        F.col("__there").isNull(), F.raise_error(F.lit("ranking keys and buckets must not be NULL"))
    ).otherwise(F.col(BUCKET))
    return joined.withColumn("__check", loud).where(F.col("__check").isNotNull()).drop(
        "__there", "__check"
    )


def salted_join(
    facts: DataFrame,
    dimension: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    salts: int = 16,
    how: str = "inner",
) -> DataFrame:
    """Inner or left join of a large table to a smaller one on keys that may be hot.

    The smaller side is repeated once per salt and the larger one spread over the
    salts by hash, so no key is tied to one task, and AQE may split what is still too
    large because nothing above relies on this partitioning. The number of salts is
    kept low: where even the repeated side turns out small at run time, AQE makes
    this a broadcast join and the large side is not shuffled at all.
    """
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(salts))
    left = facts.withColumn("__salt", salt)
    right = dimension.withColumn(
        "__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))
    )
    return left.join(right, [*keys, "__salt"], how).drop("__salt")


def spread(df: DataFrame, *keys) -> DataFrame:
    """Hash-partition by ``keys`` into as many tasks as a shuffle has.

    For stages whose cost per byte is far above average: partitions sized by bytes,
    and coalesced by AQE for being small, would leave most cores idle.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _before(keys: Sequence[str], order: Sequence) -> Window:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def bucketed_row_number(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence,
    bucket: Column,
    out: str,
    total: str | None = None,
) -> DataFrame:
    """Dense 0-based position of each row within its key.

    ``bucket`` must be non-decreasing along ``order``. ``total`` optionally
    names a column receiving the number of rows of the key.
    """
    rows = df.withColumn(BUCKET, bucket)
    counts = rows.groupBy(*keys, BUCKET).agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select(
        *keys,
        BUCKET,
        F.coalesce(F.sum("__n").over(_before(keys, [BUCKET])), F.lit(0)).alias("__offset"),
        *([F.sum("__n").over(Window.partitionBy(*keys)).alias(total)] if total else []),
    )
    inside = Window.partitionBy(*keys, BUCKET).orderBy(*order)
    return (
        _attach(rows, offsets, keys)
        .withColumn(out, (F.col("__offset") + F.row_number().over(inside) - 1).cast("bigint"))
        .drop(BUCKET, "__offset")
    )


def fixed_width_bucket(order: Column, width: int) -> Column:
    """Bucket of an integral order column; at most ``width`` distinct values meet."""
    return F.floor(order / F.lit(width)).cast("bigint")


_COMBINE = {
    "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "max": F.greatest,
    "min": F.least,
}
_AGGREGATE = {"sum": F.sum, "max": F.max, "min": F.min}


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence,
    bucket: Column,
    specs: dict[str, tuple[str, str, bool]],
) -> DataFrame:
    """Running aggregates per key.

    ``specs`` maps an output name to ``(function, column, inclusive)`` with
    function in sum/max/min; exclusive results cover the rows strictly before.
    """
    rows = df.withColumn(BUCKET, bucket)
    totals = rows.groupBy(*keys, BUCKET).agg(
        *[_AGGREGATE[fn](column).alias(f"__t_{out}") for out, (fn, column, _) in specs.items()]
    )
    prefix = _before(keys, [BUCKET])
    offsets = totals.select(
        *keys,
        BUCKET,
        *[
            _AGGREGATE[fn](f"__t_{out}").over(prefix).alias(f"__p_{out}")
            for out, (fn, _, _) in specs.items()
        ],
    )
    inside = Window.partitionBy(*keys, BUCKET).orderBy(*order)
    joined = _attach(rows, offsets, keys)
    for out, (fn, column, inclusive) in specs.items():
        frame = inside.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        joined = joined.withColumn(
            out, _COMBINE[fn](F.col(f"__p_{out}"), _AGGREGATE[fn](column).over(frame))
        )
    return joined.drop(BUCKET, *[f"__p_{out}" for out in specs])


def previous_value(
    df: DataFrame, keys: Sequence[str], order: str, bucket: Column, column: str, out: str
) -> DataFrame:
    """``lag(column, 1)`` along ``order`` that also looks into earlier buckets."""
    rows = df.withColumn(BUCKET, bucket)
    lasts = rows.groupBy(*keys, BUCKET).agg(F.max_by(column, order).alias("__last"))
    carried = lasts.select(
        *keys, BUCKET, F.lag("__last").over(Window.partitionBy(*keys).orderBy(BUCKET)).alias("__carry")
    )
    inside = Window.partitionBy(*keys, BUCKET).orderBy(order)
    return (
        _attach(rows, carried, keys)
        .withColumn("__first", F.row_number().over(inside) == 1)
        .withColumn(
            out, F.when(F.col("__first"), F.col("__carry")).otherwise(F.lag(column).over(inside))
        )
        .drop(BUCKET, "__carry", "__first")
    )


def sample_per_cell(
    rows: DataFrame,
    wanted: DataFrame,
    cell: Sequence[str],
    identity: Sequence[str],
    seed_parts: Sequence,
    want: str = "want",
    hex_digits: int = 4,
) -> DataFrame:
    """Exactly ``want`` rows of each cell, drawn without replacement by hash order.

    Only counts per (cell, hash prefix) are aggregated; they give the prefix at
    which a cell is full. Rows below that prefix are taken without a shuffle and
    only rows *of* that prefix are ranked, so a cell holding most of the table
    costs no more than any other. A cell with fewer rows than wanted is an error.
    """
    tagged = rows.withColumn("__h", hash_hex(*seed_parts)).withColumn(
        BUCKET, F.substring("__h", 1, hex_digits)
    )
    counts = tagged.groupBy(*cell, BUCKET).agg(F.count(F.lit(1)).alias("__n"))
    by_cell = Window.partitionBy(*cell)
    filled = counts.select(
        *cell,
        BUCKET,
        "__n",
        F.coalesce(F.sum("__n").over(_before(cell, [BUCKET])), F.lit(0)).alias("__before"),
        F.sum("__n").over(by_cell).alias("__have"),
    )
    request = wanted.select(*cell, F.col(want).cast("bigint").alias("__want")).where("__want > 0")
    checked = _join_on(request, filled, cell, "left").withColumn(
        "__want",
        F.when(
            F.coalesce(F.col("__have"), F.lit(0)) < F.col("__want"),
            F.raise_error(F.lit("not enough rows in a cell to sample from")),
        ).otherwise(F.col("__want")),
    )
    cutoffs = checked.where(
        (F.col("__before") < F.col("__want")) & (F.col("__want") <= F.col("__before") + F.col("__n"))
    ).select(
        *cell,
        F.col(BUCKET).alias("__cut"),
        (F.col("__want") - F.col("__before")).alias("__need"),
    )
    candidates = salted_join(tagged, cutoffs, cell, [BUCKET])
    inside = candidates.where(F.col(BUCKET) < F.col("__cut"))
    edge_order = Window.partitionBy(*cell, BUCKET).orderBy("__h", *identity)
    edge = (
        candidates.where(F.col(BUCKET) == F.col("__cut"))
        .withColumn("__rank", F.row_number().over(edge_order))
        .where("__rank <= __need")
        .drop("__rank")
    )
    return inside.unionByName(edge).drop("__h", BUCKET, "__cut", "__need")


def lookup_interval(
    points: DataFrame,
    point: str,
    intervals: DataFrame,
    low: str,
    high: str,
    width: float | Column,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Join each point to the interval ``[low, high)`` holding it.

    Intervals are spread over the bins they touch, which turns the range condition into
    an equi-join. The width of the bins should be about that of the intervals, so that
    few of either meet; a column that is one of the keys gives each key its own.
    """
    width = width if isinstance(width, Column) else F.lit(width)
    lo_bin = F.floor(F.col(low) / width).cast("bigint")
    hi_bin = F.greatest(lo_bin, (F.ceil(F.col(high) / width) - 1).cast("bigint"))
    spread = intervals.where(F.col(high) > F.col(low)).withColumn(
        "__bin", F.explode(F.sequence(lo_bin, hi_bin))
    )
    binned = points.withColumn("__bin", F.floor(F.col(point) / width).cast("bigint"))
    joined = _join_on(binned, spread, [*keys, "__bin"])
    return joined.where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("__bin")
