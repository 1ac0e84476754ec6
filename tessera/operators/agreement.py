"""Contingency statistics, agreement scores and classification metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranking import bucketed_row_number, fixed_width_bucket

EPS = 1e-12
CODE_BUCKET = 1 << 16


def cell_counts(df: DataFrame, label: str, center: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, label, center).agg(F.count(F.lit(1)).alias("n"))


def contingency(df: DataFrame, label: str = "label", center: str = "medical_center") -> DataFrame:
    """Dense label x centre counts, zeros kept."""
    cells = cell_counts(df, label, center)
    frame = (
        cells.agg(F.collect_set(label).alias("__l"), F.collect_set(center).alias("__c"))
        .select(F.explode("__l").alias(label), "__c")
        .select(label, F.explode("__c").alias(center))
    )
    return frame.join(cells, [label, center], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def cramers_v(cells: DataFrame, label: str, center: str, keys: Sequence[str] = ()) -> DataFrame:
    """Cramer's V per key from counts (columns label, center, n).

    The table is the given labels times the given centres: those that only have zero
    counts enlarge it, and pairs that are not listed count 0. Chi-square sums
    ``(n - e)^2 / e`` over the listed pairs and ``e`` over the others, whose sum is the
    total less the listed expectations. No rows at all give 0.
    """
    row, col, whole = (F.sum("n").over(Window.partitionBy(*keys, *by)) for by in ((label,), (center,), ()))
    expected = F.when(F.col("__all") > 0, F.col("__row") * F.col("__col") / F.col("__all").cast("double")).otherwise(0.0)
    listed = (
        cells.groupBy(*keys, label, center).agg(F.sum("n").alias("n"))
        .withColumns({"__row": row, "__col": col, "__all": whole}).withColumn("__e", expected)
    )
    apart = F.sum(F.when(F.col("__e") > 0, (F.col("n") - F.col("__e")) * (F.col("n") - F.col("__e")) / F.col("__e")).otherwise(0.0))
    unlisted = F.greatest(F.sum("n") - F.sum("__e"), F.lit(0.0))
    degrees = F.greatest(F.least(F.countDistinct(label), F.countDistinct(center)) - 1, F.lit(1))
    chi2_per_n = F.when(F.sum("n") > 0, (apart + unlisted) / F.sum("n")).otherwise(0.0)
    return listed.groupBy(*keys).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sqrt(chi2_per_n / degrees), F.lit(0.0)).alias("cramers_v")
    )


def count_cube(df: DataFrame, axes: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Rows of each combination of the axes, as ``n``. What scores agreement reads the
    rows once, here; all margins are sums over cells."""
    return df.groupBy(*keys, *axes).agg(F.count(F.lit(1)).alias("n"))


def _like_pairs(cells: DataFrame, keys: Sequence[str], alike: dict[str, tuple[str, ...]]) -> DataFrame:
    """Per key: ``total`` rows, and for each name in ``alike`` the number of row pairs
    whose values in those columns are the same.

    All margins come from one aggregation by grouping sets over the cells.
    """
    columns = list(dict.fromkeys(c for by in alike.values() for c in by))
    # Bit of a column in a set's number: set where the column is summed over.
    number = {by: sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in by) for by in (*alike.values(), ())}
    margins = cells.groupingSets([[F.col(c) for c in (*keys, *by)] for by in number], *keys, *columns).agg(
        F.sum("n").cast("double").alias("__n"), F.grouping_id().alias("__set")
    )
    pairs = F.col("__n") * (F.col("__n") - 1) / 2
    return margins.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("__set") == number[()], F.col("__n"))), F.lit(0.0)).alias("total"),
        *[F.sum(F.when(F.col("__set") == number[by], pairs)).alias(name) for name, by in alike.items()],
    )


def _rand_index(both: str, one: str, other: str) -> Column:
    """Adjusted Rand index from pairs alike in both columns, in one and in the other."""
    pairs = F.col("total") * (F.col("total") - 1) / 2
    expected = F.try_divide(F.col(one) * F.col(other), pairs)
    denominator = (F.col(one) + F.col(other)) / 2 - expected
    return F.when((F.col("total") < 2) | (F.abs(denominator) < EPS), F.lit(0.0)).otherwise(
        F.try_divide(F.col(both) - expected, denominator)
    )


def adjusted_rand(df: DataFrame, truth: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """Adjusted Rand index per key; 0 for n < 2 or a degenerate denominator.

    NULL is a class like any other. Without keys an empty table gives one row, 0 of 0.
    """
    named = df.select(*keys, F.col(truth).alias("__t"), F.col(predicted).alias("__p"))
    alike = {"__both": ("__t", "__p"), "__one": ("__t",), "__other": ("__p",)}
    counted = _like_pairs(count_cube(named, ["__t", "__p"], keys), keys, alike)
    return counted.select(*keys, _rand_index("__both", "__one", "__other").alias("ari"), F.col("total").cast("bigint").alias("n"))


def clustering_agreement(
    df: DataFrame,
    cluster: str,
    label: str = "label",
    center: str = "medical_center",
    keys: Sequence[str] = (),
    counted: bool = False,
) -> DataFrame:
    """ARI with the label minus ARI with the centre, from one (label, centre, cluster)
    cube: (keys, ari_label, n, ari_center, score).

    ``df`` holds rows, or, if ``counted``, cells with the number of their rows as ``n``
    (several cells of one combination add up).
    """
    cells = df if counted else count_cube(df, [label, center, cluster], keys)
    alike = {
        "__label": (label,), "__center": (center,), "__cluster": (cluster,),
        "__label_cluster": (label, cluster), "__center_cluster": (center, cluster),
    }
    return _like_pairs(cells, keys, alike).select(
        *keys,
        _rand_index("__label_cluster", "__label", "__cluster").alias("ari_label"),
        F.col("total").cast("bigint").alias("n"),
        _rand_index("__center_cluster", "__center", "__cluster").alias("ari_center"),
    ).withColumn("score", F.col("ari_label") - F.col("ari_center"))


def balanced_accuracy(
    predictions: DataFrame, truth: str, predicted: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Mean recall over the true classes."""
    recall = predictions.groupBy(*keys, truth).agg(
        F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("__recall")
    )
    return recall.groupBy(*keys).agg(F.avg("__recall").alias("balanced_accuracy"))


def first_appearance_codes(df: DataFrame, column: str, order: str, out: str = "code") -> DataFrame:
    """(value, code): 0-based integer codes by first appearance along ``order``."""
    first = df.groupBy(column).agg(F.min(order).alias("__first"))
    bucket = fixed_width_bucket(F.col("__first"), CODE_BUCKET)
    return bucketed_row_number(first, [], ["__first", column], bucket, out).select(column, out)


def sorted_codes(df: DataFrame, column: str, out: str = "code") -> DataFrame:
    """(value, code): 0-based integer codes in sorted order of a string column."""
    values = df.select(column).distinct()
    prefix = F.substring(F.col(column).cast("string"), 1, 4)
    return bucketed_row_number(values, [], [column], prefix, out)


def majority_vote(
    votes: DataFrame, keys: Sequence[str], choice: str, code: str
) -> DataFrame:
    """Most frequent choice per key; ties go to the smallest code."""
    counted = votes.groupBy(*keys, choice, code).agg(F.count(F.lit(1)).alias("__n"))
    best = F.max_by(choice, F.struct(F.col("__n"), -F.col(code)))
    return counted.groupBy(*keys).agg(best.alias("predicted"))


def mean_std(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean, population standard deviation and count."""
    return df.groupBy(*keys).agg(
        F.avg(value).alias("value"),
        F.stddev_pop(value).alias("std"),
        F.count(F.lit(1)).alias("n"),
    )
