"""Average performance drop over splits of growing correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = 1e-12


def drop_by_rep(accuracy: DataFrame) -> DataFrame:
    """Signed mean relative change against the balanced split 1, per repetition
    and side. Without split 1 a repetition is an error; without others it is 0."""
    columns = []
    for side in ("id", "ood"):
        base = F.max(F.when(F.col("split_id") == 1, F.col(f"acc_{side}")))
        columns.append(base.alias(f"base_{side}"))
        columns.append(F.avg(F.when(F.col("split_id") != 1, F.col(f"acc_{side}"))).alias(f"mean_{side}"))
    grouped = accuracy.groupBy("rep").agg(*columns)

    def change(side: str):
        base, mean = F.col(f"base_{side}"), F.col(f"mean_{side}")
        return (
            F.when(base.isNull(), F.raise_error(F.lit("balanced split 1 is missing")))
            .when(mean.isNull(), F.lit(0.0))
            .otherwise((mean - base) / F.greatest(base, F.lit(EPS)))
        )

    return grouped.select(
        "rep", change("id").alias("apd_id"), change("ood").alias("apd_ood")
    ).withColumn("apd_avg", (F.col("apd_id") + F.col("apd_ood")) / 2)


def average_performance_drop(accuracy: DataFrame) -> DataFrame:
    """Mean and population deviation over repetitions: one row per side."""
    rows = drop_by_rep(accuracy).select(
        F.explode(
            F.array(
                *[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v"))
                  for m in ("apd_id", "apd_ood", "apd_avg")]
            )
        ).alias("e")
    )
    return rows.groupBy(F.col("e.metric").alias("metric")).agg(
        F.avg("e.v").alias("value"), F.stddev_pop("e.v").alias("std"), F.count(F.lit(1)).alias("n")
    )


def accuracy_by_rho(accuracy: DataFrame) -> DataFrame:
    """Mean accuracy and population deviation per correlation level and side."""
    return accuracy.groupBy("correlation_level").agg(
        *[
            stat(f"acc_{side}").alias(f"{name}_{side}")
            for side in ("id", "ood")
            for name, stat in (("mean", F.avg), ("std", F.stddev_pop))
        ]
    )
