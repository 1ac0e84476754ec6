"""Vector, token-list and schedule functions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_EPS = 1e-12


def to_doubles(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def l2_normalize(vector: Column) -> Column:
    """``x / (norm + 1e-12)``."""
    values = to_doubles(vector)
    # Divided where the sum ends: a norm beside the elements would be summed up for each of them.
    scaled = lambda total: F.transform(values, lambda x: x / (F.sqrt(total) + F.lit(NORM_EPS)))
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x * x, scaled)


def mean_pool(tokens: Column) -> Column:
    """Element-wise mean of an array of equally long vectors."""
    count = F.size(tokens).cast("double")
    summed = F.aggregate(
        F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))),
        to_doubles(tokens[0]),
        lambda acc, t: F.zip_with(acc, t, lambda x, y: x + y.cast("double")),
    )
    return F.transform(summed, lambda x: x / count)


def gather_tokens(values: Column, mask: Column) -> Column:
    """Elements of ``values`` at the 0-based ids of ``mask``, in mask order."""
    return F.transform(mask, lambda i: F.element_at(values, (i + 1).cast("int")))


def token_complement(tokens: Column, total) -> Column:
    """Ids 0..total-1 that are not in ``tokens``, ascending."""
    n = total if isinstance(total, Column) else F.lit(int(total))
    return F.array_except(F.sequence(F.lit(0).cast("bigint"), (n - 1).cast("bigint")), tokens)


def threshold_schedule(start: float, floor: float, step: float, policy: str = "lower_threshold") -> Column:
    """Thresholds to try in turn: start, start-step, ... above the floor, then the floor."""
    if policy not in ("skip_anchor", "lower_threshold"):
        raise ValueError(f"unknown insufficient-target policy: {policy!r}")
    if not 0.0 <= floor <= start:
        raise ValueError("floor must lie in [0, start]")
    if step <= 0:
        raise ValueError("step must be > 0")
    s, f, d = F.lit(float(start)), F.lit(float(floor)), F.lit(float(step))
    if policy == "skip_anchor":
        return F.array(s)
    # Number of strictly-above-floor steps; the epsilon absorbs float drift.
    steps = F.ceil((s - f - F.lit(1e-9)) / d).cast("int")
    above = F.when(
        steps > 0, F.transform(F.sequence(F.lit(0), steps - 1), lambda i: F.bround(s - i * d, 6))
    ).otherwise(F.array().cast("array<double>"))
    return F.array_distinct(F.concat(above, F.array(F.bround(f, 6))))
