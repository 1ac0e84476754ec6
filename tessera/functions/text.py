"""Identifier, name and configuration-value functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def trim_columns(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.trim(F.col(n).cast("string")) for n in names})


def path_stem(path: Column) -> Column:
    """File name without directory and last extension."""
    name = F.regexp_extract(path, r"([^/]+)/*$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def sanitize_slide_id(slide_id: Column) -> Column:
    return F.translate(slide_id, "/ ", "__")


def sanitize_token(token: Column) -> Column:
    """Keep ``[A-Za-z0-9._-]``; anything else becomes a single dash."""
    dashed = F.regexp_replace(F.trim(token), r"[^A-Za-z0-9._-]+", "-")
    cleaned = F.regexp_replace(F.regexp_replace(dashed, r"-{2,}", "-"), r"^-+|-+$", "")
    return F.when(cleaned == "", F.lit("x")).otherwise(cleaned)


def display_anchor_name(anchor_id: Column) -> Column:
    """``slide_0000004`` -> ``A005``; ids without a trailing number stay."""
    digits = F.regexp_extract(anchor_id, r"_(\d+)$", 1)
    number = (digits.cast("bigint") + 1).cast("string")
    padded = F.when(F.length(number) >= 3, number).otherwise(F.lpad(number, 3, "0"))
    return F.when(digits != "", F.concat(F.lit("A"), padded)).otherwise(anchor_id)


def output_stem(index: Column, slide_id: Column, anchor_id: Column) -> Column:
    i = index.cast("string")
    padded = F.when(F.length(i) >= 3, i).otherwise(F.lpad(i, 3, "0"))
    return F.concat(
        F.lit("s"),
        padded,
        F.lit("_"),
        sanitize_token(slide_id),
        F.lit("_"),
        sanitize_token(display_anchor_name(anchor_id)),
    )


def stratum_value(metadata: Column, key: str) -> Column:
    return F.coalesce(F.nullif(F.element_at(metadata, key), F.lit("")), F.lit("unknown"))


def metric_key(dataset: Column, metric: Column, rho: Column | None = None) -> Column:
    """``dataset/metric`` or, per correlation level, ``dataset/metric_rho0_14``."""
    base = F.concat_ws("/", dataset, metric)
    if rho is None:
        return base
    return F.concat(base, F.lit("_rho"), F.replace(F.format_string("%.2f", rho), F.lit("."), F.lit("_")))


def parse_levels(text: Column) -> Column:
    """Comma list -> doubles, each in [0, 1]."""
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    levels = F.transform(parts, lambda p: p.cast("double"))
    return F.when(
        (F.size(levels) == 0) | F.exists(levels, lambda v: v.isNull() | (v < 0.0) | (v > 1.0)),
        F.raise_error(F.lit("correlation levels must be numbers in [0, 1]")),
    ).otherwise(levels)


def scaled_cadence(count: Column, fraction: Column, budget: Column) -> Column:
    """Image interval given as a count or as a share of the budget (0 = off)."""
    bad = (count < 0) | (fraction < 0.0) | (fraction > 1.0)
    share = F.when(fraction == 0.0, F.lit(0)).otherwise(
        F.greatest(F.lit(1), F.bround(budget.cast("double") * fraction, 0).cast("bigint"))
    )
    return (
        F.when(bad, F.raise_error(F.lit("cadence must be a count >= 0 or a share in [0, 1]")))
        .when(count.isNotNull(), count.cast("bigint"))
        .otherwise(share.cast("bigint"))
    )


def poll_interval(tune_every: Column, batch: Column) -> Column:
    """Steps between two polls: a twentieth of the tuning interval, at least one."""
    steps = F.bround(tune_every.cast("double") / (batch * 20).cast("double"), 0)
    return F.greatest(F.lit(1), steps.cast("bigint"))


def sanitize_run_id(run_id: Column) -> Column:
    """Trimmed id with runs of other characters replaced; empty is an error."""
    trimmed = F.trim(run_id)
    return F.when(
        F.coalesce(trimmed, F.lit("")) == "", F.raise_error(F.lit("run id is empty"))
    ).otherwise(F.regexp_replace(trimmed, r"[^A-Za-z0-9._-]+", "-"))


def folder_name(value: str | None) -> str:
    """A value as Spark writes it into the name of a partition's folder."""
    if not value:
        return "__HIVE_DEFAULT_PARTITION__"
    return "".join(f"%{ord(c):02X}" if c < " " or c in "\"#%'*/:=?\\\x7f{[]^" else c for c in value)
