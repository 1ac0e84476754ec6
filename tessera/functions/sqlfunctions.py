"""Geometry and hashing helpers as temporary SQL functions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFINITIONS = {
    "spacing_to_level0_px": "(size BIGINT, spacing DOUBLE, spacing0 DOUBLE) RETURNS BIGINT "
    "RETURN CAST(bround(size * spacing / spacing0, 0) AS BIGINT)",
    "level0_to_spacing_px": "(size BIGINT, spacing DOUBLE, spacing0 DOUBLE) RETURNS BIGINT "
    "RETURN CAST(bround(size * spacing0 / spacing, 0) AS BIGINT)",
    "snap_to_multiple": "(size BIGINT, patch BIGINT) RETURNS BIGINT RETURN "
    "CASE WHEN greatest(1, size) - greatest(patch, greatest(1, size) DIV patch * patch) "
    "<= greatest(patch, (greatest(1, size) + patch - 1) DIV patch * patch) - greatest(1, size) "
    "THEN greatest(patch, greatest(1, size) DIV patch * patch) "
    "ELSE greatest(patch, (greatest(1, size) + patch - 1) DIV patch * patch) END",
    "hash_u32": "(key STRING) RETURNS BIGINT "
    "RETURN CAST(conv(substring(md5(key), 1, 8), 16, 10) AS BIGINT)",
    "hash_partition": "(key STRING, partitions BIGINT) RETURNS BIGINT "
    "RETURN pmod(CAST(conv(substring(md5(key), 1, 8), 16, 10) AS BIGINT), partitions)",
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    for name, body in DEFINITIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(DEFINITIONS)
