"""Seeded hashing: the only source of randomness in the package.

A draw is a pure function of ``(seed, key, ...)``, so it does not depend on
partitioning, task retries or executor loss, and any SQL engine with ``md5``
reproduces it.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

UINT32_RANGE = 4294967296.0


def _part(value) -> Column:
    return value.cast("string") if isinstance(value, Column) else F.lit(str(value))


def hash_hex(*parts) -> Column:
    """md5 of the parts joined by ``|``, as 32 hex digits. Parts must not be NULL."""
    return F.md5(F.concat_ws("|", *[_part(p) for p in parts]))


def hex_to_long(hex_digits: Column) -> Column:
    return F.conv(hex_digits, 16, 10).cast("bigint")


def hash_u32(*parts) -> Column:
    """First 32 bits of the hash as a non-negative bigint."""
    return hex_to_long(F.substring(hash_hex(*parts), 1, 8))


def hash_unit(*parts) -> Column:
    """Uniform double in [0, 1)."""
    return hash_u32(*parts) / F.lit(UINT32_RANGE)


def hash_partition(key, partitions: int) -> Column:
    """Stable partition id in [0, partitions)."""
    if partitions <= 0:
        raise ValueError("partitions must be > 0")
    return F.pmod(hash_u32(key), F.lit(int(partitions)))


def blake_partition(key, partitions: int, digest_bytes: int = 8) -> Column:
    """Partition id from a little-endian BLAKE2b digest, for sites that already
    store partitions computed that way. Spark has no BLAKE2b expression, so
    this one function costs an Arrow batch transfer.
    """
    if partitions <= 0:
        raise ValueError("partitions must be > 0")

    @F.pandas_udf("bigint")
    def digest(values: pd.Series) -> pd.Series:
        return values.map(
            lambda v: int.from_bytes(
                hashlib.blake2b(str(v).encode("utf-8"), digest_size=digest_bytes).digest(), "little"
            )
            % partitions
        )

    return digest(key)
