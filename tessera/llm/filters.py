"""A bit per hash value: a filter of fixed size that says which keys may be in a table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.tasks import arrow_batch

#: 8 MiB, whatever the input; with more keys than it can tell apart it lets more pass.
BITS = 26
_BLOCK = 16


def filter_position(*key: Column, bits: int = BITS) -> Column:
    """Place of a key in the filter; NULL keys have one too."""
    return F.shiftrightunsigned(F.xxhash64(*key), 64 - bits)


def bit_filter(positions: DataFrame, bits: int = BITS) -> np.ndarray:
    """Packed bits of all positions (one long column): at most 2^bits / 8 bytes are collected."""
    blocks = 1 << (bits - _BLOCK)
    tasks = max(1, min(blocks // 16, int(positions.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            block, low = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for b in np.unique(block):
                seen.setdefault(int(b), np.zeros(1 << _BLOCK, bool))[low[block == b]] = True
        for b, own in seen.items():
            yield arrow_batch({"block": pa.array([b], pa.int64()), "bits": pa.array([np.packbits(own).tobytes()], pa.binary())})

    place = F.col(positions.columns[0])
    split = positions.select(F.shiftright(place, _BLOCK).alias("block"), place.bitwiseAND(F.lit((1 << _BLOCK) - 1)).alias("low")).distinct()
    packed = np.zeros((blocks, 1 << (_BLOCK - 3)), np.uint8)
    for row in split.repartition(tasks, "block").mapInArrow(merge, "block long, bits binary").collect():
        packed[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return packed.ravel()


def may_hold(packed: np.ndarray, positions: np.ndarray) -> np.ndarray:
    return ((packed[positions >> 3] >> (7 - (positions & 7)).astype(np.uint8)) & 1).astype(bool)
