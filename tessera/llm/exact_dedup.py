"""Exact deduplication: counting quotient filters first, bytes only for suspects.

Each task folds the fingerprints of its rows into a counting quotient filter: the
quotient (high bits) says where, the sorted remainders (low bits) say which, and a
count goes with each. Filters travel as segments of the quotient range, and segments
of different tasks merge without loss by merging their sorted remainders. Only texts
whose fingerprint was counted more than once are compared, byte by byte.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.tasks import arrow_batch
from tessera.session import materialize

WHITE = " \t\n\x0b\f\r"
QUOTIENT_BITS = 20
REMAINDER_BITS = 32


class QuotientFilter:
    """Sorted (quotient, remainder) slots with counts."""

    def __init__(self, slots: np.ndarray, counts: np.ndarray) -> None:
        self.slots, self.counts = slots, counts

    @classmethod
    def merge(cls, slots: list[np.ndarray], counts: list[np.ndarray]) -> QuotientFilter:
        every, n = np.concatenate(slots), np.concatenate(counts)
        order = np.argsort(every, kind="stable")  # runs are sorted: a merge
        every = every[order]
        first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]][: len(every)])
        return cls(every[first], np.add.reduceat(n[order], first) if len(first) else n)

    @classmethod
    def of(cls, fingerprints: np.ndarray) -> QuotientFilter:
        return cls(*np.unique(fingerprints, return_counts=True))

    def segments(self, quotient_bits: int, remainder_bits: int, segment_bits: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        """(segment, slots per quotient, remainders, counts) of the non-empty segments."""
        shift = quotient_bits + remainder_bits - segment_bits
        segment = self.slots >> shift
        starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]][: len(segment)])
        for start, end in zip(starts, [*starts[1:], len(segment)], strict=False):
            own = self.slots[start:end]
            places, run = np.unique((own >> remainder_bits) & ((1 << (quotient_bits - segment_bits)) - 1), return_counts=True)
            remainders = (own & ((1 << remainder_bits) - 1)).astype(np.uint32)
            yield int(segment[start]), np.stack([places, run]).astype(np.uint32).tobytes(), remainders.tobytes(), self.counts[start:end].astype(np.int64).tobytes()


def read_segment(segment: int, places: bytes, remainders: bytes, counts: bytes, quotient_bits: int, remainder_bits: int, segment_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots and counts of a written segment."""
    where, run = np.frombuffer(places, np.uint32).reshape(2, -1).astype(np.int64)
    quotients = np.repeat(where, run) | (segment << (quotient_bits - segment_bits))
    return (quotients << remainder_bits) | np.frombuffer(remainders, np.uint32).astype(np.int64), np.frombuffer(counts, np.int64)


def repeated_fingerprints(fingerprints: DataFrame, quotient_bits: int = QUOTIENT_BITS, remainder_bits: int = REMAINDER_BITS) -> DataFrame:
    """Fingerprints (one long column, at most quotient + remainder bits) counted more than once."""
    spark = fingerprints.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    segment_bits = min(quotient_bits, max(4, (32 * tasks - 1).bit_length()))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[QuotientFilter] = []
        for batch in batches:
            parts.append(QuotientFilter.of(batch.column(0).to_numpy()))
            if len(parts) == 16:
                parts = [QuotientFilter.merge([p.slots for p in parts], [p.counts for p in parts])]
        if parts:
            whole = QuotientFilter.merge([p.slots for p in parts], [p.counts for p in parts])
            rows = list(zip(*whole.segments(quotient_bits, remainder_bits, segment_bits), strict=True))
            if rows:
                yield arrow_batch({"segment": pa.array(rows[0], pa.int64()), **{n: pa.array(c, pa.binary()) for n, c in zip(("places", "remainders", "counts"), rows[1:], strict=True)}})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots: dict[int, list] = defaultdict(list)
        counts: dict[int, list] = defaultdict(list)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s, c = read_segment(*row, quotient_bits, remainder_bits, segment_bits)
                slots[row[0]].append(s), counts[row[0]].append(c)
        for segment in slots:
            merged = QuotientFilter.merge(slots[segment], counts[segment])
            yield arrow_batch({"fingerprint": pa.array(merged.slots[merged.counts > 1], pa.int64())})

    written = fingerprints.mapInArrow(build, "segment long, places binary, remainders binary, counts binary")
    return written.repartition(tasks, "segment").mapInArrow(merge, "fingerprint long")


def normalised(text: Column) -> Column:
    """The text without ASCII white space; NULL counts as empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), WHITE, "")


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", quotient_bits: int = QUOTIENT_BITS, remainder_bits: int = REMAINDER_BITS, row_column: str | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without ASCII white space; NULL is an
    empty text, and empty texts are equal. The row with the longest original text
    stays, then the one with the smallest id (NULL ids last), then one of the rows
    that repeat it: exactly one row of a group is kept. Without documents there are
    no rows; other columns are ignored. Where ``row_column`` has numbers of the rows,
    the result also has row and keep_row, the number of the row that stays.
    """
    bits = quotient_bits + remainder_bits
    text = F.col(text_column)
    fingerprint = F.shiftrightunsigned(F.xxhash64(normalised(text)), 64 - bits)
    rows = materialize(
        docs.select(
            F.col(id_column).alias("doc_id"),
            F.length(F.coalesce(text.cast("string"), F.lit(""))).cast("long").alias("chars"),
            fingerprint.alias("fingerprint"),
            F.unhex(F.sha2(normalised(text).cast("binary"), 256)).alias("sha"),
            (F.col(row_column) if row_column else F.monotonically_increasing_id()).alias("row"),
        ),
        "fingerprints",
    )
    repeated = materialize(repeated_fingerprints(rows.select("fingerprint"), quotient_bits, remainder_bits), "repeated")
    # Bytes decide: the texts themselves are the grouping key (copies fold before the shuffle).
    suspects = docs.select(fingerprint.alias("fingerprint"), normalised(text).alias("body")).join(repeated, "fingerprint", "left_semi")
    groups = (
        suspects.groupBy("fingerprint", "body").agg(F.count("*").alias("group_size"))
        .where("group_size > 1")
        .select("fingerprint", F.unhex(F.sha2(F.col("body").cast("binary"), 256)).alias("sha"), "group_size")
    )
    groups = materialize(groups, "copies")
    # Folded before the shuffle; written, so that the joins below can be split on a hot group.
    best = F.min(F.struct((-F.col("chars")).alias("shorter"), F.col("doc_id").isNull().alias("unknown"), "doc_id", "row"))
    chosen = rows.groupBy("fingerprint", "sha").agg(best.alias("best")).join(groups, ["fingerprint", "sha"]).select(
        "fingerprint", "sha", F.col("best.doc_id").alias("best_id"), F.col("best.row").alias("best_row"), F.col("group_size").alias("copies")
    )
    chosen = materialize(chosen, "kept-copies")
    grouped = F.col("best_row").isNotNull()
    return rows.join(chosen, ["fingerprint", "sha"], "left").select(
        "doc_id",
        F.when(grouped, F.col("best_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("group_size"),
        F.when(grouped, F.col("best_row") == F.col("row")).otherwise(True).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        *([F.col("row"), F.coalesce("best_row", "row").alias("keep_row")] if row_column else []),
    )
