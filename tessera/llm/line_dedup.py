"""Dropping lines that many documents share.

Two Bloom filters, for keys seen once and for keys seen twice, are built per task and
merged. Only lines that may have been seen twice are shuffled, for exact counting and
to choose the document that keeps them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.tasks import arrow_batch, byte_texts
from tessera.session import materialize

MIN_CHARS, MIN_DOCS = 20, 3
#: Bits of each filter (8 MiB); the size of what is collected and broadcast. With more
#: keys than it can tell apart more lines are shuffled, and results stay the same.
FILTER_BITS = 26
_BLOCK = 16  # bits of a position inside a filter block


def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return line.strip().lower()


def counted(key: bytes, least: int) -> bool:
    """Has at least ``least`` code points."""
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The two filter positions of each 64-bit hash."""
    return np.stack([hashes >> np.uint64(64 - bits), hashes & np.uint64((1 << bits) - 1)]).astype(np.int64)


class SeenFilters:
    """Once-seen (1) and twice-seen (2) flags at each filter position."""

    def __init__(self, bits: int) -> None:
        self.bits, self.flags = bits, np.zeros(1 << bits, np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        hashes, n = np.unique(hashes, return_counts=True)
        at = _positions(hashes, self.bits)
        again = (self.flags[at[0]] & self.flags[at[1]] & 1).astype(bool) | (n > 1)
        self.flags[at.ravel()] |= 1
        self.flags[at[:, again].ravel()] |= 2

    def blocks(self) -> Iterator[tuple[int, bytes, bytes]]:
        """(block, positions seen, positions seen twice) of the blocks in use."""
        set_at = np.flatnonzero(self.flags)
        block = set_at >> _BLOCK
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]][: len(block)])
        for start, end in zip(starts, [*starts[1:], len(block)], strict=False):
            own = set_at[start:end]
            low = (own & ((1 << _BLOCK) - 1)).astype(np.uint16)
            yield int(block[start]), low.tobytes(), low[self.flags[own] > 1].tobytes()


def twice_seen(docs: DataFrame, bits: int, min_chars: int) -> np.ndarray:
    """The merged twice-seen filter, packed: 2^bits / 8 bytes, whatever the input.

    A position counts as seen twice if some task saw it twice or two tasks saw it.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = SeenFilters(bits)
        for batch in batches:
            hashes: list[int] = []
            for text in byte_texts(batch.column(0)):
                hashes += map(xxhash.xxh3_64_intdigest, {k for k in map(line_key, text.split(b"\n")) if counted(k, min_chars)})
            seen.add(np.array(hashes, np.uint64))
        rows = list(zip(*seen.blocks(), strict=True))
        if rows:
            yield arrow_batch({"block": pa.array(rows[0], pa.int64()), "once": pa.array(rows[1], pa.binary()), "twice": pa.array(rows[2], pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, once, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = flags.setdefault(block, np.zeros(1 << _BLOCK, np.uint8))
                at = np.frombuffer(once, np.uint16)
                own[at] |= (own[at] & 1) << 1 | 1
                own[np.frombuffer(twice, np.uint16)] |= 2
        for block, own in flags.items():
            yield arrow_batch({"block": pa.array([block], pa.int64()), "bits": pa.array([np.packbits(own > 1).tobytes()], pa.binary())})

    blocks = 1 << (bits - _BLOCK)
    tasks = min(blocks // 16, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    built = docs.mapInArrow(build, "block long, once binary, twice binary")
    merged = built.repartition(max(1, tasks), "block").mapInArrow(merge, "block long, bits binary")
    packed = np.zeros((blocks, 1 << (_BLOCK - 3)), np.uint8)
    for row in merged.collect():  # at most 2^bits / 8 bytes
        packed[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return packed.ravel()


def drop_repeated_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, bits: int = FILTER_BITS) -> DataFrame:
    """Split texts at \\n and drop lines whose key many documents hold.

    A key of at least ``min_chars`` code points that is in at least ``min_docs``
    documents loses all its lines except in the largest id that holds it. Result, a
    row per document: doc_id, n_lines, n_dropped, kept_text (NULL where nothing was
    dropped: the text is as it was), kept_sha256. NULL and empty texts are one empty
    line. Rows that repeat an id count as one document, and with the id that keeps a
    line all keep it; each row with a NULL id counts as a document, and a NULL id is
    smaller than any other. No rows give no rows; other columns are ignored.
    """
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(twice_seen(source.select("text"), bits, min_chars))
    id_field = T.StructField("doc_id", source.schema["doc_id"].dataType)
    lines_schema = T.StructType([
        T.StructField("row", T.LongType()), id_field, T.StructField("n_lines", T.LongType()), T.StructField("sha", T.StringType()),
        T.StructField("text", T.BinaryType()), T.StructField("suspects", T.ArrayType(T.BinaryType())),
    ])

    def suspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, row = shared.value, TaskContext.get().partitionId() << 40

        def repeated(keys: list[bytes]) -> np.ndarray:
            at = _positions(np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys)), bits)
            return ((packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0)

        for batch in batches:
            texts = byte_texts(batch.column(1))
            keys: list[bytes] = []
            ends, n_lines = [], []
            for text in texts:
                lines = text.split(b"\n")
                keys += dict.fromkeys(k for k in map(line_key, lines) if counted(k, min_chars))
                ends.append(len(keys)), n_lines.append(len(lines))
            marks = repeated(keys)
            found = [[keys[k] for k in np.flatnonzero(marks[a:b]) + a] for a, b in zip([0, *ends], ends, strict=False)]
            yield arrow_batch({
                "row": pa.array(range(row, row + len(texts)), pa.int64()), "doc_id": batch.column(0), "n_lines": pa.array(n_lines, pa.int64()),
                "sha": pa.array([hashlib.sha256(t).hexdigest() for t in texts]), "text": pa.array([t if f else None for t, f in zip(texts, found, strict=True)], pa.binary()), "suspects": pa.array(found, pa.list_(pa.binary())),
            })
            row += len(texts)

    lines = materialize(source.mapInArrow(suspect, lines_schema), "suspect_lines")
    suspects = lines.select("row", "doc_id", F.explode("suspects").alias("key"))
    # Rows of one id are one document; each row without an id is one of its own.
    holders = suspects.select("key", "doc_id", F.when(F.col("doc_id").isNull(), F.col("row")).alias("nameless")).distinct()
    shared_keys = holders.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs).select("key", "keeper")
    shared_keys = materialize(shared_keys, "shared-lines")  # a join of two plain shuffles can be split on a hot key
    drops = suspects.join(shared_keys, "key").where(~F.col("doc_id").eqNullSafe(F.col("keeper"))).groupBy("row").agg(F.collect_list("key").alias("keys"))

    def rejoin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_dropped, kept = [], []
            for text, keys in zip(batch.column("text").to_pylist(), batch.column("keys").to_pylist(), strict=True):
                gone, lines = set(keys), text.split(b"\n")
                rest = [line for line in lines if line_key(line) not in gone]
                n_dropped.append(len(lines) - len(rest)), kept.append(b"\n".join(rest))
            yield arrow_batch({"row": batch.column("row"), "n_dropped": pa.array(n_dropped, pa.int64()), "kept_text": pa.array([k.decode() for k in kept]), "kept_sha": pa.array([hashlib.sha256(k).hexdigest() for k in kept])})

    changed = lines.select("row", "text").join(drops, "row").mapInArrow(rejoin, "row long, n_dropped long, kept_text string, kept_sha string")
    return lines.select("row", "doc_id", "n_lines", "sha").join(changed, "row", "left").select(
        "doc_id", "n_lines", F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), "kept_text", F.coalesce("kept_sha", "sha").alias("kept_sha256")
    )
