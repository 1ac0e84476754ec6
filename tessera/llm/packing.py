"""Best-fit decreasing packing of token sequences into fixed-length rows.

Best-fit decreasing looks at sizes only, and a size is at most the capacity. So the
exact packing of *all* pieces follows from the number of pieces per length: runs of
equal pieces meet runs of equal bins, and a segment tree over the remaining
capacities finds the tightest open bin in logarithmic time. What reaches the driver
is the histogram (at most ``capacity`` rows); what goes back is a list of runs.
Pieces find their bin by their rank among the pieces of the same length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.tasks import arrow_batch, str_texts, worker_store
from tessera.llm.tokens import WordIds
from tessera.session import materialize

CAPACITY = 2048
_RANK_BITS = 44


class TightestFit:
    """Segment tree over capacities 0..n: the smallest open one that is large enough."""

    def __init__(self, largest: int) -> None:
        self.leaves = 1 << largest.bit_length()
        self.open = bytearray(2 * self.leaves)

    def set(self, capacity: int, is_open: bool) -> None:
        node = self.leaves + capacity
        self.open[node] = is_open
        while node > 1:
            node >>= 1
            self.open[node] = self.open[2 * node] | self.open[2 * node + 1]

    def find(self, least: int) -> int | None:
        """Smallest open capacity >= least."""
        node = self.leaves + least
        if self.open[node]:
            return least
        while node > 1:
            if not node & 1 and self.open[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.open[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None


def best_fit_runs(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, first bin, pieces per bin, offset) and the number of bins.

    A run says: pieces of this length, from this rank on, go ``pieces per bin`` at a
    time into consecutive bins, starting at this offset.
    """
    tree = TightestFit(capacity)
    ranges: dict[int, list[tuple[int, int]]] = defaultdict(list)
    runs: list[tuple[int, int, int, int, int]] = []
    bins = 0

    def put(remaining: int, first: int, n: int) -> None:
        if remaining and n:
            ranges[remaining].append((first, n))
            tree.set(remaining, True)

    for size in sorted(histogram, reverse=True):
        left, rank = histogram[size], 0
        while left:
            remaining = tree.find(size)
            if remaining is None:
                fresh = -(-left // (capacity // size))
                put(capacity, bins, fresh)
                bins += fresh
                continue
            first, n = ranges[remaining].pop()
            if not ranges[remaining]:
                tree.set(remaining, False)
            fit = remaining // size
            full = min(n, left // fit)
            if full:
                runs.append((size, rank, first, fit, capacity - remaining))
                put(remaining - fit * size, first, full)
                rank, left = rank + full * fit, left - full * fit
            if n > full and 0 < left < fit:
                runs.append((size, rank, first + full, left, capacity - remaining))
                put(remaining - left * size, first + full, 1)
                full, rank, left = full + 1, rank + left, 0
            put(remaining, first + full, n - full)
    return np.array(sorted(runs), np.int64).reshape(-1, 5), bins


def cut_pieces(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Token ids of every text plus ``end_id``, cut into pieces of at most ``capacity``.

    A row per piece: id, piece, start, length, ids_crc32, and its place among the
    pieces of that length in its task (``part``, ``nth``). Written out once, so that
    the places hold even if a task runs again.
    """
    width = 4 * capacity
    last = np.array([end_id], "<u4").tobytes()
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_column].dataType), T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
        T.StructField("part", T.LongType()), T.StructField("nth", T.LongType()),
    ])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_store(f"words:{tokenizer}", lambda: WordIds(tokenizer))
        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            rows, pieces, starts, lengths, crcs, nths = [], [], [], [], [], []
            for row, ids in enumerate(words.texts(str_texts(batch.column(1)))):
                ids += last
                for piece, at in enumerate(range(0, len(ids), width)):
                    own = ids[at : at + width]
                    size = len(own) // 4
                    rows.append(row), pieces.append(piece), starts.append(at // 4), lengths.append(size)
                    crcs.append(zlib.crc32(own)), nths.append(seen[size])
                    seen[size] += 1
            yield arrow_batch({
                "doc_id": batch.column(0).take(pa.array(rows, pa.int64())), "piece": pa.array(pieces, pa.int32()), "start": pa.array(starts, pa.int64()),
                "length": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64()), "part": pa.array([part] * len(rows), pa.int64()), "nth": pa.array(nths, pa.int64()),
            })

    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return materialize(source.mapInArrow(cut, schema), "pieces")


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset by best-fit decreasing over all pieces."""
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    runs, _ = best_fit_runs(histogram, capacity)
    shared = pieces.sparkSession.sparkContext.broadcast(runs)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ranked_before"))
    schema = T.StructType([
        *(f for f in pieces.schema if f.name not in ("part", "nth")), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
    ])
    kept = [f.name for f in schema][:-2]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        keys = (table[:, 0] << _RANK_BITS) | table[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("nth").to_numpy() + batch.column("ranked_before").to_numpy()
            run = table[np.searchsorted(keys, (length << _RANK_BITS) | rank, "right") - 1]
            after = rank - run[:, 1]
            yield arrow_batch({c: batch.column(c) for c in kept} | {"sequence_id": pa.array(run[:, 2] + after // run[:, 3]), "offset": pa.array(run[:, 4] + after % run[:, 3] * length)})

    return pieces.join(offsets, ["part", "length"]).mapInArrow(place, schema)


def pack(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Result: a row per piece with doc_id, piece, start, length, ids_crc32, sequence_id
    and offset. NULL and empty texts are one piece that holds only ``end_id``. Texts
    longer than the capacity are cut; nothing else is. Rows are packed as they come,
    so a repeated row is packed twice, and a NULL id stays NULL. Pieces of equal
    length are interchangeable. An empty table gives no rows; other columns are
    ignored.
    """
    return place_pieces(cut_pieces(docs, tokenizer, id_column, text_column, capacity, end_id), capacity)
