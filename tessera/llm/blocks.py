"""Per-document work on distinct strings without shuffling documents or occurrences.

Tasks turn runs of documents ("blocks" of bounded text) into a vocabulary of distinct
units and, for each document, places in it. Only vocabularies are shuffled, packed in
groups of units with equal beginnings: equal units of all blocks meet in one task, in
sorted order, get their value once, and go back to their blocks as packed tables.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tasks import arrow_batch, str_texts
from tessera.session import scratch_dir

#: Characters of a block; a longer text is a block of its own.
BLOCK_CHARS = 24_000_000
_TASK_BLOCK_BITS = 32
#: Units whose first characters are equal are in one group.
PREFIX = 6

_GROUPS = pa.list_(pa.struct([("part", pa.int32()), ("n", pa.int32()), ("lengths", pa.binary()), ("size", pa.int64()), ("units", pa.binary()), ("places", pa.binary())]))


def _squeeze(data: bytes) -> bytes:
    return pa.Codec("zstd", compression_level=9).compress(data, asbytes=True)


def _planes(numbers: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of uint32 numbers, first all lowest ones and so on."""
    return numbers.view(np.uint8).reshape(-1, 4).T[:width].tobytes()


def pack(numbers: np.ndarray) -> bytes:
    """uint32 numbers, compressed: how many bytes each needs (1, 2 or 4), then the bytes
    of those that need the same number, plane by plane."""
    numbers = np.asarray(numbers).astype("<u4")
    if not len(numbers):
        return b""
    kind = (numbers > 0xFF).astype(np.uint8) + (numbers > 0xFFFF)
    plain = kind.tobytes() + b"".join(_planes(numbers[kind == k], 1 << k) for k in range(3))
    return len(plain).to_bytes(8, "little") + _squeeze(plain)


def unpack(packed: bytes, n: int) -> np.ndarray:
    if not n:
        return np.empty(0, np.uint32)
    plain = np.frombuffer(pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd", asbytes=True), np.uint8)
    kind, at, out = plain[:n], n, np.zeros((n, 4), np.uint8)
    for k in range(3):
        own = np.flatnonzero(kind == k)
        for byte in range(1 << k):
            out[own, byte] = plain[at : at + len(own)]
            at += len(own)
    return out.view("<u4").ravel()


def write_blocks(docs: DataFrame, id_column: str, text_column: str, cut: Callable[[], Callable[[str], list[str]]], note: Callable[[list[str], dict[str, int]], tuple[np.ndarray, np.ndarray]], block_chars: int) -> DataFrame:
    """Written table: block, ids, n_bytes, sizes, first, second, groups; a row per block.

    ``cut()`` gives the function that cuts a text into units; ``note(units, known)``
    adds new units to the vocabulary and turns a document into two arrays of numbers,
    ``sizes`` being the lengths of the first. A group is (part, n, lengths, units, places).
    """
    parts = 2 * _tasks(docs)
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units_of, number = cut(), TaskContext.get().partitionId() << _TASK_BLOCK_BITS
        known: dict[str, int] = {}
        rows, first, second, sizes, n_bytes, chars = [], [], [], [], [], 0

        def groups() -> list[dict]:
            units = list(known)
            order = np.array(sorted(range(len(units)), key=units.__getitem__), np.int64)
            part = np.array([zlib.crc32(units[k][:PREFIX].encode()) % parts for k in order], np.int64)
            regrouped = np.argsort(part, kind="stable")
            order, part = order[regrouped], part[regrouped]
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]][: len(part)])
            out = []
            for a, b in zip(starts, [*starts[1:], len(part)], strict=False):
                own = [units[k].encode() for k in order[a:b]]
                out.append({"part": int(part[a]), "n": len(own), "lengths": pack(np.array([len(u) for u in own])), "size": sum(map(len, own)), "units": _squeeze(b"".join(own)), "places": pack(order[a:b])})
            return out

        def block() -> pa.RecordBatch:
            ids, one = pa.concat_arrays(rows), lambda values: pa.array([values], pa.list_(pa.int64()))
            return arrow_batch({
                "block": pa.array([number], pa.int64()), "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), "n_bytes": one(n_bytes), "sizes": one(sizes),
                "first": pa.array([pack(np.concatenate(first))], pa.binary()), "second": pa.array([pack(np.concatenate(second))], pa.binary()), "groups": pa.array([groups()], _GROUPS),
            })

        for batch in batches:
            begin = 0
            for row, text in enumerate(str_texts(batch.column(1))):
                if sizes and chars + len(text) > block_chars:
                    rows.append(batch.column(0)[begin:row])
                    yield block()
                    known, number, begin = {}, number + 1, row
                    rows, first, second, sizes, n_bytes, chars = [], [], [], [], [], 0
                a, b = note(units_of(text), known)
                first.append(a), second.append(b), sizes.append(len(a)), n_bytes.append(len(text.encode()))
                chars += len(text)
            rows.append(batch.column(0)[begin:])
        if sizes:
            yield block()

    schema = f"block long, ids array<{kind}>, n_bytes array<long>, sizes array<long>, first binary, second binary, groups array<struct<part:int,n:int,lengths:binary,size:long,units:binary,places:binary>>"
    path = scratch_dir(docs.sparkSession, "blocks")
    source.mapInArrow(gather, schema).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def with_values(blocks: DataFrame, value: Callable[[], Callable[[list[str]], Iterable[bytes]]]) -> DataFrame:
    """Blocks with ``tables``: packed (n, places, lengths, n_values, values) of their units.

    ``value()`` gives the function from units to values (uint32 numbers as bytes). It
    gets the units of one part at a time, sorted, so equal units follow each other.
    """
    packed = blocks.select("block", F.explode("groups").alias("g")).select("block", "g.*")

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values_of, now, rows = value(), None, []

        def tables() -> Iterator[pa.RecordBatch]:
            units: list[str] = []
            for r in rows:
                data, ends = pa.decompress(r["units"], r["size"], "zstd", asbytes=True), np.cumsum(unpack(r["lengths"], r["n"])).tolist()
                units += [data[a:b].decode() for a, b in zip([0, *ends], ends, strict=False)]
            order = sorted(range(len(units)), key=units.__getitem__)
            found: list[bytes] = [b""] * len(units)
            for k, v in zip(order, values_of([units[k] for k in order]), strict=True):
                found[k] = v
            out, at = [], 0
            for r in rows:
                own, at = found[at : at + r["n"]], at + r["n"]
                places = unpack(r["places"], r["n"]).astype(np.int64)
                by_place = np.argsort(places)
                own = [own[k] for k in by_place.tolist()]
                joined = np.frombuffer(b"".join(own), "<u4")
                out.append((r["block"], r["n"], pack(np.diff(places[by_place], prepend=0)), pack(np.array([len(v) // 4 for v in own])), len(joined), pack(joined)))
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary())
            yield arrow_batch({n: pa.array(c, k) for n, c, k in zip(("block", "n", "places", "lengths", "n_values", "values"), zip(*out, strict=True), kinds, strict=True)})

        for batch in batches:
            for r in batch.to_pylist():
                if r["part"] != now and rows:
                    yield from tables()
                    rows = []
                now = r["part"]
                rows.append(r)
        if rows:
            yield from tables()

    dealt = packed.repartition(_tasks(blocks), "part").sortWithinPartitions("part")
    found = dealt.mapInArrow(resolve, "block long, n int, places binary, lengths binary, n_values int, values binary")
    gathered = found.groupBy("block").agg(F.collect_list(F.struct("n", "places", "lengths", "n_values", "values")).alias("tables"))
    return blocks.drop("groups").join(gathered, "block", "left")


def read_tables(tables: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
    """All values of a block in the order of their places, and the end of each place's values."""
    if not tables:
        return np.empty(0, np.uint32), np.zeros(1, np.int64)
    places = np.concatenate([np.cumsum(unpack(t["places"], t["n"]).astype(np.int64)) for t in tables])
    lengths = np.concatenate([unpack(t["lengths"], t["n"]) for t in tables]).astype(np.int64)
    values = np.concatenate([unpack(t["values"], t["n_values"]) for t in tables])
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(places)
    sizes = lengths[order]
    ends = np.r_[0, np.cumsum(sizes)]
    at = np.repeat(starts[order] - ends[:-1], sizes) + np.arange(ends[-1])
    return values[at], ends
