"""Small helpers of the functions that run inside Spark tasks."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa

_STORE = "_tessera_worker_store"


def worker_store(key: str, make: Callable):
    """An object kept while tasks of a Python worker ask for the same key.

    Task functions travel by value, so their module globals are new in every
    task; a tokenizer or a word cache is worth keeping between them. Only the last
    one is kept: workers serve stage after stage, and their memory is bounded.
    """
    store = sys.modules.setdefault(_STORE, types.ModuleType(_STORE))
    kept = getattr(store, "kept", None)
    if kept is None or kept[0] != key:
        store.kept = kept = None
        store.kept = kept = (key, make())
    return kept[1]


class RecentValues:
    """Values of keys asked for lately, in two generations.

    What is asked for moves to the young generation. When that is full it becomes the
    old one, and what wasn't asked for since then goes: frequent keys always stay.
    """

    def __init__(self, limit: int = 300_000) -> None:
        self.limit, self.young, self.old = limit, {}, {}

    def of(self, keys: set, make: Callable[[set], dict]) -> dict:
        """A dict that has all of ``keys``; ``make`` gives the values of those that aren't kept."""
        if len(self.young) >= self.limit:
            self.young, self.old = {}, self.young
        missing = keys.difference(self.young)
        if missing:
            again = missing & self.old.keys()
            self.young.update((k, self.old[k]) for k in again)
            self.young.update(make(missing - again))
        return self.young


def row_slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batch in parts of few rows, of which one at a time becomes Python objects."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; NULL counts as the empty text."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def str_texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def arrow_batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)
