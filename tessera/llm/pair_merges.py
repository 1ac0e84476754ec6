"""Byte-pair merges of many units at once, on padded matrices of token ids.

Units are dealt to buckets by length. In each round every row of a bucket merges its
leftmost pair of least rank and moves up what follows, so a matrix loses a column a
round; rows without a mergeable pair leave it. Ranks of pairs come from a hash table
that whole columns are looked up in.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np

#: Rank of a pair that doesn't merge, and the id that fills rows up.
NONE, PAD = np.int32(2**31 - 1), np.int32(-1)
#: Widths of the buckets; longer units are merged one by one.
WIDTHS = np.array([4, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64, 96, 128, 192, 256])
#: Cells of a matrix.
CELLS = 1 << 18


class PairTable:
    """(left id, right id) -> rank: open addressing with linear probing. ``made[rank]`` is the new id."""

    _SPREAD = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, made: np.ndarray) -> None:
        self.made = made.astype(np.int32)
        self.bits = max(4, (4 * len(left)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        keys, rank = (left.astype(np.int64) << 32) | right.astype(np.int64), rank.astype(np.int32)
        at = self._slots(keys)
        while len(keys):
            # Of the keys that want one free slot the first gets it; the others go on.
            free = self.keys[at] == -1
            winners = np.zeros(len(keys), bool)
            winners[np.flatnonzero(free)[np.unique(at[free], return_index=True)[1]]] = True
            self.keys[at[winners]], self.ranks[at[winners]] = keys[winners], rank[winners]
            keys, rank, at = keys[~winners], rank[~winners], (at[~winners] + 1) & (len(self.keys) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * self._SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; NONE where it doesn't merge or holds PAD."""
        keys = (left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)
        shape, keys = keys.shape, keys.ravel()
        at = self._slots(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.ranks[at], NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out.reshape(shape)


def merge_rows(ids: np.ndarray, table: PairTable) -> np.ndarray:
    """Rows of ids, filled up with PAD at their ends, after all their merges."""
    out = np.full(ids.shape, PAD, np.int32)
    rows, ranks = np.arange(len(ids)), table.of(ids[:, :-1], ids[:, 1:])
    while ids.shape[1] > 1 and len(rows):
        at = ranks.argmin(axis=1)
        best = ranks[np.arange(len(rows)), at]
        merging = best != NONE
        if not merging.all():
            out[rows[~merging], : ids.shape[1]] = ids[~merging]
            rows, ids, ranks, at, best = (x[merging] for x in (rows, ids, ranks, at, best))
        k, at_column = np.arange(len(rows)), at[:, None]
        ids = np.where(np.arange(ids.shape[1] - 1) <= at_column, ids[:, :-1], ids[:, 1:])
        ids[k, at] = table.made[best]
        if ids.shape[1] == 1:
            break
        ranks = np.where(np.arange(ranks.shape[1] - 1) <= at_column, ranks[:, :-1], ranks[:, 1:])
        after = np.flatnonzero(at < ids.shape[1] - 1)
        ranks[after, at[after]] = table.of(ids[after, at[after]], ids[after, at[after] + 1])
        before = np.flatnonzero(at > 0)
        ranks[before, at[before] - 1] = table.of(ids[before, at[before] - 1], ids[before, at[before]])
    out[rows, : ids.shape[1]] = ids
    return out


def merge_long(ids: np.ndarray, table: PairTable) -> np.ndarray:
    """One long row after all its merges.

    All places of the least rank merge in one round, from the left and without
    overlaps, if no pair that comes up on the way has a rank as low; then one by one
    they would merge in the same way. Else the leftmost merges alone.
    """
    ranks = table.of(ids[:-1], ids[1:])
    while len(ranks) and (best := ranks.min()) != NONE:
        at = np.flatnonzero(ranks == best)
        made = table.made[best]
        if len(at) > 1:
            k = np.arange(len(at))
            first = np.maximum.accumulate(np.where(np.r_[True, np.diff(at) > 1], k, 0))
            at = at[(k - first) % 2 == 0]
        while True:
            new = ids.copy()
            new[at] = made
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            new, place = new[stay], at - np.arange(len(at))
            left = place[place > 0]
            before = table.of(new[left - 1], new[left])
            if len(at) == 1 or (before.min(initial=NONE) > best and table.of(np.full(np.count_nonzero(at + 2 < len(ids)), made), ids[at[at + 2 < len(ids)] + 2]).min(initial=NONE) > best):
                break
            at = at[:1]
        ranks = ranks[stay[1:]] if len(new) > 1 else ranks[:0]
        right = place[place < len(new) - 1]
        ranks[right] = table.of(new[right], new[right + 1])
        ranks[left - 1] = before
        ids = new
    return ids


def merge_units(ids: np.ndarray, lengths: np.ndarray, table: PairTable) -> list[bytes]:
    """Merged ids of each unit as little-endian uint32 bytes.

    ``ids`` (int32) has the ids that the units start with, one unit after the other.
    """
    out: list[bytes] = [b""] * len(lengths)
    starts = np.cumsum(lengths) - lengths
    bucket = np.searchsorted(WIDTHS, lengths)
    order = np.argsort(bucket, kind="stable")
    for b, width in enumerate(WIDTHS):
        own = order[np.searchsorted(bucket[order], b) : np.searchsorted(bucket[order], b, "right")]
        for chunk in np.array_split(own, max(1, -(-len(own) * int(width) // CELLS))):
            if not len(chunk):
                continue
            column = np.arange(width)
            place = np.minimum(starts[chunk, None] + column, len(ids) - 1)
            merged = merge_rows(np.where(column < lengths[chunk, None], ids[place], PAD), table)
            there = merged != PAD
            data = merged[there].astype("<u4").tobytes()
            ends = (4 * np.cumsum(there.sum(axis=1))).tolist()
            for k, a, e in zip(chunk.tolist(), [0, *ends], ends, strict=False):
                out[k] = data[a:e]
    for k in np.flatnonzero(lengths > WIDTHS[-1]):
        out[k] = merge_long(ids[starts[k] : starts[k] + lengths[k]], table).astype("<u4").tobytes()
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, of a file with a line 'base64 rank' for each token."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def byte_pairs(ranks: dict[bytes, int]) -> PairTable:
    """Two tokens merge when their bytes together are a token; its rank is the rank and the id."""

    def splits() -> Iterator[tuple[int, int, int]]:
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    yield left, right, rank

    left, right, rank = np.array(list(splits()), np.int64).reshape(-1, 3).T
    return PairTable(left, right, rank, np.arange(max(ranks.values()) + 1))
