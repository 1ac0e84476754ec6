"""Maximal periodic runs of words, and texts with their repetitions taken out.

Documents are searched in groups of bounded size, as one sequence in which words of
different documents differ. An enhanced suffix array (order, ranks, LCP) stands for
the suffix tree, of which no node is made:

1. Prefix doubling sorts suffixes; the ranks of each doubling are kept, so that the
   common extension of two places is a few look-ups, to the right and to the left.
2. For each LCP interval of depth d the suffixes of all children but the largest look
   whether the suffix d places after or before them lies in the interval too (its rank
   says so) and goes on differently: then d words are said twice in a row there, and a
   third time doesn't follow (a branching tandem).
3. Such a square rotated to the left as far as words repeat is a run; squares of the
   multiples of a period end in the same run, which keeps the least period.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tasks import arrow_batch, byte_texts

#: Shortest run, and the words of the documents that are searched together.
MIN_WORDS, GROUP_WORDS = 12, 1 << 18
#: Suffixes of an expansion at a time.
_CHUNK = 1 << 21


class SuffixOrder:
    """Suffix array of numbers, with the ranks of prefixes of 1, 2, 4 ... numbers.

    Numbers that occur once must end every repetition, the last one included.
    """

    def __init__(self, numbers: np.ndarray) -> None:
        n = len(numbers)
        self.order = np.argsort(numbers, kind="stable").astype(np.int32)
        ordered = numbers[self.order]
        head = np.r_[True, ordered[1:] != ordered[:-1]]
        rank = np.empty(n, np.int32)
        rank[self.order] = np.maximum.accumulate(np.where(head, np.arange(n, dtype=np.int32), 0))
        self.levels, width = [rank], 1
        while True:
            open_ = np.flatnonzero(~(head & np.r_[head[1:], True]))  # places in groups of several
            if not len(open_):
                break
            suffix = self.order[open_]
            key = (rank[suffix].astype(np.int64) << 32) | rank[suffix + width]
            by_key = np.argsort(key, kind="stable")
            key, suffix = key[by_key], suffix[by_key]
            self.order[open_] = suffix
            new = np.r_[True, key[1:] != key[:-1]]
            head[open_] = new
            rank = rank.copy()
            rank[suffix] = np.maximum.accumulate(np.where(new, open_, 0))
            self.levels.append(rank)
            width *= 2
        self.rank = rank

    def lcp(self) -> np.ndarray:
        """Common length of each suffix and the one before it in order; -1 at both ends."""
        x, y = self.order[:-1].copy(), self.order[1:].copy()
        start = x.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            step = (self.levels[k][x] == self.levels[k][y]).astype(np.int32) << k
            x, y = x + step, y + step
        return np.r_[np.int32(-1), x - start, np.int32(-1)]

    def extend_left(self, at: np.ndarray, period: np.ndarray) -> np.ndarray:
        """The first place from which all words up to ``at`` repeat after ``period`` words."""
        at = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            before = np.maximum(at - (1 << k), 0)
            same = (at >= 1 << k) & (self.levels[k][before] == self.levels[k][before + period])
            at = np.where(same, before, at)
        return at


def lcp_intervals(lcp: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first, last, interval) of all children but the largest, and (first, last, depth) of
    the intervals; first and last are places in suffix order."""
    inner = np.flatnonzero(lcp > 0)
    if not len(inner):
        return (np.empty(0, np.int64),) * 6
    depth = lcp[inner]
    # Minima over 1, 2, 4 ... places, as far as an interval can reach.
    breaks = np.flatnonzero(lcp <= 0)
    minima = [lcp]
    for k in range(int(np.diff(breaks).max()).bit_length() - 1):
        last = minima[-1]
        minima.append(np.r_[np.minimum(last[: -(1 << k)], last[1 << k :]), last[-(1 << k) :]])
    left, right = inner.copy(), inner.copy()
    for k in range(len(minima) - 1, -1, -1):
        before = np.maximum(left - (1 << k), 0)
        left = np.where((left >= 1 << k) & (minima[k][before] >= depth), before, left)
        ahead = np.minimum(right, len(lcp) - (1 << k))
        right = np.where((right + (1 << k) <= len(lcp)) & (minima[k][ahead] >= depth), right + (1 << k), right)
    first, last = left - 1, right - 1
    order = np.argsort((first << 32) | depth, kind="stable")
    first, last, depth, split = first[order], last[order], depth[order], inner[order]
    new = np.r_[True, (first[1:] != first[:-1]) | (depth[1:] != depth[:-1])]
    interval, heads = np.cumsum(new) - 1, np.flatnonzero(new)
    first, last, depth = first[heads], last[heads], depth[heads]
    # A split ends a child; after the last split of an interval comes one more child.
    begin = np.where(new, first[interval], np.r_[0, split[:-1]])
    tails = np.r_[heads[1:], len(split)] - 1
    begin, end, owner = np.r_[begin, split[tails]], np.r_[split - 1, last], np.r_[interval, np.arange(len(heads))]
    by_size = np.lexsort((end - begin, owner))
    small = by_size[np.r_[owner[by_size][1:] == owner[by_size][:-1], False]]
    return begin[small], end[small], owner[small], first, last, depth


def branching_tandems(numbers: np.ndarray, suffixes: SuffixOrder) -> tuple[np.ndarray, np.ndarray]:
    """(place, length) of each word sequence that is said twice from there and no further."""
    begin, end, owner, first, last, depth = lcp_intervals(suffixes.lcp())
    sizes = end - begin + 1
    found_at, found_depth = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    cuts = np.searchsorted(np.cumsum(sizes), np.arange(_CHUNK, sizes.sum() + _CHUNK, _CHUNK), "right") if len(sizes) else []
    a = 0
    for b in [*cuts, len(sizes)]:
        b = min(max(b, a + 1), len(sizes))
        if b <= a:
            continue
        n = sizes[a:b]
        place = np.repeat(begin[a:b] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        mine, at = np.repeat(owner[a:b], n), suffixes.order[place].astype(np.int64)
        low, high, d = first[mine], last[mine], depth[mine].astype(np.int64)
        for other, start in ((at + d, at), (at - d, at - d)):
            inside = np.flatnonzero((other >= 0) & (other < len(numbers)))
            rank = suffixes.rank[other[inside]]
            inside = inside[(rank >= low[inside]) & (rank <= high[inside])]
            s, w = start[inside], d[inside]
            ends = numbers[s + w] != numbers[s + 2 * w]
            found_at.append(s[ends]), found_depth.append(w[ends])
        a = b
    return np.concatenate(found_at), np.concatenate(found_depth)


def runs_of(numbers: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, least period) of the maximal runs in a sequence as ``SuffixOrder`` takes it."""
    suffixes = SuffixOrder(numbers)
    at, period = branching_tandems(numbers, suffixes)
    start, end = suffixes.extend_left(at, period), at + 2 * period
    long = end - start >= min_words
    start, end, period = start[long], end[long], period[long]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    least = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])][: len(start)]
    return start[least], end[least], period[least]


_ODD = np.random.default_rng(20250611).integers(1, 2**62, MIN_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _may_repeat(numbers: np.ndarray, document: np.ndarray, width: int) -> np.ndarray:
    """Documents in which some ``width`` words in a row occur twice (hashes may say it of others too).

    A run of at least 2 * width words has them: its beginning, and one period later.
    """
    n = len(numbers) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    value = document[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(width):
        value += numbers[k : k + n].astype(np.uint64) * _ODD[k]
    value ^= value >> np.uint64(32)
    value = value * np.uint64(0xD6E8FEB86659FD93)
    inside = document[:n] == document[width - 1 :]
    ordered = np.sort(value[inside])
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.empty(0, np.int64)
    near = np.minimum(np.searchsorted(twice, value), len(twice) - 1)
    return np.unique(document[:n][inside & (twice[near] == value)])


def search(texts: list[list[bytes]], min_words: int) -> tuple[np.ndarray, ...]:
    """(document, start, length, period) of the runs of documents given as words, in this order."""
    number = defaultdict(count().__next__)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    numbers = np.fromiter((number[w] for words in texts for w in words), np.int64, int(sizes.sum()))
    begins = np.cumsum(sizes) - sizes
    # With fewer words than that in a row said twice there is no run in a document.
    chosen = _may_repeat(numbers, np.repeat(np.arange(len(texts)), sizes), max(1, min(len(_ODD), min_words // 2)))
    if not len(chosen):
        return (np.empty(0, np.int64),) * 4
    # Words of a document, then a number of its own.
    own = sizes[chosen] + 1
    ends = np.cumsum(own)
    document = np.repeat(np.arange(len(chosen)), own)
    within = np.arange(ends[-1]) - np.repeat(ends - own, own)
    mark = within == sizes[chosen][document]
    key = document * len(number) + numbers[np.minimum(begins[chosen][document] + within, len(numbers) - 1)]
    _, dense = np.unique(key[~mark], return_inverse=True)
    sequence = np.empty(len(key), np.int64)
    sequence[mark], sequence[~mark] = np.arange(len(chosen)), dense + len(chosen)
    start, end, period = runs_of(sequence, min_words)
    document = document[start]
    start = start - (ends - own)[document]
    order = np.lexsort((period, start, document))
    return chosen[document][order], start[order], (end - (ends - own)[document] - start)[order], period[order]


def collapse(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bytes:
    """The words that no run repeats (each run keeps its first period), joined by spaces."""
    if len(start):
        steps = np.zeros(len(words) + 1, np.int64)
        np.add.at(steps, start + period, 1)
        np.add.at(steps, start + length, -1)
        words = compress(words, (np.cumsum(steps[:-1]) == 0).tolist())
    return b" ".join(words)


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_words: int = MIN_WORDS, group_words: int = GROUP_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, runs array<start, length, period>, collapsed.

    Words are runs without ASCII white space. A run is a stretch of words with smallest
    period q (words q apart are equal), of at least max(``min_words``, 2 * q) words,
    that no neighbouring word extends with that period; runs are ordered by start, then
    period. ``collapsed`` has the words that no run repeats, joined by single spaces.
    NULL and empty texts have no words and no runs. Rows are searched as they come:
    repeated rows repeat, NULL ids stay NULL, no rows give no rows. A document of more
    than ``group_words`` words is searched alone and whole. Other columns are ignored.
    """
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def answer(ids: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
        document, start, length, period = search(texts, min_words)
        ends = np.searchsorted(document, np.arange(len(texts) + 1))
        runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"])
        collapsed = [collapse(words, start[a:b], length[a:b], period[a:b]) for words, a, b in zip(texts, ends, ends[1:], strict=False)]
        return arrow_batch({
            "doc_id": ids, "n_words": pa.array([len(t) for t in texts], pa.int64()),
            "runs": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), runs), "collapsed": pa.array(collapsed, pa.binary()).cast(pa.string()),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[list[bytes]] = []
            begin = words = 0
            for row, text in enumerate(byte_texts(batch.column(1))):
                own = text.split()
                if texts and words + len(own) > group_words:
                    yield answer(batch.column(0)[begin:row], texts)
                    texts, begin, words = [], row, 0
                texts.append(own)
                words += len(own)
            if texts:
                yield answer(batch.column(0)[begin:], texts)

    return source.mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
