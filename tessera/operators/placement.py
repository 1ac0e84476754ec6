"""Search for target boxes inside one context: numbered candidates, greedy acceptance.

Candidates come in stages; an anchor asks for the next one only if it isn't done with
those before. Tissue of all candidates of a stage is read off a summed-area table of the
context's rectangles: four look-ups a box, however many rectangles there are.

``search_together`` works a stage off for many anchors at once, as arrays of (anchor,
candidate); contexts of many rectangles are searched one by one (``Search``).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np

from tessera.functions.geometry import MAX_OVERLAP_RATIO

#: Candidates that have been tried after each stage; the last stage is the policy's maximum.
STAGES = (64, 512)
#: The same where anchors are searched together, and how many candidates they have at once.
STAGES_TOGETHER, TOGETHER = (16, 64, 512), 1 << 15
#: Contexts of more rectangles, and prefixes that don't fit one block of md5, are searched alone.
MOST_RECTANGLES, LONGEST_PREFIX = 64, 48
#: Fractions this near to a threshold are summed up exactly.
NEAR = 1e-9


class TissueArea:
    """Summed-area table over the edges of disjoint rectangles (x0, y0, x1, y1)."""

    def __init__(self, rectangles: np.ndarray) -> None:
        self.rectangles = rectangles
        self.xs, self.ys = (np.unique(rectangles[:, k::2]) for k in (0, 1))
        if len(self.xs) < 2 or len(self.ys) < 2:
            self.table = None
            return
        x0, x1 = (np.searchsorted(self.xs, rectangles[:, k]) for k in (0, 2))
        y0, y1 = (np.searchsorted(self.ys, rectangles[:, k]) for k in (1, 3))
        steps = np.zeros((len(self.xs), len(self.ys)))
        for x, y, sign in ((x0, y0, 1), (x1, y0, -1), (x0, y1, -1), (x1, y1, 1)):
            np.add.at(steps, (x, y), sign)
        covered = steps.cumsum(0).cumsum(1)[:-1, :-1] * np.diff(self.xs)[:, None] * np.diff(self.ys)[None, :]
        self.table = np.zeros((len(self.xs), len(self.ys)))
        self.table[1:, 1:] = covered.cumsum(0).cumsum(1)

    def _upto(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Tissue to the left of x and above y; inside a cell it grows evenly."""
        place = []
        for edges, v in ((self.xs, x), (self.ys, y)):
            k = np.clip(np.searchsorted(edges, v, "right") - 1, 0, len(edges) - 2)
            place.append((k, np.clip((v - edges[k]) / (edges[k + 1] - edges[k]), 0.0, 1.0)))
        (i, fx), (j, fy) = place
        t = self.table
        near, right, below, far = t[i, j], t[i + 1, j], t[i, j + 1], t[i + 1, j + 1]
        return near + fx * (right - near) + fy * (below - near) + fx * fy * (far - right - below + near)

    def of(self, x0: np.ndarray, y0: np.ndarray, size: int) -> np.ndarray:
        """Tissue in the squares with these upper left corners."""
        if self.table is None:
            return np.zeros(len(x0))
        x1, y1 = x0 + size, y0 + size
        return self._upto(x1, y1) - self._upto(x0, y1) - self._upto(x1, y0) + self._upto(x0, y0)

    def exactly(self, x0: int, y0: int, size: int) -> float:
        """Sum over the rectangles, in their order."""
        if not len(self.rectangles):
            return 0.0
        r = self.rectangles
        wide = np.maximum(np.minimum(x0 + size, r[:, 2]) - np.maximum(x0, r[:, 0]), 0)
        high = np.maximum(np.minimum(y0 + size, r[:, 3]) - np.maximum(y0, r[:, 1]), 0)
        return float(np.cumsum(wide * high)[-1])


def digests(prefix: str, first: int, last: int) -> np.ndarray:
    """The first two unsigned 32-bit numbers of md5(prefix + number), for numbers first..last."""
    begun = hashlib.md5(prefix.encode(), usedforsecurity=False)

    def each() -> Iterator[bytes]:
        for k in range(first, last + 1):
            h = begun.copy()
            h.update(b"%d" % k)
            yield h.digest()

    return np.frombuffer(b"".join(each()), ">u4").reshape(-1, 4)[:, :2].astype(np.int64)


class Search:
    """Candidates of one anchor, made as far as they are asked for."""

    def __init__(self, prefix: str, context: int, size: int, low: int, step: int, count: int, shift: int, rectangles: np.ndarray | None) -> None:
        self.prefix, self.context, self.size = prefix, context, size
        self.low, self.step, self.count, self.shift = low, step, count, shift
        self.tissue = None if rectangles is None else TissueArea(rectangles)
        self.x0 = self.y0 = np.empty(0, np.int64)
        self.fraction = np.empty(0)

    def extend(self, upto: int) -> None:
        made = len(self.x0)
        if made >= upto:
            return
        draws = self.low + self.step * (digests(self.prefix, made + 1, upto) % self.count) - self.shift
        x0, y0 = draws[:, 0], draws[:, 1]
        inside = (x0 >= 0) & (y0 >= 0) & (x0 + self.size <= self.context) & (y0 + self.size <= self.context)
        fraction = np.ones(len(x0)) if self.tissue is None else self.tissue.of(x0, y0, self.size) / (self.size * self.size)
        self.x0, self.y0 = np.r_[self.x0, x0], np.r_[self.y0, y0]
        self.fraction = np.r_[self.fraction, np.where(inside, fraction, -1.0)]

    def exact_fraction(self, k: int) -> float:
        return self.tissue.exactly(int(self.x0[k]), int(self.y0[k]), self.size) / float(self.size * self.size)

    def accepted(self, threshold: float, wanted: int) -> list[int]:
        """Candidates taken in order: enough tissue, and little overlap with those before."""
        enough = self.fraction >= threshold - NEAR
        if self.tissue is not None:
            for k in np.flatnonzero(enough & (self.fraction < threshold + NEAR)):
                enough[k] = self.exact_fraction(k) >= threshold
        left, taken = np.flatnonzero(enough), []
        limit = MAX_OVERLAP_RATIO * self.size * self.size
        while len(left) and len(taken) < wanted:
            k = int(left[0])
            taken.append(k)
            left = left[1:]
            wide = np.maximum(self.size - np.abs(self.x0[left] - self.x0[k]), 0)
            high = np.maximum(self.size - np.abs(self.y0[left] - self.y0[k]), 0)
            left = left[wide * high <= limit]
        return taken

    def result(self, thresholds: Sequence[float], wanted: int, attempts: int) -> tuple[list[tuple], float] | None:
        """Boxes (x0, y0, x1, y1, fraction) at the first threshold that allows enough of them."""
        for upto in (*(s for s in STAGES if s < attempts), attempts):
            self.extend(upto)
            last = upto == attempts
            for threshold in thresholds if last else thresholds[:1]:
                taken = self.accepted(threshold, wanted)
                if len(taken) >= wanted:
                    return [self._box(k) for k in taken], threshold
        return None

    def _box(self, k: int) -> tuple[int, int, int, int, float | None]:
        x0, y0 = int(self.x0[k]), int(self.y0[k])
        return x0, y0, x0 + self.size, y0 + self.size, None if self.tissue is None else self.exact_fraction(k)


def _md5_steps() -> list[tuple[int, np.uint32, int, int]]:
    """(round, constant, word, rotation) of the 64 steps of md5 (RFC 1321)."""
    turns = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
    words = (lambda i: i, lambda i: 5 * i + 1, lambda i: 3 * i + 5, lambda i: 7 * i)
    return [(i // 16, np.uint32(int(abs(math.sin(i + 1)) * 2**32)), words[i // 16](i) % 16, turns[i // 16][i % 4]) for i in range(64)]


MD5_STEPS = _md5_steps()
MD5_BEGIN = tuple(np.uint32(v) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))


def digests_together(prefixes: Sequence[bytes], upto: int) -> tuple[np.ndarray, np.ndarray]:
    """``digests(prefix, 1, upto)`` of each prefix, as two arrays (prefix, number): the same md5
    over all of them at once. Every prefix and number fit one block."""
    lengths = np.array([len(p) for p in prefixes])
    message = np.zeros((len(prefixes), upto, 64), np.uint8)
    message[:, :, :LONGEST_PREFIX] = np.frombuffer(b"".join(p.ljust(LONGEST_PREFIX, b"\0") for p in prefixes), np.uint8).reshape(-1, 1, LONGEST_PREFIX)
    numbers = np.arange(1, upto + 1)
    for length in np.unique(lengths):
        own = np.flatnonzero(lengths == length)
        own = slice(None) if len(own) == len(lengths) else own
        for digits in range(1, len(str(upto)) + 1):
            some = slice(10 ** (digits - 1) - 1, min(upto, 10**digits - 1))
            for k in range(digits):
                message[own, some, length + k] = 48 + numbers[some] // 10 ** (digits - 1 - k) % 10
            message[own, some, length + digits] = 0x80
            bits = 8 * (length + digits)
            message[own, some, 56], message[own, some, 57] = bits % 256, bits // 256
    block = np.ascontiguousarray(message.view("<u4").reshape(-1, 16).T).astype(np.uint32, copy=False)
    a, b, c, d = (np.full(block.shape[1], v) for v in MD5_BEGIN)
    for turn, constant, word, left in MD5_STEPS:
        if turn == 0:
            mixed = d ^ (b & (c ^ d))
        elif turn == 1:
            mixed = c ^ (d & (b ^ c))
        elif turn == 2:
            mixed = b ^ c ^ d
        else:
            mixed = c ^ (b | ~d)
        mixed += a
        mixed += constant
        mixed += block[word]
        turned = mixed << np.uint32(left)
        turned |= mixed >> np.uint32(32 - left)
        turned += b
        a, b, c, d = d, turned, b, c
    heads = ((v + begin).byteswap().astype(np.int64).reshape(len(prefixes), upto) for v, begin in zip((a, b), MD5_BEGIN[:2], strict=True))
    return tuple(heads)


class _Candidates:
    """The first candidates of some anchors, and the tissue in them: arrays (anchor, candidate)."""

    def __init__(self, upto: int, prefixes: Sequence[bytes], numbers: np.ndarray, rectangles: Sequence[np.ndarray | None]) -> None:
        context, self.size, low, step, count, shift = (numbers[:, k, None] for k in range(6))
        self.x0, self.y0 = (low + step * (drawn % count) - shift for drawn in digests_together(prefixes, upto))
        inside = (self.x0 >= 0) & (self.y0 >= 0) & (self.x0 + self.size <= context) & (self.y0 + self.size <= context)
        masked = np.array([r is not None for r in rectangles])
        most = max((len(r) for r in rectangles if r is not None), default=0)
        edges = np.zeros((len(rectangles), most, 4))
        for k, r in enumerate(rectangles):
            if r is not None:
                edges[k, : len(r)] = r
        tissue = np.zeros(self.x0.shape)
        for k in range(most):  # summed in their order, as ``TissueArea.exactly`` does; what is missing adds 0
            left, top, right, bottom = (edges[:, k, e, None] for e in range(4))
            wide = np.minimum(self.x0 + self.size, right) - np.maximum(self.x0, left)
            high = np.minimum(self.y0 + self.size, bottom) - np.maximum(self.y0, top)
            tissue += np.maximum(wide, 0) * np.maximum(high, 0)
        fraction = np.where(masked[:, None], tissue / (self.size * self.size).astype(np.float64), 1.0)
        self.fraction = np.where(inside, fraction, -1.0)

    def accepted(self, threshold: float, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether an anchor has enough boxes, and the candidates taken in order."""
        left, rows = self.fraction >= threshold, np.arange(len(self.fraction))
        enough, taken = np.ones(len(rows), bool), np.zeros((len(rows), wanted), np.int64)
        limit = MAX_OVERLAP_RATIO * self.size * self.size
        for n in range(wanted):
            first = left.argmax(axis=1)
            enough &= left[rows, first]
            taken[:, n] = first
            if n + 1 < wanted:
                wide = np.maximum(self.size - np.abs(self.x0 - self.x0[rows, first][:, None]), 0)
                high = np.maximum(self.size - np.abs(self.y0 - self.y0[rows, first][:, None]), 0)
                left &= wide * high <= limit
                left[rows, first] = False
        return enough, taken


def search_together(
    prefixes: Sequence[str], numbers: np.ndarray, rectangles: Sequence[np.ndarray | None], thresholds: Sequence[float], wanted: int, attempts: int
) -> list[tuple[list[tuple], float] | None]:
    """``Search(prefix, *numbers, rectangles).result(thresholds, wanted, attempts)`` of each row.

    ``numbers`` are rows of context, size, low, step, count and shift.
    """
    found: list = [None] * len(prefixes)
    coded = [p.encode() for p in prefixes]
    alone = [len(p) > LONGEST_PREFIX or (r is not None and len(r) > MOST_RECTANGLES) for p, r in zip(coded, rectangles, strict=True)]
    for k in np.flatnonzero(alone):
        found[k] = Search(prefixes[k], *numbers[k].tolist(), rectangles[k]).result(thresholds, wanted, attempts)
    open_rows = np.flatnonzero(~np.array(alone, bool))
    for upto in (*(s for s in STAGES_TOGETHER if s < attempts), attempts):
        later, each = [], max(1, TOGETHER // upto)
        for rows in (open_rows[k : k + each] for k in range(0, len(open_rows), each)):
            made = _Candidates(upto, [coded[k] for k in rows], numbers[rows], [rectangles[k] for k in rows])
            waits = np.ones(len(rows), bool)
            for threshold in thresholds if upto == attempts else thresholds[:1]:
                enough, taken = made.accepted(threshold, wanted)
                for k in np.flatnonzero(enough & waits):
                    at, bare, size = taken[k], rectangles[rows[k]] is None, int(numbers[rows[k], 1])
                    corners = zip(made.x0[k, at].tolist(), made.y0[k, at].tolist(), made.fraction[k, at].tolist(), strict=True)
                    found[rows[k]] = [(x, y, x + size, y + size, None if bare else f) for x, y, f in corners], threshold
                waits &= ~enough
                if not waits.any():
                    break
            later.append(rows[waits])
        open_rows = np.concatenate(later) if later else open_rows
    return found
