"""The search inside a context against plain sums and a plain loop."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators.placement import Search, TissueArea, digests, digests_together, search_together


def disjoint(rng, n, width):
    """Horizontal runs of a raster, scaled to fractions of pixels."""
    out = []
    for y in rng.choice(width, n, replace=False):
        x0, x1 = sorted(rng.choice(width + 1, 2, replace=False))
        out.append((x0, y, x1, y + 1))
    return np.array(sorted(out), float) * 1.37


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(0, 20), st.integers(1, 30))
def test_summed_area_table(seed, n, size):
    rng = np.random.default_rng(seed)
    area = TissueArea(disjoint(rng, n, 40).reshape(-1, 4))
    x, y = rng.integers(-5, 60, 50), rng.integers(-5, 60, 50)
    exact = [area.exactly(int(a), int(b), size) for a, b in zip(x, y, strict=True)]
    assert np.allclose(area.of(x, y, size), exact, atol=1e-9)


def plain(prefix, context, size, low, step, count, shift, rectangles, thresholds, wanted, attempts):
    for threshold in thresholds:
        taken = []
        for i in range(1, attempts + 1):
            if len(taken) >= wanted:
                break
            digest = hashlib.md5(f"{prefix}{i}".encode()).hexdigest()
            x, y = (low + step * (int(h, 16) % count) - shift for h in (digest[:8], digest[8:16]))
            if x < 0 or y < 0 or x + size > context or y + size > context:
                continue
            cover = lambda a, b, p, q: max(0, min(a + size, p) - max(a, q))
            if any(cover(x, 0, bx + size, bx) * cover(y, 0, by + size, by) > size * size / 4 for bx, by, _ in taken):
                continue
            f = None
            if rectangles is not None:
                f = sum(cover(x, 0, r[2], r[0]) * cover(y, 0, r[3], r[1]) for r in rectangles.tolist()) / (size * size)
                if f < threshold:
                    continue
            taken.append((x, y, f))
        if len(taken) >= wanted:
            return taken, threshold
    return None


@pytest.mark.parametrize("seed", range(12))
def test_search_is_the_plain_loop(seed):
    """Thresholds in turn, stages or not, with and without a mask, aligned or not."""
    rng = np.random.default_rng(seed)
    rectangles = None if seed % 4 == 3 else disjoint(rng, 5 + 4 * seed, 64)
    size = int(rng.integers(8, 24))
    low, step, count, shift = (size // 2, 1, 64 - 2 * (size // 2), size // 2) if seed % 2 else (0, 4, 12, 0)
    given_, policy = (f"7|0|a{seed}|", 64, size, low, step, count, shift, rectangles), ([0.6, 0.4, 0.2, 0.05], 4, 700)
    found, want = Search(*given_).result(*policy), plain(*given_, *policy)
    assert (found is None) == (want is None)
    if found:
        assert found[1] == want[1] and [b[:2] for b in found[0]] == [b[:2] for b in want[0]]
        assert all(b[4] == w[2] or abs(b[4] - w[2]) < 1e-12 for b, w in zip(found[0], want[0], strict=True))


def test_search_together_is_the_single_search():
    """Masks or none, none of their rectangles or many, long prefixes, aligned or not; some anchors need the last stage."""
    rng = np.random.default_rng(5)
    prefixes, numbers, rectangles = [], [], []
    for k in range(90):
        size = int(rng.integers(8, 24))
        low, step, count, shift = (size // 2, 1, 64 - 2 * (size // 2), size // 2) if k % 2 else (0, 4, 12, 0)
        prefixes.append(f"7|0|a{k}|" + "x" * (60 * (k % 9 == 8)))
        numbers.append((64, size, low, step, count, shift))
        rectangles.append(None if k % 7 == 6 else np.round(disjoint(rng, int(rng.integers(0, 25)) + 45 * (k % 11 == 10), 80).reshape(-1, 4)))
    for policy in (([0.6, 0.4, 0.2, 0.05], 4, 700), ([0.9], 3, 40), ([0.5, 0.1], 2, 1200)):
        alone = [Search(p, *n, r).result(*policy) for p, n, r in zip(prefixes, numbers, rectangles, strict=True)]
        assert search_together(prefixes, np.array(numbers), rectangles, *policy) == alone
        assert {f is None for f in alone} == {True, False}
    assert search_together([], np.empty((0, 6), np.int64), [], [0.5], 4, 700) == []


def test_digests_together():
    prefixes = [b"", b"7|0|S1_0000001|", b"x" * 48]
    both = digests_together(prefixes, 1203)
    for k, prefix in enumerate(prefixes):
        assert (np.stack([both[0][k], both[1][k]], 1) == digests(prefix.decode(), 1, 1203)).all()
