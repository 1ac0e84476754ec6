"""Neighbours that tiles' bounds leave over against all pairs."""

import numpy as np
import pytest

from tessera.operators import neighbours as N


def clustered(clusters=12, each=50, width=16):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(clusters, width))
    rows = [c + 0.05 * rng.normal(size=(each, width)) for c in centres]
    # Vectors without a direction, and repeated ones (ties go to the lower id).
    return np.concatenate([*rows, np.zeros((3, width)), np.repeat(centres[:2], 5, 0)])


@pytest.mark.parametrize(("cells", "block"), [((), 16384), ((), 40), (("cell",), 64)])
def test_against_all_pairs(spark, monkeypatch, cells, block):
    monkeypatch.setattr(N, "LEAST_BLOCK", 20)
    v = clustered()
    cell = [f"c{k % 3}" for k in range(len(v))]
    df = spark.createDataFrame([(f"r{k:04d}", [float(x) for x in v[k]], cell[k]) for k in range(len(v))], "sample_id string, embedding array<double>, cell string")
    unit = v / (np.sqrt((v * v).sum(1, keepdims=True)) + 1e-12)
    sims = np.round(unit @ unit.T, N.SIM_DIGITS)
    want = set()
    for i in range(len(v)):
        for c in set(cell) if cells else {None}:
            own = sorted((j for j in range(len(v)) if c is None or cell[j] == c), key=lambda j, i=i: (-sims[i, j], j))
            want |= {(f"r{i:04d}", f"r{j:04d}") for j in own[:6]}
    found = N.neighbour_partials(df, 6, cells=cells, block_rows=block).collect()
    assert {(r["query_id"], r["neighbour_id"]) for r in found} == want and len(found) == len(want)
    assert N.neighbour_partials(df.limit(0), 6, cells=cells).collect() == []


def test_few_tile_pairs_survive():
    """Far clusters: a tile meets little but its own cluster. Without structure nothing is lost."""
    angles = np.arccos(np.clip(np.eye(50), -1, 1))
    tile = np.arange(50)
    block, other, bound = N.surviving_tiles(tile, np.zeros(50, int), tile, np.full(50, 10), np.full(50, 0.1), angles, 5)
    assert block.tolist() == other.tolist() == tile.tolist() and (bound >= 1).all()
    block, other, _ = N.surviving_tiles(tile, np.zeros(50, int), tile, np.full(50, 10), np.full(50, np.pi), angles, 5)
    assert len(block) == 2500
    # Too few rows in the nearest tile: the next ones are needed too.
    assert len(N.surviving_tiles(tile[:1], np.zeros(50, int), tile, np.full(50, 10), np.full(50, 0.1), angles, 11)[0]) == 50


def test_pivots_are_apart():
    rng = np.random.default_rng(2)
    centres = np.eye(8)
    sample = np.repeat(centres, 20, 0) + 0.01 * rng.normal(size=(160, 8))
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    assert len({int(p.argmax()) for p in N.choose_pivots(sample, 8)}) == 8
    assert len(N.choose_pivots(np.repeat(centres[:2], 9, 0), 8)) == 2


def test_rows_sent_do_not_grow_with_shuffle_partitions(spark, monkeypatch):
    """Blocks follow the cores: more partitions of a shuffle send no candidate more often."""
    monkeypatch.setattr(N, "LEAST_BLOCK", 1)
    x = np.random.default_rng(3).normal(size=(400, 6))
    df = spark.createDataFrame([(f"r{k:04d}", v.tolist()) for k, v in enumerate(x)], "sample_id string, embedding array<double>")
    seen = []
    monkeypatch.setattr(N, "_tiled", lambda *a, made=N._tiled: seen.append(a[4]) or made(*a))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in (4, 200):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            N.neighbour_partials(df, 3).count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] > 2


def test_only_what_reaches_the_floor_is_ranked():
    """Where the m-th of each row is known, few entries are left, and none that counts is missing."""
    from tessera.operators import neighbours as N

    rng = np.random.default_rng(8)
    sims = np.round(rng.uniform(-1, 1, (20, 5000)), 3)
    floor = np.sort(sims, axis=1)[:, -4]
    rows, cols, values = N._reaching(sims, floor, 4)
    assert len(rows) < 20 * 40 and (values == sims[rows, cols]).all()
    wanted = set(zip(*map(np.ndarray.tolist, N._best_per_row(sims, 4)[:2]), strict=True))
    assert wanted <= set(zip(rows.tolist(), cols.tolist(), strict=True))
    # A floor that is too low, or none, leaves the m largest of each row.
    for low in (np.full(20, -1.0), np.full(20, -2.0)):
        assert len(N._reaching(sims, low, 4)[0]) == 80
