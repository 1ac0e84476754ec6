"""Packing of numbers is an exact round trip."""

import numpy as np
import pytest

from tessera.llm.blocks import pack, unpack


@pytest.mark.parametrize("high", [1, 256, 257, 65536, 65537, 2**32])
def test_round_trip(high):
    rng = np.random.default_rng(high)
    for n in (0, 1, 2, 1000, 70_000):
        numbers = rng.integers(0, high, n, dtype=np.uint64).astype(np.uint32)
        assert (unpack(pack(numbers), n) == numbers).all()
    edges = np.array([0, 255, 256, 65535, 65536, 2**32 - 1], np.uint32)
    out = unpack(pack(edges), len(edges))
    assert (out == edges).all() and out.flags.writeable


def test_many_blocks_in_a_task(spark):
    """Blocks of different tasks have different numbers, however many a task has."""
    import public_tokenizers

    from tessera.llm.token_counts import token_counts

    rows = [(k, f"text number {k} of {k % 7}") for k in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    path = public_tokenizers.path("byte_bpe_50k.json")
    count = lambda chars: sorted((r["doc_id"], r["n_tokens"]) for r in token_counts(docs, path, block_chars=chars).collect())
    assert count(1) == count(10**6)
