"""Near-duplicates against all pairs."""

import random
from collections import Counter, defaultdict
from math import comb

import numpy as np
import pytest

from tessera.llm import near_dedup
from tessera.llm.near_dedup import HASHES, least_agreements, surviving


def shingles(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4))


def brute(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, own in enumerate(sets):
        common = Counter(j for s in own for j in holders[s])
        for s in own:
            holders[s].append(i)
        for j, n in common.items():
            if 100 * n >= percent * (len(own) + len(sets[j]) - n) and find(i) != find(j):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)].append(doc_id)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        own = least[find(i)]
        smallest = min((d for d in own if d is not None), default=None)
        out.append((doc_id, len(sets[i]), smallest, doc_id == smallest if smallest is not None else len(own) == 1))
    return sorted(out, key=str)


def found(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()), key=str)


def copies(rng, words, n, changes):
    out = []
    for _ in range(n):
        own = list(words)
        for _ in range(rng.randrange(changes)):
            own[rng.randrange(len(own))] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


# Blocks of 8 members split the large group's buckets over many tasks.
@pytest.mark.parametrize("block", [4000, 1 << 21])  # shingles
def test_near_duplicates(spark, block):
    rng = random.Random(5)
    base = [f"b{rng.randrange(10**6)}" for _ in range(150)]
    texts = copies(rng, base, 90, 8) + copies(rng, [f"c{k}" for k in range(60)], 12, 3)
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 80))) for _ in range(30)]
    texts += ["one two", "One  TWO", "one two three", None, "", " \t", "one\x0btwo", "a b c d e", "A b c d e", "x y z"]
    rows = [*enumerate(texts), (None, texts[0]), (None, "x y z"), (None, "nowhere else"), (4, texts[4]), (None, "thrice null"), (None, "thrice null")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, node string, label long")
    assert found(near_dedup.near_duplicates(docs, block=block)) == brute(rows)


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert found(near_dedup.near_duplicates(docs)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_empty(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_bounds_miss_as_chosen():
    for n, m in least_agreements(0.85, 1e-3):
        above = lambda k, n=n: sum(comb(n + 1, i) * 0.85**i * 0.15 ** (n + 1 - i) for i in range(k + 1))
        assert above(m) >= 1e-3 > (above(m - 1) if m else 0)
    x = np.random.default_rng(1).integers(0, 4, (50, HASHES)).astype(np.uint32)
    assert list(surviving(x, x.copy(), least_agreements(0.85, 1e-6))) == list(range(50))
    assert not len(surviving(x, x + 9, least_agreements(0.85, 1e-6)))
