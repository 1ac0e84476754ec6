"""Runs of words against a search of all periods."""

import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import periodic_runs, queries


def brute(w, least=12):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - start >= max(least, 2 * q):
                found.setdefault((start, i + q), q)
            i = max(i, start + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def kept(w, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40), min_size=1, max_size=5), st.sampled_from([1, 2, 5, 12]))
def test_search(texts, least):
    document, *runs = periodic_runs.search(texts, least)
    found = [[] for _ in texts]
    for d, *run in zip(document.tolist(), *[x.tolist() for x in runs], strict=True):
        found[d].append(tuple(run))
    assert found == [brute(w, least) for w in texts]


def test_table(spark):
    rng = random.Random(1)
    texts = [None, "", " \t\n", "x " * 30000, "a b " * 6, "A a " * 6 + "q", " ".join(rng.choice("ab") for _ in range(300)), "one two three four " * 3, "é\x0bé\x1fé " * 9]
    rows = [*enumerate(texts), (4, "a b " * 6), (None, "z " * 12)]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, runs string, period long")
    for group in (1, 1 << 18):
        found = periodic_runs.periodic_runs(docs, group_words=group).collect()
        got = sorted([(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in found], key=str)
        want = []
        for i, t in rows:
            w = [x.decode() for x in (t or "").encode().split()]
            runs = [(0, 30000, 1)] if len(w) == 30000 else brute(w)
            want.append((i, len(w), runs, kept(w, runs)))
        assert got == sorted(want, key=str)
    assert periodic_runs.periodic_runs(docs.limit(0)).collect() == []


def test_query(spark, sf):
    """The registered query on the whole table."""
    import hashlib

    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        w = [x.decode() for x in r["text"].encode().split()]
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = brute(w) if n < 3000 else None
        if runs is None:
            d, *found = periodic_runs.search([[x.encode() for x in w]], 12)
            runs = list(zip(*[x.tolist() for x in found], strict=True))
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        lines = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept(w, runs))]
        want[r["doc_id"]] = (len(runs), *best, best[1] * 1000 // best[2] if runs else None, *sha)
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["op12_periodic_runs"](spark, sf).collect()}
    assert got == want and any(v[0] for v in want.values())
