"""The manifest against trees built by hand."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, leaf string, run long"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, lower=False):
    i, text, lang, source, n = row
    fields = (i, source, lang, n, text.translate({c: c + 32 for c in range(65, 91)}) if lower and text is not None else text)
    return digest(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def climb(nodes):
    """Root, and for each node the siblings as (before, after) from the bottom to the top."""
    paths, groups = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        above, owners = [], []
        for at in range(0, len(nodes), 8):
            run = nodes[at : at + 8]
            for j in range(len(run)):
                for k in groups[at + j]:
                    paths[k].append(("".join(run[:j]), "".join(run[j + 1 :])))
            above.append(digest(*run)), owners.append(sum(groups[at : at + 8], []))
        nodes, groups = above, owners
    return nodes[0], paths


def brute(rows, tampered):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    below, out = [], []
    for name in names:
        members = sorted(trees[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        below.append((members, *climb([leaf_of(r) for r in members])))
    root, tops = climb([s for _, s, _ in below])
    for (members, subroot, paths), top in zip(below, tops, strict=True):
        for r, path in zip(members, paths, strict=True):
            folded, proof = leaf_of(r, tampered(r[0])), ""
            for before, after in path + top:
                folded, proof = digest(before, folded, after), proof + before + after
            out.append((r[0], leaf_of(r), subroot, root, digest(proof), folded, folded == root))
    return sorted(out, key=str)


def third(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 0


def got(docs, **parameters):
    lowered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    rows = merkle.manifest_rows(docs, presented={"text": lowered}, **parameters).select("doc_id", *[merkle.hex_text(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")], F.sha2(merkle.hex_text(F.col("proof")).cast("binary"), 256), merkle.hex_text(F.col("folded_root")), "verified")
    return sorted((tuple(r) for r in rows.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", 3) for r in rows], SCHEMA)


ODD = [
    (1, "Ab", "en", "s", 2), (None, "Text", "en", None, None), (None, "Text", "en", None, None), (3, None, "en", "s", None), (3, "", "en", "s", 0), (3, "", "en", "s", 0),
    (4, "Ünï\n" * 30000, None, "s", 9), (-5, "ABC", None, "S:1", 3), (6, "lone", "x", None, 1), (2**62, "z", "", "", 1),
]


@pytest.mark.parametrize("rows", [ODD, ODD[:1], [(k, f"T{k}", f"l{k}", "s", 1) for k in range(70)]])
def test_small_tables(spark, rows):
    assert got(frame(spark, rows)) == brute(rows, third)


@pytest.mark.parametrize("salts", [1, 128])
def test_many_leaves(spark, salts):
    """Several levels, runs that are not full, one tree with most of the leaves."""
    rows = [(k, f"Text {k}", "en" if k % 5 else "de", "s", k) for k in range(577)]
    assert got(frame(spark, rows), rows=salts) == brute(rows, third)


def test_untouched_and_empty(spark):
    docs = frame(spark, ODD)
    assert {r["verified"] for r in merkle.manifest_rows(docs).collect()} == {True}
    assert merkle.manifest_rows(docs.limit(0)).collect() == []
