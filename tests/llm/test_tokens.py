"""Packing and token counts against the libraries themselves."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing, token_counts

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "\n\n", "a  b \n \n c", "Ünïcode ÇA İstanbul ẞ", "é combining 가", "ΣΊΣΥΦΟΣ ς", "x\x1cy\x1fz", "nbsp here\u0085there",
    "<|endoftext|>hello<|startoftext|> <|ENDOFTEXT|>", "don't we'll I'm 1234 ½²", "emoji 😀 漢字   ﻿", "tab\tand\x0bvt", "a" * 5000, "w " * 4000, "\x00\x7f ctrl", "ǅ ŉ ŀ'S",
]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, part string, n long")


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def best_fit_decreasing(sizes, capacity):
    bins = []
    for size in sorted(sizes, reverse=True):
        fits = [b for b in range(len(bins)) if bins[b] >= size]
        if fits:
            bins[min(fits, key=lambda b: bins[b])] -= size
        else:
            bins.append(capacity - size)
    return sorted(bins)


def test_runs_are_best_fit_decreasing():
    rng = random.Random(3)
    for _ in range(60):
        capacity = rng.choice([7, 16, 50])
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(0, 120))]
        runs, bins = packing.best_fit_runs({s: sizes.count(s) for s in set(sizes)}, capacity)
        free = [capacity] * bins
        for size in set(sizes):
            own = runs[runs[:, 0] == size]
            for rank in range(sizes.count(size)):
                run = own[np.searchsorted(own[:, 1], rank, "right") - 1]
                free[run[2] + (rank - run[1]) // run[3]] -= size
        assert sorted(free) == best_fit_decreasing(sizes, capacity)


def check_packing(rows, texts):
    tok = Tokenizer.from_file(WORD)
    want = {}
    for i, text in texts:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, at in enumerate(range(0, len(ids), 2048)):
            own = ids[at : at + 2048]
            want[i, piece] = (at, len(own), zlib.crc32(own.tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    assert len(rows) == len(want)
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) == len(best_fit_decreasing([r["length"] for r in rows], 2048))


def test_packing(spark, sf):
    docs = documents(spark, sf)
    rows = packing.pack(docs, WORD).collect()
    check_packing(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_packing_of_odd_texts(spark):
    check_packing(packing.pack(frame(spark, ODD), WORD).collect(), list(enumerate(ODD)))


@pytest.mark.parametrize("block", [50, 10**7])
def test_token_counts(spark, sf, block):
    tok = Tokenizer.from_file(BYTE)
    docs = documents(spark, sf).select("doc_id", "text").union(frame(spark, ODD).selectExpr("doc_id + 1000000", "text"))
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(docs, BYTE, block_chars=block).collect()}
    want = {}
    for r in docs.collect():
        n = len(tok.encode(r["text"] or "", add_special_tokens=False).ids)
        want[r["doc_id"]] = (len((r["text"] or "").encode()), n, n > 512)
    assert got == want


def test_repeated_null_and_missing_rows(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "c"), (1, "c"), (None, None)], "doc_id long, text string")
    assert sorted(map(str, token_counts.token_counts(docs, BYTE).select("doc_id", "n_tokens").collect())) == sorted(
        ["Row(doc_id=None, n_tokens=2)", "Row(doc_id=1, n_tokens=1)", "Row(doc_id=1, n_tokens=1)", "Row(doc_id=None, n_tokens=0)"]
    )
    assert packing.pack(docs, WORD).count() == 4
    assert token_counts.token_counts(docs.limit(0), BYTE).collect() == []
    assert packing.pack(docs.limit(0), WORD).collect() == []
