"""Ids against the library's, and what they decode to."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tessera.llm import byte_bpe, queries
from tessera.llm.pair_merges import PairTable, merge_long, merge_rows, read_ranks

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.ByteEncoder(PATH, PATTERN)


PARTS = [
    "a", "b", "the", " ", "  ", "\n", "\t", "\r\n", "é", "ß", "İ", "中", "文字", "🙂", "0", "12", "²", "½", "'s", "'ll", "'", "<|endoftext|>", "...", "!!", "՘", "\U0001246f",
    "\U0003d000", "\x1c", "\x85", "\xa0", "\x00", "‍", "aa", "Aa", "http", "://", "_", "-", "==", "ing", "tion",
]


def test_random_texts(encoder, library):
    rng = random.Random(7)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    texts += ["".join(rng.choice(a) for _ in range(n)) for a in ("a", "ab", "abcdeth", "=-*#", "éèaß", " ") for n in (255, 256, 257, 3000)]
    for text, ids in zip(texts, encoder.texts(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)


def test_long_rows_merge_as_short_ones():
    """Pairs whose result ranks below its parts are merged one by one where order matters."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        left, right = rng.integers(0, 6, 40), rng.integers(0, 6, 40)
        pairs = np.unique(np.c_[left, right], axis=0)
        rank = rng.permutation(len(pairs))
        table = PairTable(pairs[:, 0], pairs[:, 1], rank, rng.integers(0, 6, len(pairs)))
        ids = rng.integers(0, 6, rng.integers(1, 40)).astype(np.int32)
        rows = merge_rows(ids[None, :], table)[0]
        assert merge_long(ids, table).tolist() == rows[rows >= 0].tolist()


def test_table(spark, library, monkeypatch):
    texts = [None, "", "a", "The end.", "x" * 200_000, "word " * 300_000, "<|endoftext|>", "՘ a"]
    rows = [*enumerate(texts), (3, "The end."), (None, "no id")]
    docs = spark.createDataFrame([(i, t, 1, "clash") for i, t in rows], "doc_id long, text string, n_tokens int, ids string")
    got = byte_bpe.decode(byte_bpe.encode(docs, PATH, PATTERN), PATH).collect()
    want = [(i, np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in rows]
    assert sorted([(r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in got], key=str) == sorted(want, key=str)
    assert all(r["n_tokens"] == len(r["ids"]) // 4 for r in got)
    assert byte_bpe.decode(byte_bpe.encode(docs.limit(0), PATH, PATTERN), PATH).collect() == []


def test_query(spark, sf, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.QUERIES["op13_byte_bpe_codec"](spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode_ordinary(docs[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()
