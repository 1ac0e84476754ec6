"""SentencePiece encoding and decoding against the library and all segmentations."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tessera.llm.sentencepieces import Pieces, SortedWords, decode, encode

MODEL = public_tokenizers.path("piece_bpe_32k.model")
UNITS = ["a", "b", "e", "the", "in", "tion", " ", "  ", "   ", "\n", "\t", "é", "▁", "▁▁", "漢", "😀", "1", "00", "...", "!!", "A", "Th", "́", "\x00", " \n ", "ing", "--", "er", "a.b", "(a)", "'s", ".com", "://", "_x", "$\\", "},", "a,"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def encoded(pieces, text):
    words = pieces.words.findall(pieces.mark(text))
    walk = SortedWords(pieces)
    table = {w: walk.ids_of(w) for w in sorted(set(words))}
    return np.frombuffer(b"".join(table[w] for w in words), "<u4").tolist()


def test_random_texts(library):
    rng, pieces = random.Random(1), Pieces.load(MODEL)
    for _ in range(3000):
        text = "".join(rng.choice(UNITS) for _ in range(rng.randint(0, 25)))
        assert encoded(pieces, text) == library.encode(text), text


def test_unigram_scores():
    """The best of all segmentations, whatever words came before."""
    table = {"▁": -3.0, "▁a": -2.5, "a": -3.2, "b": -2.9, "ab": -4.1, "ba": -3.7, "▁ab": -6.0, "aba": -6.3, "c": -2.2}
    pieces = Pieces([("<unk>", 0.0, 2), *((p, s, 1) for p, s in table.items())], unigram=True)

    def best(word):
        if not word:
            return 0.0
        return max(best(word[k:]) + table.get(word[:k], -16.3) for k in range(1, len(word) + 1) if word[:k] in table or k == 1)

    rng = random.Random(2)
    walk = SortedWords(pieces)
    for word in sorted({"▁" + "".join(rng.choice("abcd") for _ in range(rng.randint(0, 9))) for _ in range(200)}):
        walk.ids_of(word)
        assert walk.scores[-1] == pytest.approx(best(word))


def test_codec(spark, sf, library):
    odd = [None, "", " ", "  x ", "漢字 😀\n", "a" * 3000]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    docs = docs.selectExpr("doc_id", "text", "'x' as ids", "1 as block")
    want = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for block in (2000, 10**8):
        found = encode(docs, MODEL, block_chars=block)
        got = {r["doc_id"]: r for r in found.collect()}
        assert {i: list(r["ids"]) for i, r in got.items()} == {i: library.encode(t) for i, t in want.items()}
        assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["n_pieces"] == len(r["ids"]) for r in got.values())
    back = {r["doc_id"]: r["text"] for r in decode(found, MODEL).collect()}
    assert back == want == {i: library.decode(list(r["ids"])) for i, r in got.items()}
    assert encode(docs.limit(0), MODEL).collect() == []


def test_decoding_odd_ids(spark):
    rows = [(1, None), (2, []), (3, [40000, -1]), (4, [None, 259]), (5, [3 + 0xE9])]
    got = {r["k"]: r["text"] for r in decode(spark.createDataFrame(rows, "k int, ids array<int>"), MODEL).collect()}
    assert got == {1: "", 2: "", 3: "��", 4: " ", 5: "�"}
