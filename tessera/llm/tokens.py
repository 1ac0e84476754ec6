"""Byte-level BPE of single pre-tokens with the models of the tokenizers library.

Texts are cut into units that the merges never cross, so that each distinct unit is
merged once:

* word pieces (``WordIds``): white space separates, so a unit is a run without it; new
  runs are merged on matrices, with the library's merges;
* byte pieces (``BytePieces``): the pre-tokens of the byte-level pattern, merged by the
  library.

Texts with characters outside a range on which Python's and the library's
character classes were compared (see ``PLAIN_ONLY``), or with a special string,
go through the library as a whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import regex
from tokenizers import Tokenizer

from tessera.llm.pair_merges import PairTable, merge_units
from tessera.llm.tasks import RecentValues

# A character outside the compared range, or the start of a special string.
NOT_PLAIN = re.compile("[^\t-\r -˿‐-‧€]|<\\|")
# Fixed value: the byte-level pattern of the vocabulary.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Fixed value: the split pattern of the word vocabulary.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself, or the next free code point from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in shown else next(free)) for b in range(256)]


#: Bytes of the single-byte characters inside the compared range.
PLAIN_LATIN = bytes([*range(9, 14), *range(32, 256)])
#: Characters of texts whose new runs are merged together.
CHUNK_CHARS = 1_000_000


def is_plain(text: str) -> bool:
    """``NOT_PLAIN`` isn't found in the text."""
    try:
        if not text.encode("latin-1").translate(None, PLAIN_LATIN):
            return "<|" not in text
    except UnicodeEncodeError:
        pass
    return not NOT_PLAIN.search(text)


class WordIds:
    """Texts to ids with a word vocabulary: ids of runs without white space, merged many at a time."""

    def __init__(self, path: str) -> None:
        self.whole = Tokenizer.from_file(path)
        self.parts = regex.compile(WORD_PATTERN)
        self.latin = re.compile(WORD_PATTERN.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9"))
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, made = (np.array([ids[x] for x in column], np.int64) for column in (*zip(*pairs, strict=True), map("".join, pairs)))
        self.table = PairTable(left, right, np.arange(len(pairs)), made)
        self.inner, self.last = (np.array([ids[c + e] for c in byte_alphabet()], np.int32) for e in ("", end))
        self.known = RecentValues()

    def _learn(self, runs: set[str]) -> dict[str, bytes]:
        names = list(runs)
        # A run of letters is a part; most others need no Unicode tables either.
        cut = [(run,) if run.isascii() and run.isalpha() else (self.latin if run.isascii() else self.parts).findall(run) for run in names]
        parts = list(set().union(*cut))
        if not parts:
            return dict.fromkeys(names, b"")
        data = [p.encode() for p in parts]
        lengths = np.fromiter(map(len, data), np.int64, len(data))
        joined = np.frombuffer(b"".join(data), np.uint8)
        starts, ends = self.inner[joined], np.cumsum(lengths) - 1
        starts[ends] = self.last[joined[ends]]
        value = dict(zip(parts, merge_units(starts, lengths, self.table), strict=True))
        return {run: value[own[0]] if len(own) == 1 else b"".join([value[p] for p in own]) for run, own in zip(names, cut, strict=True)}

    def texts(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text, as little-endian uint32 bytes."""
        held: list[list[str] | None] = []
        whole: list[str] = []
        chars = 0

        def encoded() -> Iterator[bytes]:
            values = self.known.of(set().union(*filter(None, held)), self._learn)
            rest = iter(whole)
            for runs in held:
                if runs is None:
                    yield np.array(self.whole.encode(next(rest), add_special_tokens=False).ids, "<u4").tobytes()
                else:
                    yield b"".join(map(values.__getitem__, runs))

        for text in texts:
            if held and chars + len(text) > CHUNK_CHARS:
                yield from encoded()
                held, whole, chars = [], [], 0
            if is_plain(text):
                held.append(text.lower().split())
            else:
                held.append(None)
                whole.append(text)
            chars += len(text)
        yield from encoded()


class BytePieces:
    """Pre-tokens of a text, and the number of tokens of a pre-token."""

    def __init__(self, path: str) -> None:
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.pattern = regex.compile(BYTE_PATTERN)
        self.alphabet = byte_alphabet()
        self.special = {t.content for t in self.whole.get_added_tokens_decoder().values()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")

    def pre_tokens(self, text: str) -> list[str]:
        """Pre-tokens; a special string is a pre-token of its own."""
        if not NOT_PLAIN.search(text):
            return self.pattern.findall(text)
        out: list[str] = []
        for k, segment in enumerate(self.cut.split(text)):
            if k % 2:
                out.append(segment)
            elif segment:
                out += [segment[a:b] for _, (a, b) in self.whole.pre_tokenizer.pre_tokenize_str(segment)]
        return out

    def count(self, pre_token: str) -> int:
        if pre_token in self.special:
            return 1
        return len(self.model.tokenize("".join([self.alphabet[b] for b in pre_token.encode()])))
