"""SentencePiece encoding and decoding over a corpus: shared-prefix forward search.

Texts are marked and cut into words at each mark (no piece reaches over one). The
distinct words of the corpus are sorted, so that consecutive words are a depth-first
walk through their trie, and the forward states of a common prefix are computed once.

* Unigram models: the usual Viterbi scores.
* BPE models: a prefix has exactly one encoding, and its last piece follows from the
  last pieces of shorter prefixes: a piece may follow another if the merges of the two
  together leave the border between them standing. That is a forward pass in which
  forbidden transitions count minus infinity and allowed ones nothing, so it shares
  prefixes in the same way and gives the merges' result.

Blocks of documents keep their words as places in a local vocabulary, so the words of
the corpus are never shuffled, only vocabularies are.
"""

from __future__ import annotations

import re
import string
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.blocks import BLOCK_CHARS, read_tables, unpack, with_values, write_blocks
from tessera.llm.tasks import arrow_batch, worker_store

MARK = "▁"
# Piece types and the penalty of unknown characters in the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0


class Pieces:
    """Pieces of a model, with the forward step of its kind."""

    PAIRS = 400_000

    def __init__(self, pieces: Iterable[tuple[str, float, int]], unigram: bool, dummy_prefix: bool = True) -> None:
        self.pieces = list(pieces)
        self.unigram, self.dummy_prefix = unigram, dummy_prefix
        if any(kind == USER_DEFINED for _, _, kind in self.pieces):
            raise ValueError("models with user-defined pieces are not supported")
        self.ids = {p: k for k, (p, _, kind) in enumerate(self.pieces) if kind == NORMAL}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces with a mark inside are not supported")
        self.longest = max(map(len, self.ids), default=1)
        self.bytes = {int(p[3:5], 16): k for k, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.unknown = next((k for k, (_, _, kind) in enumerate(self.pieces) if kind == UNKNOWN), 0)
        self.unknown_score = min((s for _, s, kind in self.pieces if kind == NORMAL), default=0.0) - UNKNOWN_PENALTY
        joined = self.joined()
        some = "".join(rf"|(?<=[{''.join(map(re.escape, sorted(a)))}]){re.escape(p)}" for p, a in joined.items() if a)
        on = rf"(?:[^\w{MARK}{''.join(map(re.escape, joined))}]{some})"
        other = rf"(?:[^\w{MARK}]|_)*"
        # Marks and other characters, then letters, going on past characters that don't end a word.
        self.words = re.compile(rf"(?=[\s\S]){MARK}*{other}(?:[^\W_]+(?:{on}{other})?)*")
        self.borders: dict[int, bool] = {}
        self.wholes: dict[str, bool] = {}

    @classmethod
    def load(cls, path: str) -> Pieces:
        from sentencepiece import sentencepiece_model_pb2 as format_

        model = format_.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        rules = model.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that leave characters and spaces as they are, with marks before words, are supported")
        return cls(((p.piece, p.score, p.type) for p in model.pieces), model.trainer_spec.model_type == 1, rules.add_dummy_prefix)

    def joined(self) -> dict[str, set[str]]:
        """Punctuation, and the letters and digits that it follows in some piece. After
        all others the border before it always stands, so a word can end there."""
        found: dict[str, set[str]] = {p: set() for p in string.punctuation}
        for piece in self.ids:
            for a, b in zip(piece, piece[1:]):
                if b in found and a.isalnum():
                    found[b].add(a)
        return found

    def mark(self, text: str) -> str:
        return (MARK if text and self.dummy_prefix else "") + text.replace(" ", MARK)

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging: best score first, then leftmost."""
        symbols = list(text)
        while True:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                found = self.ids.get(symbols[k] + symbols[k + 1])
                if found is not None and (best is None or self.pieces[found][1] > best):
                    best, at = self.pieces[found][1], k
            if at < 0:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def whole(self, piece: str) -> bool:
        known = self.wholes.get(piece)
        if known is None:
            known = self.wholes[piece] = len(self.merged(piece)) == 1
        return known

    def border(self, left: str, right: str) -> bool:
        """Do the merges of both together leave the border between them?"""
        a, b = self.ids.get(left), self.ids.get(right)
        key = None if a is None or b is None else a << 32 | b
        known = self.borders.get(key)
        if known is None:
            known = self.merged(left + right) == [left, right]
            if key is not None:
                if len(self.borders) >= self.PAIRS:
                    self.borders.clear()
                self.borders[key] = known
        return known

    def step(self, word: str, starts: list[int], scores: list[float]) -> None:
        """Append the state of the next prefix: where its last piece starts, and its score."""
        end = len(starts)
        if self.unigram:
            best, start = scores[end - 1] + self.unknown_score, end - 1
            for at in range(max(0, end - self.longest), end):
                piece = self.ids.get(word[at:end])
                if piece is not None and scores[at] + self.pieces[piece][1] > best:
                    best, start = scores[at] + self.pieces[piece][1], at
            starts.append(start), scores.append(best)
            return
        for at in range(max(0, end - self.longest), end - 1):
            piece = word[at:end]
            if piece in self.ids and self.whole(piece) and (not at or self.border(word[starts[at] : at], piece)):
                starts.append(at)
                return
        starts.append(end - 1)

    def ids_of(self, word: str, starts: list[int]) -> bytes:
        out: list[int] = []
        end = len(word)
        while end:
            piece = word[starts[end] : end]
            found = self.ids.get(piece)
            if found is not None:
                out.append(found)
            elif self.bytes:
                out += [self.bytes[b] for b in reversed(piece.encode())]
            elif not (self.unigram and out and out[-1] == self.unknown):
                out.append(self.unknown)
            end = starts[end]
        return np.array(out[::-1], "<u4").tobytes()

    def decode_table(self) -> list[bytes | int]:
        """Bytes of each piece; a byte piece is the byte's number."""
        table: list[bytes | int] = []
        for piece, _, kind in self.pieces:
            if kind == BYTE:
                table.append(int(piece[3:5], 16))
            elif kind == CONTROL:
                table.append(b"")
            else:
                table.append((" ⁇ " if kind == UNKNOWN else piece.replace(MARK, " ")).encode())
        return table


class SortedWords:
    """Words in sorted order are a depth-first walk; states of the shared prefix stay."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces, self.last, self.ids = pieces, "", b""
        self.starts, self.scores = [0], [0.0]

    def ids_of(self, word: str) -> bytes:
        last, same = self.last, 0
        if word == last:
            return self.ids
        most = min(len(last), len(word))
        while same < most and word[same] == last[same]:
            same += 1
        del self.starts[same + 1 :], self.scores[same + 1 :]
        while len(self.starts) <= len(word):
            self.pieces.step(word, self.starts, self.scores)
        self.last, self.ids = word, self.pieces.ids_of(word, self.starts)
        return self.ids


def _sequence(units: list[str], known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words in order, plus 1; a word's first occurrence in its block is 0."""
    out = np.empty(len(units), np.uint32)
    for k, unit in enumerate(units):
        place = known.get(unit)
        if place is None:
            known[unit] = len(known)
            out[k] = 0
        else:
            out[k] = place + 1
    return out, np.zeros(0, np.uint32)


def encode(docs: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Ids of every whole text: doc_id, ids, n_pieces, ids_crc32 (of little-endian uint32 ids).

    As the library encodes them, without begin and end. NULL and empty texts have no
    ids. Rows are encoded as they come: repeated rows repeat, NULL ids stay NULL, no
    rows give no rows. A text longer than ``block_chars`` is a block of its own. Other
    columns are ignored.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    load = lambda: worker_store(f"pieces:{model}", lambda: Pieces.load(model))

    def cut() -> Callable[[str], list[str]]:
        pieces = load()
        return lambda text: pieces.words.findall(pieces.mark(text))

    def search() -> Callable[[list[str]], Iterable[bytes]]:
        return lambda words: map(SortedWords(load()).ids_of, words)

    blocks = write_blocks(docs, id_column, text_column, cut, _sequence, block_chars)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                cell = lambda name, row=row: batch.column(name)[row]
                ids, sizes = cell("ids").values, cell("sizes").values.to_numpy()
                places = unpack(cell("first").as_py(), int(sizes.sum()))  # plus 1; 0 is the next new word
                new = places == 0
                places[new] = np.arange(1, np.count_nonzero(new) + 1, dtype=np.uint32)
                values, ends = read_tables(cell("tables").as_py())
                lengths, stops = np.diff(ends), np.cumsum(sizes)
                for first in range(0, len(ids), 256):  # some documents at a time
                    last = min(first + 256, len(ids))
                    own = places[stops[first] - sizes[first] : stops[last - 1]].astype(np.int64) - 1
                    n = lengths[own]
                    after = np.r_[0, np.cumsum(n)]
                    found = values[np.repeat(ends[own] - after[:-1], n) + np.arange(after[-1])].astype("<u4")
                    bounds = after[np.r_[0, np.cumsum(sizes[first:last])]]
                    crcs = [zlib.crc32(found[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
                    yield arrow_batch({"doc_id": ids[first:last], "ids": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(found.view(np.int32))), "n_pieces": pa.array(np.diff(bounds)), "ids_crc32": pa.array(crcs, pa.int64())})

    found = with_values(blocks, search)
    return found.select("ids", "sizes", "first", "tables").mapInArrow(assemble, f"doc_id {kind}, ids array<int>, n_pieces long, ids_crc32 long")


def decode(encoded: DataFrame, model: str, ids_column: str = "ids", into: str = "text") -> DataFrame:
    """Replace the ids by their text (column ``into``); other columns stay.

    NULL and empty lists give the empty text, NULL ids inside a list nothing, ids that
    the model lacks the replacement character, and so do bytes that are no UTF-8.
    """
    kept = [c for c in encoded.columns if c not in (ids_column, into)]
    schema = T.StructType([*(encoded.schema[c] for c in kept), T.StructField(into, T.StringType())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = worker_store(f"pieces:{model}", lambda: Pieces.load(model))
        table = [bytes([p]) if isinstance(p, int) else p for p in pieces.decode_table()]
        nothing, lost = len(table), len(table) + 1
        table += [b"", "\ufffd".encode()]

        def texts_of(lists: pa.ListArray) -> Iterator[str]:
            """Some lists at a time: as Python numbers they are large."""
            for first in range(0, len(lists), 256):
                part = lists[first : first + 256]
                ids = part.flatten().fill_null(nothing).to_numpy().astype(np.int64)
                ids = np.where((ids >= 0) & (ids <= nothing), ids, lost)
                ends = np.cumsum(part.value_lengths().fill_null(0).to_numpy())
                for a, b in zip([0, *ends], ends, strict=False):
                    text = b"".join([table[i] for i in ids[a:b].tolist()]).decode("utf-8", "replace")
                    yield text[1:] if pieces.dummy_prefix and text.startswith(" ") else text

        for batch in batches:
            texts = list(texts_of(batch.column(ids_column)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], names=[*kept, into])

    return encoded.select(*kept, ids_column).mapInArrow(join, schema)
