"""Byte-level BPE: whole texts to token ids, and ids back to bytes.

A pattern cuts texts into units that merges never cross. The units that a worker
hasn't met lately are merged together on padded matrices (see ``pair_merges``); the
others are looked up. Documents never leave the task that reads them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.pair_merges import byte_pairs, merge_units, read_ranks
from tessera.llm.tasks import RecentValues, arrow_batch, row_slices, str_texts, worker_store

#: Characters of texts whose units are merged together, and units of a longer text at a time.
CHUNK_CHARS, CHUNK_UNITS = 1_000_000, 250_000

# Letters and numbers of the regex module's Unicode version that the
# pattern's own version doesn't have, as ranges of a character class.
NEW_LETTERS = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d\U000107bb-\U000107bf"
    "\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011df1\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3"
    "\U00016ff2-\U00016ff3\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2"
    "\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    "\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e"
    "\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
NEW_NUMBERS = (
    "\U00011de0-\U00011de9\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ff4-\U00016ff6"
)


def spelled(pattern: str, members: dict[str, str]) -> str:
    """The pattern with named classes (\\s, \\p{L} ...) replaced by their members; \\S is what \\s isn't."""
    out, inside = [], False
    for piece in re.findall(r"\\p\{\w+\}|\\.|.", pattern, re.S):
        if piece in members:
            out.append(members[piece] if inside else f"[{members[piece]}]")
        elif piece == r"\S" and not inside:
            out.append(rf"[^{members[chr(92) + 's']}]")
        else:
            inside = piece == "[" or inside and piece != "]"
            out.append(piece)
    return "".join(out)


class ByteEncoder:
    """Texts to ids with a file of ranks and the pattern that cuts texts into units."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks = read_ranks(path)
        self.table = byte_pairs(self.ranks)
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.pattern = regex.compile(pattern)
        older = {r"\s": r"\s", r"\p{L}": rf"[\p{{L}}--[{NEW_LETTERS}]]", r"\p{N}": rf"[\p{{N}}--[{NEW_NUMBERS}]]"}
        self.older, self.newer = regex.compile(spelled(pattern, older), regex.V1), re.compile(f"[{NEW_LETTERS}{NEW_NUMBERS}]")
        # Texts of single-byte characters need no Unicode tables.
        latin = {name: "".join(re.escape(chr(c)) for c in range(256) if regex.match(name, chr(c))) for name in older}
        self.latin = re.compile(spelled(pattern, latin))
        self.known = RecentValues(150_000)

    def cut(self, text: str) -> re.Pattern | regex.Pattern:
        """The pattern for this text, in the form that is fastest for its characters."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.older if self.newer.search(text) else self.pattern
        return self.latin

    def _learn(self, units: set[str]) -> dict[str, bytes]:
        """Ids of units, as bytes; a unit that is a token as a whole is that token."""
        out, merging = {}, []
        for unit in units:
            data = unit.encode()
            rank = self.ranks.get(data)
            if rank is None:
                merging.append((unit, data))
            else:
                out[unit] = rank.to_bytes(4, "little")
        if merging:
            names, data = zip(*merging, strict=True)
            lengths = np.fromiter(map(len, data), np.int64, len(data))
            out.update(zip(names, merge_units(self.bytes[np.frombuffer(b"".join(data), np.uint8)], lengths, self.table), strict=True))
        return out

    def encode(self, lists: list[list[str]]) -> list[bytes]:
        """Ids (little-endian uint32) of each list of units."""
        known = self.known
        values = known.of(set().union(*lists), self._learn)
        return [b"".join(map(values.__getitem__, units)) for units in lists]

    def texts(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text, a bounded number of characters at a time."""
        lists: list[list[str]] = []
        chars = 0
        for text in texts:
            if lists and chars + len(text) > CHUNK_CHARS:
                yield from self.encode(lists)
                lists, chars = [], 0
            if len(text) <= CHUNK_CHARS:
                lists.append(self.cut(text).findall(text))
                chars += len(text)
                continue
            found = (m.group() for m in self.cut(text).finditer(text))
            yield b"".join(self.encode([part])[0] for part in iter(lambda: list(islice(found, CHUNK_UNITS)), []))
        if lists:
            yield from self.encode(lists)


def _in_parts(rows: Iterator[tuple], names: tuple[str, ...], kinds: tuple[pa.DataType, ...], limit: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Batches of the rows that hold about ``limit`` bytes in their last column."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= limit:
            yield arrow_batch({n: pa.array(c, k) for n, c, k in zip(names, zip(*held, strict=True), kinds, strict=True)})
            held, size = [], 0
    if held:
        yield arrow_batch({n: pa.array(c, k) for n, c, k in zip(names, zip(*held, strict=True), kinds, strict=True)})


def encode(docs: DataFrame, ranks: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (little-endian uint32 in a binary).

    No special tokens: their strings in a text are ordinary text. NULL and empty texts
    have no ids. Rows are encoded as they come: repeated rows repeat, NULL ids stay NULL,
    no rows give no rows. Long texts are encoded whole, in parts of bounded size. Other
    columns are ignored.
    """
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_store(f"ranks:{ranks}:{pattern}", lambda: ByteEncoder(ranks, pattern))
        for batch in batches:
            parts = (zip(b.column(0).to_pylist(), encoder.texts(str_texts(b.column(1))), strict=True) for b in row_slices(batch))
            rows = ((i, len(ids) // 4, ids) for i, ids in chain.from_iterable(parts))
            yield from _in_parts(rows, ("doc_id", "n_tokens", "ids"), (batch.schema.field(0).type, pa.int64(), pa.binary()))

    return source.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """Rows of ``encode`` with ``decoded``, the bytes that their ids stand for, added.

    Ids that the ranks don't have are an error; NULL ids decode to no bytes.
    """
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = worker_store(f"tokens:{ranks}", lambda: {rank: token for token, rank in read_ranks(ranks).items()})
        for batch in batches:
            rows = (
                (i, n, ids, b"".join(map(tokens.__getitem__, np.frombuffer(ids or b"", "<u4").tolist())))
                for b in row_slices(batch)
                for i, n, ids in zip(*(c.to_pylist() for c in b.columns), strict=True)
            )
            yield from _in_parts(rows, ("doc_id", "n_tokens", "ids", "decoded"), (batch.schema.field(0).type, pa.int64(), pa.binary(), pa.binary()))

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, decoded binary")
