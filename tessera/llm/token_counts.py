"""Token counts of whole texts without materialising token ids.

A text is a bag of pre-tokens, and its number of tokens is a sum over the bag. Blocks of
documents (see ``blocks``) keep a local vocabulary and a sparse matrix of documents x
pre-tokens. Each distinct pre-token is merged once, its number of pieces is joined back
to the blocks, and each block's matrix is multiplied by its vector of counts. Neither
ids nor (document, pre-token) rows are ever shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.blocks import BLOCK_CHARS, read_tables, unpack, with_values, write_blocks
from tessera.llm.tasks import arrow_batch, worker_store
from tessera.llm.tokens import BytePieces


def _bag(units: list[str], known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places as differences, and how often each occurs."""
    bag = Counter(units)
    for unit in bag:
        if unit not in known:
            known[unit] = len(known)
    places = np.fromiter(map(known.__getitem__, bag), np.uint32, len(bag))
    order = np.argsort(places)
    return np.diff(places[order], prepend=np.uint32(0)), np.fromiter(bag.values(), np.uint32, len(bag))[order]


def token_counts(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", limit: int = 512, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Special strings inside a text count as one token each, as the library has it by
    default. NULL and empty texts have 0 bytes and 0 tokens. Rows are counted as they
    come: repeated rows repeat, NULL ids stay NULL, no rows give no rows. A text
    longer than ``block_chars`` is a block of its own and is counted whole. Other
    columns are ignored.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    pieces = lambda: worker_store(f"bytes:{tokenizer}", lambda: BytePieces(tokenizer))

    def count() -> Callable[[list[str]], Iterable[bytes]]:
        model = pieces()

        def values(pre_tokens: list[str]) -> Iterator[bytes]:
            """Pieces of each pre-token; equal ones follow each other and are merged once."""
            last, n = None, b""
            for p in pre_tokens:
                if p != last:
                    last, n = p, model.count(p).to_bytes(4, "little")
                yield n

        return values

    blocks = write_blocks(docs, id_column, text_column, lambda: pieces().pre_tokens, _bag, block_chars)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                cell = lambda name, row=row: batch.column(name)[row]
                sizes = cell("sizes").values.to_numpy()
                ends = np.r_[0, np.cumsum(sizes)]
                steps, often = (unpack(cell(c).as_py(), int(ends[-1])).astype(np.int64) for c in ("first", "second"))
                running = np.r_[0, np.cumsum(steps)]
                places = running[1:] - np.repeat(running[ends[:-1]], sizes)
                vector, _ = read_tables(cell("tables").as_py())
                total = np.r_[0, np.cumsum(vector[places] * often if len(places) else places)]
                n_tokens = np.diff(total[ends])
                yield arrow_batch({"doc_id": cell("ids").values, "n_bytes": cell("n_bytes").values, "n_tokens": pa.array(n_tokens), "over_limit": pa.array(n_tokens > limit)})

    return with_values(blocks, count).select("ids", "n_bytes", "sizes", "first", "second", "tables").mapInArrow(add_up, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
