"""Near-duplicate documents: MinHash bands, sequential Bayesian pruning, exact checks.

1. Documents with equal shingle sets fold into one class; only classes go on.
2. Bands of the signature put classes into buckets. Every member of a bucket is
   paired with the bucket's first class only, never with all others.
3. A pair's signatures are compared batch by batch. Under a uniform prior the
   similarity given m agreements of n has a Beta(m + 1, n - m + 1) posterior; the pair
   is dropped when the posterior chance of reaching the threshold falls below the miss
   probability. Survivors are checked on their full shingle sets.
4. Links make components. Where a bucket still holds several components, its other
   pairs across components are worked off in bounded blocks of members, by the same
   pruning and exact checks; a task reports only links that join components.
5. The two sets of links together give the final components.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.filters import bit_filter, filter_position, may_hold
from tessera.llm.shingles import HASHES, MinHasher, WordHashes, overlap, shingle_set, words_of
from tessera.llm.tasks import arrow_batch, byte_texts, row_slices, worker_store
from tessera.session import materialize

PERCENT = 85
BANDS, ROWS = 25, 5  # misses 4e-7 of the pairs at 0.85
BATCH = 16
MISS = 1e-6
#: Shingles of a block of a bucket: two blocks are what one task holds of it at a time.
BLOCK = 1 << 21


def least_agreements(threshold: float, miss: float, hashes: int = HASHES, batch: int = BATCH) -> list[tuple[int, int]]:
    """(n, fewest agreements of n to go on) after each batch.

    The posterior Beta(m + 1, n - m + 1) lies above t with the probability that a
    Binomial(n + 1, t) is at most m.
    """
    out = []
    for n in range(batch, hashes + 1, batch):
        above, m = 0.0, -1
        while above < miss:
            m += 1
            above += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def surviving(x: np.ndarray, y: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """Places of the signature pairs (rows of x and y) that no batch prunes."""
    alive = np.arange(len(x))
    agree, done = np.zeros(len(x), np.int64), 0
    for n, least in bounds:
        agree = agree + (x[alive, done:n] == y[alive, done:n]).sum(axis=1)
        stay = agree >= least
        alive, agree, done = alive[stay], agree[stay], n
    return alive


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on sorted distinct arrays."""
    common = overlap(x, y)
    return 100 * common >= percent * (len(x) + len(y) - common)


def _classes(docs: DataFrame, id_column: str, text_column: str, row_column: str | None) -> DataFrame:
    """row, doc_id, n, hi, lo (128 bits that name the shingle set), signature."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, signer = worker_store("word_hashes", WordHashes), MinHasher()
        row = TaskContext.get().partitionId() << 40
        for batch in (part for whole in batches for part in row_slices(whole, 1024)):
            sets = [shingle_set(words_of(t), hashes) for t in byte_texts(batch.column(1))]
            names = [set_name(s) for s in sets]
            yield arrow_batch({
                "row": batch.column(2) if row_column else pa.array(range(row, row + len(sets)), pa.int64()), "doc_id": batch.column(0), "n": pa.array([len(s) for s in sets], pa.int64()),
                "hi": pa.array([n[0] for n in names], pa.int64()), "lo": pa.array([n[1] for n in names], pa.int64()),
                "signature": pa.array([signer(s).tobytes() if len(s) else None for s in sets], pa.binary()),
            })
            row += len(sets)

    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"), *([F.col(row_column)] if row_column else []))
    kind = source.schema["doc_id"].dataType.simpleString()
    return materialize(source.mapInArrow(sign, f"row long, doc_id {kind}, n long, hi long, lo long, signature binary"), "signatures")


def set_name(shingles: np.ndarray) -> tuple[int, int]:
    """128-bit hash of a shingle set as two signed longs."""
    hi, lo = np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), np.int64)
    return int(hi), int(lo)


def _buckets(classes: DataFrame) -> DataFrame:
    """(bucket, node, n) for each band of each class; n is the size of its set."""

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes = batch.column("node").to_numpy(), batch.column("n")
            signatures = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(len(nodes), HASHES)
            for b in range(BANDS):
                own = np.ascontiguousarray(signatures[:, b * ROWS : (b + 1) * ROWS])
                keys = np.array([xxhash.xxh3_64_intdigest(r, b) for r in own], np.uint64).view(np.int64)
                yield arrow_batch({"bucket": pa.array(keys), "node": pa.array(nodes), "n": sizes})

    return materialize(classes.select("node", "n", "signature").mapInArrow(band, "bucket long, node long, n long"), "buckets")


def _sets(docs: DataFrame, id_column: str, text_column: str, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles) of the given classes, made anew from their texts.

    A bit filter on the id leaves out most other documents where they are read, so no
    text is shuffled; the name of the set then decides.
    """
    wanted = materialize(classes.select("node", "doc_id", "hi", "lo").join(nodes, "node", "left_semi"), "wanted")
    packed = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted.select(filter_position(F.col("doc_id")))))

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = worker_store("word_hashes", WordHashes), set()
        for batch in (part for whole in batches for part in row_slices(whole)):
            stay = pa.array(may_hold(packed.value, batch.column(0).to_numpy()))
            out = []
            for text in byte_texts(batch.column(1).filter(stay)):
                own = shingle_set(words_of(text), hashes)
                name = set_name(own)
                if name not in seen:
                    seen.add(name)
                    out.append((*name, own.tobytes()))
            hi, lo, shingles = zip(*out, strict=True) if out else ((), (), ())
            yield arrow_batch({"hi": pa.array(hi, pa.int64()), "lo": pa.array(lo, pa.int64()), "shingles": pa.array(shingles, pa.binary())})

    source = docs.select(filter_position(F.col(id_column)).alias("place"), F.col(text_column).cast("string").alias("text"))
    made = source.mapInArrow(shingle, "hi long, lo long, shingles binary")
    return materialize(made.join(wanted.select("node", "hi", "lo"), ["hi", "lo"]).select("node", "shingles"), "shingle-sets")


def _verify(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, bounds: list[tuple[int, int]]) -> DataFrame:
    """The pairs (a, b) that are linked: pruned by signatures, then compared in full."""
    left = classes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("signature").alias("s_a"))
    right = classes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("signature").alias("s_b"))
    sized = pairs.join(left, "a").join(right, "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, HASHES) for c in ("s_a", "s_b"))
            stay = pa.array(surviving(x, y, bounds))
            yield arrow_batch({"a": batch.column("a").take(stay), "b": batch.column("b").take(stay)})

    likely = materialize(sized.select("a", "b", "s_a", "s_b").mapInArrow(prune, "a long, b long"), "candidates")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in row_slices(whole)):
            x, y = (batch.column(c).to_pylist() for c in ("x", "y"))
            same = pa.array([linked(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), percent) for p, q in zip(x, y, strict=True)])
            yield arrow_batch({"a": batch.column("a").filter(same), "b": batch.column("b").filter(same)})

    full = likely.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return materialize(full.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"), "verified")


def _across(mixed: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, bounds: list[tuple[int, int]], block: int) -> DataFrame:
    """Links between components (bucket, node, label, shingles) inside buckets that hold several.

    A bucket's members are dealt to blocks by a hash of their node, as many as its
    shingles need; a task gets the members of one pair of blocks.
    """
    blocks = F.ceil(F.col("shingles") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    dealt = mixed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "label")
    rows = dealt.join(classes.select("node", "n", "signature"), "node").join(sets, "node")

    def compare(key, group: pd.DataFrame) -> pd.DataFrame:
        _, i, j = key
        group = group.sort_values(["n", "node"], ignore_index=True)
        nodes, n, sides = group["node"].to_numpy(), group["n"].to_numpy(), group["own"].to_numpy()
        signatures = np.frombuffer(b"".join(group["signature"]), np.uint32).reshape(len(group), HASHES)
        sets = [np.frombuffer(s, np.uint64) for s in group["shingles"]]
        _, label = np.unique(group["label"].to_numpy(), return_inverse=True)
        found = []
        for k in range(len(group)):
            # Later rows are at least as long; those too long for the threshold go.
            end = int(np.searchsorted(n, n[k] * 100 // percent, "right"))
            others = np.arange(k + 1, max(end, k + 1))
            others = others[label[others] != label[k]]
            if i != j:
                others = others[sides[others] != sides[k]]
            if not len(others):
                continue
            others = others[surviving(np.broadcast_to(signatures[k], (len(others), HASHES)), signatures[others], bounds)]
            for other in others:
                if label[other] != label[k] and linked(sets[k], sets[other], percent):
                    found.append((nodes[k], nodes[other]))
                    label[label == label[other]] = label[k]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return materialize(rows.groupBy("bucket", "i", "j").applyInPandas(compare, "a long, b long"), "links-across")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = PERCENT, miss: float = MISS, block: int = BLOCK, row_column: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Words are runs without ASCII white space, A-Z lower-cased; a document's set is its
    distinct 5-word shingles (as 64-bit hashes), with fewer words the whole sequence. Documents are linked
    when 100 * intersection >= percent * union. component_id is the smallest id that
    links reach, and kept says whether the document has it. Documents without words,
    and NULL texts, are alone. A NULL id is larger than any other; a component of NULL
    ids has none and keeps none of them but where it is a single document. Rows that
    repeat an id are documents of their own, and with the smallest id all are kept. No
    rows give no rows; other columns are ignored. Where ``row_column`` has numbers of
    the rows, the result also has row and keep_row, the number of the one row of the
    component that stays: of those with the smallest id the first.
    """
    bounds = least_agreements(percent / 100, miss)
    rows = _classes(docs, id_column, text_column, row_column)
    named = rows.where("n > 0").groupBy("hi", "lo").agg(F.min("row").alias("node"), F.count("*").alias("copies"))
    named = materialize(named, "classes")
    classes = materialize(rows.join(named.select("hi", "lo", "node"), ["hi", "lo"]).where("row = node").select("node", "doc_id", "n", "hi", "lo", "signature"), "class-signatures")

    buckets = _buckets(classes)
    first = materialize(buckets.groupBy("bucket").agg(F.min("node").alias("first"), F.count("*").alias("members"), F.sum("n").alias("shingles")).where("members > 1"), "shared-buckets")
    crowded = materialize(buckets.drop("n").join(first, "bucket"), "crowded")
    sets = _sets(docs, id_column, text_column, classes, crowded.select("node").distinct())

    pairs = crowded.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    stars = _verify(pairs, classes, sets, percent, bounds)
    labels = components(stars)
    members = crowded.where("members > 2").join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"), "shingles")
    members = materialize(members, "labelled")
    several = members.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket")
    mixed = materialize(members.join(several, "bucket", "left_semi"), "mixed")
    across = _across(mixed, classes, sets, percent, bounds, block)
    final = materialize(components(stars.union(across)), "components")

    placed = rows.select("row", "doc_id", "n", "hi", "lo").join(named.select("hi", "lo", "node"), ["hi", "lo"], "left").join(final, "node", "left")
    placed = placed.withColumn("group", F.when(F.col("n") > 0, F.coalesce("label", "node")).otherwise(F.col("row")))
    stays = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")).alias("stays")
    least = placed.groupBy("group").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("size"), *([stays] if row_column else []))
    least = materialize(least, "least-ids")
    return placed.join(least, "group").select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", (F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("size") == 1)).alias("kept"),
        *([F.col("row"), F.col("stays.row").alias("keep_row")] if row_column else []),
    )
