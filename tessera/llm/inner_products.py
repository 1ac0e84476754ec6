"""Exact top-k inner products: norm order, rotated partial sums, residual bounds.

Candidates are ordered by descending length and dealt to slices of bounded size.
Queries come in blocks. The slice of the longest vectors goes first and gives every
query a score to beat, and with it the length that a vector needs at least. Later slices
follow in rounds of twice as many each; before a round queries are dealt to blocks by the
length that they need, and a block meets a slice, in a task of its own, only if the
slice's longest vector has the length that one of the block's queries needs. There, chunks whose longest vector can't reach the score to beat end the
work; in the others the product of the leading coordinates, after a rotation that
gathers most of the variance in them, plus the product of the remaining lengths
(Cauchy-Schwarz) bounds the score, and only what may pass is multiplied out in
integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.tasks import arrow_batch
from tessera.session import materialize

K = 10
QUERY_BLOCK, SLICE, CHUNK = 512, 16384, 1024
HEAD = 16


def scale_floor(embedding: Column, scale: int = 1024) -> Column:
    """floor(scale * component) as integers."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def usable(embedding: Column) -> Column:
    """Not NULL, and no component NULL or not finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return embedding.isNotNull() & F.forall(embedding, finite)


def _matrix(blobs, width: int) -> np.ndarray:
    """Integer vectors (rows), zeros after the end of shorter ones."""
    blobs = list(blobs)
    if all(len(b) == 8 * width for b in blobs):
        return np.frombuffer(b"".join(blobs), np.int64).reshape(-1, width)
    out = np.zeros((len(blobs), width), np.int64)
    for row, blob in zip(out, blobs, strict=True):
        own = np.frombuffer(blob, np.int64)
        row[: len(own)] = own
    return out


def best_of(queries: np.ndarray, query_ids: np.ndarray, least: np.ndarray, ids: np.ndarray, vectors: np.ndarray, rotation: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, id, score) of up to k best candidates of each query with a score of at least ``least``."""
    order = np.argsort(-(vectors.astype(np.float64) ** 2).sum(axis=1), kind="stable")
    ids, vectors = ids[order], vectors[order]
    q, c = queries @ rotation, vectors @ rotation
    tail = lambda x: np.sqrt((x[:, HEAD:] ** 2).sum(axis=1))
    q_tail, c_tail, q_norm, c_norm = tail(q), tail(c), np.sqrt((q**2).sum(axis=1)), np.sqrt((c**2).sum(axis=1))
    beat = least.astype(np.float64).copy()
    top = (np.empty(0, np.int64),) * 3
    for at in range(0, len(ids), CHUNK):
        own = slice(at, at + CHUNK)
        slack = 1e-9 * q_norm * c_norm[at] + 1e-6  # rounding of the rotation
        open_ = np.flatnonzero(q_norm * c_norm[at] + slack >= beat)
        if not len(open_):
            break  # every later vector is shorter
        bound = q[open_, :HEAD] @ c[own, :HEAD].T + q_tail[open_, None] * c_tail[None, own]
        row, col = np.nonzero((bound + slack[open_, None] >= beat[open_, None]) & (query_ids[open_, None] != ids[None, own]))
        row, col = open_[row], col + at
        score = np.einsum("ij,ij->i", queries[row], vectors[col]) if len(row) else np.empty(0, np.int64)
        row, found, score = (np.r_[a, b] for a, b in zip(top, (row, ids[col], score), strict=True))
        order = np.lexsort((found, -score, row))
        row, found, score = row[order], found[order], score[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        top = tuple(x[rank < k] for x in (row, found, score))
        n = np.bincount(top[0], minlength=len(queries))
        last = np.cumsum(n) - 1
        full = n >= k
        beat[full] = np.maximum(beat[full], top[2][last[full]])
    return top


def top_inner_products(vectors: DataFrame, is_query: Column, id_column: str = "vec_id", vector_column: str = "embedding", k: int = K, scale: int = 1024, query_block: int = QUERY_BLOCK, slice_rows: int = SLICE) -> DataFrame:
    """The k highest integer inner products of each query: query_id, rank, vec_id, score.

    Components become floor(scale * x). Candidates are all rows but those with the
    query's own id; ties go to the smaller id. Vectors that are NULL or hold NULL or
    non-finite components, and rows without an id, take no part. Shorter vectors
    count as filled up with zeros. Queries that repeat an id with the same vector are
    one query; candidates that repeat are candidates each. With fewer candidates than
    k all are returned; without queries no rows. Other columns are ignored. A vector of
    length 2^31 or more, with which a score might leave 64 bits, is an error.
    """
    spark = vectors.sparkSession
    whole = scale_floor(F.col(vector_column), scale)
    square = F.aggregate("whole", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = (
        vectors.where(usable(F.col(vector_column)) & F.col(id_column).isNotNull())
        .select(F.col(id_column).cast("long").alias("id"), whole.alias("whole"), F.coalesce(is_query, F.lit(False)).alias("query"))
        .withColumn("norm", F.sqrt(square))
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [np.array(v, np.int64).tobytes() for v in batch.column("whole").to_pylist()]
            yield arrow_batch({"id": batch.column("id"), "query": batch.column("query"), "norm": batch.column("norm"), "data": pa.array(blobs, pa.binary())})

    # No score is larger than the product of the two greatest lengths.
    fits = F.col("norm") < float(2**31)
    rows = rows.withColumn("norm", F.when(fits, F.col("norm")).otherwise(F.raise_error(F.lit("a vector is too long for scores of 64 bits"))))
    rows = materialize(rows.mapInArrow(pack, "id long, query boolean, norm double, data binary"), "vectors")
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.length("data")), F.lit(0)).alias("bytes"), F.sum(F.col("query").cast("long")).alias("queries")).first()
    width = max(1, size["bytes"] // 8)
    n_slices, n_blocks = max(1, -(-size["n"] // slice_rows)), max(1, -(-(size["queries"] or 0) // query_block))
    rotation = spark.sparkContext.broadcast(_rotation(rows, width))  # width x width

    dealt = rows.repartitionByRange(n_slices, F.desc("norm"), "id").withColumn("slice", F.spark_partition_id())
    dealt = materialize(dealt.select("slice", "id", "norm", "data"), "slices")
    reach = materialize(dealt.groupBy("slice").agg(F.max("norm").alias("longest")), "reach")
    queries = materialize(
        rows.where("query").select("id", "norm", "data").distinct().select(F.col("id").alias("query_id"), "norm", "data", F.xxhash64("id", "data").alias("q"), F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int").alias("block")),
        "queries",
    )

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Queries (left) against a slice (right)."""
        if not len(left) or not len(right):
            return pd.DataFrame({"q": pd.Series(dtype="int64"), "query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
        least = left["least"].fillna(-(2**62)).to_numpy(np.float64)
        place, ids, score = best_of(_matrix(left["data"], width), left["query_id"].to_numpy(), least, right["id"].to_numpy(), _matrix(right["data"], width), rotation.value, k)
        return pd.DataFrame({"q": left["q"].to_numpy()[place], "query_id": left["query_id"].to_numpy()[place], "vec_id": ids, "score": score})

    def against(asks: DataFrame, pairs: DataFrame) -> DataFrame:
        """Each query block meets its slices of ``pairs``, one task a pair."""
        left = asks.join(pairs, "block").where(F.col("longest") >= F.col("needs")).select("block", "slice", "q", "query_id", "least", "data")
        right = dealt.join(pairs.select("block", "slice"), "slice").select("block", "slice", "id", "data")
        return left.groupBy("block", "slice").cogroup(right.groupBy("block", "slice")).applyInPandas(search, "q long, query_id long, vec_id long, score long")

    def leading(found: DataFrame) -> DataFrame:
        best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    asks = queries.withColumns({"least": F.lit(None).cast("long"), "needs": F.lit(-1.0)})
    found = materialize(against(asks, materialize(open_pairs(asks, reach, 0, 1), "pairs")), "longest")
    at = 1
    while at < n_slices:
        best = materialize(leading(found), "leading")
        beat = best.where(F.col("rank") == k).select("q", F.col("score").alias("least"))
        asks = queries.drop("block").join(beat, "q", "left").withColumn("needs", needed_length(F.col("least"), F.col("norm")))
        asks = materialize(asks.repartitionByRange(n_blocks, "needs", "q").withColumn("block", F.spark_partition_id()), "asks")
        pairs = materialize(open_pairs(asks, reach, at, min(2 * at, n_slices)), "pairs")
        if pairs.isEmpty():
            break  # the slices behind hold shorter vectors still
        found = materialize(best.drop("rank").union(against(asks, pairs)), "found")
        at *= 2
    return leading(found).select("query_id", "rank", "vec_id", "score")


def needed_length(least: Column, norm: Column) -> Column:
    """Length below which no vector's product with a query of length ``norm`` comes to
    ``least``; -1 if any vector's may. Slack covers the rounding of lengths."""
    return F.coalesce(F.when(norm > 0, (least.cast("double") - 1e-6) / (norm * (1 + 1e-9))), F.lit(-1.0))


def open_pairs(asks: DataFrame, reach: DataFrame, first: int, end: int) -> DataFrame:
    """(block, slice, longest) for the slices from ``first`` to before ``end`` that can
    hold what one of a block's queries needs. Only numbers of blocks and slices are paired."""
    blocks = asks.groupBy("block").agg(F.min("needs").alias("least_needed"))
    numbered = blocks.withColumn("slice", F.explode(F.sequence(F.lit(first), F.lit(end - 1))))
    return numbered.join(reach, "slice").where(F.col("longest") >= F.col("least_needed")).select("block", "slice", "longest")


def _rotation(rows: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of all vectors, by falling singular value.

    They are the eigenvectors of the sum of outer products, which tasks sum up first:
    width x width numbers reach the driver.
    """

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            m = _matrix(batch.column("data").to_pylist(), width).astype(np.float64)
            total += m.T @ m
        yield arrow_batch({"row": pa.array(range(width), pa.int32()), "sums": pa.array(list(total), pa.list_(pa.float64()))})

    cells = rows.select("data").mapInArrow(outer, "row int, sums array<double>").select("row", F.posexplode("sums").alias("col", "x"))
    total = np.zeros((width, width))
    for r in cells.groupBy("row", "col").agg(F.sum("x").alias("x")).collect():
        total[r["row"], r["col"]] = r["x"]
    _, directions = np.linalg.eigh((total + total.T) / 2)
    return np.ascontiguousarray(directions[:, ::-1])
