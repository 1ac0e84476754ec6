"""Exact cosine neighbours and distance sums over an embedding table.

Neighbours: rows are dealt to tiles around pivots. A tile is known by its pivot, its
size and its radius, and on the sphere these bound every similarity between two tiles
(triangle inequality). From the bounds alone follows which candidate tiles can hold one
of the ``m`` nearest rows of a query tile; only their vectors are sent to it, so a tile
pair that is ruled out costs nothing but the comparison of its bounds. A task streams
the surviving candidates past its queries, nearest tiles first, and skips what its
results have outgrown.

Distance sums need every pair. Queries are hashed into blocks of bounded size, and a
task streams all candidates past a block; each vector is sent once per block.

Only the best ``m`` of each query and cell - or one distance sum per cluster - leave a
task: what is written grows with the rows, not with their square.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.operators.ranking import _join_on
from tessera.session import materialize

BLOCK_ROWS = 16384
#: Pivots, and rows to choose them from: what the driver collects of the vectors.
PIVOTS, PIVOT_SAMPLE = 256, 2048
TILE, BOUND = "__tile", "__bound"
#: Bounds on similarities are widened by this: rounding of angles and of similarities.
SLACK = 1e-6
LEAST_BLOCK = 256
BLOCKS_PER_CORE = 2
CELL_NUMBER = "__cell"
WINDOW_EXTRA = 64  # fixed value: extra candidates looked at beyond k
SIM_DIGITS = 9  # similarities are compared after rounding, ties go to the lower id
_TILE = 512
#: Rows that a task holds where it merges what a query tile found in all cells.
HELD_ROWS = 1 << 23


def _matrix(column: pa.ChunkedArray, unit: bool = True) -> np.ndarray:
    """Vectors of a list column as rows, by default scaled to unit length."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    matrix = flat.astype(np.float64).reshape(len(column), -1)
    if not unit:
        return matrix
    return matrix / (np.sqrt((matrix * matrix).sum(axis=1, keepdims=True)) + 1e-12)


def _best_per_row(sims: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, similarity) of the m largest entries of each row; equal
    values are taken in column order."""
    m = min(m, sims.shape[1])
    kth = np.partition(-sims, m - 1, axis=1)[:, m - 1 : m]
    rows, cols = np.nonzero(-sims <= kth)
    values = sims[rows, cols]
    order = np.lexsort((cols, -values, rows))
    rows, cols, values = rows[order], cols[order], values[order]
    starts = np.searchsorted(rows, np.arange(sims.shape[0]))
    keep = np.arange(len(rows)) - starts[rows] < m
    return rows[keep], cols[keep], values[keep]


def _reaching(sims: np.ndarray, floor: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, rounded similarity) of entries that may be among a row's m largest so far.

    Where every row knows what its m-th reaches, only entries that reach it are looked at
    again; the others, nearly all, are neither rounded nor ranked.
    """
    if floor.min() > -2.0:
        rows, cols = np.nonzero(sims >= floor[:, None] - SLACK)
        if len(rows) <= 2 * m * len(sims):
            return rows, cols, np.round(sims[rows, cols], SIM_DIGITS)
    return _best_per_row(np.round(sims, SIM_DIGITS), m)


def _tasks(spark: SparkSession) -> tuple[int, int]:
    """Tasks of a shuffle, and blocks that keep all cores busy.

    Each candidate is sent once per block, so blocks are as many as cores need, not as
    shuffles have partitions: those grow with the rows, and what is sent with the product.
    """
    cores = spark.sparkContext.defaultParallelism
    return max(cores, int(spark.conf.get("spark.sql.shuffle.partitions"))), BLOCKS_PER_CORE * cores


class Merge(Protocol):
    """What becomes, inside the task, of the nearest rows of a query tile in all cells."""

    schema: T.StructType

    def pack(self, queries: pa.Table, best: pa.Table) -> pa.Table:
        """What is held of one cell; ``best`` has __row (of the query), __sim, the id and what is carried."""

    def close(self, queries: pa.Table, parts: list[pa.Table]) -> pa.Table: ...


class _Fold(Protocol):
    """Work of one query block that meets its candidates batch by batch."""

    def add(self, candidates: pa.Table) -> None: ...

    def result(self) -> pa.Table: ...


def _fold_blocks(
    df: DataFrame,
    id_col: str,
    cells: Sequence[str],
    block_rows: int,
    schema: T.StructType,
    begin: Callable[[pa.Table], _Fold],
    own_cell: bool = False,
) -> DataFrame:
    """Result of ``begin(query block)`` after it has seen all candidates of a cell;
    of its own cell only if ``own_cell``.

    A task streams the candidates of a cell past one block of queries at a time. What
    it holds is the block, its running result and one batch, and only the final result
    leaves it: its size doesn't depend on how many candidates there are.
    """
    spark = df.sparkSession
    counts = df.groupBy(*cells).agg(F.count(F.lit(1)).alias("__n"))
    numbered = counts.withColumn(CELL_NUMBER, F.row_number().over(Window.orderBy(*(cells or [F.lit(0)]))) - 1)
    total = numbered.agg(F.sum("__n").alias("n"), F.count(F.lit(1)).alias("cells")).first()
    n, n_cells = int(total["n"] or 0), max(1, int(total["cells"]))
    # Blocks of at most block_rows, and enough of them to keep the cluster busy.
    tasks, wide = _tasks(spark)
    blocks = max(1, -(-n // block_rows), min(-(-wide // n_cells), -(-n // LEAST_BLOCK)))
    own = F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int")
    columns = df.columns

    def upto(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    placed = _join_on(df, numbered.drop("__n"), cells) if cells else df.withColumn(CELL_NUMBER, F.lit(0))
    meets = F.col(CELL_NUMBER) if own_cell else upto(n_cells)
    queries = (placed if own_cell else df).select(own.alias("__block"), meets.alias(CELL_NUMBER), F.lit(0).alias("__kind"), *columns)
    candidates = placed.select(upto(blocks).alias("__block"), CELL_NUMBER, F.lit(1).alias("__kind"), *columns)
    key = ["__block", CELL_NUMBER]
    parts = min(blocks * n_cells, 32 * tasks)
    # By number, not by hash: no task gets several blocks while another has none.
    every = queries.unionByName(candidates).withColumn("__part", ((F.col(CELL_NUMBER) * blocks + F.col("__block")) % parts).cast("int"))
    dealt = every.repartitionById(parts, "__part").drop("__part")
    arrow = to_arrow_schema(schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, work = None, [], None

        def results() -> Iterator[pa.RecordBatch]:
            if work is not None:
                yield from work.result().cast(arrow).to_batches(max_chunksize=65536)

        for batch in batches:
            parts = np.stack([batch.column(k).to_numpy() for k in range(3)])
            cuts = np.flatnonzero((parts[:, 1:] != parts[:, :-1]).any(axis=0)) + 1
            rows = pa.Table.from_batches([batch]).drop_columns([*key, "__kind"])
            for start, end in zip([0, *cuts], [*cuts, batch.num_rows]):
                if start == end:
                    continue
                group, kind = tuple(parts[:2, start]), parts[2, start]
                if group != now:
                    yield from results()
                    now, waiting, work = group, [], None
                if kind == 0:
                    waiting.append(rows.slice(start, end - start))
                elif waiting or work is not None:
                    if work is None:
                        work, waiting = begin(pa.concat_tables(waiting)), []
                    work.add(rows.slice(start, end - start))
        yield from results()

    return dealt.sortWithinPartitions(*key, "__kind", id_col).mapInArrow(fold, schema)


def neighbour_partials(
    df: DataFrame,
    m: int,
    id_col: str = "sample_id",
    vector: str = "embedding",
    carry: Sequence[str] = (),
    cells: Sequence[str] = (),
    block_rows: int = BLOCK_ROWS,
    merge: Merge | None = None,
) -> DataFrame:
    """The ``m`` most similar candidates (self included) of each query in each cell:
    (query_id, neighbour_id, similarity, q_*, n_*).

    Without ``cells`` all rows are one cell. With them, the neighbours within any
    union of cells can be merged from one result of at most rows x cells x m rows.
    With ``merge`` these rows stay in the task, and what it makes of a query tile is returned.
    """
    carry = list(dict.fromkeys([*carry, *cells]))
    slim = df.select(id_col, vector, *[c for c in carry if c != id_col])
    types = {f.name: f.dataType for f in slim.schema.fields}
    schema = T.StructType(
        [
            T.StructField("query_id", types[id_col]),
            T.StructField("neighbour_id", types[id_col]),
            T.StructField("similarity", T.DoubleType()),
            *[T.StructField(f"q_{c}", types[c]) for c in carry],
            *[T.StructField(f"n_{c}", types[c]) for c in carry],
        ]
    )

    class Nearest:
        def __init__(self, queries: pa.Table) -> None:
            self.queries, self.vectors = queries, _matrix(queries[vector])
            self.merged, self.waiting = None, []
            #: What a row must reach for each query, and for any of them.
            self.floor, self.beat = np.full(len(self.vectors), -2.0), -2.0

        def add(self, candidates: pa.Table) -> None:
            near = pc.greater_equal(candidates[BOUND], pa.scalar(self.beat))  # a row below can't be among the best of any query
            candidates = candidates.filter(near).drop_columns([BOUND]).sort_by(id_col)
            if not len(candidates):
                return
            base = _matrix(candidates[vector])
            slim = candidates.select([id_col, *(c for c in carry if c != id_col)])
            for start in range(0, len(self.vectors), _TILE):
                sims = self.vectors[start : start + _TILE] @ base.T
                rows, cols, values = _reaching(sims, self.floor[start : start + _TILE], m)
                if len(rows):
                    self.waiting.append(slim.take(cols).append_column("__row", pa.array(rows + start)).append_column("__sim", pa.array(values)))
            # Merged when as many wait as are held: sorting them grows with what is found, not with the batches.
            if self.merged is None or sum(map(len, self.waiting)) >= len(self.merged):
                self._merge()

        def _merge(self) -> None:
            every = pa.concat_tables(self.waiting if self.merged is None else [self.merged, *self.waiting])
            every = every.take(pc.sort_indices(every, [("__row", "ascending"), ("__sim", "descending"), (id_col, "ascending")]))
            row = every["__row"].to_numpy()
            self.merged, self.waiting = every.filter(pa.array(np.arange(len(row)) - np.searchsorted(row, row) < m)), []
            last = np.searchsorted(self.merged["__row"].to_numpy(), np.arange(len(self.vectors)), "right") - 1
            if len(self.merged) == m * len(self.vectors):
                self.floor = self.merged["__sim"].to_numpy()[last]
                self.beat = float(self.floor.min()) - SLACK

        @property
        def best(self) -> pa.Table:
            if self.waiting:
                self._merge()
            return self.merged

        def result(self) -> pa.Table:
            q = self.queries.take(self.best["__row"])
            columns = [q[id_col], self.best[id_col], self.best["__sim"], *(q[c] for c in carry), *(self.best[c] for c in carry)]
            return pa.Table.from_arrays(columns, names=schema.names)

    if merge is not None:
        schema = merge.schema
    return _fold_tiles(slim, m, id_col, vector, list(cells), block_rows, schema, Nearest, merge)


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Rows of the sample far from each other: each next one has the least similarity to those chosen."""
    chosen, nearest = [0], sample @ sample[0]
    while len(chosen) < min(count, len(sample)):
        far = int(nearest.argmin())
        if nearest[far] > 1 - SLACK:
            break
        chosen.append(far)
        nearest = np.maximum(nearest, sample @ sample[far])
    return sample[chosen]


def surviving_tiles(own: np.ndarray, cell: np.ndarray, pivot: np.ndarray, rows: np.ndarray, radius: np.ndarray, angles: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query tile, candidate tile, greatest similarity) of the pairs that may hold neighbours.

    ``cell``, ``pivot``, ``rows`` and ``radius`` describe all tiles, in order of cells;
    ``angles`` are those between pivots. A query of a tile is at least
    angle - radius - radius away from a candidate of another one, and at most
    angle + radius + radius. The nearest candidate tiles of a cell that hold m rows
    together so bound the m-th neighbour; tiles that begin beyond it are left out.
    """
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]][: len(cell)])
    ends = np.r_[starts[1:], len(cell)]
    found = []
    for a in own:
        between, reach = angles[pivot[a], pivot], radius[a] + radius
        highest = np.cos(np.maximum(between - reach, 0.0))
        lowest = np.cos(np.minimum(between + reach, np.pi))
        for start, end in zip(starts, ends, strict=True):
            near = np.argsort(-lowest[start:end], kind="stable") + start
            enough = np.searchsorted(np.cumsum(rows[near]), m)
            least = lowest[near[enough]] if enough < len(near) else -1.0
            stay = np.flatnonzero(highest[start:end] + SLACK >= least) + start
            found.append((np.full(len(stay), a), stay, highest[stay] + SLACK))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def _tiled(df: DataFrame, id_col: str, vector: str, cells: Sequence[str], tile_rows: int, count: int) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """The rows with their cell number and tile, written; the tiles (tile, cell, pivot, rows,
    radius), numbered in order of cells; and the angles between pivots."""
    spark = df.sparkSession
    sample = df.select(vector).orderBy(F.xxhash64(id_col), id_col).limit(PIVOT_SAMPLE).toArrow()
    unit = _matrix(sample[vector]) if len(sample) else np.zeros((0, 1))
    unit = unit[np.abs((unit * unit).sum(axis=1) - 1) < SLACK]
    pivots = choose_pivots(unit, count) if len(unit) else np.zeros((1, 1))
    angles = np.arccos(np.clip(pivots @ pivots.T, -1.0, 1.0))
    shared = spark.sparkContext.broadcast(pivots)  # at most PIVOTS vectors

    counts = df.groupBy(*cells).agg(F.count(F.lit(1)).alias("__n"))
    numbered = counts.withColumn(CELL_NUMBER, (F.row_number().over(Window.orderBy(*(cells or [F.lit(0)]))) - 1).cast("int"))
    placed = _join_on(df, numbered.drop("__n"), cells) if cells else df.withColumn(CELL_NUMBER, F.lit(0))
    at = placed.columns.index(vector)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _matrix(pa.chunked_array([batch.column(at)])) if batch.num_rows else np.zeros((0, shared.value.shape[1]))
            if own.shape[1] != shared.value.shape[1]:
                own = np.zeros((batch.num_rows, shared.value.shape[1]))
            sims = own @ shared.value.T
            nearest = np.nan_to_num(sims, nan=-1.0).argmax(axis=1)
            angle = np.arccos(np.clip(sims[np.arange(len(own)), nearest], -1.0, 1.0))
            # A vector without a direction has no angle: its tile reaches everywhere.
            regular = np.abs((own * own).sum(axis=1) - 1) < SLACK
            angle = np.where(regular, angle, np.pi)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest.astype(np.int32)), pa.array(angle), pa.array(~regular)], names=[*batch.schema.names, "__pivot", "__angle", "__odd"])

    fields = T.StructType([*placed.schema.fields, T.StructField("__pivot", T.IntegerType()), T.StructField("__angle", T.DoubleType()), T.StructField("__odd", T.BooleanType())])
    assigned = materialize(placed.mapInArrow(assign, fields), "assigned")
    around = [CELL_NUMBER, "__pivot", "__odd"]
    part = F.pmod(F.xxhash64(id_col), F.col("__parts")).cast("int").alias("__part")
    parts = assigned.groupBy(*around).agg(F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("__parts"))
    parted = _join_on(assigned, materialize(parts, "tile-parts"), around).select("*", part)
    key = [*around, "__part"]
    tiles = parted.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), F.max("__angle").alias("radius"))
    # One row per tile: their number is that of the rows over tile_rows, and of the cells times the pivots.
    tiles = materialize(tiles.withColumn(TILE, (F.row_number().over(Window.orderBy(*key)) - 1).cast("int")), "tiles")
    rows = _join_on(parted, tiles.select(*key, TILE), key).select(TILE, CELL_NUMBER, *df.columns)
    return rows, tiles.select(TILE, CELL_NUMBER, F.col("__pivot").alias("pivot"), "rows", "radius"), angles


def _fold_tiles(df: DataFrame, m: int, id_col: str, vector: str, cells: Sequence[str], block_rows: int, schema: T.StructType, begin: Callable[[pa.Table], _Fold], merge: Merge | None = None) -> DataFrame:
    """Result of ``begin(query tile)`` for each cell after it has seen the candidate tiles
    of that cell that may hold one of a query's m nearest rows.

    Queries are sent once, candidates once for each query tile that they survive for.
    """
    spark = df.sparkSession
    tasks, wide = _tasks(spark)
    size = df.groupBy(*cells).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("cells")).first()
    if merge is not None:
        block_rows = max(1, min(block_rows, HELD_ROWS // (m * max(1, size["cells"]))))
    tile_rows = min(block_rows, max(LEAST_BLOCK, -(-size["n"] // wide)))
    # No more pivots than fill the tiles of a cell: small tiles would send each vector often.
    pivots = max(1, min(PIVOTS, size["n"] // (tile_rows * max(1, size["cells"]))))
    rows, tiles, angles = _tiled(df, id_col, vector, cells, tile_rows, pivots)
    known = tiles.orderBy(TILE).toArrow()  # a row of numbers per tile
    column = {c: known[c].to_numpy() for c in known.column_names}
    shared = spark.sparkContext.broadcast((column[CELL_NUMBER], column["pivot"], column["rows"], column["radius"], angles))
    n_tiles = known.num_rows

    def survive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in np.array_split(batch.column(0).to_numpy(), max(1, batch.num_rows // 16)):
                block, tile, bound = surviving_tiles(own, *shared.value, m)
                yield pa.RecordBatch.from_arrays([pa.array(tile, pa.int32()), pa.array(block, pa.int32()), pa.array(bound)], names=[TILE, "__block", BOUND])

    pairs = spark.range(n_tiles).repartition(max(1, min(n_tiles, tasks)), "id").mapInArrow(survive, f"{TILE} int, __block int, {BOUND} double")
    needed = materialize(pairs.groupBy(TILE).agg(F.collect_list(F.struct("__block", BOUND)).alias("by")), "surviving-tiles")
    sent = _join_on(rows, needed, [TILE]).withColumn("b", F.explode("by"))
    candidates = sent.select(F.col("b.__block").alias("__block"), CELL_NUMBER, F.lit(1).alias("__kind"), F.col(f"b.{BOUND}").alias(BOUND), *df.columns)
    queries = rows.select(F.col(TILE).alias("__block"), F.lit(-1).alias(CELL_NUMBER), F.lit(0).alias("__kind"), F.lit(0.0).alias(BOUND), *df.columns)
    parts = max(1, min(n_tiles, 32 * tasks))
    # By number, not by hash: no task gets several tiles while another has none.
    every = queries.unionByName(candidates).withColumn("__part", F.col("__block") % parts)
    dealt = every.repartitionById(parts, "__part").drop("__part")
    arrow = to_arrow_schema(schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, cell, queries, work, held = None, None, [], None, []

        def results(over: bool) -> Iterator[pa.RecordBatch]:
            """Of the cell that ends, and of the tile where that is over too."""
            if work is not None and merge is None:
                yield from work.result().cast(arrow).to_batches(max_chunksize=65536)
            elif work is not None:
                held.append(merge.pack(work.queries, work.best))
                if over:
                    yield from merge.close(work.queries, held).cast(arrow).to_batches(max_chunksize=65536)
                    held.clear()

        for batch in batches:
            parts = np.stack([batch.column(k).to_numpy() for k in range(2)])
            cuts = np.flatnonzero((parts[:, 1:] != parts[:, :-1]).any(axis=0)) + 1
            rows = pa.Table.from_batches([batch]).drop_columns(["__block", CELL_NUMBER, "__kind"])
            for start, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if start == end:
                    continue
                own, now = parts[:, start]
                if own != block or now != cell:
                    yield from results(own != block)
                    queries, work = queries if own == block else [], None
                    block, cell = own, now
                if now < 0:
                    queries.append(rows.slice(start, end - start))
                    continue
                if work is None:
                    work = begin(pa.concat_tables(queries).drop_columns([BOUND]))
                work.add(rows.slice(start, end - start))
        yield from results(True)

    order = ["__block", CELL_NUMBER, F.desc(BOUND), id_col]
    return dealt.sortWithinPartitions(*order).mapInArrow(fold, schema)


def _nearest_first(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(F.col("similarity").desc(), F.col("neighbour_id"))


def top_neighbours(partials: DataFrame, k: int, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """The k nearest rows other than the query itself, ranked from 1."""
    others = partials.where("query_id <> neighbour_id")
    return others.withColumn("rank", F.row_number().over(_nearest_first(keys))).where(
        F.col("rank") <= k
    )


def knn_cosine(df: DataFrame, k: int, **layout) -> DataFrame:
    return top_neighbours(neighbour_partials(df, k + 1, **layout), k)


def slide_aware_neighbours(
    partials: DataFrame, k: int, window, slide: str = "slide_id", keys: Sequence[str] = ("query_id",)
) -> DataFrame:
    """k neighbours per query, rows of its own slide only as a fallback.

    Only the ``window`` nearest rows, self included, are considered. Rows from
    the query's slide come after all others and are flagged ``backfilled``; a
    query left with fewer than k rows is an error.
    """
    seen = partials.withColumn("__near", F.row_number().over(_nearest_first(keys))).where(
        F.col("__near") <= window
    )
    same = F.col(f"q_{slide}") == F.col(f"n_{slide}")
    others = seen.where("query_id <> neighbour_id").withColumn("backfilled", same)
    order = Window.partitionBy(*keys).orderBy("backfilled", "__near")
    ranked = others.withColumn("rank", F.row_number().over(order)).withColumn(
        "__have", F.count(F.lit(1)).over(Window.partitionBy(*keys))
    )
    checked = F.when(
        F.col("__have") < k, F.raise_error(F.lit("not enough neighbours to compute the index"))
    ).otherwise(F.col("rank"))
    return ranked.withColumn("rank", checked).where(F.col("rank") <= k).drop("__near", "__have")


def cluster_distance_sums(
    df: DataFrame,
    cluster: str,
    id_col: str = "sample_id",
    vector: str = "embedding",
    normalize: bool = True,
    block_rows: int = BLOCK_ROWS,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Euclidean distance sum and row count from each row to each cluster:
    (*keys, id, own, other, distance, n), self excluded from the count. Rows meet
    within their keys only."""
    slim = df.select(*keys, id_col, vector, cluster)
    types = {f.name: f.dataType for f in slim.schema.fields}
    schema = T.StructType(
        [
            *[T.StructField(k, types[k]) for k in keys],
            T.StructField(id_col, types[id_col]),
            T.StructField("own", types[cluster]),
            T.StructField("other", types[cluster]),
            T.StructField("distance", T.DoubleType()),
            T.StructField("n", T.LongType()),
        ]
    )

    class Sums:
        """Distance sums of a query block to the clusters seen so far."""

        def __init__(self, queries: pa.Table) -> None:
            self.queries, self.vectors = queries, _matrix(queries[vector], normalize)
            self.squares = (self.vectors * self.vectors).sum(axis=1)
            self.sums: dict = {}

        def add(self, candidates: pa.Table) -> None:
            base = _matrix(candidates[vector], normalize)
            base_sq = (base * base).sum(axis=1)
            coded = candidates[cluster].combine_chunks().dictionary_encode()
            member = np.eye(len(coded.dictionary))[coded.indices.to_numpy(zero_copy_only=False)]
            itself = pc.index_in(self.queries[id_col].combine_chunks(), candidates[id_col].combine_chunks())
            at = itself.fill_null(-1).to_numpy(zero_copy_only=False)
            sums, counts = np.empty((len(at), member.shape[1])), np.tile(member.sum(axis=0), (len(at), 1))
            for start in range(0, len(at), _TILE):
                tile = slice(start, start + _TILE)
                squared = self.squares[tile, None] + base_sq[None, :] - 2.0 * (self.vectors[tile] @ base.T)
                distance = np.sqrt(np.maximum(squared, 0.0))
                hit = np.flatnonzero(at[tile] >= 0)
                distance[hit, at[tile][hit]] = 0.0
                sums[tile] = distance @ member
            hit = np.flatnonzero(at >= 0)
            counts[hit] -= member[at[hit]]
            for k, name in enumerate(coded.dictionary.to_pylist()):
                before = self.sums.get(name, (0.0, 0.0))
                self.sums[name] = (before[0] + sums[:, k], before[1] + counts[:, k])

        def result(self) -> pa.Table:
            names = pa.array(list(self.sums), self.queries[cluster].type)
            distance, count = (np.stack([v[k] for v in self.sums.values()]) for k in (0, 1))
            rows = np.tile(np.arange(len(self.vectors)), len(names))
            return pa.Table.from_arrays(
                [
                    *(self.queries[k].take(rows) for k in keys),
                    self.queries[id_col].take(rows),
                    self.queries[cluster].take(rows),
                    names.take(np.repeat(np.arange(len(names)), len(self.vectors))),
                    pa.array(distance.ravel()),
                    pa.array(np.rint(count.ravel()).astype(np.int64)),
                ],
                names=schema.names,
            )

    return _fold_blocks(slim, id_col, list(keys), block_rows, schema, Sums, own_cell=True)


def silhouette(df: DataFrame, cluster: str, keys: Sequence[str] = (), **layout) -> DataFrame:
    """Mean Euclidean silhouette per keys (1 row without); rows alone in their cluster count 0."""
    id_col = layout.get("id_col", "sample_id")
    sums = cluster_distance_sums(df, cluster, keys=keys, **layout)
    mean = F.col("distance") / F.col("n")
    own = F.col("own") == F.col("other")
    per_row = sums.groupBy(*keys, id_col).agg(
        F.max(F.when(own & (F.col("n") > 0), mean)).alias("a"), F.min(F.when(~own, mean)).alias("b")
    )
    widest = F.greatest("a", "b")
    value = F.when(F.col("a").isNull() | (widest == 0), F.lit(0.0)).otherwise(
        (F.col("b") - F.col("a")) / widest
    )
    return per_row.groupBy(*keys).agg(F.avg(value).alias("silhouette"), F.count(F.lit(1)).alias("n"))


def silhouettes(
    df: DataFrame,
    clusters: str,
    keys: Sequence[str] = (),
    id_col: str = "sample_id",
    vector: str = "embedding",
    normalize: bool = True,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``silhouette`` of several clusterings of the same rows from one set of distances:
    (*keys, place, silhouette, n, used).

    ``clusters`` is an array of a row's cluster in each, equally long within the keys;
    ``place`` counts from 0, ``used`` is the number of clusters. A query block sees all
    rows, so its scores are made where its sums are and only their total leaves the task.
    """
    slim = df.select(*keys, id_col, vector, clusters)
    types = {f.name: f.dataType for f in slim.schema.fields}
    numbers = [("place", T.IntegerType()), ("total", T.DoubleType()), ("rows", T.LongType()), ("used", T.IntegerType())]
    schema = T.StructType([T.StructField(c, t) for c, t in [*((k, types[k]) for k in keys), *numbers]])

    def lists(table: pa.Table) -> np.ndarray:
        flat = table[clusters].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(len(table), -1)

    class Scores:
        """Distance sums of a query block to all clusters seen so far, side by side."""

        def __init__(self, queries: pa.Table) -> None:
            self.queries, self.vectors, self.own = queries, _matrix(queries[vector], normalize), lists(queries)
            self.ids = queries[id_col].combine_chunks()
            self.squares = (self.vectors * self.vectors).sum(axis=1)
            self.columns: dict[tuple[int, int], int] = {}
            self.sums, self.counts = np.zeros((len(queries), 0)), np.zeros(0)

        def add(self, candidates: pa.Table) -> None:
            base, theirs = _matrix(candidates[vector], normalize), lists(candidates)
            base_sq = (base * base).sum(axis=1)
            member = np.zeros((len(base), len(self.columns)))
            for place in range(theirs.shape[1]):
                for name in np.unique(theirs[:, place]):
                    column = self.columns.setdefault((place, int(name)), len(self.columns))
                    if column == member.shape[1]:
                        member = np.c_[member, np.zeros(len(base))]
                    member[:, column] = theirs[:, place] == name
            fresh = member.shape[1] - len(self.counts)
            self.sums = np.pad(self.sums, ((0, 0), (0, fresh)))
            self.counts = np.pad(self.counts, (0, fresh)) + member.sum(axis=0)
            at = pc.index_in(self.ids, candidates[id_col].combine_chunks()).fill_null(-1).to_numpy(zero_copy_only=False)
            for start in range(0, len(at), _TILE):
                tile = slice(start, start + _TILE)
                distance = self.vectors[tile] @ base.T
                distance *= -2.0
                distance += self.squares[tile, None]
                distance += base_sq
                np.sqrt(np.maximum(distance, 0.0, out=distance), out=distance)
                hit = np.flatnonzero(at[tile] >= 0)
                distance[hit, at[tile][hit]] = 0.0
                self.sums[tile] += distance @ member

        def result(self) -> pa.Table:
            found = []
            rows = np.arange(len(self.own))
            for place in range(self.own.shape[1]):
                names, columns = zip(*sorted((name, c) for (p, name), c in self.columns.items() if p == place), strict=True)
                sums, count = self.sums[:, columns], self.counts[list(columns)]
                own = np.searchsorted(names, self.own[:, place])
                alone = count[own] < 2
                a = sums[rows, own] / np.where(alone, 1, count[own] - 1)
                apart = sums / count
                apart[rows, own] = np.inf
                b = apart.min(axis=1) if len(names) > 1 else a
                widest = np.maximum(a, b)
                value = np.where(alone | (widest == 0), 0.0, (b - a) / np.where(widest == 0, 1.0, widest))
                found.append((place, float(value.sum()), len(rows), len(names)))
            scores = [pa.array(c) for c in zip(*found, strict=True)]
            return pa.Table.from_arrays([*(self.queries[k].take(np.zeros(len(found), np.int64)) for k in keys), *scores], names=schema.names)

    parts = _fold_blocks(slim, id_col, list(keys), block_rows, schema, Scores, own_cell=True)
    total = parts.groupBy(*keys, "place").agg(F.sum("total").alias("total"), F.sum("rows").alias("n"), F.max("used").alias("used"))
    return total.select(*keys, "place", (F.col("total") / F.col("n")).alias("silhouette"), "n", "used")
