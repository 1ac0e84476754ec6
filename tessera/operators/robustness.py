"""Label/centre pairs and the kNN robustness index."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.hashing import hash_hex
from tessera.operators.agreement import (
    balanced_accuracy,
    cell_counts,
    clustering_agreement,
    count_cube,
    first_appearance_codes,
    majority_vote,
    mean_std,
)
from tessera.operators.neighbours import (
    BLOCK_ROWS,
    WINDOW_EXTRA,
    neighbour_partials,
    slide_aware_neighbours,
)
from tessera.operators.ranking import salted_join
from tessera.session import materialize

K_CANDIDATES = (3, 5, 7, 10, 15)  # fixed values: default neighbour counts
CELL = ("label", "medical_center")


def infer_pairs(cells: DataFrame, dataset: str) -> DataFrame:
    """All label pairs x centre pairs whose four cells are non-empty.

    ``cells`` are label/centre counts; both joins are equi-joins on them.
    """
    cells = cells.where("n > 0")
    a, b = cells.alias("a"), cells.alias("b")
    rows = a.join(
        b,
        (F.col("a.label") == F.col("b.label"))
        & (F.col("a.medical_center") < F.col("b.medical_center")),
    ).select(
        F.col("a.label").alias("label"),
        F.col("a.medical_center").alias("m1"),
        F.col("b.medical_center").alias("m2"),
        (F.col("a.n") + F.col("b.n")).alias("n"),
    )
    x, y = rows.alias("x"), rows.alias("y")
    pairs = x.join(
        y,
        (F.col("x.m1") == F.col("y.m1"))
        & (F.col("x.m2") == F.col("y.m2"))
        & (F.col("x.label") < F.col("y.label")),
    ).select(
        F.col("x.label").alias("c1"),
        F.col("y.label").alias("c2"),
        F.col("x.m1").alias("m1"),
        F.col("x.m2").alias("m2"),
        (F.col("x.n") + F.col("y.n")).alias("pair_rows"),
    )
    return pairs.withColumn(
        "pair_id",
        F.concat(
            F.lit(f"{dataset}::"),
            F.concat_ws("__", "c1", "c2"),
            F.lit("::"),
            F.concat_ws("__", "m1", "m2"),
        ),
    )


def subsample_pairs(pairs: DataFrame, max_pairs: int | None, seed: int = 0) -> DataFrame:
    """At most ``max_pairs`` pairs, chosen by hash; all of them when unset."""
    if not max_pairs or max_pairs <= 0:
        return pairs
    return pairs.orderBy(hash_hex(seed, F.col("pair_id")), "pair_id").limit(max_pairs)


def align_centers(df: DataFrame, centers: Sequence[str]) -> DataFrame:
    """Rows of the named centres."""
    return df.where(F.col("medical_center").isin(list(centers)))


def pair_membership(pairs: DataFrame) -> DataFrame:
    """One row per (pair, cell): the four cells of each pair."""
    corners = F.array(
        *[F.struct(F.col(c).alias("label"), F.col(m).alias("medical_center"))
          for c in ("c1", "c2") for m in ("m1", "m2")]
    )
    return pairs.withColumn("__cell", F.explode(corners)).select(
        *pairs.columns, "__cell.label", "__cell.medical_center"
    )


def subset_by_pair(df: DataFrame, pairs: DataFrame, spread_by: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Rows of every pair in one pass, tagged with ``pair_id``."""
    member = pair_membership(pairs).select("pair_id", "pair_rows", *CELL)
    return salted_join(df, member, CELL, spread_by)


def pair_agreement(df: DataFrame, pairs: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Agreement of one given clustering with labels and centres within each pair:
    (pair_id, ari_label, n, ari_center, score).

    Rows are counted once, into a (label, centre, cluster) cube; a pair is a sum over
    its cells, so no row is repeated for the pairs it is in.
    """
    cells = subset_by_pair(count_cube(df, [*CELL, cluster]), pairs, [cluster])
    return clustering_agreement(cells, cluster, *CELL, keys=["pair_id"], counted=True)


def cell_neighbours(
    df: DataFrame, kmax: int, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Nearest rows of each query in each label/centre cell. Neighbours of the
    whole set and of every pair are merged from this one result."""
    return neighbour_partials(
        df, kmax + WINDOW_EXTRA, carry=["slide_id"], cells=CELL, block_rows=block_rows
    )


def whole_neighbours(df: DataFrame, kmax: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Nearest rows of each query in the whole set: a row's window, not one for each cell."""
    return neighbour_partials(df, kmax + WINDOW_EXTRA, carry=["slide_id", "label"], block_rows=block_rows)


def knn_label_accuracy(
    df: DataFrame, partials: DataFrame, k_values: Sequence[int], rows: int
) -> DataFrame:
    """(k, balanced_accuracy) of the majority label among the k neighbours."""
    kmax = max(k_values)
    window = min(kmax + WINDOW_EXTRA, rows - 1)
    neighbours = slide_aware_neighbours(partials, kmax, window)
    codes = first_appearance_codes(df, "label", "row_idx")
    ks = F.array(*[F.lit(int(k)).cast("bigint") for k in k_values])
    seen = neighbours.select(
        "query_id",
        F.col("q_label").alias("truth"),
        F.col("n_label").alias("label"),
        F.explode(F.filter(ks, lambda k: k >= F.col("rank"))).alias("k"),
    )
    votes = salted_join(seen, codes, ["label"], ["query_id"])
    predicted = majority_vote(votes, ["k", "query_id", "truth"], "label", "code")
    return balanced_accuracy(predicted, "truth", "predicted", ["k"])


def best_k(accuracy: DataFrame, k_values: Sequence[int]) -> DataFrame:
    """First candidate reaching the highest accuracy (1 row)."""
    position = F.array_position(
        F.array(*[F.lit(int(k)).cast("bigint") for k in k_values]), F.col("k")
    )
    return accuracy.agg(
        F.max_by("k", F.struct(F.col("balanced_accuracy"), -position)).alias("k"),
        F.max("balanced_accuracy").alias("balanced_accuracy"),
    )


def pair_robustness(partials: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(pair_id, so, os, value): share of same-label/other-centre neighbours
    among those that agree in exactly one of the two; 0.5 if there are none."""
    member = pair_membership(pairs.where(F.col("pair_rows") > k + 1))
    queries = member.select(
        "pair_id", "pair_rows", F.col("label").alias("q_label"), F.col("medical_center").alias("q_medical_center")
    )
    nears = member.select(
        "pair_id", F.col("label").alias("n_label"), F.col("medical_center").alias("n_medical_center")
    )
    cell_pairs = queries.join(nears, "pair_id")
    corners = ["q_label", "q_medical_center", "n_label", "n_medical_center"]
    scoped = salted_join(partials, cell_pairs, corners, ["query_id"])
    window = F.least(F.lit(k + WINDOW_EXTRA), F.col("pair_rows") - 1)
    chosen = slide_aware_neighbours(scoped, k, window, keys=("pair_id", "query_id"))
    same_label = F.col("q_label") == F.col("n_label")
    same_center = F.col("q_medical_center") == F.col("n_medical_center")
    counted = chosen.groupBy("pair_id").agg(
        F.count_if(same_label & ~same_center).alias("so"),
        F.count_if(~same_label & same_center).alias("os"),
    )
    total = F.col("so") + F.col("os")
    return counted.withColumn(
        "value", F.when(total > 0, F.col("so") / total).otherwise(F.lit(0.5))
    )


class PairCounts:
    """Counts of ``pair_robustness`` from the nearest rows of a query tile in all cells.

    All queries of a tile are of one cell, so each pair that it is in merges the same four cells.
    """

    schema = T.StructType([T.StructField("pair_id", T.StringType()), T.StructField("so", T.LongType()), T.StructField("os", T.LongType())])

    def __init__(self, pairs: Sequence[Row], k: int, id_col: str = "sample_id") -> None:
        self.k, self.id_col = k, id_col
        self.pairs: dict = {}
        for p in pairs:
            corners = [(label, center) for label in (p["c1"], p["c2"]) for center in (p["m1"], p["m2"])]
            for corner in corners:
                self.pairs.setdefault(corner, []).append((p["pair_id"], p["pair_rows"], corners))

    def pack(self, queries: pa.Table, best: pa.Table) -> tuple:
        own = queries.take(best["__row"])
        slim = {
            "row": best["__row"].cast(pa.int32()),
            "sim": best["__sim"],
            "id": best[self.id_col],
            "same": pc.equal(own["slide_id"], best["slide_id"]),
            "itself": pc.equal(own[self.id_col], best[self.id_col]),
        }
        return tuple(best[c][0].as_py() for c in CELL), pa.table(slim).combine_chunks()

    def close(self, queries: pa.Table, parts: list) -> pa.Table:
        label, center = (queries[c][0].as_py() for c in CELL)
        found = dict(parts)
        counts = [(pair, *self._count(found, corners, label, center, rows)) for pair, rows, corners in self.pairs.get((label, center), [])]
        return pa.table([list(c) for c in zip(*counts, strict=True)] or [[], [], []], names=self.schema.names)

    def _count(self, found: dict, corners: list, label: str, center: str, rows: int) -> tuple[int, int]:
        cells = []
        for corner in corners:
            kind = 1 if corner[0] == label and corner[1] != center else 2 if corner[0] != label and corner[1] == center else 0
            cells.append(found[corner].append_column("kind", pa.array(np.full(len(found[corner]), kind, np.int8))))
        every = pa.concat_tables(cells)
        every = every.take(pc.sort_indices(every, [("row", "ascending"), ("sim", "descending"), ("id", "ascending")]))
        row, same, itself, kind = (every[c].to_numpy() for c in ("row", "same", "itself", "kind"))
        near = np.arange(len(row)) - np.searchsorted(row, row)
        seen = (near < min(self.k + WINDOW_EXTRA, rows - 1)) & ~itself
        row, same, near, kind = row[seen], same[seen], near[seen], kind[seen]
        order = np.lexsort((near, same, row))
        row, kind = row[order], kind[order]
        first, last = np.searchsorted(row, row), np.searchsorted(row, row, "right")
        if len(row) and (last - first).min() < self.k:
            raise ValueError("not enough neighbours to compute the index")
        kind = kind[np.arange(len(row)) - first < self.k]
        return int((kind == 1).sum()), int((kind == 2).sum())


def pair_robustness_of(df: DataFrame, pairs: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``pair_robustness`` of rows with embeddings. Cells are merged where they were found:
    a task returns counts per pair, not the nearest rows of every query in every cell."""
    usable = pairs.where(F.col("pair_rows") > k + 1).collect()  # label pairs x centre pairs
    counts = neighbour_partials(
        df, k + WINDOW_EXTRA, carry=["slide_id"], cells=CELL, block_rows=block_rows, merge=PairCounts(usable, k)
    )
    counted = counts.groupBy("pair_id").agg(F.sum("so").alias("so"), F.sum("os").alias("os"))
    total = F.col("so") + F.col("os")
    return counted.withColumn("value", F.when(total > 0, F.col("so") / total).otherwise(F.lit(0.5)))


def compute_ri(
    df: DataFrame,
    dataset: str,
    k_candidates: Sequence[int] = K_CANDIDATES,
    max_pairs: int | None = None,
    seed: int = 0,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Robustness index of a dataset: (dataset, k, value, std, n).

    k is chosen from the neighbours in the whole set. Then each task merges the cells of
    the pairs for its queries: lists per cell are neither shuffled nor written.
    """
    kmax = max(k_candidates)
    cells = cell_counts(df, *CELL)
    rows = int(cells.agg(F.sum("n")).first()[0] or 0)
    whole = whole_neighbours(df, kmax, block_rows)
    pairs = subsample_pairs(infer_pairs(cells, dataset), max_pairs, seed)
    k = int(best_k(knn_label_accuracy(df, whole, k_candidates, rows), k_candidates).first()["k"])
    # One small row per pair, read more than once.
    summary = mean_std(materialize(pair_robustness_of(df, pairs, k, block_rows), "pairs"), "value")
    checked = F.when(
        F.col("n") == 0, F.raise_error(F.lit(f"{dataset}: no usable label/centre pairs"))
    ).otherwise(F.col("value"))
    return summary.select(
        F.lit(dataset).alias("dataset"),
        F.lit(k).cast("bigint").alias("k"),
        checked.alias("value"),
        "std",
        "n",
    )
