"""Quality classifier from trusted positives and unlabelled text.

Positive-unlabelled learning: the non-negative unbiased risk
``pi * E_P[l(f)] + max(0, E_U[l(-f)] - pi * E_P[l(-f)])`` with the sigmoid loss
``l(z) = 1 / (1 + exp(z))``, which bounds what a single text can add. The class prior
``pi`` is estimated from the scores of positives and of unlabelled text; labels that say
bad are not read, and no document enters as a negative. Features describe the shape of
a text in any language; the model is a sum of one step function per feature.

Trusted positives are a sample of bounded size; the unlabelled are all documents that
may be learned from. These are dealt to blocks by chance, tasks minimise the risk on
the positives and their own block, and the mean of the blocks' weights is the model.
Bin edges, the prior and the border at the prior come from all unlabelled rows.
"""

from __future__ import annotations

import math
import operator
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.tasks import arrow_batch, byte_texts
from tessera.session import intermediate_tables, materialize

#: Bound of the sample of labelled rows, and unlabelled rows of a block.
MAX_POSITIVES, BLOCK_ROWS = 6000, 12000
BINS = 12
#: Cells of the histogram of scores.
_CELLS = 4096
_KINDS = 8


def _byte_kinds() -> np.ndarray:
    """Kind of each byte: space, line end, lower, upper, digit, sentence mark, symbol, non-ASCII."""
    kinds = np.full(256, 6, np.uint8)
    for kind, members in enumerate((b" \t", b"\n\r", bytes(range(97, 123)), bytes(range(65, 91)), bytes(range(48, 58)), b".,;:'\"?-()")):
        kinds[list(members)] = kind
    kinds[128:] = 7
    return kinds


KINDS = _byte_kinds()
N_FEATURES = _KINDS * _KINDS + 10
_CHUNK = 1 << 20


def shape(text: bytes) -> np.ndarray:
    """Shares of byte-kind pairs, then word and line statistics (float32)."""
    pairs, carried = np.zeros(_KINDS * _KINDS, np.int64), None
    for at in range(0, len(text), _CHUNK):
        kinds = KINDS[np.frombuffer(text, np.uint8, min(_CHUNK, len(text) - at), at)]
        if carried is not None:
            kinds = np.r_[carried, kinds]
        pairs += np.bincount(kinds[:-1] * np.uint8(_KINDS) + kinds[1:], minlength=_KINDS * _KINDS)
        carried = kinds[-1:]
    words = text.split()
    n = len(words)
    lines = text.split(b"\n")
    often = Counter(words)
    stats = (
        math.log1p(n),
        len(text) / n if n else 0.0,
        len(often) / n if n else 0.0,
        sum(map(operator.eq, words, words[1:])) / n if n else 0.0,
        max(often.values(), default=0) / n if n else 0.0,
        len(set(zip(words, words[1:], strict=False))) / n if n else 0.0,
        math.log1p(len(lines)),
        len(set(lines)) / len(lines),
        max(map(len, words), default=0) / 100,
        math.log1p(max(map(len, lines))),
    )
    return np.r_[pairs / max(1, pairs.sum()), stats].astype(np.float32)


class StepModel:
    """Sum of a step function per feature: bin edges and a weight for each bin.

    Plain arrays, so that it travels to executors that don't have this package.
    """

    def __init__(self, edges: list[np.ndarray], weights: np.ndarray, bias: float) -> None:
        self.edges, self.weights, self.bias = edges, weights, bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return step_scores((self.edges, self.weights, self.bias), x)


def bins_of(edges: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """Bin of each feature (rows x features, uint8)."""
    out = np.empty(x.shape, np.uint8)
    for k, own in enumerate(edges):
        out[:, k] = np.searchsorted(own, x[:, k], "right")
    return out


def first_places(edges: list[np.ndarray]) -> np.ndarray:
    """Place of each feature's first bin among the weights; at the end the number of weights."""
    return np.r_[0, np.cumsum([len(e) + 1 for e in edges])].astype(np.int64)


def step_scores(model: tuple[list[np.ndarray], np.ndarray, float], x: np.ndarray) -> np.ndarray:
    edges, weights, bias = model
    return _sigmoid(weights[first_places(edges)[:-1] + bins_of(edges, x)].sum(axis=1) + bias)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


class _Rows:
    """Rows as places of their ones; products with a weight vector and its transpose."""

    def __init__(self, columns: np.ndarray, width: int) -> None:
        self.columns, self.width = np.c_[columns, np.full(len(columns), width - 1)], width

    def __len__(self) -> int:
        return len(self.columns)

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        return w[self.columns].sum(axis=1)

    def gather(self, per_row: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns.ravel(), np.repeat(per_row, self.columns.shape[1]), self.width)


def prior_cuts(positive: np.ndarray) -> np.ndarray:
    """Scores of positives at which ``estimate_prior`` looks."""
    return np.quantile(positive, np.linspace(0.02, 0.98, 97))


def estimate_prior(positive: np.ndarray, above_u: np.ndarray, n_unlabelled: int, delta: float = 0.1) -> float:
    """Share of positives among the unlabelled, from scores of positives against unlabelled.

    ``above_u`` is the share of unlabelled rows that reach each of ``prior_cuts``. Where
    scores are high hardly any negative is left, so the share of unlabelled above a cut
    over the share of positives above it bounds the prior from above; the cut with the
    tightest bound, sampling error included, is taken.
    """
    above_p = 1 - np.searchsorted(np.sort(positive), prior_cuts(positive), "left") / len(positive)
    slack = math.sqrt(math.log(4 / delta) / 2) * (1 / math.sqrt(len(positive)) + 1 / math.sqrt(n_unlabelled))
    best = int(np.argmin((above_u + slack) / np.maximum(above_p, 1e-9)))
    return float(np.clip(above_u[best] / max(above_p[best], 1e-9), 0.01, 0.99))


def _adam(gradient, w: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Steps that shrink to a twentieth; the mean of the last third of the way."""
    m, v, mean = np.zeros(len(w)), np.zeros(len(w)), np.zeros(len(w))
    last = max(1, steps // 3)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - rate * 0.05 ** (t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        if t > steps - last:
            mean += w / last
    return mean


STEPS, RATE, RIDGE = 120, 0.05, 1e-3


def _shrink(width: int) -> np.ndarray:
    return np.r_[np.full(width - 1, RIDGE), 0]


def order_weights(p: _Rows, u: _Rows) -> np.ndarray:
    """Positives against unlabelled: convex to learn, and a good start for the risk."""
    shrink = _shrink(p.width)

    def slope(w: np.ndarray) -> np.ndarray:
        return p.gather(-_sigmoid(-(p @ w)) / (2 * len(p))) + u.gather(_sigmoid(u @ w) / (2 * len(u))) + shrink * w

    return _adam(slope, np.zeros(p.width), STEPS, RATE)


def risk_weights(p: _Rows, u: _Rows, w: np.ndarray, prior: float) -> np.ndarray:
    """From w on to the least non-negative risk; its slope at a score is the same for both signs."""
    shrink = _shrink(p.width)

    def slope(w: np.ndarray) -> np.ndarray:
        at_p, at_u = _sigmoid(p @ w), _sigmoid(u @ w)
        slope_p, slope_u = at_p * (1 - at_p) / len(p), at_u * (1 - at_u) / len(u)
        of_positive = -prior * p.gather(slope_p) + shrink * w
        if at_u.mean() < prior * at_p.mean():  # an estimate below zero counts as zero: nothing is left to fit there
            return of_positive
        return of_positive + u.gather(slope_u) - prior * p.gather(slope_p)

    return _adam(slope, w, STEPS, RATE)


def at_border(w: np.ndarray, cells: np.ndarray, counts: np.ndarray, positive: np.ndarray, prior: float | None) -> tuple[np.ndarray, float]:
    """Weights moved so that the share of the prior lies above zero, with a mean margin of 2.

    ``counts`` are the unlabelled rows from each of ``cells`` (scores, rising) to the next.
    """
    total = counts.sum()
    if prior is None:
        from_here = np.r_[np.cumsum(counts[::-1])[::-1], 0]
        above = from_here[np.searchsorted(cells, prior_cuts(positive), "left")]
        prior = estimate_prior(positive, above / total, int(total))
    border = cells[min(int(np.searchsorted(np.cumsum(counts), (1 - prior) * total)), len(cells) - 1)]
    w = w.copy()
    w[-1] -= border
    return w * (2 / max(float((np.abs(cells - border) * counts).sum() / total), 1e-6)), prior


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None) -> tuple[StepModel, float]:
    """The model of least non-negative risk on one block, and the class prior it was fitted with."""
    edges = [np.unique(np.quantile(unlabelled[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(unlabelled.shape[1])]
    p, u = (_rows(edges, bins_of(edges, x)) for x in (positive, unlabelled))
    w = order_weights(p, u)
    cells, counts = np.unique(u @ w, return_counts=True)
    w, prior = at_border(w, cells, counts, p @ w, prior)
    w = risk_weights(p, u, w, prior)
    return StepModel(edges, w[:-1], float(w[-1])), prior


def _rows(edges: list[np.ndarray], bins: np.ndarray) -> _Rows:
    """Rows of bins as places of their weights, without the features that have one bin only."""
    first = first_places(edges)
    varying = [k for k, e in enumerate(edges) if len(e)]
    return _Rows((first[:-1] + bins)[:, varying], int(first[-1]) + 1)


def held_out_rows(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 1 on division by 3; a NULL id doesn't."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sample(rows: DataFrame, n: int) -> np.ndarray:
    """Features of the n rows with the smallest hashes (of ids too, so that copies are
    drawn apart)."""
    chosen = rows.select("features", F.xxhash64("doc_id", "features").alias("h")).orderBy("h").limit(n).collect()
    return np.array([r["features"] for r in chosen], np.float32).reshape(-1, N_FEATURES)


def _features(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """row, doc_id and the features of each whole text, written out."""
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = pa.array(range(row, row + batch.num_rows), pa.int64())
            yield arrow_batch({"row": rows, "doc_id": batch.column(0), "features": pa.array([shape(t) for t in byte_texts(batch.column(1))], pa.list_(pa.float32()))})
            row += batch.num_rows

    return materialize(source.mapInArrow(describe, f"row long, doc_id {kind}, features array<float>"), "features")


def _edges(rows: DataFrame) -> list[np.ndarray]:
    """Bin edges of each feature: approximate quantiles of all rows, folded in the tasks."""
    shares = np.linspace(0, 1, BINS + 1)[1:-1].tolist()
    found = rows.agg(*[F.percentile_approx(F.col("features")[k], shares, 2000).alias(f"f{k}") for k in range(N_FEATURES)]).first()
    return [np.unique(np.array(found[k] or [], np.float32)) for k in range(N_FEATURES)]


def _mean_of_blocks(binned: DataFrame, blocks: int, work) -> np.ndarray:
    """Weights that ``work(bins)`` gives on each block of rows, averaged by the blocks' rows."""

    def on_block(key, group: pd.DataFrame) -> pd.DataFrame:
        bins = np.frombuffer(b"".join(group["bins"]), np.uint8).reshape(-1, N_FEATURES)
        w = work(bins)
        return pd.DataFrame({"place": np.arange(len(w)), "w": w * len(bins), "n": len(bins)})

    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block")
    sums = binned.groupBy(block).applyInPandas(on_block, "place int, w double, n long").groupBy("place").agg(F.sum("w").alias("w"), F.sum("n").alias("n"))
    return np.array([r["w"] / r["n"] for r in sorted(sums.collect())])  # a row per weight


def _score_counts(binned: DataFrame, first: np.ndarray, w: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows by score: cells, among them ``cuts``, and the rows from each to the next."""
    ends = [np.array([f(w[a:b]) for a, b in zip(first, first[1:], strict=False)]).sum() + w[-1] for f in (np.min, np.max)]
    cells = np.unique(np.r_[np.linspace(ends[0] - 1e-6, ends[1], _CELLS), cuts])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(cells), np.int64)
        for batch in batches:
            bins = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, N_FEATURES)
            z = w[first[:-1] + bins].sum(axis=1) + w[-1]
            n += np.bincount(np.maximum(np.searchsorted(cells, z, "right") - 1, 0), minlength=len(cells))
        yield arrow_batch({"cell": pa.array(range(len(cells)), pa.int32()), "n": pa.array(n)})

    counts = np.zeros(len(cells), np.int64)
    for r in binned.select("bins").mapInArrow(tally, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        counts[r["cell"]] = r["n"]
    return cells, counts


def learn(rows: DataFrame, labels: DataFrame, prior: float | None = None, max_positives: int = MAX_POSITIVES, block_rows: int = BLOCK_ROWS) -> StepModel | None:
    """The model fitted on rows (row, doc_id, features) that are not held out; None without any.

    Trusted positives are the rows of ``labels`` (doc_id, quality) with quality 1, at
    most ``max_positives`` of them, by a hash of the rows; unlabelled are all documents,
    in blocks of about ``block_rows``. The class prior is estimated from the scores
    (``estimate_prior``) unless given. Labels of 0 are not read.
    """
    learnable = rows.where(~held_out_rows(F.col("doc_id")))
    trusted = labels.where(~held_out_rows(F.col("doc_id")) & (F.col("quality") == 1)).select(F.col("doc_id").alias("trusted")).distinct()
    positive = _sample(learnable.join(trusted, F.col("doc_id") == F.col("trusted"), "left_semi"), max_positives)
    n = learnable.count()
    if not len(positive) or not n:
        return None
    edges = _edges(learnable)
    first = first_places(edges)

    def to_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = bins_of(edges, batch.column("features").flatten().to_numpy().reshape(-1, N_FEATURES))
            yield arrow_batch({"row": batch.column("row"), "bins": pa.array([b.tobytes() for b in bins], pa.binary())})

    binned = materialize(learnable.select("row", "features").mapInArrow(to_bins, "row long, bins binary"), "binned")
    own, blocks = bins_of(edges, positive), max(1, round(n / block_rows))
    w = _mean_of_blocks(binned, blocks, lambda bins: order_weights(_rows(edges, own), _rows(edges, bins)))
    of_positive = w[first[:-1] + own].sum(axis=1) + w[-1]
    cells, counts = _score_counts(binned, first, w, prior_cuts(of_positive))
    start, prior = at_border(w, cells, counts, of_positive, prior)
    w = _mean_of_blocks(binned, blocks, lambda bins: risk_weights(_rows(edges, own), _rows(edges, bins), start, prior))
    return StepModel(edges, w[:-1], float(w[-1]))


def _shared(spark: SparkSession, model: StepModel | None):
    """Broadcast of the model's arrays (objects of this package would be looked up by name)."""
    return spark.sparkContext.broadcast((model.edges, model.weights, model.bias) if model else None)


def _scores(model: tuple | None, features: np.ndarray) -> np.ndarray:
    return step_scores(model, features) if model and len(features) else np.full(len(features), 0.5)


def score_quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", **learning) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from 0.5 on).

    Learns as ``learn`` says; labels and ids are no inputs of a score. NULL and empty
    texts are scored like any other. Without positives or without documents to learn
    from, every score is 0.5. Rows are scored as they come: repeated rows repeat, NULL
    ids stay NULL and count as not held out. No rows give no rows; other columns are
    ignored.
    """
    rows = _features(docs, id_column, text_column)
    shared = _shared(docs.sparkSession, learn(rows, labels, **learning))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = _scores(shared.value, batch.column("features").flatten().to_numpy().reshape(-1, N_FEATURES))
            yield arrow_batch({"doc_id": batch.column("doc_id"), "score": pa.array(value), "predicted": pa.array((value >= 0.5).astype(np.int32))})

    scored = rows.select("doc_id", "features").mapInArrow(score, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
    return scored.select("doc_id", held_out_rows(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", **learning) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least 0.5."""
    with intermediate_tables(docs.sparkSession):
        shared = _shared(docs.sparkSession, learn(_features(docs, id_column, text_column), labels, **learning))
    at = docs.columns.index(text_column)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features = np.array([shape(t) for t in byte_texts(batch.column(at).cast(pa.string()))], np.float32).reshape(-1, N_FEATURES)
            yield batch.filter(pa.array(_scores(shared.value, features) >= 0.5))

    return docs.mapInArrow(keep, docs.schema)
