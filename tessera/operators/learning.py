"""Linear probes and clustering scores of embeddings, and batch inference.

Fits of all splits, and of all pairs, advance together (``probes``, ``clustering``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.arrays import dot, l2_normalize, to_doubles
from tessera.operators import clustering
from tessera.operators.agreement import cell_counts, mean_std
from tessera.operators.clustering import assign_clusters, best_attempts, fit_kmeans, settle
from tessera.operators.performance_drop import accuracy_by_rho, average_performance_drop
from tessera.operators.robustness import CELL, infer_pairs, subsample_pairs, subset_by_pair
from tessera.operators.probes import fit_probes, probe_accuracy, probe_rows
from tessera.session import materialize

MIN_PAIR_ROWS = 8  # fixed value: smaller pairs are not clustered
MODEL_SCHEMA = (
    "rep bigint, split_id bigint, weights array<array<double>>, intercepts array<double>"
)


def align_features(splits: DataFrame, features: DataFrame, vector: str = "embedding") -> DataFrame:
    """Splits with the unit-length feature of each sample; samples without one drop out."""
    unit = features.select("sample_id", l2_normalize(F.col(vector)).alias("feature"))
    return splits.join(unit, "sample_id")


def score_linear(rows: DataFrame, models: DataFrame) -> DataFrame:
    """Adds ``predicted`` (class code) from the linear model of the row's split."""
    margins = F.zip_with(
        F.transform("weights", lambda w: dot(w, F.col("feature"))), "intercepts", lambda a, b: a + b
    )
    joined = rows.join(models, ["rep", "split_id"]).withColumn("__m", margins)
    one = (F.element_at("__m", 1) > 0).cast("bigint")
    many = (F.array_position("__m", F.array_max("__m")) - 1).cast("bigint")
    return joined.withColumn(
        "predicted", F.when(F.size("__m") == 1, one).otherwise(many)
    ).drop("__m", "weights", "intercepts")


def probe_splits(splits: DataFrame, features: DataFrame, c: float = 1.0, max_iter: int = 1000) -> DataFrame:
    """Accuracy on both test sides per (rep, split_id, correlation_level), with the largest
    entry of each fit's final gradient and the passes it took.

    L2-penalised logistic regression with an unpenalised intercept: the mean loss of the
    n training rows plus |w|^2 / (2 C n). ``features`` has one unit-length feature per
    sample; samples without one drop out.
    """
    rows, known, classes = probe_rows(splits, features)
    return probe_accuracy(rows, fit_probes(rows, known, classes, c, max_iter))


def linear_probe(aligned: DataFrame, **probe) -> DataFrame:
    """``probe_splits`` of rows that carry their feature."""
    return probe_splits(aligned.drop("feature"), aligned.select("sample_id", "feature").dropDuplicates(["sample_id"]), **probe)


def compute_apd(splits: DataFrame, features: DataFrame, vector: str = "embedding", **probe) -> tuple[DataFrame, DataFrame]:
    """(drop per side, accuracy per correlation level) of probes on all splits."""
    unit = features.select("sample_id", l2_normalize(F.col(vector)).alias("feature"))
    accuracy = materialize(probe_splits(splits, unit, **probe), "accuracy")
    return average_performance_drop(accuracy), accuracy_by_rho(accuracy)


def kmeans(df: DataFrame, k: int, restarts: int = 10, seed: int = 0, feature: str = "feature") -> DataFrame:
    """Rows with ``cluster`` from the restart with the lowest cost; each row is in the
    cluster with the nearest mean."""
    rows = materialize(df.withColumn("group_id", F.lit("all")).withColumn("feature", to_doubles(F.col(feature))), "points")
    best = settle(rows, best_attempts(fit_kmeans(rows, [("all", k, a) for a in range(restarts)], seed)))
    return assign_clusters(rows, list(enumerate(best))).drop("group_id", "fit")


def best_k_by_silhouette(df: DataFrame, k_min: int = 2, k_max: int = 10, restarts: int = 10, seed: int = 0) -> int:
    """First k with the highest mean silhouette; partitions into one cluster are skipped."""
    points = df.select("sample_id", F.lit("all").alias("group_id"), to_doubles(F.col("feature")).alias("feature"))
    return clustering.best_k_by_silhouette(materialize(points, "points"), k_min, k_max, restarts, seed).get("all", int(k_min))


def clustering_score(
    df: DataFrame,
    dataset: str,
    repeats: int = 5,
    k_min: int = 2,
    k_max: int = 10,
    max_pairs: int | None = None,
    seed: int = 0,
    search_restarts: int = 10,
    score_restarts: int = 5,
) -> DataFrame:
    """ARI with the label minus ARI with the centre, averaged over repeats and
    pairs: (value, std, n). All pairs are searched and scored together."""
    pairs = subsample_pairs(infer_pairs(cell_counts(df, *CELL), dataset), max_pairs, seed)
    large = materialize(pairs.where(F.col("pair_rows") >= MIN_PAIR_ROWS), "large-pairs")
    if large.isEmpty():
        raise RuntimeError(f"{dataset}: no pair is large enough to cluster")
    unit = df.withColumn("feature", to_doubles(l2_normalize(F.col("embedding")))).drop("embedding")
    rows = materialize(subset_by_pair(unit, large).withColumnRenamed("pair_id", "group_id"), "pairs")
    ks = clustering.best_k_by_silhouette(rows, k_min, k_max, search_restarts, seed)
    return mean_std(clustering.agreement_of_clusters(rows, ks, repeats, score_restarts, seed), "value")


def embed(
    df: DataFrame,
    make_model: Callable,
    inputs: str,
    input_shape: Sequence[int],
    batch_size: int = 256,
    out: str = "embedding",
) -> DataFrame:
    """Batch inference followed by mean pooling over tokens and L2 normalisation.

    ``make_model`` returns a function on a float batch of shape (rows, *input_shape)
    giving (rows, tokens, dim) or (rows, dim). It runs once per Python worker.
    """

    def make_predict():
        import numpy as np

        model = make_model()

        def predict(batch):
            result = np.asarray(model(batch), dtype=np.float32)
            pooled = result.mean(axis=1) if result.ndim == 3 else result
            return pooled / (np.linalg.norm(pooled, axis=1, keepdims=True) + 1e-12)

        return predict

    infer = predict_batch_udf(
        make_predict,
        return_type=T.ArrayType(T.FloatType()),
        batch_size=batch_size,
        input_tensor_shapes=[list(input_shape)],
    )
    return df.withColumn(out, infer(F.col(inputs)))
