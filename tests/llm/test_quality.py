"""Held-out accuracy of the classifier, and its parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality


def auc(score, label):
    rank = np.argsort(np.argsort(score)) + 1
    n = label.sum()
    return (rank[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = quality.score_quality(spark.read.parquet(f"{sf}/documents.parquet"), labels).where("held_out").join(labels, "doc_id").toPandas()
    label = found["quality"].to_numpy()
    assert auc(found["score"].to_numpy(), label) > 0.99
    assert (found["predicted"].to_numpy() == label).mean() > 0.97
    assert found["predicted"].to_numpy()[label == 1].mean() > 0.98
    assert ((found["score"] >= 0.5) == (found["predicted"] == 1)).all()


def test_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(None, None), (10**9, ""), (10**9, ""), (10**9 + 1, "word " * 200_000)], "doc_id long, text string")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = docs.union(odd).withColumn("score", F.lit("x")).withColumn("features", F.lit(1))
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality.keep_quality(docs, labels).count() == sum(r["predicted"] for r in got)
    assert quality.keep_quality(docs, labels).columns == docs.columns
    assert {r["score"] for r in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.score_quality(docs.limit(0), labels).collect() == []


def test_labels_of_held_out_rows_change_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.held_out_rows(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r["doc_id"]: r["score"] for r in quality.score_quality(docs, x).collect()} for x in (labels, turned))
    assert a == b


@pytest.mark.parametrize("share", [0.3, 0.7])
def test_prior_from_scores(share):
    """Without labels of both kinds the prior comes from the scores themselves."""
    rng = np.random.default_rng(7)
    good, bad = rng.normal(1.5, 1, (6000, 3)), rng.normal(-1.5, 1, (6000, 3))
    n = int(5000 * share)
    unlabelled = np.r_[good[:n], bad[: 5000 - n]].astype(np.float32)
    model, prior = quality.fit(good[3000:].astype(np.float32)[:2000] if n <= 3000 else good[n : n + 2000].astype(np.float32), unlabelled)
    assert abs(prior - share) < 0.08
    assert ((model.score(unlabelled) >= 0.5) == (np.arange(5000) < n)).mean() > 0.95


def test_risk_stays_non_negative():
    """With few positives and a high prior the fit doesn't drive the risk of negatives below zero."""
    rng = np.random.default_rng(3)
    p, u = rng.normal(1, 1, (30, 4)).astype(np.float32), rng.normal(0, 1, (400, 4)).astype(np.float32)
    model, _ = quality.fit(p, u, prior=0.8)
    assert model.score(u).mean() - 0.8 * model.score(p).mean() > -0.1


@pytest.mark.parametrize("seed", range(3))
def test_fit_is_stable(seed):
    """Other samples of one population give classifiers that keep the good and drop the bad."""
    rng = np.random.default_rng(seed)
    good, bad = rng.normal(1.2, 1, (4000, 6)).astype(np.float32), rng.normal(-1.2, 1, (700, 6)).astype(np.float32)
    model, _ = quality.fit(good[:1500], np.r_[good[1500:], bad], prior=2500 / 3200)
    assert (model.score(good) >= 0.5).mean() > 0.97 and (model.score(bad) >= 0.5).mean() < 0.15


def test_blocks_agree_with_one_block(spark):
    """Dealt to several blocks the fit gives nearly the same decisions as on all rows at once."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    one, several = ({r["doc_id"]: r["predicted"] for r in quality.score_quality(docs, labels, block_rows=n).collect()} for n in (10**6, 2200))
    assert np.mean([one[k] == several[k] for k in one]) > 0.97


def test_executors_without_the_package(tmp_path):
    """A session whose workers can't import this package."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[2])!r})
from tessera.session import local_session
from tessera.llm.queries import QUERIES
spark = local_session("bare", 2, 2)
assert QUERIES["op5_quality_classifier"](spark, "/root/testdata/sf0.001").count() == 200
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=300)
