import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import learning as M
from tessera.operators.clustering import fit_kmeans
from tessera.plans import evaluation as E
from tessera.sources import fixtures as X
from tests.conftest import one


def blobs(spark, n=90):
    rng = np.random.default_rng(1)
    centers = np.eye(3) * 4
    rows = []
    for i in range(n):
        v = centers[i % 3] + rng.normal(size=3) * 0.1
        label, center = "ab"[i % 3 != 0], "xy"[(i // 3) % 2]
        rows.append((f"s{i:03d}", i, label, center, f"{center}{label}{i % 5}", [float(x) for x in v]))
    return spark.createDataFrame(
        rows, "sample_id string, row_idx bigint, label string, medical_center string, slide_id string, embedding array<float>"
    )


def test_kmeans_and_silhouette_find_the_blobs(spark):
    df = blobs(spark).withColumn("feature", F.col("embedding").cast("array<double>"))
    sizes = [r["count"] for r in M.kmeans(df, 3, restarts=4).groupBy("cluster").count().collect()]
    assert sorted(sizes) == [30, 30, 30]
    assert M.best_k_by_silhouette(df, 2, 4, restarts=4) == 3


def test_kmeans_goes_on_until_rows_stay(spark, monkeypatch):
    """A fit that still moves when the joint passes end is not the result."""
    monkeypatch.setattr(M, "fit_kmeans", lambda rows, wanted, seed: fit_kmeans(rows, wanted, seed, max_passes=1))
    x = np.random.default_rng(2).normal(size=(400, 3))
    df = spark.createDataFrame([(f"s{i}", v.tolist()) for i, v in enumerate(x)], "sample_id string, feature array<double>")
    with pytest.warns(UserWarning, match="still moved"):
        rows = M.kmeans(df, 4, restarts=2).collect()
    x, own = np.array([r["feature"] for r in rows]), np.array([r["cluster"] for r in rows])
    means = np.array([x[own == c].mean(axis=0) for c in range(4)])
    assert (((x[:, None] - means) ** 2).sum(axis=2).argmin(axis=1) == own).all()


def test_clustering_score_prefers_labels(spark):
    row = one(M.clustering_score(blobs(spark), "d", repeats=1, k_max=3, search_restarts=2, score_restarts=2))
    assert row["n"] == 1 and row["value"] > 0.4


def test_probe_separates_what_is_separable(spark):
    df = blobs(spark)
    part = F.when(F.col("row_idx") % 3 == 0, "train").when(F.col("row_idx") % 3 == 1, "id_test").otherwise("ood_test")
    shuffled = df.withColumn("row_idx", F.pmod(F.xxhash64("sample_id"), F.lit(30)))
    splits = shuffled.select(
        "sample_id", "label", part.alias("partition"), F.lit(0.0).alias("correlation_level"),
        F.explode(F.array(*[F.lit(i).cast("bigint") for i in (1, 2)])).alias("split_id"), F.lit(0).cast("bigint").alias("rep"),
    )
    drop, by_rho = M.compute_apd(splits, df.select("sample_id", "embedding"), c=100.0)
    assert {r["metric"]: r["value"] for r in drop.collect()} == {"apd_id": 0.0, "apd_ood": 0.0, "apd_avg": 0.0}
    assert one(by_rho)["mean_id"] > 0.95
    with pytest.raises(RuntimeError, match="lacks a partition"):
        M.linear_probe(M.align_features(splits.where("partition <> 'id_test'"), df))


def test_many_classes_are_scored_by_argmax(spark):
    rows = spark.createDataFrame([([1.0, 0.0], 0, 1), ([0.0, 1.0], 0, 1), ([-1.0, -1.0], 0, 1)], "feature array<double>, rep bigint, split_id bigint")
    models = spark.createDataFrame([(0, 1, [[2.0, 0.0], [0.0, 2.0], [-1.0, -1.0]], [0.0, 0.0, 0.5])], M.MODEL_SCHEMA)
    got = {tuple(r["feature"]): r["predicted"] for r in M.score_linear(rows, models).collect()}
    assert got == {(1.0, 0.0): 0, (0.0, 1.0): 1, (-1.0, -1.0): 2}


def test_plugins():
    with pytest.raises(ValueError, match="unknown plugin"):
        E.build_plugins([{"type": "nothing"}])
    assert E.build_plugins([{"type": "nothing", "enable": False}]) == []
    plugin = E.build_plugins([{"type": "robustness", "tune_every_images": 100}])[0]
    assert plugin.should_run(200, 1) and not plugin.should_run(250, 1)


def test_event_keeps_going_and_demands_its_selection(spark, sf):
    rows = X.eval_features(spark, sf)
    data = {"good": E.EvalDataset(rows), "bad": E.EvalDataset(rows.where("label = 'tumor'"))}
    plugins = E.build_plugins([{"type": "robustness", "ri": {"k_candidates": [3]}}])
    event = E.evaluate(spark, plugins, data, 1, 64)
    assert set(event.errors) == {"robustness/bad"} and set(event.log) == {"robustness/good/ri"}
    assert event.rows.first()["extra"] == '{"k": 3}'
    stopping = {"enable": True, "selection": {"plugin": "robustness", "dataset": "bad", "metric": "ri"}}
    with pytest.raises(ValueError, match="was not emitted"):
        E.evaluate(spark, plugins, data, 1, 64, stopping)
    assert E.evaluate(spark, [], data, 1, 64).rows.isEmpty()


def test_joint_probes_reach_the_optimum(spark):
    """Two classes (Newton steps) and three (remembered gradients), splits that overlap."""
    from tessera.operators import probes as P

    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 5))
    for names in ("ab", "abc"):
        label = [names[k] for k in (x[:, :3].argmax(axis=1) % len(names))]
        sides = ["train", "train", "id_test", "ood_test"]
        rows = [(f"s{i}", label[i], sides[(i + s) % 4], 0.0, s, 0) for i in range(120) for s in (1, 2, 3)]
        splits = spark.createDataFrame(rows, "sample_id string, label string, partition string, correlation_level double, split_id bigint, rep bigint")
        features = spark.createDataFrame([(f"s{i}", v.tolist()) for i, v in enumerate(x)], "sample_id string, feature array<double>")
        stored, known, classes = P.probe_rows(splits, features)
        assert classes == len(names) and [k[1:2] for k in known] == [(1,), (2,), (3,)]
        fits = P.fit_probes(stored, known, classes, c=0.5)
        for fit in fits:
            assert fit.done and fit.flatness <= P.TOLERANCE
            own = [i for i in range(120) if sides[(i + fit.split_id) % 4] == "train"]
            design, code = np.c_[x[own], np.ones(len(own))], np.array([names.index(label[i]) for i in own])
            penalty = np.tile(np.r_[np.ones(5), 0], len(fit.point) // 6) / (0.5 * len(own))
            objective = lambda w: P.loss_of(design, code, w, False)[0] / len(own) + 0.5 * (penalty * w * w).sum()  # noqa: B023, E731
            assert all(objective(fit.point) <= objective(fit.point + 1e-3 * rng.normal(size=len(fit.point))) for _ in range(20))
        got = {r["split_id"]: r for r in P.probe_accuracy(stored, fits).collect()}
        for fit in fits:
            z = np.c_[x, np.ones(120)] @ fit.point.reshape(-1, 6).T
            guess = (z[:, 0] > 0).astype(int) if z.shape[1] == 1 else z.argmax(axis=1)
            test = [i for i in range(120) if sides[(i + fit.split_id) % 4] == "id_test"]
            assert got[fit.split_id]["acc_id"] == np.mean([guess[i] == names.index(label[i]) for i in test])


@pytest.mark.parametrize("held", [1 << 22, 600])
def test_kmeans_takes_its_steps_in_few_passes(spark, monkeypatch, held):
    """The steps are those of passes over all rows, where a group is held whole and where it isn't."""
    from tessera.operators import clustering as C
    from tessera.session import materialize

    x = np.random.default_rng(3).normal(size=(3000, 3))
    rows = materialize(spark.createDataFrame([("g", f"s{i:04d}", v.tolist()) for i, v in enumerate(x)], "group_id string, sample_id string, feature array<double>"), "points")
    monkeypatch.setattr(C, "HELD", held)
    starts, passes, real = [], [], C._pass
    monkeypatch.setattr(C, "_spread_out", lambda pool, weight, k, rng: starts.append(pool[:k].copy()) or pool[:k].copy())
    monkeypatch.setattr(C, "_pass", lambda *args: passes.append(1) or real(*args))
    fits = C.fit_kmeans(rows, [("g", 4, 0), ("g", 7, 0)])
    steps = []
    for fit, centres in zip(fits, starts, strict=True):
        steps.append(0)
        while True:
            steps[-1] += 1
            own = ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
            after = np.array([x[own == c].mean(axis=0) for c in range(fit.k)])
            cost, far, centres = ((x - centres[own]) ** 2).sum(), np.abs(after - centres).max(), after
            if far <= 1e-6:
                break
        assert fit.steps == steps[-1] and not fit.moving
        assert np.abs(fit.centres - centres).max() < 1e-9 and fit.cost == pytest.approx(cost)
    # One pass more counts the candidates for starts.
    assert len(passes) == 2 if held > 9000 else len(passes) - 1 < max(steps)


def test_silhouettes_of_many_clusterings(spark):
    """The same as one by one; a row alone in its cluster counts 0."""
    from tessera.operators.neighbours import silhouette, silhouettes

    rng = np.random.default_rng(5)
    rows = [("ab"[i % 2], f"s{i:03d}", rng.normal(size=3).tolist(), [int(rng.integers(4)), int(i < 2), 0 if i % 2 else i % 6]) for i in range(90)]
    df = spark.createDataFrame(rows, "g string, sample_id string, feature array<double>, clusters array<int>")
    layout = {"keys": ["g"], "vector": "feature", "normalize": False, "block_rows": 20}
    got = {(r["g"], r["place"]): r for r in silhouettes(df, "clusters", **layout).collect()}
    for place in range(3):
        one_by_one = silhouette(df.withColumn("cluster", F.col("clusters")[place]), "cluster", **layout)
        for r in one_by_one.collect():
            found = got.pop((r["g"], place))
            assert found["n"] == r["n"]
            if found["used"] > 1:
                assert found["silhouette"] == pytest.approx(r["silhouette"], abs=1e-12)
            else:
                assert (r["g"], place) == ("b", 2)
    assert not got


def test_norms_are_summed_once_a_row(spark):
    """A long vector takes time by its length, not by the square of it."""
    from time import perf_counter

    from tessera.functions.arrays import l2_normalize

    x = np.random.default_rng(6).normal(size=20_000)
    df = spark.createDataFrame([(x.tolist(),), ([3.0, 4.0],), (None,), ([],)], "v array<double>")
    start = perf_counter()
    long, short, none, empty = (r[0] for r in df.select(l2_normalize(F.col("v"))).collect())
    assert perf_counter() - start < 10
    assert np.abs(np.array(long) - x / np.sqrt((x * x).sum())).max() < 1e-12 and short == pytest.approx([0.6, 0.8])
    assert none is None and empty == []
