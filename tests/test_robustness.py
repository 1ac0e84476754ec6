import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import agreement as A
from tessera.operators import neighbours as N
from tessera.operators import robustness as R
from tessera.sources import fixtures as X
from tests.conftest import one

SCHEMA = "sample_id string, row_idx bigint, label string, medical_center string, slide_id string, embedding array<float>"


def frame(spark, vectors, labels, centers, slides):
    rows = [
        (f"s{i:04d}", i, str(labels[i]), str(centers[i]), str(slides[i]), [float(x) for x in v])
        for i, v in enumerate(vectors)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_four_point_index_is_one(spark):
    # Neighbour of each point: same label, other centre.
    v = [[1, 0], [1, 0.05], [0, 1], [0.05, 1]]
    df = frame(spark, v, [0, 0, 1, 1], [0, 1, 0, 1], "abcd")
    cells = A.cell_counts(df, *R.CELL)
    partials = R.cell_neighbours(df, 1)
    row = one(R.pair_robustness(partials, R.infer_pairs(cells, "d"), 1))
    assert (row["so"], row["os"], row["value"]) == (4, 0, 1.0)


@pytest.mark.parametrize("block_rows", [7, 64, 4096])
def test_blocks_do_not_change_neighbours(spark, block_rows):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 5))
    v[10] = v[11] = v[12]  # ties
    df = frame(spark, v, rng.integers(0, 2, 60), rng.integers(0, 3, 60), rng.integers(0, 9, 60))
    got = N.knn_cosine(df, 4, block_rows=block_rows)
    found = {(r["query_id"], r["rank"]): r["neighbour_id"] for r in got.collect()}
    unit = v.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True) + 1e-12
    sims = np.round(unit @ unit.T, 9)
    for i in range(60):
        order = sorted((j for j in range(60) if j != i), key=lambda j: (-sims[i, j], j))[:4]
        assert [found[(f"s{i:04d}", r + 1)] for r in range(4)] == [f"s{j:04d}" for j in order]


def test_own_slide_only_fills_up(spark):
    v = [[1, 0], [1, 0.01], [1, 0.02], [0.5, 1], [0.4, 1]]
    df = frame(spark, v, "aabba", "xyxyx", ["p", "p", "p", "q", "q"])
    chosen = N.slide_aware_neighbours(R.cell_neighbours(df, 3), 3, 5)
    mine = chosen.where("query_id = 's0000'").orderBy("rank").collect()
    assert [(r["neighbour_id"], r["backfilled"]) for r in mine] == [("s0003", False), ("s0004", False), ("s0001", True)]
    with pytest.raises(Exception, match="not enough neighbours"):
        N.slide_aware_neighbours(R.cell_neighbours(df, 5), 5, 5).collect()


def test_no_informative_neighbour_is_one_half(spark):
    # Two close points per cell: every nearest neighbour agrees in label and centre.
    v = [[c + e for c, e in zip(base, (d, 0, 0, 0))] for base in np.eye(4) for d in (0.0, 0.01)]
    df = frame(spark, v, "aaaabbbb", "xxyyxxyy", "12345678")
    row = one(R.pair_robustness(R.cell_neighbours(df, 1), R.infer_pairs(A.cell_counts(df, *R.CELL), "d"), 1))
    assert (row["so"], row["os"], row["value"]) == (0, 0, 0.5)


def merged_frame(spark):
    rng = np.random.default_rng(11)
    v = rng.normal(size=(150, 4))
    v[20:30] = v[20]  # ties across cells and slides
    return frame(spark, v, rng.integers(0, 3, 150), rng.integers(0, 3, 150), rng.integers(0, 6, 150))


@pytest.mark.parametrize(("block_rows", "held"), [(4096, 1 << 23), (4096, 9 * 67 * 10)])
def test_cells_merged_in_the_task(spark, monkeypatch, block_rows, held):
    """Counts of the pairs are those from lists per cell, whatever a task holds; the lists stay in the task."""
    monkeypatch.setattr(N, "LEAST_BLOCK", 8)
    monkeypatch.setattr(N, "HELD_ROWS", held)
    df = merged_frame(spark)
    pairs = R.infer_pairs(A.cell_counts(df, *R.CELL), "d")
    want = {tuple(r) for r in R.pair_robustness(R.cell_neighbours(df, 3), pairs, 3).select("pair_id", "so", "os", "value").collect()}
    got = {tuple(r) for r in R.pair_robustness_of(df, pairs, 3, block_rows).select("pair_id", "so", "os", "value").collect()}
    assert got == want and len(got) == 9


def test_windows_of_the_whole_set_have_one_list_a_row(spark):
    df = merged_frame(spark)
    assert R.whole_neighbours(df, 3).count() == 150 * 67
    keys = ["query_id", "neighbour_id", "rank", "backfilled"]
    one_list, by_cell = ({tuple(r) for r in N.slide_aware_neighbours(p, 3, 67).select(*keys).collect()} for p in (R.whole_neighbours(df, 3), R.cell_neighbours(df, 3)))
    assert one_list == by_cell


def test_pairs_need_four_cells(spark):
    cells = spark.createDataFrame(
        [("a", "x", 3), ("a", "y", 1), ("b", "x", 2), ("b", "y", 4), ("c", "x", 9), ("c", "z", 1)],
        "label string, medical_center string, n bigint",
    )
    row = one(R.infer_pairs(cells, "d"))
    assert (row["pair_id"], row["pair_rows"]) == ("d::a__b::x__y", 10)


def test_pair_subsampling_is_seeded(spark, sf):
    pairs = R.infer_pairs(A.cell_counts(X.eval_manifest(spark, sf), *R.CELL), "t")
    pick = lambda seed: {r["pair_id"] for r in R.subsample_pairs(pairs, 3, seed).collect()}
    assert len(pick(1)) == 3 and pick(1) == pick(1)
    assert R.subsample_pairs(pairs, None).count() == pairs.count()


def test_best_k_takes_the_first_of_equals(spark):
    acc = spark.createDataFrame([(5, 0.9), (3, 0.9), (7, 0.8)], "k bigint, balanced_accuracy double")
    assert one(R.best_k(acc, (3, 5, 7)))["k"] == 3
    assert one(R.best_k(acc, (5, 3, 7)))["k"] == 5


def test_majority_ties_go_to_the_first_label(spark):
    votes = spark.createDataFrame([(1, "z", 0), (1, "a", 1), (2, "a", 1), (2, "a", 1), (2, "z", 0)], "q bigint, label string, code bigint")
    got = {r["q"]: r["predicted"] for r in A.majority_vote(votes, ["q"], "label", "code").collect()}
    assert got == {1: "z", 2: "a"}


def test_ari_and_clustering_agreement(spark):
    df = spark.createDataFrame([(0, 0, 0), (0, 0, 1), (1, 1, 0), (1, 1, 1)], "cluster int, label int, medical_center int")
    row = one(A.clustering_agreement(df, "cluster"))
    assert row["ari_label"] == 1.0 and row["score"] > 0.9
    single = df.limit(1)
    assert one(A.adjusted_rand(single, "label", "cluster"))["ari"] == 0.0
    same = df.withColumn("cluster", F.lit(0)).withColumn("label", F.lit(0))
    assert one(A.adjusted_rand(same, "label", "cluster"))["ari"] == 0.0


def test_ari_against_pair_counting(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 3, 40), rng.integers(0, 4, 40)
    df = spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "t int, p int")
    n11 = n10 = n01 = n00 = 0
    for i, j in itertools.combinations(range(40), 2):
        x, y = a[i] == a[j], b[i] == b[j]
        n11, n10, n01, n00 = n11 + (x and y), n10 + (x and not y), n01 + (not x and y), n00 + (not x and not y)
    expected = 2 * (n11 * n00 - n10 * n01) / ((n11 + n10) * (n10 + n00) + (n11 + n01) * (n01 + n00))
    assert one(A.adjusted_rand(df, "t", "p"))["ari"] == pytest.approx(expected)


def test_agreement_of_pairs_is_that_of_their_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, f"l{a}", f"m{b}", None if c == 3 else int(c)) for i, (a, b, c) in enumerate(zip(*(rng.integers(0, n, 400).tolist() for n in (3, 3, 4))))]
    df = spark.createDataFrame(rows, "sample_id long, label string, medical_center string, cluster int")
    pairs = R.infer_pairs(A.cell_counts(df, "label", "medical_center"), "d")
    columns = ["pair_id", "n", *[F.round(c, 9).alias(c) for c in ("ari_label", "ari_center", "score")]]
    by_cube = R.pair_agreement(df, pairs).select(*columns)
    by_rows = A.clustering_agreement(R.subset_by_pair(df, pairs), "cluster", keys=["pair_id"]).select(*columns)
    assert by_cube.count() == pairs.count() > 1
    assert by_cube.exceptAll(by_rows).isEmpty() and by_rows.exceptAll(by_cube).isEmpty()
    some = pairs.limit(1)
    apart = R.subset_by_pair(df, some)
    label, got = one(A.adjusted_rand(apart, "label", "cluster")), one(R.pair_agreement(df, some))
    assert got["ari_label"] == pytest.approx(label["ari"]) and got["n"] == label["n"]
    center = one(A.adjusted_rand(apart, "medical_center", "cluster"))
    assert got["score"] == pytest.approx(label["ari"] - center["ari"])


def test_agreement_of_nothing(spark):
    none = spark.createDataFrame([], "sample_id long, label string, medical_center string, cluster int")
    assert tuple(one(A.adjusted_rand(none, "label", "cluster"))) == (0.0, 0)
    assert A.adjusted_rand(none, "label", "cluster", ["sample_id"]).isEmpty()
    assert one(A.clustering_agreement(none, "cluster"))["score"] == 0.0


@pytest.mark.parametrize("table,v", [([[2100, 2100], [2100, 2100]], 0.0), ([[0, 4200], [4200, 0]], 1.0), ([[1500, 2700], [2700, 1500]], 0.2857)])
def test_cramers_v(spark, table, v):
    rows = [(str(i), str(j), n) for i, r in enumerate(table) for j, n in enumerate(r)]
    cells = spark.createDataFrame(rows, "label string, medical_center string, n bigint")
    assert one(A.cramers_v(cells, "label", "medical_center"))["cramers_v"] == pytest.approx(v, abs=1e-3)


def test_silhouette_blocks_and_singletons(spark):
    v = [[0, 1], [0.1, 1], [1, 0], [1, 0.1], [-1, -1]]
    df = frame(spark, v, "aabbc", "xxxxx", "12345").withColumn("cluster", F.col("label"))
    whole = one(N.silhouette(df, "cluster"))["silhouette"]
    split = one(N.silhouette(df, "cluster", block_rows=2))["silhouette"]
    unit = np.array(v) / np.linalg.norm(v, axis=1, keepdims=True)
    d = np.linalg.norm(unit[:, None] - unit[None], axis=2)
    groups = [[0, 1], [2, 3], [4]]
    s = []
    for g in groups:
        for i in g:
            if len(g) == 1:
                s.append(0.0)
                continue
            a = np.mean([d[i, j] for j in g if j != i])
            b = min(np.mean([d[i, j] for j in h]) for h in groups if h is not g)
            s.append((b - a) / max(a, b))
    assert whole == pytest.approx(np.mean(s), abs=1e-6) and split == pytest.approx(whole, abs=1e-9)


def test_result_does_not_depend_on_row_order(spark, sf):
    df = X.eval_features(spark, sf).where("row_idx < 200")
    a = one(R.compute_ri(df, "d", (3, 5)))
    b = one(R.compute_ri(df.repartition(5), "d", (3, 5), block_rows=64))
    assert tuple(a) == tuple(b)
