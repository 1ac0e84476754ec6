import pytest
from pyspark.sql import functions as F

from tessera.operators import allocations as L
from tessera.operators import performance_drop as D
from tessera.operators import splits as S
from tests.conftest import one

SCHEMA = "sample_id string, label string, medical_center string, slide_id string"


def manifest(spark, centers, slides, rows, labels=("normal", "tumor")):
    data = [
        (f"{c}_{l}_{s}_{r}", l, c, f"{c}_{l}_{s}")
        for c in centers for l in labels for s in range(slides) for r in range(rows)
    ]
    return spark.createDataFrame(data, SCHEMA)


FIVE = ("RUMC", "UMCU", "CWZ", "RST", "LPON")


def test_custom_splits_are_complete_and_reproducible(spark):
    m = manifest(spark, ("RUMC", "UMCU", "CWZ"), 8, 4)
    make = lambda df: S.generate_splits(
        df, "other", ("RUMC", "UMCU"), ("CWZ",), (0.0, 0.5, 1.0), repetitions=2, seed=7, mode="custom"
    )
    splits = make(m)
    assert splits.select("rep", "split_id").distinct().count() == 6
    again = make(m.repartition(5))
    assert splits.exceptAll(again).isEmpty() and again.exceptAll(splits).isEmpty()
    assert S.leakage_report(splits.where("partition <> 'ood_test'")).isEmpty()
    # test sides do not change with the level, and ood holds whole centres
    tests = splits.where("partition <> 'train'").groupBy("rep", "split_id", "partition").count()
    assert {(r["partition"], r["count"]) for r in tests.collect()} == {("id_test", 32), ("ood_test", 64)}
    totals = splits.where("partition = 'train'").groupBy("rep", "split_id").count()
    assert {r["count"] for r in totals.collect()} == {48}
    v = {r["split_id"]: r["v"] for r in splits.groupBy("split_id").agg(F.max("cramers_v_realized").alias("v")).collect()}
    assert v[1] == pytest.approx(0.0, abs=1e-6) and v[3] == pytest.approx(1.0, abs=1e-6)
    assert v[1] < v[2] < v[3]


def test_other_seed_gives_other_rows(spark):
    m = manifest(spark, ("A", "B", "C"), 8, 4)
    args = dict(id_centers=("A", "B"), ood_centers=("C",), levels=(0.5,), repetitions=1, mode="custom")
    a = S.generate_splits(m, "d", seed=1, **args)
    assert not a.exceptAll(S.generate_splits(m, "d", seed=2, **args)).isEmpty()


def test_tabulated_splits_rescale(spark):
    m = manifest(spark, FIVE, 3, 1)
    splits = S.generate_splits(m, "camelyon", FIVE[:2], FIVE[2:], repetitions=1)
    assert splits.select("split_id").distinct().count() == 8
    # one of three slides per cell is held out, so two rows per cell remain
    sizes = splits.where("partition = 'train'").groupBy("split_id").count().collect()
    assert {r["count"] for r in sizes} == {8}


def test_unknown_dataset_without_levels_gives_no_splits(spark):
    m = manifest(spark, FIVE, 4, 2)
    assert S.generate_splits(m, "unknown", FIVE[:2], FIVE[2:]).isEmpty()


def test_missing_ood_and_empty_cells_are_errors(spark):
    m = manifest(spark, ("A", "B"), 4, 2)
    with pytest.raises(ValueError, match="out-of-distribution"):
        S.generate_splits(m, "d", ("A", "B"), ("Z",), (0.0,), mode="custom")
    holes = manifest(spark, ("A", "B", "C"), 4, 2).where("NOT (label = 'tumor' AND medical_center = 'B')")
    with pytest.raises(Exception, match="cell of the training pool is empty"):
        S.generate_splits(holes, "d", ("A", "B"), ("C",), (0.0,), mode="custom").collect()


def test_slide_in_two_cells_is_reported(spark):
    rows = [(f"x{i}", l, "A", f"s{i}") for i in range(10) for l in ("normal", "tumor")]
    rows = [(f"{s}_{l}", l, c, sl) for s, l, c, sl in rows] + [("o1", "normal", "C", "o"), ("o2", "tumor", "C", "o")]
    m = spark.createDataFrame(rows, SCHEMA)
    with pytest.raises(RuntimeError, match="leakage"):
        S.generate_splits(m, "d", ("A",), ("C",), (0.0,), mode="custom")


@pytest.mark.parametrize("slides,held", [(1, 0), (2, 1), (5, 1), (8, 2), (10, 2)])
def test_held_out_slide_count(spark, slides, held):
    m = manifest(spark, ("A",), slides, 1, labels=("normal",))
    assert S.test_slides(m, 0.2, 0, 1).count() == held


def test_single_slide_cells_never_lose_their_training_rows(spark):
    m = manifest(spark, ("A",), 2, 3, labels=("normal",))
    assert S.slide_level_split(m, 0.99).where("NOT held_out").count() == 3


def test_tabulated_designs_reach_their_levels(spark):
    from tessera.operators.agreement import cramers_v

    for level, table in L.TABULATED.items():
        cells = spark.createDataFrame(
            [(str(i), str(j), n) for i, r in enumerate(table) for j, n in enumerate(r)],
            "label string, medical_center string, n bigint",
        )
        assert one(cramers_v(cells, "label", "medical_center"))["cramers_v"] == pytest.approx(level, abs=0.02)


def brute_fill(slack, amount):
    slack, given = list(slack), [0] * len(slack)
    for _ in range(amount):
        i = max(range(len(slack)), key=lambda x: (slack[x], -x))
        if slack[i] <= 0:
            break
        slack[i] -= 1
        given[i] += 1
    return given


@pytest.mark.parametrize("slack", [(5, 3, 9, 0), (4, 4, 4, 4), (0, 0, 0, 0), (10, 1, 1, 1), (7, 6, 6, 2)])
def test_water_fill_equals_one_by_one(spark, slack):
    rows = [(a, i, s, a) for a in (-2, 0, 1, 3, 7, 11, 100) for i, s in enumerate(slack)]
    cells = spark.createDataFrame(rows, "k bigint, idx bigint, slack bigint, amount bigint")
    got = L.water_fill(cells, ["k"], "slack", "amount", "idx", "given").orderBy("k", "idx").collect()
    for a in {r[0] for r in rows}:
        assert [r["given"] for r in got if r["k"] == a] == brute_fill(slack, max(a, 0))


def test_custom_allocation_keeps_totals_and_caps(spark):
    cells = spark.createDataFrame(
        [(0, l, c, i, j, i * 3 + j, 4 + 3 * i + 5 * j)
         for i, l in enumerate("ab") for j, c in enumerate("xyz")],
        "rep bigint, label string, medical_center string, i bigint, j bigint, idx bigint, avail bigint",
    )
    out = S.split_allocation(cells, "d", "custom", (0.0, 0.3, 1.0)).collect()
    for split in (1, 2, 3):
        rows = [r for r in out if r["split_id"] == split]
        assert sum(r["want"] for r in rows) == 12 and all(0 <= r["want"] <= r["avail"] for r in rows)
    assert {r["want"] for r in out if r["split_id"] == 1} == {2}


def test_performance_drop(spark):
    acc = spark.createDataFrame(
        [(0, 1, 0.0, 0.80, 0.80), (0, 2, 0.5, 0.76, 0.80), (0, 3, 1.0, 0.72, 0.80)],
        "rep bigint, split_id bigint, correlation_level double, acc_id double, acc_ood double",
    )
    row = one(D.drop_by_rep(acc))
    assert row["apd_id"] == pytest.approx(-0.075) and row["apd_ood"] == 0.0
    assert one(D.drop_by_rep(acc.where("split_id = 1")))["apd_avg"] == 0.0
    with pytest.raises(Exception, match="split 1 is missing"):
        D.drop_by_rep(acc.where("split_id > 1")).collect()


def test_split_cache(spark, tmp_path):
    m = manifest(spark, ("A", "B", "C"), 5, 2)
    args = dict(id_centers=("A", "B"), ood_centers=("C",), levels=(0.0, 1.0), repetitions=1, mode="custom", seed=0)
    first, hit = S.cached_splits(m, "d", str(tmp_path), **args)
    again, hit_again = S.cached_splits(m.repartition(3), "d", str(tmp_path), **args)
    assert (hit, hit_again) == (False, True)
    assert first.exceptAll(again).isEmpty()
    _, other = S.cached_splits(m, "d", str(tmp_path), **{**args, "repetitions": 2})
    _, changed = S.cached_splits(m.where("sample_id <> 'A_normal_0_0'"), "d", str(tmp_path), **args)
    assert (other, changed) == (False, False)
