import hashlib

import numpy as np
import pytest
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.hashing import blake_partition, hash_partition
from tessera.operators import index as I
from tessera.operators import masks as K
from tessera.operators import sampling as W
from tessera.operators import targets as T
from tessera.plans.catalog import queries as catalog_queries
from tessera.plans.sampling_pass import sampling_plan
from tessera.session import materialize
from tessera.sources import fixtures as X
from tests.conftest import one

P = I.DEFAULT_PROFILE


@pytest.fixture(scope="module")
def catalog(spark):
    sf = "/root/testdata/sf0.001"
    anchors = I.anchor_catalog(X.slides(spark, sf), X.mask_runs(spark, sf), P)
    return materialize(I.with_shards(anchors, 8), "catalog")


def test_inverse_frequency_weights(spark):
    counts = spark.createDataFrame([("a", 100), ("b", 25)], "stratum_id string, anchors bigint")
    w = {r["stratum_id"]: r["weight"] for r in W.stratum_weights(counts).collect()}
    assert w["a"] == pytest.approx(0.2) and w["b"] == pytest.approx(0.8)
    w = {r["stratum_id"]: r["weight"] for r in W.stratum_weights(counts, {"a": 3.0}).collect()}
    assert w == {"a": 1.0, "b": 0.0}


@pytest.mark.parametrize("weights", ["sometimes", {"a": -1.0}, 5])
def test_bad_weights(spark, weights):
    counts = spark.createDataFrame([("a", 1)], "stratum_id string, anchors bigint")
    with pytest.raises(ValueError):
        W.stratum_weights(counts, weights)


def test_partition_is_stable_and_in_range(spark):
    df = spark.range(500).select(F.concat(F.lit("a"), "id").alias("k"))
    for fn in (hash_partition, blake_partition):
        rows = df.select(fn(F.col("k"), 17).alias("p")).collect()
        assert rows == df.select(fn(F.col("k"), 17).alias("p")).collect()
        assert all(0 <= r["p"] < 17 for r in rows) and len({r["p"] for r in rows}) == 17


def test_each_cycle_visits_every_anchor_once(spark, catalog):
    n = catalog.where("stratum_id = 'ASIA'").count()
    draws = W.draw_range(spark, 1500)
    drawn = W.sample_anchors(catalog, draws, seed=3, weights={"ASIA": 1.0})
    assert drawn.count() == 1500
    assert {r["stratum_id"] for r in drawn.select("stratum_id").distinct().collect()} == {"ASIA"}
    per_cycle = drawn.groupBy("cycle").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("anchor_id").alias("d")).orderBy("cycle").collect()
    assert all(r["n"] == r["d"] == n for r in per_cycle[:-1])
    # shards come in a new order, their rows stay in order
    orders = {}
    for r in drawn.where(F.col("cycle") < per_cycle[-1]["cycle"]).orderBy("visit").collect():
        orders.setdefault(r["cycle"], []).append(r["shard_key"])
    assert len({tuple(sorted(o)) for o in orders.values()}) == 1
    assert len({tuple(o) for o in orders.values()}) > 1
    rows = drawn.where("cycle = 0").orderBy("visit").select("shard_key", "row_in_shard").collect()
    assert all(b["row_in_shard"] == a["row_in_shard"] + 1 for a, b in zip(rows, rows[1:]) if a["shard_key"] == b["shard_key"])


def test_draws_meet_few_shards(spark, catalog, monkeypatch):
    """A bin of positions holds about one shard, whatever the number of shards: in bins of a
    fixed width every draw met all shards of its bin."""
    calls = []
    lookup = W.lookup_interval
    monkeypatch.setattr(W, "lookup_interval", lambda *a: calls.append(a) or lookup(*a))
    fine = I.with_shards(catalog.drop("shard_index", "row_in_shard"), 2)
    drawn = W.sample_anchors(fine, W.draw_range(spark, 1500), seed=3, weights={"ASIA": 1.0})
    points, point, intervals, low, high, width, keys = calls[-1]
    width = width if isinstance(width, Column) else F.lit(width)
    bins = intervals.withColumn("bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor((F.col(high) - 1) / width))))
    pairs = points.withColumn("bin", F.floor(F.col(point) / width)).join(bins.select(*keys, "bin"), [*keys, "bin"]).count()
    assert drawn.count() == 1500 and pairs <= 3 * 1500


def test_readers_see_disjoint_anchors_and_passes_differ(spark, catalog):
    draws = W.draw_range(spark, 400, 2)
    drawn = W.sample_anchors(catalog, draws, seed=1, partitions=2)
    seen = drawn.groupBy("anchor_id").agg(F.countDistinct("partition").alias("n"))
    assert seen.where("n > 1").isEmpty()
    other = W.sample_anchors(catalog, draws, seed=1, pass_index=1, partitions=2)
    key = ["partition", "draw_idx", "anchor_id"]
    assert not drawn.select(key).exceptAll(other.select(key)).isEmpty()


def test_global_strategy_and_strata_missing_from_a_partition(spark, catalog):
    draws = W.draw_range(spark, 300)
    assert W.sample_anchors(catalog, draws, strategy="global_uniform").count() == 300
    lonely = catalog.where("slide_id = 'S1'").unionByName(catalog.where("slide_id = 'S2'").limit(1))
    assert W.sample_anchors(lonely, W.draw_range(spark, 50, 4), partitions=4).count() > 0


def test_weights_steer_the_draws(spark, catalog):
    drawn = W.sample_anchors(catalog, W.draw_range(spark, 4000), seed=9, weights="uniform")
    shares = [r["count"] / 4000 for r in drawn.groupBy("stratum_id").count().collect()]
    assert all(abs(s - 1 / len(shares)) < 0.05 for s in shares)


def test_index_lookup_wraps_and_fails(spark):
    anchors = spark.createDataFrame([(0, "a", False), (1, "b", True), (2, "c", False)], "position bigint, anchor_id string, ok boolean")
    requests = spark.createDataFrame([(0,), (1,), (2,), (5,)], "index bigint")
    found = {r["index"]: r["anchor_id"] for r in W.anchor_by_index(anchors, requests, "ok").collect()}
    assert found == {0: "b", 1: "b", 2: "b", 5: "b"}
    with pytest.raises(ValueError, match="no anchor"):
        W.anchor_by_index(anchors.withColumn("ok", F.lit(False)), requests, "ok")


@pytest.mark.parametrize("n,share", [(1, 1.0), (31, 0.2), (32, 0.2), (33, 0.1), (500, 0.02), (3000, 0.3)])
def test_index_lookup_against_a_scan(spark, n, share):
    rng = np.random.default_rng(n)
    ok = rng.random(n) < share
    ok[rng.integers(n)] = True
    anchors = spark.createDataFrame([(i, f"a{i}", None if i % 7 == 3 and not u else bool(u)) for i, u in enumerate(ok)], "position bigint, anchor_id string, ok boolean")
    asked = [int(i) for i in rng.integers(-n, 3 * n, 200)] + [0, n - 1, n, -1]
    requests = spark.createDataFrame(list(enumerate(asked)), "r int, index bigint")
    found = {r["r"]: r["position"] for r in W.anchor_by_index(anchors, requests, "ok").collect()}
    places = np.flatnonzero(ok)
    for r, index in enumerate(asked):
        ahead = places[places >= index % n]
        assert found[r] == (ahead[0] if len(ahead) else places[0])
    assert len(found) == len(asked)


def test_shards_of_a_cycle_are_in_hash_order(spark):
    sizes = {f"s{i:03d}": 1 + i % 5 for i in range(300)}
    rows = [(0, "A", c, k, n) for c in range(3) for k, n in sizes.items()]
    shards = spark.createDataFrame(rows, "partition bigint, draw_stratum string, cycle bigint, shard_key string, rows bigint")
    got = {(r["cycle"], r["shard_key"]): (r["shard_lo"], r["shard_hi"]) for r in W.shuffled_shards(shards, 4, 1).collect()}
    for cycle in range(3):
        at = 0
        for key in sorted(sizes, key=lambda k: hashlib.md5(f"4|1|0|{cycle}|{k}".encode()).hexdigest()):
            assert got.pop((cycle, key)) == (at, at + sizes[key])
            at += sizes[key]
    assert not got


def context(spark, tissue, ctx=64, target=16, margin_um=8.0, keys=20):
    """Anchors with a given context tissue (list of rectangles or None)."""
    kind = "array<struct<x0:double,y0:double,x1:double,y1:double>>"
    lit = F.lit(None).cast(kind) if tissue is None else F.array(
        *[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), r)]) for r in tissue]
    ).cast(kind)
    return spark.range(keys).select(
        F.concat(F.lit("a"), "id").alias("anchor_id"),
        F.lit(ctx).cast("bigint").alias("context_size_requested_px"),
        F.lit(target).cast("bigint").alias("target_size_in_context_px"),
        F.lit(margin_um).alias("target_margin_um"),
        F.lit(1.0).alias("context_effective_mpp"),
        lit.alias("tissue"),
    )


def area(a, b):
    return max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))


@pytest.mark.parametrize("aligned", [False, True])
def test_placed_targets_respect_all_rules(spark, aligned):
    square = (16, 16, 48, 48)
    policy = T.PlacementPolicy(patch=8, aligned=aligned, min_tissue=0.5, policy="skip_anchor")
    rows = T.place_targets(context(spark, [square]), P, policy, seed=4).collect()
    placed = [r for r in rows if r["targets"]]
    assert placed
    for r in placed:
        boxes = [(b["x0"], b["y0"], b["x1"], b["y1"]) for b in r["targets"]]
        assert len(boxes) == 4
        for i, b in enumerate(boxes):
            assert 0 <= b[0] and b[2] <= 64 and b[2] - b[0] == 16
            assert area(b, square) / 256 >= 0.5
            assert r["targets"][i]["fraction"] == pytest.approx(area(b, square) / 256)
            assert all(area(b, o) <= 64 for o in boxes[:i])
            assert not aligned or (b[0] % 8 == 0 and b[1] % 8 == 0)


def test_placement_equals_a_step_by_step_search(spark):
    import hashlib

    square = (8, 4, 44, 40)
    policy = T.PlacementPolicy(patch=8, min_tissue=0.9, min_tissue_floor=0.3, min_tissue_step=0.2)
    rows = T.place_targets(context(spark, [square], keys=12), P, policy, seed=4).collect()
    for r in rows:
        expected = None
        for t in policy.thresholds():
            boxes = []
            for i in range(1, policy.max_attempts + 1):
                if len(boxes) == 4:
                    break
                h = hashlib.md5(f"4|0|{r['anchor_id']}|{i}".encode()).hexdigest()
                x0, y0 = (8 + int(h[k : k + 8], 16) % 48 - 8 for k in (0, 8))
                b = (x0, y0, x0 + 16, y0 + 16)
                if b[0] < 0 or b[1] < 0 or b[2] > 64 or b[3] > 64 or any(area(b, o) > 64 for o in boxes):
                    continue
                if area(b, square) / 256 >= t:
                    boxes.append(b)
            if len(boxes) == 4:
                expected = (t, boxes)
                break
        got = r["targets"] and (r["effective_threshold"], [(b["x0"], b["y0"], b["x1"], b["y1"]) for b in r["targets"]])
        assert got == expected


def test_impossible_tissue_gives_nothing(spark):
    policy = T.PlacementPolicy(patch=8, min_tissue=0.95, policy="skip_anchor")
    rows = T.place_targets(context(spark, [(24, 24, 40, 40)], keys=3), P, policy).collect()
    assert all(r["targets"] is None and r["effective_threshold"] is None for r in rows)


def test_without_a_mask_tissue_is_not_tested(spark):
    policy = T.PlacementPolicy(patch=8, policy="skip_anchor")
    rows = T.place_targets(context(spark, None, keys=5), P, policy).collect()
    assert all(len(r["targets"]) == 4 and r["targets"][0]["fraction"] is None for r in rows)


def test_thresholds_are_lowered_in_turn(spark):
    # A strip 8 px wide: no 16-px box is more than half tissue.
    policy = T.PlacementPolicy(patch=8, min_tissue=0.7, min_tissue_floor=0.3, min_tissue_step=0.1)
    assert policy.thresholds() == [0.7, 0.6, 0.5, 0.4, 0.3]
    rows = T.place_targets(context(spark, [(28, 0, 36, 64)], keys=8), P, policy).collect()
    assert {r["effective_threshold"] for r in rows} <= {0.5, 0.4, 0.3} and rows[0]["targets"]
    with pytest.raises(ValueError):
        T.PlacementPolicy(policy="skip_slide").thresholds()


def test_context_too_small_for_the_margin(spark):
    rows = T.place_targets(context(spark, None, ctx=16, target=16, margin_um=100.0, keys=2), P, T.PlacementPolicy(patch=8, aligned=True))
    assert all(r["targets"] is None or r["targets"][0]["x0"] == 0 for r in rows.collect())


def footprint(spark, boxes, **options):
    rows = [(0, 0, [tuple(map(float, b)) for b in boxes])]
    schema = "sample_idx bigint, batch_id bigint, boxes array<struct<x0:double,y0:double,x1:double,y1:double>>"
    return one(K.footprint_masks(spark.createDataFrame(rows, schema), 14, 14, 16, **options))


def test_encoder_and_predictor_masks_do_not_meet(spark):
    boxes = [(32, 32, 96, 96), (96, 32, 160, 96), (32, 96, 96, 160), (96, 96, 160, 160)]
    row = footprint(spark, boxes, encoders=2)
    pred = {t for m in row["pred_masks"] for t in m}
    assert len(row["enc_masks"]) == 2 and len(row["enc_masks"][0]) == 132
    assert not pred & set(row["enc_masks"][0]) and not row["leak"]


def test_full_footprint_falls_back_and_is_flagged(spark):
    row = footprint(spark, [(0, 0, 224, 224)])
    assert row["enc_masks"][0] == [0, 1, 2, 3] and row["leak"]


def test_batch_is_cut_to_the_shortest(spark, sf):
    masked = K.footprint_masks(X.target_boxes(spark, sf), 32, 32, 16)
    lengths = masked.select("batch_id", F.explode("pred_masks").alias("m")).groupBy("batch_id").agg(F.countDistinct(F.size("m")).alias("n"))
    assert lengths.where("n > 1").isEmpty()
    assert masked.where(F.exists("pred_masks", lambda m: F.arrays_overlap(m, F.element_at("enc_masks", 1)))).isEmpty()


def test_multiblock_masks(spark, sf):
    made = K.multiblock_masks(X.target_boxes(spark, sf).select("sample_idx", "batch_id"), 14, 14, encoders=2, seed=2)
    rows = made.collect()
    for r in rows:
        assert len(r["pred_masks"]) == 4 and len(r["enc_masks"]) == 2
        pred = {t for m in r["pred_masks"] for t in m}
        assert all(0 <= t < 196 for m in r["enc_masks"] for t in m) and all(0 <= t < 196 for t in pred)
        assert all(len(m) == r["keep_enc"] for m in r["enc_masks"])
    full = K.multiblock_masks(X.target_boxes(spark, sf).select("sample_idx", "batch_id"), 14, 14, allow_overlap=True, seed=2)
    assert full.agg(F.min("keep_enc")).first()[0] > 100
    tiny = K.multiblock_masks(X.target_boxes(spark, sf).select("sample_idx", "batch_id"), 4, 4, min_keep=15)
    with pytest.raises(Exception, match="too few tokens"):
        tiny.collect()


def test_random_split_is_a_partition(spark, sf):
    rows = K.random_token_split(X.target_boxes(spark, sf).select("sample_idx", "batch_id"), 49, (0.3, 0.7)).collect()
    ratios = {}
    for r in rows:
        assert sorted(r["enc_mask"] + r["pred_mask"]) == list(range(49))
        assert len(r["enc_mask"]) == int(49 * (1 - r["mask_ratio"]))
        ratios.setdefault(r["batch_id"], set()).add(r["mask_ratio"])
    assert all(len(v) == 1 for v in ratios.values())


def test_sampling_pass(spark, sf, catalog):
    plan = sampling_plan(
        X.slides(spark, sf), X.mask_runs(spark, sf), catalog.drop("shard_index", "row_in_shard"),
        W.draw_range(spark, 64), P, T.PlacementPolicy(), seed=1, rows_per_shard=8,
    )
    rows = plan.collect()
    assert 0 < len(rows) <= 64 and all(len(r["targets"]) == 4 for r in rows)
    batches = {}
    for r in rows:
        batches.setdefault(r["batch_id"], []).append(r["keep_pred"])
    assert all(len(v) <= 8 and len(set(v)) == 1 for v in batches.values())
    assert sorted(r["sample_idx"] for r in rows) == list(range(len(rows)))


def test_sampling_pass_searches_once(spark, sf, catalog):
    """The rows that are numbered come from a table: the search is not in the plan that reads them twice."""
    plan = sampling_plan(
        X.slides(spark, sf), X.mask_runs(spark, sf), catalog.drop("shard_index", "row_in_shard"),
        W.draw_range(spark, 8), P, T.PlacementPolicy(), rows_per_shard=8,
    )
    assert "MapInArrow" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_repeat_interleave_matches_blocks(spark):
    rows = spark.range(6).select("id", F.col("id").alias("o"))
    got = [r["id"] for r in K.repeat_interleave(rows, "o", 2, 3).orderBy("o").collect()]
    x = np.arange(6)
    assert got == np.concatenate([np.tile(x[i : i + 2], 3) for i in (0, 2, 4)]).tolist()


def test_box_tokens_are_made_in_all_tasks(spark, sf):
    """Some seventy rows a box: a file of few bytes is not expanded in one task."""
    made = catalog_queries()["box_tokens"](spark, sf)
    assert made.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "size(transform" not in plan[plan.index("RepartitionByExpression") :]
