"""Split generation, allocation and performance-drop queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import allocations as L
from tessera.operators import performance_drop as D
from tessera.operators import splits as S
from tessera.plans.oracle_ctes import CTES
from tessera.plans.registry import query, with_ctes
from tessera.sources import fixtures as X

SEED, REPS, FRACTION = 11, 2, 0.2
CUSTOM_LEVELS = (0.0, 0.5, 1.0)

CTES["reps"] = f"SELECT unnest(range({REPS})) AS rep"
CTES["idrows"] = "SELECT * FROM evalm WHERE medical_center IN ('C0', 'C1')"
CTES["held"] = f"""
  SELECT rep, label, medical_center, slide_id FROM (
    SELECT *, row_number() OVER (PARTITION BY rep, label, medical_center ORDER BY md5('{SEED}|' || rep || '|' || label || '|' || medical_center || '|' || slide_id)) AS r,
      count(*) OVER (PARTITION BY rep, label, medical_center) AS s
    FROM (SELECT DISTINCT label, medical_center, slide_id FROM idrows), reps)
  WHERE r <= CASE WHEN s <= 1 THEN 0 ELSE least(s - 1, greatest(1, round_even(s * {FRACTION}::DOUBLE, 0))) END
"""
CTES["sides"] = """
  SELECT e.*, r.rep, EXISTS (SELECT 1 FROM held h WHERE h.rep = r.rep AND h.label = e.label
    AND h.medical_center = e.medical_center AND h.slide_id = e.slide_id) AS held_out
  FROM idrows e, reps r
"""
CTES["avail"] = """
  SELECT rep, label, medical_center, (label = 'tumor')::INT AS i, (medical_center = 'C1')::INT AS j,
    2 * (label = 'tumor')::INT + (medical_center = 'C1')::INT AS idx, count(*) AS avail
  FROM sides WHERE NOT held_out GROUP BY ALL
"""
# Tabulated designs scaled, largest remainder, capped, water filled unit by unit.
CTES["t_total"] = """
  SELECT rep, greatest(4, least(round_even(8400 * min(avail / 2100.0::DOUBLE), 0), sum(avail)))::BIGINT AS total FROM avail GROUP BY rep
"""
CTES["t_scaled"] = """
  SELECT *, alloc * (total / 8400.0::DOUBLE) AS s, floor(alloc * (total / 8400.0::DOUBLE)) AS f
  FROM (SELECT a.*, total, lv + 1 AS split_id, round_even(lv / 7.0::DOUBLE, 2) AS rho, CASE WHEN i = j THEN 2100 - 300 * lv ELSE 2100 + 300 * lv END AS alloc
        FROM avail a JOIN t_total USING (rep), (SELECT unnest(range(8)) AS lv))
"""
CTES["t_rounded"] = """
  SELECT *, least(avail, f + (alloc > 0 AND row_number() OVER (PARTITION BY rep, split_id ORDER BY CASE WHEN alloc = 0 THEN -1 ELSE s - f END DESC, idx DESC)
      <= total - sum(f) OVER (PARTITION BY rep, split_id))::INT)::BIGINT AS w
  FROM t_scaled
"""
CTES["t_units"] = """
  SELECT rep, split_id, idx, row_number() OVER (PARTITION BY rep, split_id ORDER BY level DESC, idx) AS r
  FROM (SELECT rep, split_id, idx, unnest(range(1, avail - w + 1)) AS level FROM t_rounded)
"""
CTES["t_alloc"] = """
  SELECT t.rep, t.split_id, rho, label, medical_center, idx, avail, w + (
      SELECT count(*) FROM t_units u WHERE u.rep = t.rep AND u.split_id = t.split_id AND u.idx = t.idx AND u.r <= t.deficit) AS want
  FROM (SELECT *, total - sum(w) OVER (PARTITION BY rep, split_id) AS deficit FROM t_rounded) t
"""
T_CTES = "reps evalm idrows held sides avail t_total t_scaled t_rounded t_units t_alloc"

# Custom designs: greedy association in (label, preferred centre first) order.
CTES["c_base"] = "SELECT rep, greatest(1, min(avail) // 2) AS base FROM avail GROUP BY rep"
CTES["c_steps"] = """
  SELECT a.*, base, row_number() OVER (PARTITION BY rep ORDER BY i, (j <> i % 2)::INT, j) AS step FROM avail a JOIN c_base USING (rep)
"""
CTES["c_fold"] = """
  SELECT rep, 0::BIGINT AS step, NULL::INT AS idx, 0::BIGINT AS take, -1 AS cur, 0::BIGINT AS row_left, base * 2 AS c0, base * 2 AS c1 FROM c_base
  UNION ALL
  SELECT rep, step, idx, take, i, rl - take, c0 - CASE WHEN j = 0 THEN take ELSE 0 END, c1 - CASE WHEN j = 1 THEN take ELSE 0 END
  FROM (SELECT s.rep, s.step, s.idx, s.i, s.j, f.c0, f.c1, CASE WHEN f.cur = s.i THEN f.row_left ELSE s.base * 2 END AS rl,
          greatest(0, least(CASE WHEN f.cur = s.i THEN f.row_left ELSE s.base * 2 END, CASE WHEN s.j = 0 THEN f.c0 ELSE f.c1 END, s.avail)) AS take
        FROM c_fold f JOIN c_steps s ON s.rep = f.rep AND s.step = f.step + 1)
"""
CTES["c_target"] = """
  SELECT s.*, lv.split_id, lv.rho, base * 4 AS total, least(avail, floor((1.0 - lv.rho) * base + lv.rho * take))::BIGINT AS w
  FROM c_steps s JOIN c_fold f USING (rep, idx), (SELECT unnest([1, 2, 3]) AS split_id, unnest([0.0::DOUBLE, 0.5, 1.0]) AS rho) lv
"""
CTES["c_units"] = CTES["t_units"].replace("t_rounded", "c_target")
CTES["c_alloc"] = CTES["t_alloc"].replace("t_units", "c_units").replace("t_rounded", "c_target")
C_CTES = "reps evalm idrows held sides avail c_base c_steps c_fold c_target c_units c_alloc"


def _splits_sql(alloc: str, dataset: str) -> str:
    return f"""
      , sp AS (SELECT DISTINCT split_id, rho FROM {alloc}),
      train AS (SELECT sample_id, label, medical_center, slide_id, 'train' AS partition, rep, split_id FROM (
          SELECT s.*, a.split_id, want, row_number() OVER (PARTITION BY s.rep, a.split_id, s.label, s.medical_center
            ORDER BY md5('{SEED}|' || s.rep || '|' || a.split_id || '|' || sample_id)) AS r
          FROM sides s JOIN {alloc} a ON a.rep = s.rep AND a.label = s.label AND a.medical_center = s.medical_center WHERE NOT held_out)
        WHERE r <= want),
      v AS (SELECT rep, split_id, sqrt(greatest(0, sum(o * o / (r * c)) - 1)) AS v FROM (
          SELECT rep, split_id, want::DOUBLE AS o, sum(want) OVER (PARTITION BY rep, split_id, label) AS r, sum(want) OVER (PARTITION BY rep, split_id, medical_center) AS c
          FROM {alloc} WHERE want > 0) GROUP BY ALL),
      allrows AS (SELECT * FROM train
        UNION ALL SELECT sample_id, label, medical_center, slide_id, 'id_test', rep, split_id FROM sides, sp WHERE held_out
        UNION ALL SELECT sample_id, label, medical_center, slide_id, 'ood_test', rep, split_id FROM evalm, reps, sp WHERE medical_center IN ('C2', 'C3', 'C4'))
      SELECT sample_id, label, medical_center, slide_id, partition, rho AS correlation_level, rho AS cramers_v_target,
        round(v, 6) AS cramers_v_realized, '{dataset}' AS dataset, rep, split_id
      FROM allrows JOIN sp USING (split_id) JOIN v USING (rep, split_id)"""


def _id_rows(spark, sf):
    return X.eval_manifest(spark, sf).where(F.col("medical_center").isin(*X.ID_CENTERS))


@query(
    "slide_split",
    with_ctes(CTES, "reps evalm idrows held sides", "SELECT rep, sample_id, slide_id, held_out FROM sides"),
)
def slide_split(spark, sf):
    return S.slide_level_split(_id_rows(spark, sf), FRACTION, SEED, REPS).select(
        "rep", "sample_id", "slide_id", "held_out"
    )


def _availability(spark, sf):
    rows = _id_rows(spark, sf)
    split = S.slide_level_split(rows, FRACTION, SEED, REPS)
    return S.availability(X.eval_manifest(spark, sf), X.ID_CENTERS, split.where("NOT held_out"), REPS)


@query("train_availability", with_ctes(CTES, "reps evalm idrows held sides avail", "SELECT rep, label, medical_center, idx::BIGINT AS idx, avail FROM avail"))
def train_availability(spark, sf):
    return _availability(spark, sf).select("rep", "label", "medical_center", "idx", "avail")


ALLOCATION = "SELECT rep, split_id::BIGINT AS split_id, rho AS correlation_level, label, medical_center, avail, want FROM {}"


@query("allocation_scaled", with_ctes(CTES, T_CTES, ALLOCATION.format("t_alloc")))
def allocation_scaled(spark, sf):
    allocation = S.split_allocation(_availability(spark, sf), "camelyon", "tabulated", ())
    return allocation.select("rep", "split_id", "correlation_level", "label", "medical_center", "avail", "want")


@query("allocation_custom", with_ctes(CTES, C_CTES, ALLOCATION.format("c_alloc"), recursive=True))
def allocation_custom(spark, sf):
    allocation = S.split_allocation(_availability(spark, sf), "tiles", "custom", CUSTOM_LEVELS)
    return allocation.select("rep", "split_id", "correlation_level", "label", "medical_center", "avail", "want")


@query("splits_tabulated", with_ctes(CTES, T_CTES, _splits_sql("t_alloc", "camelyon")))
def splits_tabulated(spark, sf):
    splits = S.generate_splits(
        X.eval_manifest(spark, sf), "camelyon", X.ID_CENTERS, X.OOD_CENTERS,
        repetitions=REPS, id_test_fraction=FRACTION, seed=SEED,
    )
    return splits.withColumn("cramers_v_realized", F.round("cramers_v_realized", 6))


def _custom_splits(spark, sf):
    return S.generate_splits(
        X.eval_manifest(spark, sf), "tiles", X.ID_CENTERS, X.OOD_CENTERS, CUSTOM_LEVELS,
        repetitions=REPS, id_test_fraction=FRACTION, seed=SEED, mode="custom",
    )


@query("splits_custom", with_ctes(CTES, C_CTES, _splits_sql("c_alloc", "tiles").replace("rep, split_id\n", "rep, split_id::BIGINT AS split_id\n"), recursive=True))
def splits_custom(spark, sf):
    return _custom_splits(spark, sf).withColumn(
        "cramers_v_realized", F.round("cramers_v_realized", 6)
    )


@query(
    "split_feature_alignment",
    with_ctes(
        CTES,
        C_CTES,
        _splits_sql("c_alloc", "tiles").replace(
            "SELECT sample_id, label, medical_center, slide_id, partition, rho AS", "SELECT partition, rep, split_id::BIGINT AS split_id, count(*) AS n, round(sum(embedding[1]), 6) AS total FROM (SELECT a.*, e.embedding FROM allrows a JOIN evalm e USING (sample_id)) GROUP BY ALL --"
        ).split("\n        round(v")[0],
        recursive=True,
    ),
)
def split_feature_alignment(spark, sf):
    joined = _custom_splits(spark, sf).join(X.features(spark, sf), "sample_id")
    return joined.groupBy("partition", "rep", "split_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum(F.element_at("embedding", 1).cast("double")), 6).alias("total"),
    )


@query(
    "leakage_report",
    """SELECT 0::BIGINT AS slides, 0::BIGINT AS leaks, 'within splits' AS scope
       UNION ALL SELECT count(*) AS slides, count(*) FILTER (n > 1) AS leaks, 'orders by month' AS scope
       FROM (SELECT o_custkey, count(DISTINCT month(o_orderdate)) AS n FROM orders GROUP BY 1)""",
)
def leakage_report(spark, sf):
    # Splits by slide never leak; orders split by month share customers, which do.
    own = S.leakage_report(_custom_splits(spark, sf).where("partition <> 'ood_test'"))
    orders = X.table(spark, sf, "orders").select(
        F.lit(0).alias("rep"),
        F.col("o_custkey").alias("slide_id"),
        F.month("o_orderdate").alias("partition"),
    )
    leaks = S.leakage_report(orders)
    return own.agg(
        F.count(F.lit(1)).alias("slides"),
        F.count(F.lit(1)).alias("leaks"),
        F.lit("within splits").alias("scope"),
    ).unionByName(
        orders.select("slide_id")
        .distinct()
        .join(leaks.select("slide_id", F.lit(1).alias("leak")), "slide_id", "left")
        .agg(
            F.count(F.lit(1)).alias("slides"),
            F.count("leak").alias("leaks"),
            F.lit("orders by month").alias("scope"),
        )
    )


CTES["fill_in"] = """
  SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_type) - 1 AS idx
  FROM (SELECT p_brand, p_type, sum(p_size)::BIGINT AS slack FROM part GROUP BY ALL)
"""


def _fill_frame(spark, sf):
    cells = X.table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.sum("p_size").alias("slack"))
    return cells.withColumn(
        "idx", (F.row_number().over(Window.partitionBy("p_brand").orderBy("p_type")) - 1).cast("bigint")
    )


@query(
    "water_fill",
    with_ctes(
        CTES,
        "fill_in",
        """, units AS (SELECT p_brand, idx, row_number() OVER (PARTITION BY p_brand ORDER BY level DESC, idx) AS r
             FROM (SELECT p_brand, idx, unnest(range(1, slack + 1)) AS level FROM fill_in)),
           amounts AS (SELECT p_brand, sum(slack) // 3 AS amount FROM fill_in GROUP BY 1)
           SELECT f.p_brand, f.p_type, f.slack, (SELECT count(*) FROM units u WHERE u.p_brand = f.p_brand AND u.idx = f.idx AND u.r <= a.amount) AS given
           FROM fill_in f JOIN amounts a USING (p_brand)""",
    ),
)
def water_fill(spark, sf):
    cells = _fill_frame(spark, sf).withColumn(
        "amount", F.floor(F.sum("slack").over(Window.partitionBy("p_brand")) / 3).cast("bigint")
    )
    return L.water_fill(cells, ["p_brand"], "slack", "amount", "idx", "given").select(
        "p_brand", "p_type", "slack", "given"
    )


@query(
    "largest_remainder",
    with_ctes(
        CTES,
        "fill_in",
        """, s AS (SELECT *, slack * (1000 / (sum(slack) OVER (PARTITION BY p_brand))::DOUBLE) AS s FROM fill_in)
           SELECT p_brand, p_type, (floor(s) + (row_number() OVER (PARTITION BY p_brand ORDER BY s - floor(s) DESC, idx DESC)
             <= 1000 - sum(floor(s)) OVER (PARTITION BY p_brand))::INT)::BIGINT AS share FROM s""",
    ),
)
def largest_remainder(spark, sf):
    cells = _fill_frame(spark, sf).withColumn("total", F.lit(1000))
    return L.largest_remainder(cells, ["p_brand"], "slack", "total", "idx", "share").select(
        "p_brand", "p_type", "share"
    )


@query(
    "sample_without_replacement",
    """SELECT l_returnflag, l_linestatus, l_orderkey, l_linenumber FROM lineitem
       QUALIFY row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY md5('5|' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_extendedprice::BIGINT), l_orderkey) <= 40""",
)
def sample_without_replacement(spark, sf):
    rows = X.table(spark, sf, "lineitem").withColumn(
        "row_key",
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.bround("l_extendedprice").cast("bigint").cast("string")),
    )
    picked = S.sample_without_replacement(rows, 40, ["l_returnflag", "l_linestatus"], "row_key", seed=5)
    return picked.select("l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber")


@query(
    "performance_drop_by_rep",
    with_ctes(
        CTES,
        "accs",
        """SELECT rep, round((mi - bi) / bi, 6) AS apd_id, round((mo - bo) / bo, 6) AS apd_ood, round(((mi - bi) / bi + (mo - bo) / bo) / 2, 6) AS apd_avg
           FROM (SELECT rep, max(acc_id) FILTER (split_id = 1) AS bi, avg(acc_id) FILTER (split_id <> 1) AS mi,
                   max(acc_ood) FILTER (split_id = 1) AS bo, avg(acc_ood) FILTER (split_id <> 1) AS mo FROM accs GROUP BY rep)""",
    ),
)
def performance_drop_by_rep(spark, sf):
    return D.drop_by_rep(X.split_accuracy(spark, sf)).select(
        "rep", *[F.round(c, 6).alias(c) for c in ("apd_id", "apd_ood", "apd_avg")]
    )


@query(
    "average_performance_drop",
    with_ctes(
        CTES,
        "accs",
        """, d AS (SELECT rep, (mi - bi) / bi AS i, (mo - bo) / bo AS o
             FROM (SELECT rep, max(acc_id) FILTER (split_id = 1) AS bi, avg(acc_id) FILTER (split_id <> 1) AS mi,
                     max(acc_ood) FILTER (split_id = 1) AS bo, avg(acc_ood) FILTER (split_id <> 1) AS mo FROM accs GROUP BY rep))
           SELECT metric, round(avg(v), 6) AS value, round(stddev_pop(v), 6) AS std, count(*) AS n FROM (
             SELECT 'apd_id' AS metric, i AS v FROM d UNION ALL SELECT 'apd_ood', o FROM d UNION ALL SELECT 'apd_avg', (i + o) / 2 FROM d) GROUP BY metric""",
    ),
)
def average_performance_drop(spark, sf):
    return D.average_performance_drop(X.split_accuracy(spark, sf)).select(
        "metric", F.round("value", 6).alias("value"), F.round("std", 6).alias("std"), "n"
    )


@query(
    "accuracy_by_rho",
    with_ctes(
        CTES,
        "accs",
        """SELECT correlation_level, round(avg(acc_id), 6) AS mean_id, round(stddev_pop(acc_id), 6) AS std_id,
             round(avg(acc_ood), 6) AS mean_ood, round(stddev_pop(acc_ood), 6) AS std_ood,
             'tiles/acc_id_rho' || CASE WHEN correlation_level = 1 THEN '1_00' ELSE '0_' || lpad(round(correlation_level * 100)::INT::VARCHAR, 2, '0') END AS log_key
           FROM accs GROUP BY correlation_level""",
    ),
)
def accuracy_by_rho(spark, sf):
    table = D.accuracy_by_rho(X.split_accuracy(spark, sf))
    return table.select(
        "correlation_level",
        *[F.round(c, 6).alias(c) for c in ("mean_id", "std_id", "mean_ood", "std_ood")],
        text.metric_key(F.lit("tiles"), F.lit("acc_id"), F.col("correlation_level")).alias("log_key"),
    )


@query(
    "parsed_levels",
    "SELECT p_partkey, 2::BIGINT AS n, (p_partkey % 50) / 100.0::DOUBLE AS first, (50 + p_partkey % 50) / 100.0::DOUBLE AS last FROM part",
)
def parsed_levels(spark, sf):
    k = F.col("p_partkey") % 50
    raw = F.concat(
        F.format_string("%.2f", k / 100.0), F.lit(" , "), F.format_string("%.2f", (50 + k) / 100.0), F.lit(",")
    )
    levels = text.parse_levels(raw)
    return X.table(spark, sf, "part").select(
        "p_partkey",
        F.size(levels).cast("bigint").alias("n"),
        F.element_at(levels, 1).alias("first"),
        F.element_at(levels, 2).alias("last"),
    )


@query(
    "table_fingerprint",
    with_ctes(
        CTES,
        "evalm",
        """, h AS (SELECT md5(concat_ws('|', 'cluster=' || cluster, 'dataset=tiles', 'image_path=/e/' || row_idx || '.png', 'label=' || label, 'medical_center=' || medical_center,
             'row_idx=' || row_idx, 'sample_id=' || sample_id, 'slide_id=' || slide_id)) AS r FROM evalm)
           SELECT sha256(count(*) || '|' || sum(('0x' || substr(r, 1, 15))::BIGINT) || '|' || bit_xor(('0x' || substr(r, 16, 15))::BIGINT)) AS fingerprint FROM h""",
    ),
)
def table_fingerprint(spark, sf):
    return S.table_fingerprint(X.eval_manifest(spark, sf))
