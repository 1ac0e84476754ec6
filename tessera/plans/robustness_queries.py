"""Queries over the embedding table: pairs, neighbours, agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.arrays import l2_normalize, mean_pool
from tessera.operators import agreement as A
from tessera.operators import neighbours as N
from tessera.operators import robustness as R
from tessera.plans.oracle_ctes import CTES
from tessera.plans.registry import query, with_ctes
from tessera.sources import fixtures as X

CTES["cells"] = "SELECT label, medical_center, count(*) AS n FROM evalm GROUP BY ALL"
CTES["pairs"] = """
  SELECT 'tiles::' || a.label || '__' || c.label || '::' || a.medical_center || '__' || b.medical_center AS pair_id,
    a.label AS c1, c.label AS c2, a.medical_center AS m1, b.medical_center AS m2, a.n + b.n + c.n + d.n AS pair_rows
  FROM cells a JOIN cells b ON a.label = b.label AND a.medical_center < b.medical_center
    JOIN cells c ON c.medical_center = a.medical_center AND a.label < c.label
    JOIN cells d ON d.label = c.label AND d.medical_center = b.medical_center
"""
CTES["sims"] = """
  SELECT q.sample_id AS q, c.sample_id AS c, q.label AS ql, c.label AS cl, q.medical_center AS qm, c.medical_center AS cm,
    q.slide_id = c.slide_id AS same_slide, round(list_dot_product(q.f, c.f), 9) AS sim
  FROM feats q, feats c
"""
# All neighbours among the window min(15 + 64, n - 1), own-slide rows last.
CTES["near"] = """
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY same_slide, rn) AS rank
  FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, c) AS rn FROM sims)
  WHERE rn <= least(79, (SELECT count(*) FROM evalm) - 1) AND q <> c
"""
CTES["votes"] = """
  SELECT k, q, ql, cl, count(*) AS n, min(code) AS code
  FROM near JOIN (SELECT unnest([3, 5, 7, 10, 15])::BIGINT AS k) ON rank <= k
    JOIN (SELECT label, min(row_idx) AS code FROM evalm GROUP BY 1) l ON l.label = cl
  GROUP BY k, q, ql, cl
"""
CTES["kacc"] = """
  SELECT k, avg(recall) AS acc FROM (
    SELECT k, ql, avg((ql = cl)::INT) AS recall FROM (
      SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY k, q ORDER BY n DESC, code) = 1) GROUP BY k, ql)
  GROUP BY k
"""
CTES["bestk"] = "SELECT k, acc FROM kacc ORDER BY acc DESC, k LIMIT 1"
CTES["pnear"] = """
  SELECT *, row_number() OVER (PARTITION BY pair_id, q ORDER BY same_slide, rn) AS rank
  FROM (SELECT s.*, pair_id, pair_rows, row_number() OVER (PARTITION BY pair_id, q ORDER BY sim DESC, c) AS rn
        FROM sims s JOIN pairs ON ql IN (c1, c2) AND cl IN (c1, c2) AND qm IN (m1, m2) AND cm IN (m1, m2))
  WHERE rn <= least((SELECT k FROM bestk) + 64, pair_rows - 1) AND q <> c
"""
CTES["pri"] = """
  SELECT pair_id, count(*) FILTER (ql = cl AND qm <> cm) AS so, count(*) FILTER (ql <> cl AND qm = cm) AS os
  FROM pnear WHERE rank <= (SELECT k FROM bestk) GROUP BY pair_id
"""
CTES["ri"] = "SELECT *, CASE WHEN so + os > 0 THEN so::DOUBLE / (so + os) ELSE 0.5 END AS value FROM pri"
SIMS = "evalm feats sims"


@query(
    "normalized_features",
    with_ctes(
        CTES,
        "evalm feats",
        "SELECT sample_id, round(f[1], 9) AS f1, round(f[64], 9) AS f64, round(list_sum(f), 8) AS total FROM feats",
    ),
)
def normalized_features(spark, sf):
    unit = X.features(spark, sf).withColumn("f", l2_normalize(F.col("embedding")))
    return unit.select(
        "sample_id",
        F.round(F.element_at("f", 1), 9).alias("f1"),
        F.round(F.element_at("f", 64), 9).alias("f64"),
        F.round(F.aggregate("f", F.lit(0.0), lambda a, x: a + x), 8).alias("total"),
    )


@query(
    "mean_pooled_tokens",
    """SELECT vec_id, round((e[1] + e[17] + e[33] + e[49]) / 4, 9) AS p1, round((e[16] + e[32] + e[48] + e[64]) / 4, 9) AS p16
       FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)""",
)
def mean_pooled_tokens(spark, sf):
    tokens = F.array(*[F.slice("embedding", 1 + 16 * t, 16) for t in range(4)])
    pooled = X.table(spark, sf, "embeddings").withColumn("p", mean_pool(tokens))
    return pooled.select(
        "vec_id",
        F.round(F.element_at("p", 1), 9).alias("p1"),
        F.round(F.element_at("p", 16), 9).alias("p16"),
    )


@query(
    "contingency_counts",
    with_ctes(CTES, "evalm", "SELECT label, slide_id AS center, count(*) AS n FROM evalm GROUP BY ALL UNION ALL SELECT l.label, s.slide_id, 0 FROM (SELECT DISTINCT label FROM evalm) l, (SELECT DISTINCT slide_id FROM evalm) s WHERE NOT EXISTS (SELECT 1 FROM evalm e WHERE e.label = l.label AND e.slide_id = s.slide_id)"),
)
def contingency_counts(spark, sf):
    m = X.eval_manifest(spark, sf).select("label", F.col("slide_id").alias("center"))
    return A.contingency(m, "label", "center")


@query(
    "contingency_cramers_v",
    """SELECT round(sqrt(sum((n - e) * (n - e) / e) / (sum(n) * least(max(r), max(k)))), 6) AS cramers_v, sum(n)::BIGINT AS n
       FROM (SELECT coalesce(n, 0) AS n, rs * cs / t AS e, r, k FROM (
               SELECT l.lang, s.source, rs::DOUBLE AS rs, cs, (SELECT count(*) FROM documents) AS t,
                 (SELECT count(DISTINCT lang) FROM documents) - 1 AS r, (SELECT count(DISTINCT source) FROM documents) - 1 AS k
               FROM (SELECT lang, count(*) AS rs FROM documents GROUP BY 1) l, (SELECT source, count(*) AS cs FROM documents GROUP BY 1) s)
             LEFT JOIN (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) USING (lang, source))""",
)
def contingency_cramers_v(spark, sf):
    cells = A.cell_counts(X.table(spark, sf, "documents"), "lang", "source")
    return A.cramers_v(cells, "lang", "source").select(
        F.round("cramers_v", 6).alias("cramers_v"), "n"
    )


@query("infer_pairs", with_ctes(CTES, "evalm cells pairs", "SELECT * FROM pairs"))
def infer_pairs(spark, sf):
    return R.infer_pairs(A.cell_counts(X.eval_manifest(spark, sf), *R.CELL), "tiles")


@query(
    "subsample_pairs",
    with_ctes(CTES, "evalm cells pairs", "SELECT pair_id, pair_rows FROM pairs ORDER BY md5('3|' || pair_id) LIMIT 4"),
)
def subsample_pairs(spark, sf):
    return R.subsample_pairs(infer_pairs(spark, sf), 4, seed=3).select("pair_id", "pair_rows")


@query(
    "subset_by_pair",
    with_ctes(
        CTES,
        "evalm cells pairs",
        """SELECT pair_id, count(*) AS n, count(DISTINCT slide_id) AS slides
           FROM evalm JOIN pairs ON label IN (c1, c2) AND medical_center IN (m1, m2) GROUP BY 1""",
    ),
)
def subset_by_pair(spark, sf):
    return (
        R.subset_by_pair(X.eval_manifest(spark, sf), infer_pairs(spark, sf))
        .groupBy("pair_id")
        .agg(F.count(F.lit(1)).alias("n"), F.countDistinct("slide_id").alias("slides"))
    )


@query(
    "label_codes",
    with_ctes(
        CTES,
        "images",
        """SELECT label, row_number() OVER (ORDER BY first, label) - 1 AS code, row_number() OVER (ORDER BY label) - 1 AS sorted_code
           FROM (SELECT label, min(row_idx) AS first FROM images GROUP BY 1)""",
    ),
)
def label_codes(spark, sf):
    m = X.labelled_images(spark, sf)
    return A.first_appearance_codes(m, "label", "row_idx").join(
        A.sorted_codes(m, "label", "sorted_code"), "label"
    )


@query(
    "knn_topk",
    with_ctes(
        CTES,
        SIMS,
        """SELECT q AS query_id, c AS neighbour_id, round(sim, 6) AS similarity,
             row_number() OVER (PARTITION BY q ORDER BY sim DESC, c) AS rank
           FROM sims WHERE q <> c QUALIFY rank <= 5""",
    ),
)
def knn_topk(spark, sf):
    found = N.knn_cosine(X.features(spark, sf), 5)
    return found.select(
        "query_id",
        "neighbour_id",
        F.round("similarity", 6).alias("similarity"),
        F.col("rank").cast("bigint").alias("rank"),
    )


@query(
    "slide_aware_neighbours",
    with_ctes(
        CTES,
        SIMS + " near",
        "SELECT q AS query_id, c AS neighbour_id, same_slide AS backfilled, rank FROM near WHERE rank <= 15",
    ),
)
def slide_aware_neighbours(spark, sf):
    df = X.eval_features(spark, sf)
    rows = df.count()
    chosen = N.slide_aware_neighbours(R.whole_neighbours(df, 15), 15, min(79, rows - 1))
    return chosen.select(
        "query_id", "neighbour_id", "backfilled", F.col("rank").cast("bigint").alias("rank")
    )


def _accuracy(spark, sf):
    df = X.eval_features(spark, sf)
    return R.knn_label_accuracy(df, R.whole_neighbours(df, 15), R.K_CANDIDATES, df.count())


@query(
    "knn_balanced_accuracy",
    with_ctes(CTES, SIMS + " near votes kacc", "SELECT k, round(acc, 6) AS balanced_accuracy FROM kacc"),
)
def knn_balanced_accuracy(spark, sf):
    return _accuracy(spark, sf).select("k", F.round("balanced_accuracy", 6).alias("balanced_accuracy"))


@query(
    "optimal_k",
    with_ctes(CTES, SIMS + " near votes kacc bestk", "SELECT k, round(acc, 6) AS balanced_accuracy FROM bestk"),
)
def optimal_k(spark, sf):
    best = R.best_k(_accuracy(spark, sf), R.K_CANDIDATES)
    return best.select("k", F.round("balanced_accuracy", 6).alias("balanced_accuracy"))


RI_CTES = "evalm feats cells pairs sims near votes kacc bestk pnear pri ri"


@query(
    "robustness_index_by_pair",
    with_ctes(CTES, RI_CTES, "SELECT pair_id, so, os, round(value, 6) AS value FROM ri"),
)
def robustness_index_by_pair(spark, sf):
    df = X.eval_features(spark, sf)
    cells = A.cell_counts(df, *R.CELL)
    rows = df.count()
    k = R.best_k(R.knn_label_accuracy(df, R.whole_neighbours(df, 15), R.K_CANDIDATES, rows), R.K_CANDIDATES).first()["k"]
    return R.pair_robustness_of(df, R.infer_pairs(cells, "tiles"), int(k)).select(
        "pair_id", "so", "os", F.round("value", 6).alias("value")
    )


@query(
    "robustness_index",
    with_ctes(
        CTES,
        RI_CTES,
        """SELECT 'tiles' AS dataset, (SELECT k FROM bestk) AS k, round(avg(value), 6) AS value,
             round(stddev_pop(value), 6) AS std, count(*) AS n FROM ri""",
    ),
)
def robustness_index(spark, sf):
    ri = R.compute_ri(X.eval_features(spark, sf), "tiles")
    return ri.select("dataset", "k", F.round("value", 6).alias("value"), F.round("std", 6).alias("std"), "n")


CTES["ari_in"] = """
  SELECT pair_id, e.* FROM evalm e JOIN pairs ON label IN (c1, c2) AND medical_center IN (m1, m2)
"""


def _ari_sql(truth: str) -> str:
    return f"""SELECT pair_id, (nij - ai * bj / t) / ((ai + bj) / 2 - ai * bj / t) AS ari FROM (
      SELECT pair_id, sum(n * (n - 1) / 2)::DOUBLE AS nij FROM (SELECT pair_id, {truth}, cluster, count(*) AS n FROM ari_in GROUP BY ALL) GROUP BY 1)
      JOIN (SELECT pair_id, sum(n * (n - 1) / 2)::DOUBLE AS ai FROM (SELECT pair_id, {truth}, count(*) AS n FROM ari_in GROUP BY ALL) GROUP BY 1) USING (pair_id)
      JOIN (SELECT pair_id, sum(n * (n - 1) / 2)::DOUBLE AS bj FROM (SELECT pair_id, cluster, count(*) AS n FROM ari_in GROUP BY ALL) GROUP BY 1) USING (pair_id)
      JOIN (SELECT pair_id, (count(*) * (count(*) - 1) / 2)::DOUBLE AS t FROM ari_in GROUP BY 1) USING (pair_id)"""


CTES["ari_label"] = _ari_sql("label")
CTES["ari_center"] = _ari_sql("medical_center")


@query(
    "adjusted_rand",
    with_ctes(
        CTES,
        "evalm cells pairs ari_in ari_label ari_center",
        """SELECT pair_id, round(l.ari, 6) AS ari_label, round(c.ari, 6) AS ari_center, round(l.ari - c.ari, 6) AS score
           FROM ari_label l JOIN ari_center c USING (pair_id)""",
    ),
)
def adjusted_rand(spark, sf):
    return R.pair_agreement(X.eval_manifest(spark, sf), infer_pairs(spark, sf)).select(
        "pair_id", *[F.round(c, 6).alias(c) for c in ("ari_label", "ari_center", "score")]
    )


@query(
    "clustering_score_fixed",
    with_ctes(
        CTES,
        "evalm cells pairs ari_in ari_label ari_center",
        """SELECT round(avg(l.ari - c.ari), 6) AS value, round(stddev_pop(l.ari - c.ari), 6) AS std, count(*) AS n
           FROM ari_label l JOIN ari_center c USING (pair_id)""",
    ),
)
def clustering_score_fixed(spark, sf):
    scores = R.pair_agreement(X.eval_manifest(spark, sf), infer_pairs(spark, sf))
    return A.mean_std(scores, "score").select(
        F.round("value", 6).alias("value"), F.round("std", 6).alias("std"), "n"
    )


@query(
    "silhouette_fixed",
    with_ctes(
        CTES,
        "evalm feats",
        """SELECT round(avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette, count(*) AS n
           FROM (SELECT q, max(m) FILTER (own) AS a, min(m) FILTER (NOT own) AS b FROM (
             SELECT q.sample_id AS q, q.cluster = c.cluster AS own, c.cluster, avg(list_distance(q.f, c.f)) AS m
             FROM feats q JOIN feats c ON q.sample_id <> c.sample_id GROUP BY ALL) GROUP BY q)""",
    ),
)
def silhouette_fixed(spark, sf):
    return N.silhouette(X.eval_features(spark, sf), "cluster").select(
        F.round("silhouette", 6).alias("silhouette"), "n"
    )


@query(
    "majority_vote",
    with_ctes(
        CTES,
        SIMS + " near votes",
        "SELECT k, q AS query_id, cl AS predicted FROM votes QUALIFY row_number() OVER (PARTITION BY k, q ORDER BY n DESC, code) = 1",
    ),
)
def majority_vote(spark, sf):
    df = X.eval_features(spark, sf)
    chosen = N.slide_aware_neighbours(R.whole_neighbours(df, 15), 15, min(79, df.count() - 1))
    ks = F.array(*[F.lit(k).cast("bigint") for k in R.K_CANDIDATES])
    votes = chosen.select(
        "query_id",
        F.col("n_label").alias("label"),
        F.explode(F.filter(ks, lambda k: k >= F.col("rank"))).alias("k"),
    ).join(A.first_appearance_codes(df, "label", "row_idx"), "label")
    return A.majority_vote(votes, ["k", "query_id"], "label", "code")


@query(
    "align_centers",
    with_ctes(
        CTES,
        "evalm",
        "SELECT medical_center, count(*) AS n FROM evalm WHERE medical_center IN ('C1', 'C3') GROUP BY 1",
    ),
)
def align_centers(spark, sf):
    kept = R.align_centers(X.eval_manifest(spark, sf), ["C1", "C3", "C9"])
    return kept.groupBy("medical_center").agg(F.count(F.lit(1)).alias("n"))


@query(
    "pair_mean_std",
    """SELECT lang, round(avg(n), 6) AS value, round(stddev_pop(n), 6) AS std, count(*) AS n
       FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) GROUP BY lang""",
)
def pair_mean_std(spark, sf):
    cells = A.cell_counts(X.table(spark, sf, "documents"), "lang", "source")
    return A.mean_std(cells, "n", ["lang"]).select(
        "lang", F.round("value", 6).alias("value"), F.round("std", 6).alias("std"), "n"
    )
