"""Draw, placement and token-mask queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import arrays, geometry as G
from tessera.operators import index as I
from tessera.operators import masks as K
from tessera.operators import sampling as W
from tessera.operators import targets as T
from tessera.operators.ranking import bucketed_row_number, spread
from tessera.plans.index_queries import ANCHOR_CTES, P, anchors
from tessera.plans.oracle_ctes import CTES
from tessera.plans.registry import query, with_ctes
from tessera.plans.sampling_pass import sampling_plan
from tessera.session import materialize
from tessera.sources import fixtures as X

SEED = 7
GRID, PATCH = 32, 16


def _catalog(spark, sf):
    """The catalog as a sampler meets it: a stored table, not a plan to re-run."""
    return materialize(anchors(spark, sf), "catalog")


def _draws(spark, sf):
    """One draw per order."""
    return X.table(spark, sf, "orders").select(
        F.lit(0).cast("bigint").alias("partition"), F.col("o_orderkey").alias("draw_idx")
    )


def _reader_draws(spark, sf):
    o = F.col("o_orderkey")
    return X.table(spark, sf, "orders").select(
        (o % 3).alias("partition"), F.floor(o / 3).cast("bigint").alias("draw_idx")
    )


CTES["strata"] = "SELECT stratum_id, count(*) AS anchors FROM anchors GROUP BY 1"


@query(
    "stratum_weights",
    with_ctes(
        CTES,
        ANCHOR_CTES + " strata",
        """SELECT 'inverse_frequency' AS mode, stratum_id, anchors, round((1.0::DOUBLE / anchors) / (SELECT sum(1.0::DOUBLE / anchors) FROM strata), 9) AS weight FROM strata
           UNION ALL SELECT 'uniform', stratum_id, anchors, round(1.0::DOUBLE / (SELECT count(*) FROM strata), 9) FROM strata
           UNION ALL SELECT 'map', stratum_id, anchors, CASE stratum_id WHEN 'ASIA' THEN 0.75 WHEN 'EUROPE' THEN 0.25 ELSE 0 END::DOUBLE FROM strata
           UNION ALL SELECT 'all_zero', stratum_id, anchors, round(1.0::DOUBLE / (SELECT count(*) FROM strata), 9) FROM strata
           UNION ALL SELECT 'global', '__all__', sum(anchors)::BIGINT, 1.0::DOUBLE FROM strata""",
    ),
)
def stratum_weights(spark, sf):
    catalog = _catalog(spark, sf)
    counts = W.stratum_counts(catalog)
    parts = [
        W.stratum_weights(counts, mode).withColumn("mode", F.lit(name))
        for name, mode in (
            ("inverse_frequency", "inverse_frequency"),
            ("uniform", "uniform"),
            ("map", '{"ASIA": 3, "EUROPE": 1}'),
            ("all_zero", {}),
        )
    ]
    parts.append(
        W.stratum_weights(W.stratum_counts(catalog, "global_uniform")).withColumn("mode", F.lit("global"))
    )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("mode", "stratum_id", "anchors", F.round("weight", 9).alias("weight"))


def _draw_ctes(readers: int) -> None:
    """CTEs of the draw sequence for one reader or several (suffix = count)."""
    s = readers
    part = "0" if s == 1 else f"CAST('0x' || substr(md5(anchor_id), 1, 8) AS BIGINT) % {s}"
    CTES[f"placed{s}"] = f"""
      SELECT *, row_number() OVER (PARTITION BY shard_key, part ORDER BY anchor_idx) - 1 AS unit_row
      FROM (SELECT *, slide_id || '#' || (anchor_idx // 8) AS shard_key, {part} AS part FROM anchors)"""
    CTES[f"tot{s}"] = f"SELECT part, stratum_id, count(*) AS total FROM placed{s} GROUP BY ALL"
    CTES[f"bounds{s}"] = f"""
      SELECT *, coalesce(lag(hi) OVER w, 0) AS lo, row_number() OVER w = count(*) OVER (PARTITION BY part) AS final
      FROM (SELECT part, stratum_id, total, sum(share) OVER (PARTITION BY part ORDER BY stratum_id) AS hi
            FROM (SELECT *, w / sum(w) OVER (PARTITION BY part) AS share FROM tot{s}
                  JOIN (SELECT stratum_id, 1.0::DOUBLE / sum(total) AS w FROM tot{s} GROUP BY 1) USING (stratum_id)))
      WINDOW w AS (PARTITION BY part ORDER BY stratum_id)"""
    source = (
        "SELECT 0 AS part, o_orderkey AS d FROM orders"
        if s == 1
        else f"SELECT o_orderkey % {s} AS part, o_orderkey // {s} AS d FROM orders"
    )
    CTES[f"visits{s}"] = f"""
      SELECT part, d, stratum_id, total, row_number() OVER (PARTITION BY part, stratum_id ORDER BY d) - 1 AS visit
      FROM (SELECT *, CAST('0x' || substr(md5('{SEED}|2|' || part || '|' || d), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM ({source}))
        JOIN bounds{s} USING (part) WHERE u >= lo AND (u < hi OR final)"""
    CTES[f"order{s}"] = f"""
      SELECT *, sum(n) OVER (PARTITION BY part, stratum_id, cycle ORDER BY md5('{SEED}|2|' || part || '|' || cycle || '|' || shard_key)) AS hi
      FROM (SELECT part, stratum_id, shard_key, count(*) AS n FROM placed{s} GROUP BY ALL)
        JOIN (SELECT DISTINCT part, stratum_id, visit // total AS cycle FROM visits{s}) USING (part, stratum_id)"""
    CTES[f"drawn{s}"] = f"""
      SELECT v.part AS partition, v.d AS draw_idx, v.stratum_id, v.visit, v.visit // v.total AS cycle, p.anchor_id
      FROM visits{s} v JOIN order{s} o ON o.part = v.part AND o.stratum_id = v.stratum_id AND o.cycle = v.visit // v.total
          AND v.visit % v.total < o.hi AND v.visit % v.total >= o.hi - o.n
        JOIN placed{s} p ON p.part = v.part AND p.shard_key = o.shard_key AND p.unit_row = v.visit % v.total - (o.hi - o.n)"""


for _readers in (1, 3):
    _draw_ctes(_readers)
DRAWN = "SELECT partition, draw_idx, stratum_id, visit, cycle, anchor_id FROM drawn{}"
DRAW_COLUMNS = ["partition", "draw_idx", "stratum_id", "visit", "cycle", "anchor_id"]


def _draw_cte_names(n: int) -> str:
    return ANCHOR_CTES + "".join(f" {c}{n}" for c in ("placed", "tot", "bounds", "visits", "order", "drawn"))


@query("sample_anchors", with_ctes(CTES, _draw_cte_names(1), DRAWN.format(1)))
def sample_anchors(spark, sf):
    catalog = I.with_shards(_catalog(spark, sf), 8)
    return W.sample_anchors(catalog, _draws(spark, sf), SEED, 2).select(*DRAW_COLUMNS)


@query("sample_anchors_partitioned", with_ctes(CTES, _draw_cte_names(3), DRAWN.format(3)))
def sample_anchors_partitioned(spark, sf):
    catalog = I.with_shards(_catalog(spark, sf), 8)
    drawn = W.sample_anchors(catalog, _reader_draws(spark, sf), SEED, 2, partitions=3)
    return drawn.select(*DRAW_COLUMNS)


@query(
    "anchor_by_index",
    with_ctes(
        CTES,
        ANCHOR_CTES,
        """, p AS (SELECT anchor_id, tissue_fraction >= 0.5 AS ok, row_number() OVER (ORDER BY slide_id, anchor_idx) - 1 AS pos FROM anchors),
           n AS (SELECT count(*) AS n, min(pos) FILTER (ok) AS first FROM p),
           nx AS (SELECT pos, coalesce(min(CASE WHEN ok THEN pos END) OVER (ORDER BY pos DESC), (SELECT first FROM n)) AS target FROM p)
           SELECT o_orderkey AS index, t.anchor_id FROM orders JOIN nx ON nx.pos = (o_orderkey * 7) % (SELECT n FROM n) JOIN p t ON t.pos = nx.target""",
    ),
)
def anchor_by_index(spark, sf):
    # Slides are the buckets: positions run through them in id order.
    numbered = bucketed_row_number(
        _catalog(spark, sf).select("anchor_id", "slide_id", "anchor_idx", "tissue_fraction"),
        [], ["anchor_idx"], F.col("slide_id"), "position",
    ).withColumn("usable", F.col("tissue_fraction") >= 0.5)
    requests = X.table(spark, sf, "orders").select(
        F.col("o_orderkey"), (F.col("o_orderkey") * 7).alias("index")
    )
    found = W.anchor_by_index(numbered, requests, "usable")
    return found.select(F.col("o_orderkey").alias("index"), "anchor_id")


@query(
    "resolution_plan",
    with_ctes(
        CTES,
        "slides",
        """SELECT slide_id, cs AS context_source_mpp, cm AS context_resolution_mode, CAST(round_even(512 * 1.0::DOUBLE / cs, 0) AS BIGINT) AS context_source_size_px,
             ts AS target_source_mpp, tm AS target_resolution_mode, CAST(round_even(256 * 0.5::DOUBLE / ts, 0) AS BIGINT) AS target_source_size_px,
             CASE WHEN mask_path IS NOT NULL THEN 8.0::DOUBLE END AS mask_source_mpp, CASE WHEN mask_path IS NOT NULL THEN 64 ELSE 1 END::BIGINT AS mask_source_size_px,
             512::BIGINT AS context_size_requested_px, 128::BIGINT AS target_size_in_context_px
           FROM (SELECT *, 1.0::DOUBLE AS cs, 'native_or_close' AS cm,
                   CASE WHEN k % 2 = 0 THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END AS ts, CASE WHEN k % 2 = 0 THEN 'fallback_from_finer' ELSE 'native_or_close' END AS tm
                 FROM slides)""",
    ),
)
def resolution_plan(spark, sf):
    plan = T.resolution_plan(X.slides(spark, sf), P, PATCH)
    return plan.select(
        "slide_id", "context_source_mpp", "context_resolution_mode", "context_source_size_px",
        "target_source_mpp", "target_resolution_mode", "target_source_size_px", "mask_source_mpp",
        "mask_source_size_px", "context_size_requested_px", "target_size_in_context_px",
    )


def _contexts(spark, sf):
    slides = X.slides(spark, sf)
    planned = T.with_plan(_catalog(spark, sf), T.resolution_plan(slides, P, PATCH))
    return T.attach_context_tissue(planned, X.mask_runs(spark, sf))


# Context windows are 64 mask pixels; 8 context pixels per mask pixel.
CTES["ctx"] = """
  SELECT *, CAST(round_even(center_x_level0 * wsi_level0_spacing_mpp / 8.0, 0) AS BIGINT) - 32 AS mx0,
    CAST(round_even(center_y_level0 * wsi_level0_spacing_mpp / 8.0, 0) AS BIGINT) - 32 AS my0 FROM anchors
"""
CTES["ctxruns"] = """
  SELECT anchor_id, 8.0::DOUBLE * (greatest(x0, mx0) - mx0) AS rx0, 8.0::DOUBLE * (greatest(y0, my0) - my0) AS ry0,
    8.0::DOUBLE * (least(x1, mx0 + 64) - mx0) AS rx1, 8.0::DOUBLE * (least(y1, my0 + 64) - my0) AS ry1
  FROM ctx c JOIN runs r ON r.slide_id = c.slide_id AND x0 < mx0 + 64 AND x1 > mx0 AND y0 < my0 + 64 AND y1 > my0
"""


@query(
    "context_tissue",
    with_ctes(
        CTES,
        ANCHOR_CTES + " ctx ctxruns",
        """SELECT anchor_id, count(*) AS pieces, round(sum((rx1 - rx0) * (ry1 - ry0)) / (512 * 512), 6) AS fraction
           FROM ctxruns GROUP BY 1""",
    ),
)
def context_tissue(spark, sf):
    area = F.aggregate(
        "tissue", F.lit(0.0), lambda a, r: a + (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    )
    return _contexts(spark, sf).select(
        "anchor_id",
        F.size("tissue").cast("bigint").alias("pieces"),
        F.round(area / (512.0 * 512.0), 6).alias("fraction"),
    )


def _placement_ctes(tag: str, aligned: bool, thresholds: list[float]) -> None:
    """Brute force: all 4000 candidates of every anchor, folded in order."""
    hx = "CAST('0x' || substr(h, 1, 8) AS BIGINT)"
    hy = "CAST('0x' || substr(h, 9, 8) AS BIGINT)"
    if aligned:
        xy = f"16 * ({hx} % 24) AS x, 16 * ({hy} % 24) AS y"
    else:
        xy = f"64 + {hx} % 384 - 64 AS x, 64 + {hy} % 384 - 64 AS y"
    CTES[f"cand_{tag}"] = f"""
      SELECT anchor_id, i, {xy} FROM (
        SELECT anchor_id, i, md5('{SEED}|0|' || anchor_id || '|' || i) AS h FROM anchors, (SELECT unnest(range(1, 4001)) AS i))"""
    CTES[f"frac_{tag}"] = f"""
      SELECT c.anchor_id, i, x, y, coalesce(sum(CASE WHEN rx0 IS NOT NULL THEN greatest(0, least(x + 128, rx1) - greatest(x, rx0)) *
          greatest(0, least(y + 128, ry1) - greatest(y, ry0)) END), 0) / 16384.0::DOUBLE AS f
      FROM cand_{tag} c LEFT JOIN ctxruns r ON r.anchor_id = c.anchor_id AND rx0 < x + 128 AND rx1 > x AND ry0 < y + 128 AND ry1 > y
      GROUP BY ALL"""
    values = ", ".join(f"{t}::DOUBLE" for t in thresholds)
    overlap = (
        "greatest(0, least(o.x, e.x) + 128 - greatest(o.x, e.x)) * greatest(0, least(o.y, e.y) + 128 - greatest(o.y, e.y)) > 4096"
    )
    CTES[f"fold_{tag}"] = f"""
      SELECT anchor_id, t, list_reduce(
          list_prepend({{'b': CAST([] AS STRUCT(x BIGINT, y BIGINT, f DOUBLE)[]), 'x': 0::BIGINT, 'y': 0::BIGINT, 'f': 0.0::DOUBLE}}, cands),
          lambda a, e: CASE WHEN len(a.b) >= 4 OR len(list_filter(a.b, lambda o: {overlap})) > 0 THEN a
            ELSE {{'b': list_append(a.b, {{'x': e.x, 'y': e.y, 'f': e.f}}), 'x': 0::BIGINT, 'y': 0::BIGINT, 'f': 0.0::DOUBLE}} END).b AS boxes
      FROM (SELECT anchor_id, t, list({{'b': CAST([] AS STRUCT(x BIGINT, y BIGINT, f DOUBLE)[]), 'x': x, 'y': y, 'f': f}} ORDER BY i) AS cands
            FROM frac_{tag}, (SELECT unnest([{values}]) AS t) WHERE f >= t GROUP BY ALL)"""
    CTES[f"placed_{tag}"] = f"""
      SELECT anchor_id, t, boxes FROM fold_{tag} WHERE len(boxes) >= 4
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY t DESC) = 1"""


_placement_ctes("free", False, [0.25, 0.2, 0.15, 0.1])
_placement_ctes("strict", True, [0.9])
TARGET_SQL = """
  SELECT p.anchor_id, t AS effective_threshold, target - 1 AS target, boxes[target].x AS x0, boxes[target].y AS y0, round(boxes[target].f, 6) AS target_tissue,
    CAST(round_even(center_x_level0 - z // 2 + (boxes[target].x + 64.0::DOUBLE) * (1.0::DOUBLE / wsi_level0_spacing_mpp), 0) AS BIGINT) AS target_x_level0,
    CAST(round_even(center_y_level0 - z // 2 + (boxes[target].y + 64.0::DOUBLE) * (1.0::DOUBLE / wsi_level0_spacing_mpp), 0) AS BIGINT) AS target_y_level0
  FROM (SELECT *, unnest([1, 2, 3, 4]) AS target FROM placed_{tag}) p
    JOIN (SELECT *, CAST(round_even(512 / wsi_level0_spacing_mpp, 0) AS BIGINT) AS z FROM anchors) a USING (anchor_id)
"""

def _target_rows(placed):
    return T.target_centers(placed).select(
        "anchor_id",
        "effective_threshold",
        F.col("target").cast("bigint").alias("target"),
        "x0",
        "y0",
        F.round("target_tissue", 6).alias("target_tissue"),
        "target_x_level0",
        "target_y_level0",
    )


@query(
    "target_boxes_relaxed",
    with_ctes(
        CTES,
        ANCHOR_CTES + " ctx ctxruns cand_free frac_free fold_free placed_free",
        TARGET_SQL.format(tag="free"),
    ),
)
def target_boxes_relaxed(spark, sf):
    return _target_rows(T.place_targets(_contexts(spark, sf), P, T.PlacementPolicy(), SEED))


@query(
    "target_boxes_aligned",
    with_ctes(
        CTES,
        ANCHOR_CTES + " ctx ctxruns cand_strict frac_strict fold_strict placed_strict",
        TARGET_SQL.format(tag="strict"),
    ),
)
def target_boxes_aligned(spark, sf):
    strict = T.PlacementPolicy(aligned=True, min_tissue=0.9, policy="skip_anchor")
    return _target_rows(T.place_targets(_contexts(spark, sf), P, strict, SEED))


@query(
    "margin_and_origins",
    """SELECT p_partkey, least(greatest(p_size % 40, t // 2), greatest(1, c // 2 - 1)) AS margin,
         (lo + 15) // 16 * 16 AS start, CASE WHEN hi < lo OR (lo + 15) // 16 * 16 > hi THEN 0 ELSE (hi - (lo + 15) // 16 * 16) // 16 + 1 END AS count
       FROM (SELECT *, greatest(0, ceil(m - t * 0.5::DOUBLE))::BIGINT AS lo, least(c - t, floor(c - m - 1 - t * 0.5::DOUBLE))::BIGINT AS hi
             FROM (SELECT *, least(greatest(p_size % 40, t // 2), greatest(1, c // 2 - 1)) AS m
                   FROM (SELECT *, 160 + p_partkey % 353 AS c, 32 + p_partkey % 97 AS t FROM part)))""",
)
def margin_and_origins(spark, sf):
    c, t = 160 + F.col("p_partkey") % 353, 32 + F.col("p_partkey") % 97
    rows = X.table(spark, sf, "part").select(
        "p_partkey",
        c.alias("c"),
        t.alias("t"),
        G.margin_for_anchor(F.col("p_size") % 40, 1.0, t, c).alias("margin"),
    )
    return rows.withColumn("r", G.aligned_origin_range("margin", "c", "t", PATCH)).select(
        "p_partkey", "margin", "r.start", "r.count"
    )


@query(
    "box_overlaps",
    with_ctes(
        CTES,
        "boxes",
        """, o AS (SELECT a.sample_idx, a.t, max(greatest(0, least(a.x0, b.x0) + 128 - greatest(a.x0, b.x0)) * greatest(0, least(a.y0, b.y0) + 128 - greatest(a.y0, b.y0))) AS px
             FROM boxes a JOIN boxes b ON a.sample_idx = b.sample_idx AND b.t < a.t GROUP BY ALL)
           SELECT sample_idx, max(px) AS worst_px, max(px) > 4096 AS too_much FROM o GROUP BY 1""",
    ),
)
def box_overlaps(spark, sf):
    b = F.col("boxes")
    worst = F.array_max(
        F.flatten(
            F.transform(
                b,
                lambda x, i: F.transform(
                    F.slice(b, F.lit(1), i), lambda y: G.overlap_area(x, y).cast("double")
                ),
            )
        )
    )
    # A box against the ones accepted before it, as placement does.
    clash = F.exists(
        F.sequence(F.lit(2), F.size(b)),
        lambda i: G.overlaps_too_much(F.element_at(b, i), F.slice(b, F.lit(1), i - 1), 128),
    )
    return X.target_boxes(spark, sf).select(
        "sample_idx", worst.alias("worst_px"), clash.alias("too_much")
    )


def _masked(spark, sf):
    return K.footprint_masks(X.target_boxes(spark, sf), GRID, GRID, PATCH)


CTES["mpred"] = """
  SELECT *, min(len(ids)) OVER (PARTITION BY batch_id) AS keep_pred FROM tokens
"""
CTES["menc"] = """
  SELECT *, min(len(rest)) OVER (PARTITION BY batch_id) AS keep_enc
  FROM (SELECT sample_idx, batch_id, u, list_filter(range(1024), lambda i: NOT list_contains(u, i)) AS rest
        FROM (SELECT sample_idx, batch_id, list_distinct(flatten(list(ids))) AS u FROM tokens GROUP BY ALL))
"""


@query(
    "footprint_masks",
    with_ctes(
        CTES,
        "boxes tokens mpred menc",
        """SELECT sample_idx, max(keep_pred)::BIGINT AS keep_pred, max(keep_enc)::BIGINT AS keep_enc, false AS leak,
             sum(list_sum(ids[:keep_pred]))::BIGINT AS pred_sum, list_sum(max(rest)[:max(keep_enc)])::BIGINT AS enc_sum
           FROM mpred JOIN menc USING (sample_idx, batch_id) GROUP BY sample_idx""",
    ),
)
def footprint_masks(spark, sf):
    def total(ids):
        return F.aggregate(ids, F.lit(0).cast("bigint"), lambda a, i: a + i)

    return _masked(spark, sf).select(
        "sample_idx",
        F.col("keep_pred").cast("bigint").alias("keep_pred"),
        F.col("keep_enc").cast("bigint").alias("keep_enc"),
        "leak",
        total(F.flatten("pred_masks")).alias("pred_sum"),
        total(F.element_at("enc_masks", 1)).alias("enc_sum"),
    )


@query(
    "box_tokens",
    with_ctes(
        CTES,
        "boxes tokens",
        "SELECT sample_idx, t::BIGINT AS target, unnest(ids)::BIGINT AS token FROM tokens",
    ),
)
def box_tokens(spark, sf):
    # A box is a few bytes and some seventy rows: tasks follow the rows made, not the bytes read.
    boxes = spread(X.target_boxes(spark, sf), "sample_idx")
    raw = K.footprint_tokens(boxes, GRID, GRID, PATCH)
    # Outer, for a filter on the lists would be moved before the exchange and make them twice;
    # without a list the second explode leaves nothing.
    return raw.select("sample_idx", F.posexplode_outer("raw_tokens").alias("t", "ids")).select(
        "sample_idx", F.col("t").cast("bigint").alias("target"), F.explode("ids").alias("token")
    )


@query(
    "token_accounting",
    with_ctes(
        CTES,
        "boxes tokens mpred",
        """SELECT sample_idx, len(list_distinct(flatten(list(ids)))) AS raw_union, len(list_distinct(flatten(list(ids[:keep_pred])))) AS collated_union,
             len(list_distinct(flatten(list(ids)))) - len(list_distinct(flatten(list(ids[:keep_pred])))) AS dropped_union,
             max(len(ids) - keep_pred) AS max_dropped, arg_max(t, (len(ids) - keep_pred) * 10 - t)::BIGINT AS focus_target
           FROM mpred GROUP BY sample_idx""",
    ),
)
def token_accounting(spark, sf):
    return K.token_accounting(_masked(spark, sf)).select(
        "sample_idx",
        "raw_union",
        "collated_union",
        "dropped_union",
        F.array_max("dropped_per_target").alias("max_dropped"),
        "focus_target",
    )


@query(
    "coverage_mismatch",
    with_ctes(
        CTES,
        "boxes tokens mpred",
        """SELECT sample_idx, t::BIGINT AS target, round(16384 - cov, 6) AS missing_px, round(keep_pred * 256 - cov, 6) AS extra_px,
             (x0 % 16)::BIGINT AS off_x, (y0 % 16)::BIGINT AS off_y
           FROM (SELECT *, list_sum(list_transform(ids[:keep_pred], lambda i:
                   greatest(0, least(x0 + 128, 16 * (i % 32) + 16) - greatest(x0, 16 * (i % 32))) *
                   greatest(0, least(y0 + 128, 16 * (i // 32) + 16) - greatest(y0, 16 * (i // 32))))) AS cov FROM mpred)""",
    ),
)
def coverage_mismatch(spark, sf):
    return K.coverage(_masked(spark, sf), GRID, GRID, PATCH).select(
        "sample_idx",
        F.col("target").cast("bigint").alias("target"),
        F.round("missing_px", 6).alias("missing_px"),
        F.round("extra_px", 6).alias("extra_px"),
        F.col("offsets.x0").alias("off_x"),
        F.col("offsets.y0").alias("off_y"),
    )


@query(
    "gather_tokens",
    """SELECT vec_id, round(e[1 + vec_id % 64] + e[1 + (vec_id * 7) % 64] + e[64], 6) AS total FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)""",
)
def gather_tokens(spark, sf):
    mask = F.array(F.col("vec_id") % 64, (F.col("vec_id") * 7) % 64, F.lit(63).cast("bigint"))
    picked = arrays.gather_tokens(arrays.to_doubles(F.col("embedding")), mask)
    return X.table(spark, sf, "embeddings").select(
        "vec_id", F.round(F.aggregate(picked, F.lit(0.0), lambda a, x: a + x), 6).alias("total")
    )


@query(
    "repeat_interleave",
    """SELECT vec_id, vec_id // 4 * 12 + r * 4 + vec_id % 4 AS ordinal FROM embeddings, (SELECT unnest([0, 1, 2]) AS r)""",
)
def repeat_interleave(spark, sf):
    rows = X.table(spark, sf, "embeddings").select("vec_id", F.col("vec_id").alias("ordinal"))
    return K.repeat_interleave(rows, "ordinal", 4, 3)


@query(
    "mask_major_order",
    "SELECT p_partkey, t::BIGINT AS target, t * (SELECT count(*) FROM part) + p_partkey AS ordinal FROM part, (SELECT unnest([0, 1, 2, 3]) AS t)",
)
def mask_major_order(spark, sf):
    boxes = X.target_boxes(spark, sf)
    rows = boxes.select("sample_idx", F.posexplode("boxes").alias("target", "b"))
    ordered = K.mask_major_order(rows, "sample_idx", "target", boxes.count(), "ordinal")
    return ordered.select(
        F.col("sample_idx").alias("p_partkey"), F.col("target").cast("bigint").alias("target"), "ordinal"
    )


@query(
    "random_token_split",
    f"""SELECT sample_idx, round(ratio, 9) AS mask_ratio, floor(196 * (1 - ratio))::BIGINT AS kept, sum(i) FILTER (r <= floor(196 * (1 - ratio)))::BIGINT AS enc_sum
        FROM (SELECT sample_idx, i, 0.4::DOUBLE + (CAST('0x' || substr(md5('{SEED}|ratio|' || batch_id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE) * (0.6::DOUBLE - 0.4::DOUBLE) AS ratio,
                row_number() OVER (PARTITION BY sample_idx ORDER BY md5('{SEED}|' || sample_idx || '|' || i)) AS r
              FROM (SELECT p_partkey AS sample_idx, p_partkey // 32 AS batch_id, unnest(range(196)) AS i FROM part))
        GROUP BY ALL""",
)
def random_token_split(spark, sf):
    split = K.random_token_split(
        X.target_boxes(spark, sf).select("sample_idx", "batch_id"), 196, (0.4, 0.6), SEED
    )
    return split.select(
        "sample_idx",
        F.round("mask_ratio", 9).alias("mask_ratio"),
        F.size("enc_mask").cast("bigint").alias("kept"),
        F.aggregate("enc_mask", F.lit(0).cast("bigint"), lambda a, i: a + i).alias("enc_sum"),
    )


def _u32(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"


def _block_sql(name: str, low: float, high: float, flat: float, steep: float) -> str:
    """Height and width of a batch's blocks of one kind."""
    u = f"{_u32(f"'{SEED}|{name}|' || (p_partkey // 32)")} / 4294967296.0::DOUBLE"
    return f"""SELECT batch_id, least(round_even(sqrt(area * ratio), 0)::BIGINT, 13) AS h, least(round_even(sqrt(area / ratio), 0)::BIGINT, 13) AS w
      FROM (SELECT batch_id, floor(196.0::DOUBLE * ({low}::DOUBLE + u * ({high}::DOUBLE - {low}::DOUBLE))) AS area, {flat}::DOUBLE + u * ({steep}::DOUBLE - {flat}::DOUBLE) AS ratio
            FROM (SELECT DISTINCT p_partkey // 32 AS batch_id, {u} AS u FROM part))"""


def _in_block(prefix: str) -> str:
    return f"k // 14 >= {prefix}top AND k // 14 < {prefix}top + {prefix}h AND k % 14 >= {prefix}lft AND k % 14 < {prefix}lft + {prefix}w"


@query(
    "multiblock_masks",
    f"""WITH ps AS ({_block_sql("pred", 0.15, 0.2, 0.75, 1.5)}), es AS ({_block_sql("enc", 0.85, 1.0, 1.0, 1.0)}),
        pb AS (SELECT p_partkey AS sample_idx, batch_id, b, h, w, {_u32(f"'{SEED}|p|' || p_partkey || '|' || b || '|top'")} % (14 - h) AS top,
                 {_u32(f"'{SEED}|p|' || p_partkey || '|' || b || '|left'")} % (14 - w) AS lft
               FROM part JOIN ps ON batch_id = p_partkey // 32, (SELECT unnest(range(4)) AS b)),
        pt AS (SELECT *, list_filter(range(196), lambda k: {_in_block("")}) AS ids FROM pb),
        avoided AS (SELECT sample_idx, n, list_distinct(flatten(list(ids) FILTER (b < n))) AS away FROM pt, (SELECT unnest(range(5)) AS n) GROUP BY ALL),
        tries AS (SELECT p_partkey AS sample_idx, batch_id, t, 4 - t // 20 AS n, h, w, {_u32(f"'{SEED}|e|0|' || p_partkey || '|' || t || '|top'")} % (14 - h) AS top,
                    {_u32(f"'{SEED}|e|0|' || p_partkey || '|' || t || '|left'")} % (14 - w) AS lft
                  FROM part JOIN es ON batch_id = p_partkey // 32, (SELECT unnest(range(100)) AS t)),
        kept AS (SELECT sample_idx, batch_id, t, list_filter(range(196), lambda k: {_in_block("")} AND NOT list_contains(coalesce(away, []), k)) AS rest
                 FROM tries JOIN avoided USING (sample_idx, n)),
        enc AS (SELECT *, min(len(rest)) OVER (PARTITION BY batch_id) AS keep_enc FROM (
                  SELECT sample_idx, batch_id, arg_min(rest, t) AS rest FROM kept WHERE len(rest) > 10 GROUP BY ALL)),
        pred AS (SELECT *, min(len(ids)) OVER (PARTITION BY batch_id) AS keep_pred FROM pt)
        SELECT sample_idx, batch_id, max(keep_pred)::BIGINT AS keep_pred, max(keep_enc)::BIGINT AS keep_enc, sum(list_sum(ids[:keep_pred]))::BIGINT AS pred_sum,
          list_sum(max(rest)[:max(keep_enc)])::BIGINT AS enc_sum, len(list_intersect(max(rest)[:max(keep_enc)], flatten(list(ids[:keep_pred]))))::BIGINT AS shared
        FROM pred JOIN enc USING (sample_idx, batch_id) GROUP BY ALL""",
)
def multiblock_masks(spark, sf):
    made = K.multiblock_masks(
        X.target_boxes(spark, sf).select("sample_idx", "batch_id"), 14, 14, seed=SEED
    )

    def total(ids):
        return F.aggregate(ids, F.lit(0).cast("bigint"), lambda a, i: a + i)

    return made.select(
        "sample_idx",
        "batch_id",
        F.col("keep_pred").cast("bigint").alias("keep_pred"),
        F.col("keep_enc").cast("bigint").alias("keep_enc"),
        total(F.flatten("pred_masks")).alias("pred_sum"),
        total(F.element_at("enc_masks", 1)).alias("enc_sum"),
        F.size(F.array_intersect(F.element_at("enc_masks", 1), F.flatten("pred_masks")))
        .cast("bigint")
        .alias("shared"),
    )


@query("sampling_plan")
def sampling_plan_query(spark, sf):
    plan = sampling_plan(
        X.slides(spark, sf), X.mask_runs(spark, sf), _catalog(spark, sf), _draws(spark, sf), P,
        T.PlacementPolicy(), seed=SEED, batch_size=8, rows_per_shard=8,
    )
    return plan.groupBy("stratum_id").agg(
        F.count(F.lit(1)).alias("samples"),
        F.countDistinct("anchor_id").alias("anchors"),
        F.round(F.avg(F.size("targets")), 6).alias("targets"),
        F.min("keep_pred").cast("bigint").alias("min_keep_pred"),
        F.count_if("leak").alias("leaks"),
    )
