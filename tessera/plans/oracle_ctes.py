"""SQL forms of the fixture frames, shared by the oracle queries."""

from __future__ import annotations

CTES: dict[str, str] = {}

CTES["slides"] = """
  SELECT s_suppkey AS k, 'S' || s_suppkey AS slide_id, '/w/S' || s_suppkey || '.tif' AS wsi_path,
    CASE WHEN s_suppkey % 13 <> 12 THEN '/m/' || s_suppkey END AS mask_path,
    CASE WHEN s_suppkey % 19 = 18 THEN 'failed' ELSE 'ok' END AS status,
    r_name AS organ, n_name AS site,
    CASE WHEN s_suppkey % 2 = 0 THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END AS wsi_level0_spacing_mpp,
    8.0::DOUBLE AS mask_level0_spacing_mpp,
    160 + 16 * (s_suppkey % 9) AS mask_level0_width,
    128 + 16 * (s_suppkey % 7) AS mask_level0_height,
    CAST((160 + 16 * (s_suppkey % 9)) * 8 * CASE WHEN s_suppkey % 2 = 0 THEN 4 ELSE 2 END AS BIGINT) AS wsi_level0_width,
    CAST((128 + 16 * (s_suppkey % 7)) * 8 * CASE WHEN s_suppkey % 2 = 0 THEN 4 ELSE 2 END AS BIGINT) AS wsi_level0_height,
    CASE WHEN s_suppkey % 2 = 0 THEN [0.25::DOUBLE, 1.0, 4.0] ELSE [0.5::DOUBLE, 1.0, 4.0] END AS wsi_spacings_mpp,
    CASE WHEN s_suppkey % 2 = 0 THEN 32.0::DOUBLE ELSE 16.0::DOUBLE END AS mask_scale
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""

CTES["runs"] = """
  SELECT slide_id, 16 * b AS y0, 16 * b + 16 AS y1, 16 * ((7 * k + 3 * b) % 5) AS x0,
    least(16 * ((7 * k + 3 * b) % 5) + 16 * (2 + (k + 5 * b) % 8), mask_level0_width) AS x1
  FROM (SELECT *, unnest(generate_series(0, mask_level0_height // 16 - 1)) AS b FROM slides)
"""

# Brute-force anchor catalog for the default profile: window 64, stride 32 mask pixels.
CTES["candidates"] = """
  SELECT * FROM (
    SELECT s.*, cy, unnest(generate_series(32, greatest(33, mask_level0_width - 32) - 1, 32)) AS cx
    FROM (SELECT *, unnest(generate_series(32, greatest(33, mask_level0_height - 32) - 1, 32)) AS cy
          FROM slides WHERE status = 'ok' AND mask_path IS NOT NULL) s)
  WHERE cx - 32 + 64 <= mask_level0_width AND cy - 32 + 64 <= mask_level0_height
"""

CTES["tissue"] = """
  SELECT c.slide_id, c.cx, c.cy,
    coalesce(sum(CASE WHEN r.x0 IS NOT NULL THEN (least(r.x1, c.cx + 32) - greatest(r.x0, c.cx - 32)) *
                 (least(r.y1, c.cy + 32) - greatest(r.y0, c.cy - 32)) END), 0)::DOUBLE / 4096 AS fraction
  FROM candidates c LEFT JOIN runs r ON c.slide_id = r.slide_id
    AND r.x0 < c.cx + 32 AND r.x1 > c.cx - 32 AND r.y0 < c.cy + 32 AND r.y1 > c.cy - 32
  GROUP BY ALL
"""

CTES["anchors"] = """
  SELECT slide_id || '_' || lpad((row_number() OVER w - 1)::VARCHAR, 7, '0') AS anchor_id,
    row_number() OVER w - 1 AS anchor_idx, slide_id, organ AS stratum_id, wsi_path, mask_path,
    x AS center_x_level0, y AS center_y_level0, cx AS center_x_mask, cy AS center_y_mask,
    round_even(fraction, 6) AS tissue_fraction, wsi_level0_spacing_mpp, mask_level0_width, mask_level0_height, wsi_spacings_mpp
  FROM (
    SELECT c.*, t.fraction, CAST(round_even(c.cx * mask_scale, 0) AS BIGINT) AS x,
      CAST(round_even(c.cy * mask_scale, 0) AS BIGINT) AS y,
      CAST(round_even(512 / wsi_level0_spacing_mpp, 0) AS BIGINT) AS size0
    FROM candidates c JOIN tissue t USING (slide_id, cx, cy))
  WHERE fraction >= 0.2 AND x - size0 // 2 >= 0 AND y - size0 // 2 >= 0
    AND x - size0 // 2 + size0 <= wsi_level0_width AND y - size0 // 2 + size0 <= wsi_level0_height
  WINDOW w AS (PARTITION BY slide_id ORDER BY cy, cx)
"""

CTES["evalm"] = """
  SELECT 's' || lpad(vec_id::VARCHAR, 9, '0') AS sample_id, vec_id AS row_idx,
    CASE WHEN label % 2 = 0 THEN 'normal' ELSE 'tumor' END AS label,
    'C' || (vec_id % 5) AS medical_center,
    'C' || (vec_id % 5) || '_' || CASE WHEN label % 2 = 0 THEN 'normal' ELSE 'tumor' END || '_' || ((vec_id // 5) % 8) AS slide_id,
    (label % 3)::BIGINT AS cluster, embedding::DOUBLE[] AS embedding
  FROM embeddings
"""

CTES["feats"] = """
  SELECT * EXCLUDE (embedding, norm), list_transform(embedding, lambda x: x / norm) AS f
  FROM (SELECT *, sqrt(list_dot_product(embedding, embedding)) + 1e-12 AS norm FROM evalm)
"""

CTES["steps"] = """
  SELECT user_id % 2 AS rank, event_id AS iteration, 64 * (event_id + 1) AS images_seen,
    (64 * (event_id + 1)) // 10000 AS pass_index, value AS loss,
    (100 + event_id % 50)::DOUBLE AS context_keep_tokens, (64 + event_id % 17)::DOUBLE AS target_predict_tokens,
    ((event_id * 37) % 400)::DOUBLE AS iteration_time_ms, ((event_id * 13) % 90)::DOUBLE AS data_wait_ms,
    ((event_id * 7) % 20)::DOUBLE AS host_to_device_ms, ((event_id * 11) % 120)::DOUBLE AS compute_ms,
    ((event_id * 5) % 6)::DOUBLE AS tune_poll_ms, (event_id * 3) % 5 AS cache_hits,
    event_id % 4 AS cache_misses, event_id % 3 AS cache_evictions, (1 + event_id % 8)::DOUBLE AS cache_open_slides,
    1e-3::DOUBLE / (1 + event_id % 10) AS learning_rate, 0.04::DOUBLE + 0.001::DOUBLE * (event_id % 5) AS weight_decay
  FROM events
"""

CTES["metrics"] = """
  SELECT 'run' || (user_id % 10) AS run,
    CASE event_type WHEN 'view' THEN 'ri' WHEN 'click' THEN 'clustering_score' WHEN 'purchase' THEN 'apd_avg'
      WHEN 'signup' THEN 'apd_id' ELSE 'apd_ood' END AS metric,
    'robustness' AS plugin, 'd' || (user_id % 3) AS dataset,
    event_id AS tune_index, 64 * (event_id + 1) AS images_seen, value / 100.0::DOUBLE AS value
  FROM events
"""

CTES["jobs"] = """
  SELECT 'run' || (user_id % 10) AS run, event_id AS tune_index, 64 * (event_id + 1) AS images_seen,
    epoch_us(ts) / 1e6::DOUBLE AS enqueued_at_s,
    epoch_us(ts) / 1e6::DOUBLE + event_id % 60 AS started_at_s,
    epoch_us(ts) / 1e6::DOUBLE + event_id % 60 + event_id % 45 AS finished_at_s,
    event_id % 11 = 0 AS dropped
  FROM events
"""

CTES["accs"] = """
  SELECT o_orderkey % 3 AS rep, 1 + (o_orderkey // 3) % 8 AS split_id,
    avg((o_totalprice > 100000)::INT) AS acc_id, avg((o_totalprice > 200000)::INT) AS acc_ood,
    round_even((1 + (o_orderkey // 3) % 8 - 1) / 7.0::DOUBLE, 2) AS correlation_level
  FROM orders GROUP BY ALL
"""

CTES["images"] = """
  SELECT doc_id AS row_idx, '/d/' || doc_id AS image_path, lang AS label, source AS medical_center,
    source || '_' || (doc_id % 7) AS slide_id
  FROM documents
"""

CTES["boxes"] = """
  SELECT p_partkey AS sample_idx, p_partkey // 32 AS batch_id, t,
    ((p_partkey * 17 + 37 * t) % 384)::DOUBLE AS x0, ((p_partkey * 29 + 53 * t) % 384)::DOUBLE AS y0
  FROM part, (SELECT unnest([0, 1, 2, 3]) AS t)
"""

# Raster of each box on a 32 x 32 grid of 16-px patches.
CTES["tokens"] = """
  SELECT *, list_sort(flatten(list_transform(range(py0, py1), lambda y: list_transform(range(px0, px1), lambda x: y * 32 + x)))) AS ids
  FROM (SELECT *, floor(x0 / 16)::BIGINT AS px0, floor(y0 / 16)::BIGINT AS py0,
          ceil((x0 + 128) / 16)::BIGINT AS px1, ceil((y0 + 128) / 16)::BIGINT AS py1 FROM boxes)
"""
