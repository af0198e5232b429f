"""DuckDB counterparts of ``bindings`` and of the shared intermediate tables."""

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "grid": (
        (),
        """SELECT (o_orderkey % 8)::INT AS area, ((o_orderkey // 8) // 40)::INT AS row,
  ((o_orderkey // 8) % 40)::INT AS col, (o_custkey % 6)::INT AS start_cls,
  (CASE WHEN o_orderstatus = 'F' THEN o_custkey % 6 ELSE (o_custkey // 6) % 6 END)::INT AS end_cls,
  (CASE WHEN o_orderpriority < '3' THEN o_custkey % 6
        ELSE (o_custkey + o_orderkey // 8) % 6 END)::INT AS pred_cls,
  o_totalprice AS score FROM orders""",
    ),
    "pixels": (
        (),
        """SELECT (l_suppkey % 16)::INT AS area, (ascii(l_returnflag) % 5)::INT AS start_cls,
  (trunc(l_quantity)::INT % 5)::INT AS end_cls,
  ((trunc(l_quantity)::INT + l_linenumber) % 5)::INT AS pred_cls, l_extendedprice AS score
  FROM lineitem""",
    ),
    "vecs": (
        (),
        """SELECT (vec_id // 100)::INT AS year, ((vec_id % 100) // 50)::INT AS area,
  ((vec_id % 50) // 10)::INT AS row, (vec_id % 10)::INT AS col, label::INT AS cls,
  embedding::DOUBLE[] AS z FROM embeddings""",
    ),
    "metric_rows": (
        (),
        """SELECT event_type AS method, (user_id % 5)::INT AS seed,
  json_extract_string(props, '$.k')::INT AS area, event_id AS row_id, user_id, value FROM events""",
    ),
    "areas": (
        (),
        """SELECT s_suppkey AS area_id, s_name AS area, n_name AS nation, r_name AS stratum,
  s_acctbal AS value,
  CASE s_suppkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'known_contact' WHEN 2 THEN 'unclear'
    ELSE 'none' END AS contact_status,
  CASE WHEN s_suppkey % 4 IN (0, 3) THEN 'tier1' WHEN s_suppkey % 4 = 1 THEN 'tier2'
    ELSE 'review_required' END AS tier
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    ),
    "parcels": (
        (),
        """SELECT p_partkey AS parcel_id, CASE length(p_type) % 5 WHEN 0 THEN '0111' WHEN 1 THEN '0311'
  WHEN 2 THEN '1003' WHEN 3 THEN '0131' ELSE '0321' END AS dlbm, p_brand AS township,
  p_size::DOUBLE AS slope, p_retailprice AS area_m2, p_partkey // 20 AS block_id FROM part""",
    ),
    "edges": (
        (),
        """SELECT a.k AS src, b.k AS dst
  FROM (SELECT p_partkey AS k, substr(p_brand, 7)::INT % 5 AS d FROM part) a
  JOIN (SELECT p_partkey AS k, substr(p_brand, 7)::INT % 5 AS d FROM part) b
  ON b.d = a.d AND (b.k = a.k + 1 OR b.k = a.k + 37)""",
    ),
    "steps": (
        (),
        """SELECT user_id AS episode, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t,
  event_type AS policy, value AS reward, json_extract_string(props, '$.k')::INT AS action
  FROM events""",
    ),
    # change candidates: valid in start and prediction, and predicted to change
    "cand": (
        ("grid",),
        "SELECT * FROM grid WHERE start_cls <> 0 AND pred_cls <> 0 AND pred_cls <> start_cls",
    ),
    # 3x3 neighbourhood support of the predicted and the start class
    "support": (
        ("grid",),
        """SELECT g.area, g.row, g.col, g.start_cls, g.end_cls, g.pred_cls, g.score,
  coalesce(sum((n.start_cls = g.pred_cls)::INT) / nullif(count(n.area), 0)::DOUBLE, 0.0) AS target_support,
  coalesce(sum((n.start_cls = g.start_cls)::INT) / nullif(count(n.area), 0)::DOUBLE, 0.0) AS source_support
  FROM (SELECT * FROM grid, (SELECT unnest([-1,0,1]) AS dr), (SELECT unnest([-1,0,1]) AS dc)) g
  LEFT JOIN grid n ON n.area = g.area AND n.row = g.row + dr AND n.col = g.col + dc
    AND NOT (dr = 0 AND dc = 0)
  GROUP BY ALL""",
    ),
    # smoothed transition reliability over all areas (alpha = 0.5, smoothing = 500)
    "trans": (
        ("grid",),
        """SELECT area, start_cls AS from_cls, pred_cls AS to_cls, count(*) AS n,
  sum((end_cls = pred_cls AND end_cls <> start_cls)::INT)::BIGINT AS exact,
  sum((end_cls <> start_cls)::INT)::BIGINT AS binary_hits
  FROM grid WHERE start_cls <> 0 AND end_cls <> 0 AND pred_cls <> 0 AND pred_cls <> start_cls
  GROUP BY ALL""",
    ),
    "files": (
        (),
        """SELECT CASE k % 5
  WHEN 0 THEN CASE WHEN (a + y) % 11 <> 0 THEN 'labels/area_' || a || '_lulc_' || y || '.npy' ELSE 'labels/area_' || a || '_lulc_x.npy' END
  WHEN 1 THEN CASE WHEN a % 7 <> 0 THEN 'predictions/area_' || a || '_lulc_pred_' || y || '_' || (y + 1) || '.npy' ELSE 'predictions/area_' || a || '_forecast.npy' END
  WHEN 2 THEN CASE WHEN (a * y) % 13 <> 0 THEN (CASE WHEN (k // 40) % 2 = 0 THEN 'cache_a' ELSE 'cache_b' END) || '/area_' || a || '_emb_' || y || '.npy' ELSE 'misc/area_' || a || '.bin' END
  WHEN 3 THEN CASE WHEN a % 3 <> 0 THEN 'cache_a/area_' || a || '_context.npy' ELSE 'misc/area_' || a || '.ctx' END
  ELSE 'notes/' || a || '.txt' END AS path
  FROM (SELECT o_orderkey AS k, o_custkey % 60 AS a, 2017 + o_orderkey % 8 AS y FROM orders)""",
    ),
    "labels_t": (
        ("files",),
        """SELECT DISTINCT regexp_extract(path, '([^/]+)_lulc_(\\d{4})\\.npy$', 1) AS area,
  regexp_extract(path, '([^/]+)_lulc_(\\d{4})\\.npy$', 2)::INT AS year FROM files
  WHERE regexp_matches(path, '[^/]+_lulc_\\d{4}\\.npy$')""",
    ),
    "preds_t": (
        ("files",),
        """SELECT DISTINCT path, regexp_extract(path, '([^/]+)_lulc_pred_(\\d{4})_(\\d{4})\\.npy$', 1) AS area,
  regexp_extract(path, '([^/]+)_lulc_pred_(\\d{4})_(\\d{4})\\.npy$', 2)::INT AS start_year,
  regexp_extract(path, '([^/]+)_lulc_pred_(\\d{4})_(\\d{4})\\.npy$', 3)::INT AS end_year FROM files
  WHERE regexp_matches(path, '[^/]+_lulc_pred_\\d{4}_\\d{4}\\.npy$')""",
    ),
    "embs_t": (
        ("files",),
        """SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS root,
  regexp_extract(path, '([^/]+)_emb_(\\d{4})\\.npy$', 1) AS area,
  regexp_extract(path, '([^/]+)_emb_(\\d{4})\\.npy$', 2)::INT AS year, path FROM files
  WHERE regexp_matches(path, '[^/]+_emb_\\d{4}\\.npy$')""",
    ),
    # start, end and predicted grids with gaps: two areas lack cells on one side
    "triple": (
        ("grid",),
        """SELECT area, row, col, start_cls, CASE WHEN area = 5 THEN NULL ELSE end_cls END AS end_cls,
  CASE WHEN area = 6 AND row >= 3 THEN NULL WHEN area = 7 THEN 3 ELSE pred_cls END AS pred_cls FROM grid""",
    ),
    # per method, seed and area: four metrics, the last one better when lower
    "seeded": (
        ("metric_rows",),
        """SELECT method, seed, area, avg(value) / 500.0 AS change_f1, max(value) / 500.0 AS fom,
  (count(*) % 8) / 8.0 AS transition_accuracy, min(value) / 500.0 AS allocation_disagreement
  FROM metric_rows GROUP BY method, seed, area""",
    ),
    "seeded_long": (
        ("seeded",),
        """SELECT method, seed, area, 'change_f1' AS metric, change_f1 AS value, 1 AS dir FROM seeded
  UNION ALL SELECT method, seed, area, 'fom', fom, 1 FROM seeded
  UNION ALL SELECT method, seed, area, 'transition_accuracy', transition_accuracy, 1 FROM seeded
  UNION ALL SELECT method, seed, area, 'allocation_disagreement', allocation_disagreement, -1 FROM seeded""",
    ),
    # challenger 'click' minus baseline 'error' per seed, area and metric
    "deltas": (
        ("seeded_long",),
        """SELECT a.seed, a.area, a.metric, a.dir, a.value AS cv, b.value AS bv, a.value - b.value AS delta
  FROM seeded_long a JOIN seeded_long b USING (seed, area, metric)
  WHERE a.method = 'click' AND b.method = 'error'""",
    ),
    # advantage per area of 'click' over 'error', with tier and stratum
    "adv": (
        ("deltas",),
        """SELECT area, CASE area % 3 WHEN 0 THEN 'tier1' WHEN 1 THEN 'tier2' ELSE 'tier1' END AS tier,
  'stratum_' || (area % 5) AS stratum, avg(delta) FILTER (metric = 'change_f1') AS primary_adv,
  avg(delta) FILTER (metric = 'fom') AS spatial_adv FROM deltas GROUP BY area""",
    ),
}
