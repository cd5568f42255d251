"""The registered queries as DuckDB SQL over the same tables.

Fragments (``WITH`` members) are shared; every query is one statement.
"""

from __future__ import annotations

import math

ORACLE: dict[str, str] = {}

# --- shared fragments -----------------------------------------------------------------------

_FRAGMENTS = {
    "corr": """
  SELECT cast(l_suppkey % 20 AS int) AS pair_id, l_linenumber AS chip, l_orderkey AS win,
         'imw-d' || cast(l_partkey % 3 AS varchar) AS detector,
         case when l_partkey % 2 = 0 then 'HH' else 'HV' end AS source_pol,
         case when l_partkey % 2 = 0 then 'VV' else 'VH' end AS s1_ref_tag,
         not (l_discount <= 0.065e0) AS outlier, l_quantity / 64 AS score, x1, y1,
         x1 + l_suppkey % 5
            + (case when l_suppkey % 10 = 9 then 15 * l_linenumber when l_linenumber = 7 then 12 else 0 end)
            + (case when l_discount <= 0.065e0 then (cast(round(l_tax * 100) AS int) - 4) * 0.125e0
                    else l_quantity * 4 - 100 end) AS x2,
         y1 - l_suppkey % 3
            + (case when l_discount <= 0.065e0 then (cast(l_quantity AS int) % 5 - 2) * 0.125e0
                    else 100 - l_quantity * 2 end) AS y2
  FROM (SELECT *, cast((l_partkey * 7) % 1100 - 20 AS double) AS x1,
               cast(cast(floor(l_extendedprice) AS bigint) % 1100 - 20 AS double) AS y1
        FROM lineitem)""",
    "bounded": """
  SELECT * FROM corr
  WHERE x1 >= 0 AND x1 < 1024 AND y1 >= 0 AND y1 < 1024
    AND x2 >= 0 AND x2 < 1024 AND y2 >= 0 AND y2 < 1024""",
    "clear": """
  SELECT *, x1 - x2 AS across, y1 - y2 AS along FROM bounded
  WHERE cast(floor(x1) AS bigint) % 64 >= 4 AND cast(floor(y2) AS bigint) % 64 >= 4""",
    "enough": """
  SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY win) AS n_win FROM clear) WHERE n_win >= 4""",
    "placed": """
  SELECT *, 1024 * chip AS wx, 512 * chip AS wy, 1024 * chip + 2 AS s1_wx, 512 * chip - 3 AS s1_wy,
         1000e0 * pair_id AS x0, -500e0 * pair_id AS y0
  FROM clear""",
    "located": """
  SELECT *, x0 + (x1 + wy) * 10e0 AS map_x1, y0 + (y1 + wx) * -10e0 AS map_y1,
         x0 + 5e0 + (x2 + s1_wy) * 10e0 AS map_x2, y0 - 5e0 + (y2 + s1_wx) * -10e0 AS map_y2
  FROM placed""",
    "specs": """
  SELECT cast(p_partkey AS int) AS ordinal,
         (case when p_partkey % 50 = 0 then p_name else replace(p_name, ' ', '-') end)
            || '-' || cast(p_partkey % 97 AS varchar) AS tag,
         case when p_size % 2 = 0 then null else p_type end AS extractor,
         p_brand AS matcher, p_size % 2 = 0 AS dense
  FROM part""",
    "first_valid": """
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY tag ORDER BY dense, ordinal) AS rn
    FROM specs WHERE NOT regexp_matches(tag, '[_( ]')) WHERE rn = 1""",
    "confs": """
  SELECT DISTINCT kind, name, case when name LIKE '%7' then NULL else lower(name) end AS model_name FROM (
    SELECT 'extract' AS kind, p_type AS name FROM part WHERE p_type <> 'ECONOMY'
    UNION ALL SELECT 'match', p_brand FROM part WHERE p_brand <> 'Brand#2'
    UNION ALL SELECT 'dense', p_brand FROM part WHERE p_brand <> 'Brand#17')""",
    "resolved": """
  SELECT f.*, case when NOT f.dense AND e.name IS NULL then 'extractor'
                   when m.name IS NULL then case when f.dense then 'dense matcher' else 'matcher' end end AS skip_reason,
         e.model_name AS feature_name, m.model_name AS matcher_name
  FROM first_valid f
    LEFT JOIN confs e ON NOT f.dense AND e.kind = 'extract' AND e.name = f.extractor
    LEFT JOIN confs m ON m.kind = case when f.dense then 'dense' else 'match' end AND m.name = f.matcher""",
    "cat": """
  SELECT * FROM resolved WHERE skip_reason IS NULL""",
    "runs": """
  SELECT o_orderkey AS ordinal, 't' || cast(o_orderkey AS varchar) AS tag,
         [0, 0, 1, 137, -9, 2][o_orderkey % 6 + 1] AS exit_code,
         round((cast(round(o_totalprice * 1000000) AS bigint)) / 60e6, 1) AS elapsed_min
  FROM orders""",
    "outcomes": """
  SELECT *, case when exit_code = 0 then 'ok' when exit_code IN (-9, 137) then 'OOM-killed'
                 else 'exit=' || cast(exit_code AS varchar) end AS outcome
  FROM runs""",
    "pixels": """
  SELECT vec_id AS chip_id, cast(i // 8 AS int) AS iy, cast(i % 8 AS int) AS ix,
         case when vec_id % 41 = 0 then 0.5e0
              when vec_id % 37 = 0 AND i = 5 then cast('nan' AS double)
              when abs(embedding[i + 1]) >= 0.02e0 then cast(embedding[i + 1] AS double) end AS v
  FROM embeddings, (SELECT unnest(range(64)) AS i)""",
    "normalized": """
  SELECT chip_id, iy, ix, v IS NOT NULL AS ok,
         case when v IS NOT NULL AND hi > lo then (v - lo) / (hi - lo) else 0e0 end AS img
  FROM (SELECT *, min(v) OVER (PARTITION BY chip_id) AS lo, max(v) OVER (PARTITION BY chip_id) AS hi
        FROM pixels)""",
    "gate": """
  SELECT chip_id, count(*) FILTER (WHERE ok) / 64e0 AS valid,
         case when max(img) = 0e0 then 'all_zero'
              when bool_or(isnan(img)) then 'nan'
              when count(*) FILTER (WHERE ok) / 64e0 < 0.8e0 then 'low_valid' end AS reject_reason
  FROM normalized GROUP BY chip_id""",
    "filled": """
  SELECT chip_id, iy, ix, coalesce(
           last_value(case when ok then img end IGNORE NULLS) OVER (
             PARTITION BY chip_id, iy ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           first_value(case when ok then img end IGNORE NULLS) OVER (
             PARTITION BY chip_id, iy ORDER BY ix ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
           0e0) AS v
  FROM normalized""",
    # All points of an order are the raw set; the inliers are the filtered set, absent for every
    # seventh order. An empty filtered set falls back to the raw one.
    "numbered": """
  SELECT *, row_number() OVER (PARTITION BY win ORDER BY x1, y1, x2, y2, outlier) AS raw_no,
         row_number() OVER (PARTITION BY win, outlier ORDER BY x1, y1, x2, y2) AS mm_no,
         count(*) FILTER (WHERE NOT outlier) OVER (PARTITION BY win) AS n_mm
  FROM corr""",
    "chosen": """
  SELECT win, cast((case when use_mm then mm_no else raw_no end) - 1 AS int) AS kp_idx, x1, y1, x2, y2
  FROM (SELECT *, win % 7 <> 0 AND n_mm > 0 AS use_mm FROM numbered) WHERE NOT use_mm OR NOT outlier""",
    "tested": """
  SELECT *, x1 >= 0 AND x1 < 1024 AND y1 >= 0 AND y1 < 1024
              AND x2 >= 0 AND x2 < 1024 AND y2 >= 0 AND y2 < 1024 AS inside,
         cast(floor(x1) AS bigint) % 64 >= 4 AND cast(floor(y2) AS bigint) % 64 >= 4 AS valid
  FROM chosen""",
    "windows": """
  SELECT win, count(*) FILTER (WHERE inside) AS n_inside,
         count(*) FILTER (WHERE inside AND valid) AS n_left
  FROM tested GROUP BY win""",
    "judged": """
  SELECT *, case when n_inside = 0 then 'out_of_bounds' when n_left < 4 then 'too_few' end AS reject_reason
  FROM windows""",
    "record_points": """
  SELECT win, kp_idx, pair_id, tag, pol, ref, wx, wy, 100 + wx AS global_scan, 200 + wy AS global_pix,
         x1 + wy AS x1, y1 + wx AS y1, x2 + wy - 3 AS x2, y2 + wx + 2 AS y2,
         1000e0 * pair_id + (x1 + wy) * 10e0 AS map_x1, -500e0 * pair_id + (y1 + wx) * -10e0 AS map_y1,
         1000e0 * pair_id + 5e0 + (x2 + wy - 3) * 10e0 AS map_x2,
         -500e0 * pair_id - 5e0 + (y2 + wx + 2) * -10e0 AS map_y2,
         'imw-' || tag || '_' || pol || '_toS1' || ref || '_pair' || pair_id || '_scan' || (100 + wx)
           || '_pix' || (200 + wy) || '_lgm_aff_4_1_0.95_' AS file_id
  FROM (SELECT t.*, cast(win % 20 AS int) AS pair_id, 'm' || cast(win % 5 AS varchar) AS tag,
               case when win % 2 = 0 then 'HH' else 'HV' end AS pol,
               case when win % 2 = 0 then 'VV' else 'VH' end AS ref,
               cast(1024 * (win % 7 + 1) AS int) AS wx, cast(512 * (win % 7 + 1) AS int) AS wy
        FROM tested t JOIN judged USING (win)
        WHERE inside AND valid AND reject_reason IS NULL)""",
    "moved": """
  SELECT *, sqrt((map_x1 - map_x2) * (map_x1 - map_x2) + (map_y1 - map_y2) * (map_y1 - map_y2)) AS distance,
         map_y1 - map_y2 AS along, map_x1 - map_x2 AS across
  FROM record_points""",
    "files": """
  SELECT (case when l_suppkey % 13 = 0 then 'disk' else 'imw-m' || cast(l_suppkey % 5 AS varchar) end)
     || (case when l_partkey % 2 = 0 then '_HH_toS1VV' else '_HV_toS1VH' end)
     || '_pair' || (case when l_quantity = 50 then 'X' else cast(l_suppkey % 20 AS varchar) end)
     || '_scan' || cast(l_linenumber * 1024 AS varchar) || '_pix' || cast(l_partkey AS varchar) || '_lgm'
     || (case when l_linenumber = 7 then '_hom' else '_aff' end) || '_4_' || cast(l_partkey % 3 + 1 AS varchar)
     || (case when l_quantity = 49 then ''
              when l_partkey % 3 = 0 then '_0.91' when l_partkey % 3 = 1 then '_0.95' else '_0.99' end)
     || '_' || (case when l_linenumber = 6 then '' else '.csv' end) AS file_name
  FROM lineitem""",
    "tokens": """
  SELECT file_name, string_split(regexp_replace(file_name, '([^/.]\\.*)\\.[^./]*$', '\\1'), '_') AS p FROM files""",
    "decoded": """
  SELECT file_name, p, replace(p[4], 'pair', '') AS s_pair, replace(p[5], 'scan', '') AS s_scan,
         replace(p[6], 'pix', '') AS s_pix
  FROM tokens""",
    "parsed": """
  SELECT *, starts_with(p[1], 'imw-') AND p[8] = 'aff' AND regexp_matches(s_pair, '^[+-]?[0-9]+$')
         AND regexp_matches(s_scan, '^[+-]?[0-9]+$') AND regexp_matches(s_pix, '^[+-]?[0-9]+$')
         AND try_cast(p[10] AS double) IS NOT NULL AND try_cast(p[11] AS double) IS NOT NULL AS good
  FROM decoded""",
    "sims": """
  SELECT a.label AS block, a.vec_id AS id0, b.vec_id AS id1,
         round(list_sum(list_transform(list_zip(a.embedding, b.embedding),
           lambda z: cast(z[1] AS double) * cast(z[2] AS double))), 9) AS s,
         list_sum(list_transform(list_zip(a.embedding, b.embedding),
           lambda z: (cast(z[1] AS double) - cast(z[2] AS double))
                     * (cast(z[1] AS double) - cast(z[2] AS double)))) AS d2
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1""",
}

_NEEDS = {
    "corr": [], "bounded": ["corr"], "clear": ["bounded"], "enough": ["clear"], "placed": ["clear"],
    "located": ["placed"], "specs": [], "first_valid": ["specs"], "confs": [], "resolved": ["first_valid", "confs"],
    "cat": ["resolved"], "runs": [], "outcomes": ["runs"], "pixels": [], "normalized": ["pixels"],
    "gate": ["normalized"], "filled": ["normalized"], "numbered": ["corr"], "chosen": ["numbered"],
    "tested": ["chosen"], "windows": ["tested"], "judged": ["windows"],
    "record_points": ["tested", "judged"], "moved": ["record_points"], "files": [], "tokens": ["files"],
    "decoded": ["tokens"], "parsed": ["decoded"], "sims": [],
}


def _with(needs: list[str], extra: dict[str, str]) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for before in _NEEDS[name]:
            visit(before)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        visit(name)
    members = [f"{name} AS ({_FRAGMENTS[name]})" for name in ordered]
    members += [f"{name} AS ({sql})" for name, sql in extra.items()]
    return "WITH " + ",\n".join(members) + "\n" if members else ""


def _oracle(name: str, needs: list[str], sql: str, **extra: str) -> None:
    ORACLE[name] = _with(needs, extra) + sql


def _r(value: str, digits: int = 6) -> str:
    return f"round({value}, {digits}) + 0e0"


# --- registry -------------------------------------------------------------------------------

_oracle("registry_resolve", ["cat"], "SELECT ordinal, tag, dense, feature_name, matcher_name FROM cat")
_oracle(
    "registry_skips", ["resolved"],
    """SELECT ordinal, tag, dense, skip_reason,
         case when skip_reason = 'extractor' then extractor else matcher end AS missing
       FROM resolved WHERE skip_reason IS NOT NULL""",
)
_oracle(
    "tag_violations", ["specs"],
    """SELECT tag, count(*) AS n,
         case when regexp_matches(tag, '[_( ]') then 'bad_character' else 'duplicate' end AS violation
       FROM specs GROUP BY tag HAVING count(*) > 1 OR regexp_matches(tag, '[_( ]')""",
)
_oracle(
    "registry_counts", ["cat"],
    """SELECT count(*) AS total, count(*) FILTER (WHERE dense) AS dense,
         count(*) FILTER (WHERE NOT dense) AS sparse FROM cat""",
)
_oracle(
    "registry_listing", ["cat"],
    """SELECT ordinal, tag, case when dense then 'dense' else 'sparse' end AS kind,
         'imw-' || tag AS detector, matcher_name AS model_name FROM cat""",
)
_oracle(
    "heavy_dense", ["cat"],
    """SELECT ordinal, tag, dense, heavy, NOT heavy AS run_forward FROM (
         SELECT *, dense AND (tag LIKE '%ring%' OR tag LIKE '%widget%') AS heavy FROM cat)""",
)
_oracle(
    "allow_list", ["cat"],
    """SELECT ordinal, tag, dense FROM cat WHERE tag IN (
         SELECT unnest(string_split(replace(p_name, ' ', '-') || '-' || cast(p_size % 97 AS varchar)
                || ', ' || replace(p_name, ' ', '-') || '-1', ',')) FROM part)""",
)
_oracle(
    "tag_lookup", ["cat"],
    """SELECT request_id, r.tag, ordinal AS catalog_ordinal,
         case when ordinal IS NULL then 2 else 0 end AS status
       FROM (SELECT p_partkey AS request_id,
               replace(p_name, ' ', '-') || '-' || cast(p_partkey % 101 AS varchar) AS tag FROM part) r
       LEFT JOIN cat ON cat.tag = r.tag""",
)

_oracle("registry_from_files", ["cat"], "SELECT ordinal, tag, dense FROM cat")

# --- sweep ----------------------------------------------------------------------------------

_oracle(
    "window_size_settings", [],
    """SELECT run_id, window_size, case when window_size IS NULL then 250 else greatest(250, window_size // 2) end
         AS window_size_small, 'window' || cast(window_size AS varchar) AS output_dir
       FROM (SELECT o_orderkey AS run_id, unnest(case when o_orderkey % 3 = 0 then [1024]
               else [cast(o_custkey % 4096 AS int), 512, NULL] end) AS window_size FROM orders)""",
)
_oracle(
    "sweep_grid", ["cat"],
    """SELECT ordinal, tag, window_size, ransac_method, ransac_threshold, ransac_confidence,
         greatest(250, window_size // 2) AS window_size_small, window_size AS loftr_max_window,
         window_size > 2000 AS debug_mode, case when window_size >= 2000 then 1 else 2 end AS min_surviving_chips,
         'window' || cast(window_size AS varchar) AS output_dir, 2048 AS num_features
       FROM cat, (SELECT unnest([400, 1024, 2000, 2048]) AS window_size), (SELECT '4' AS ransac_method),
         (SELECT unnest(['1', '2', '3']) AS ransac_threshold),
         (SELECT unnest(['0.91', '0.95', '0.99']) AS ransac_confidence)""",
)
_oracle(
    "pending_runs", [],
    """SELECT 256 * l_linenumber AS window_size, l_suppkey AS scene, count(*) AS runs FROM lineitem
       WHERE 256 * l_linenumber NOT IN (SELECT 256 * l_linenumber FROM lineitem WHERE l_linenumber % 2 = 0)
       GROUP BY ALL""",
)
_oracle(
    "cached_pairs", [],
    """SELECT o_orderkey AS request_id, o_custkey AS pair_id FROM orders
       WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""",
)
_TAGS = """
  SELECT o_orderkey AS window_id, 'm' || cast(o_custkey % 50 AS varchar) AS tag FROM orders"""
_FAILED = """
  SELECT 'm' || cast(s_suppkey AS varchar) AS tag FROM supplier WHERE s_acctbal < 0"""
_oracle(
    "failed_latch", [], "SELECT tag, window_id FROM w WHERE tag NOT IN (SELECT tag FROM f)", w=_TAGS, f=_FAILED
)
_oracle(
    "latch_flags", [],
    """SELECT tag, tag IN (SELECT tag FROM f) AS load_failed, count(*) AS windows FROM w GROUP BY ALL""",
    w=_TAGS, f=_FAILED,
)
_oracle(
    "run_summary", ["outcomes"],
    "SELECT outcome, count(*) AS runs, round(sum(elapsed_min), 1) AS minutes FROM outcomes GROUP BY outcome",
)
_oracle("run_elapsed", ["runs"], "SELECT tag, elapsed_min FROM runs")
_oracle(
    "run_status", ["runs"],
    """SELECT count(*) FILTER (WHERE exit_code = 0) AS ok, count(*) FILTER (WHERE exit_code <> 0) AS failed,
         coalesce(max(cast(exit_code <> 0 AS int)), 0) AS status FROM runs""",
)
_oracle(
    "run_report", ["outcomes"],
    """SELECT outcome, ordinal // 1000 AS page, count(*) AS runs,
         string_agg(tag, ', ' ORDER BY ordinal, tag) AS tags
       FROM outcomes GROUP BY outcome, ordinal // 1000""",
)

# --- chips ----------------------------------------------------------------------------------

_oracle("chip_normalize", ["normalized"], f"SELECT chip_id, iy, ix, {_r('img')} AS v FROM normalized")
_oracle(
    "chip_pair_source", ["gate"],
    """SELECT cast(chip_id AS int) AS pair_id, cast(1024 * (chip_id % 7) AS int) AS wx,
         cast(512 * (chip_id % 7) AS int) AS wy, reject_reason, 1000e0 * chip_id + 5e0 AS x02 FROM gate""",
)
_oracle("chip_gate", ["gate"], "SELECT chip_id, reject_reason, valid AS valid1, valid AS valid2 FROM gate")
_oracle(
    "chip_reject_counts", ["gate"],
    "SELECT coalesce(reject_reason, 'accepted') AS reject_reason, count(*) AS n FROM gate GROUP BY ALL",
)
_oracle("chip_inpaint", ["filled"], f"SELECT chip_id, iy, ix, {_r('v')} AS v FROM filled")
_oracle(
    "chip_inpaint_nearest", ["normalized"],
    f"""SELECT chip_id, iy, ix, {_r('v')} AS v FROM (
          SELECT a.chip_id, a.iy, a.ix, coalesce(arg_min(b.img,
            ((a.iy - b.iy) * (a.iy - b.iy) + (a.ix - b.ix) * (a.ix - b.ix)) * 64 + b.iy * 8 + b.ix), 0e0) AS v
          FROM normalized a LEFT JOIN normalized b ON a.chip_id = b.chip_id AND b.ok
          GROUP BY a.chip_id, a.iy, a.ix)""",
)
_oracle(
    "chip_quantize", ["filled", "gate"],
    """SELECT chip_id, iy, ix, cast(floor(least(greatest(v * 255, 0), 255)) AS int) AS u8
       FROM filled JOIN gate USING (chip_id) WHERE reject_reason IS NULL""",
)
_oracle(
    "chip_resample", ["pixels"],
    f"""SELECT chip_id, cast(iy // 3 AS int) AS iy, cast(ix // 3 AS int) AS ix, {_r('avg(v)')} AS v
        FROM pixels GROUP BY chip_id, iy // 3, ix // 3""",
)

# --- correspondences ------------------------------------------------------------------------

_oracle(
    "select_keypoints", ["chosen"],
    """SELECT win, kp_idx, cast(x1 AS float) AS x1, cast(y1 AS float) AS y1,
         cast(x2 AS float) AS x2, cast(y2 AS float) AS y2 FROM chosen""",
)
_oracle(
    "window_clean", ["judged"],
    """SELECT win, reject_reason, case when reject_reason IS NULL then n_left end AS n
       FROM judged""",
)
_oracle(
    "window_reject_counts", ["judged"],
    """SELECT 'm' || cast(win % 5 AS varchar) AS tag, coalesce(reject_reason, 'accepted') AS reject_reason,
         count(*) AS n FROM judged GROUP BY ALL""",
)
_oracle("in_bounds", ["bounded"], "SELECT pair_id, chip, x1, y1, x2, y2 FROM bounded")
_oracle("nodata_touch", ["clear"], "SELECT pair_id, chip, x1, y1, x2, y2 FROM clear")
_oracle(
    "mask_lookup", ["pixels"],
    """SELECT on_chip, x, y, count(*) AS n FROM (
         SELECT l_partkey % 500 AS on_chip, l_suppkey % 8 + 0.5e0 AS x, l_orderkey % 8 + 0.25e0 AS y FROM lineitem) q
       WHERE NOT EXISTS (SELECT 1 FROM pixels WHERE v IS NULL AND chip_id = on_chip
                         AND ix = floor(x) AND iy = floor(y)) GROUP BY ALL""",
)
_oracle("min_matches", ["enough"], "SELECT win, pair_id, chip, x1, y1, x2, y2 FROM enough")

# --- geometry and records -------------------------------------------------------------------

_oracle("pixel_to_map", ["located"], "SELECT pair_id, chip, map_x1, map_y1, map_x2, map_y2 FROM located")
_oracle(
    "displacement", ["located"],
    f"""SELECT pair_id, chip, {_r('sqrt((map_x1 - map_x2) * (map_x1 - map_x2) + (map_y1 - map_y2) * (map_y1 - map_y2))')}
          AS distance, map_y1 - map_y2 AS along, map_x1 - map_x2 AS across FROM located""",
)
_oracle(
    "local_coords", ["placed"],
    """SELECT pair_id, chip, x1 + wy AS full_x1, y1 + wx AS full_y1, x2 + s1_wy AS full_x2, y2 + s1_wx AS full_y2
       FROM placed""",
)
_oracle(
    "global_position", ["placed"],
    "SELECT pair_id, chip, 100 + wx AS global_scan, 200 + wy AS global_pix FROM placed",
)


def _list(column: str) -> str:
    return f"string_agg(cast(cast({column} * 8 AS bigint) AS varchar), ',' ORDER BY kp_idx) AS {column}"


_oracle(
    "match_record", ["moved"],
    f"""SELECT win, file_id, pair_id, global_scan, global_pix, wx AS local_init_x, wy AS local_init_y,
          'lgm' AS matcher, '' AS match_param, {_list('x1')}, {_list('y2')}, {_list('map_x1')}, {_list('map_y2')},
          {_list('along')}, {_list('across')}, {_r('sum(distance)', 4)} AS total_distance
        FROM moved GROUP BY win, file_id, pair_id, global_scan, global_pix, wx, wy""",
)
_oracle(
    "record_explode", ["moved"],
    f"""SELECT win, file_id, x1, y1, x2, y2, map_x1, map_y1, map_x2, map_y2, {_r('distance')} AS distance,
          along, across FROM moved""",
)
_oracle(
    "file_id_build", ["corr"],
    """SELECT win, 'imw-' || detector || '_' || source_pol || '_toS1' || s1_ref_tag || '_pair' || pair_id
         || '_scan' || (100 + 1024 * chip) || '_pix' || (200 + 512 * chip) || '_lgm_aff_4_'
         || (win % 3 + 1) || '_' || (case when win % 2 = 0 then '0.91' else '0.99' end) || '_.csv' AS file_name
       FROM corr""",
)
_oracle(
    "file_id_parse", ["parsed"],
    """SELECT file_name, cast(null AS varchar) AS disk_mode, cast(null AS varchar) AS det_wt,
         case when good then substr(p[1], 5) end AS desc_wt, case when good then p[1] end AS detector,
         case when good then p[2] end AS source_pol, case when good then replace(p[3], 'toS1', '') end AS s1_ref_tag,
         case when good then try_cast(s_pair AS bigint) end AS pair_id,
         case when good then try_cast(s_scan AS bigint) end AS scan,
         case when good then try_cast(s_pix AS bigint) end AS pix,
         case when good then p[7] end AS match_method, cast(null AS varchar) AS match_parameter,
         case when good then p[9] end AS ransac_method,
         case when good then try_cast(p[10] AS double) end AS ransac_threshold,
         case when good then try_cast(p[11] AS double) end AS ransac_confidence
       FROM parsed""",
)
_oracle(
    "pol_reference_join", ["parsed"],
    """SELECT pair_id, source_pol, ref_pol, 'ref/' || ref_pol || '/' || cast(pair_id AS varchar) AS ref_path,
         count(*) AS runs
       FROM (SELECT cast(s_pair AS int) AS pair_id, p[2] AS source_pol,
               case when p[2] IN ('HH', 'VV') then 'VV' else 'VH' end AS ref_pol FROM parsed WHERE good)
       WHERE pair_id IN (SELECT s_suppkey % 20 FROM supplier) GROUP BY ALL""",
)
_REF = "SELECT DISTINCT cast(s_suppkey % 20 AS int) AS pair_id FROM supplier"
_oracle(
    "reference_table", [],
    "SELECT pair_id, 'VH' AS ref_pol, 'ref/VH/' || cast(pair_id AS varchar) AS ref_path FROM r", r=_REF,
)
_oracle(
    "gcp_file", [],
    """SELECT s_suppkey AS gcp_id, cast((s_suppkey * 97) % 1000 * 10 + 5 AS double) AS X,
         cast((s_suppkey * 389) % 1000 * 10 AS double) AS Y FROM supplier""",
)
_oracle(
    "nearest_gcp", [],
    f"""SELECT match_id, arg_min(gcp_id, (d2, gcp_id)) AS gcp_id, {_r('sqrt(min(d2))')} AS gcp_distance
        FROM m LEFT JOIN LATERAL (
          SELECT gcp_id, (map_x1 - X) * (map_x1 - X) + (map_y1 - Y) * (map_y1 - Y) AS d2 FROM g) c ON d2 <= 360000e0
        GROUP BY match_id""",
    m="""
  SELECT o_orderkey AS match_id, cast(cast(floor(o_totalprice) AS bigint) % 1000 * 10 AS double) AS map_x1,
         cast((o_orderkey * 7) % 997 * 10 AS double) AS map_y1 FROM orders""",
    g="""
  SELECT s_suppkey AS gcp_id, cast((s_suppkey * 97) % 1000 * 10 + 5 AS double) AS X,
         cast((s_suppkey * 389) % 1000 * 10 AS double) AS Y FROM supplier""",
)

# --- matching -------------------------------------------------------------------------------

_oracle(
    "mutual_nn", ["sims"],
    f"SELECT cast(block AS bigint) AS block, id0, id1, {_r('s')} AS similarity FROM q WHERE r0 = 1 AND r1 = 1",
    q="""
  SELECT *, row_number() OVER (PARTITION BY block, id0 ORDER BY s DESC, id1) AS r0,
         row_number() OVER (PARTITION BY block, id1 ORDER BY s DESC, id0) AS r1 FROM sims""",
)
_oracle(
    "smnn_ratio", ["sims"],
    f"""SELECT cast(block AS bigint) AS block, id0, id1, {_r('d')} AS distance, {_r('d / n0')} AS ratio0,
          {_r('d / n1')} AS ratio1
        FROM q WHERE r0 = 1 AND r1 = 1 AND n0 > 0 AND n1 > 0 AND d / n0 <= 0.95e0 AND d / n1 <= 0.95e0""",
    q="""
  SELECT *, row_number() OVER a AS r0, row_number() OVER b AS r1, lead(d) OVER a AS n0, lead(d) OVER b AS n1
  FROM (SELECT *, round(sqrt(d2), 9) AS d FROM sims)
  WINDOW a AS (PARTITION BY block, id0 ORDER BY d, id1), b AS (PARTITION BY block, id1 ORDER BY d, id0)""",
)
_oracle(
    "dual_softmax", ["sims"],
    f"""SELECT cast(block AS bigint) AS block, id0, id1, {_r('p')} AS probability
        FROM q WHERE r0 = 1 AND r1 = 1 AND p >= 0.05e0""",
    w="""
  SELECT block, id0, id1, round(exp(s / 0.1e0) / sum(exp(s / 0.1e0)) OVER (PARTITION BY block, id0)
         * exp(s / 0.1e0) / sum(exp(s / 0.1e0)) OVER (PARTITION BY block, id1), 9) AS p FROM sims""",
    q="""
  SELECT *, row_number() OVER (PARTITION BY block, id0 ORDER BY p DESC, id1) AS r0,
         row_number() OVER (PARTITION BY block, id1 ORDER BY p DESC, id0) AS r1 FROM w""",
)
_oracle(
    "local_consistency", ["bounded"],
    """SELECT pair_id, x1, y1, x2, y2 FROM bounded JOIN (
         SELECT a.pair_id AS p, a.x1 AS a1, a.y1 AS a2, a.x2 AS a3, a.y2 AS a4
         FROM u a JOIN near b ON a.pair_id = b.pair_id AND a.cx = b.nx AND a.cy = b.ny
         WHERE abs((a.x2 - a.x1) - (b.x2 - b.x1)) <= 1 AND abs((a.y2 - a.y1) - (b.y2 - b.y1)) <= 1
         GROUP BY ALL HAVING sum(b.w) > 3)
       ON pair_id = p AND x1 = a1 AND y1 = a2 AND x2 = a3 AND y2 = a4""",
    u="""
  SELECT pair_id, x1, y1, x2, y2, count(*) AS w, floor(x1 / 64) AS cx, floor(y1 / 64) AS cy
  FROM bounded GROUP BY pair_id, x1, y1, x2, y2""",
    near="""
  SELECT *, cx + dx AS nx, cy + dy AS ny
  FROM u, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy)""",
)


def _least_squares(n: str) -> str:
    """The affine map of summed moments, a to f, and its determinant."""
    xx, xy, yy = f"({n} * s_xx - s_x * s_x)", f"({n} * s_xy - s_x * s_y)", f"({n} * s_yy - s_y * s_y)"
    parts = [f"{xx} AS xx", f"{xy} AS xy", f"{yy} AS yy"]
    for t in "uv":
        parts += [f"({n} * s_x{t} - s_x * s_{t}) AS x{t}", f"({n} * s_y{t} - s_y * s_{t}) AS y{t}"]
    return ", ".join(parts)


_SUMS = ", ".join(
    f"sum({value}) AS s_{name}" for name, value in (
        ("x", "x"), ("y", "y"), ("xx", "x * x"), ("xy", "x * y"), ("yy", "y * y"), ("u", "u"), ("xu", "x * u"),
        ("yu", "y * u"), ("v", "v"), ("xv", "x * v"), ("yv", "y * v"))
)
_SOLVED = """
  SELECT *, (u_ - a * s_x - b * s_y) / n AS c, (v_ - d * s_x - e * s_y) / n AS f FROM (
    SELECT *, s_u AS u_, s_v AS v_, (xu * yy - yu * xy) / (xx * yy - xy * xy) AS a, (yu * xx - xu * xy) / (xx * yy - xy * xy) AS b,
           (xv * yy - yv * xy) / (xx * yy - xy * xy) AS d, (yv * xx - xv * xy) / (xx * yy - xy * xy) AS e
    FROM (SELECT *, {least} FROM {source}) WHERE n >= 3 AND xx * yy - xy * xy > 1e-9 * xx * yy)"""
_oracle(
    "seeded_affine", ["bounded"],
    """SELECT pair_id, x1, y1, x2, y2 FROM b WHERE EXISTS (SELECT 1 FROM tested t JOIN supported USING (pair_id, gx, gy)
         WHERE t.pair_id = b.pair_id AND t.no = b.no)""",
    b="SELECT *, floor(x1 / 64) AS cx, floor(y1 / 64) AS cy, row_number() OVER () AS no FROM bounded",
    seed="""
  SELECT pair_id, cx AS gx, cy AS gy, x1 AS sx1, y1 AS sy1, x2 AS sx2, y2 AS sy2 FROM (SELECT *, row_number() OVER (
    PARTITION BY pair_id, cx, cy ORDER BY score DESC, x1, y1, x2, y2) AS rn FROM b) WHERE rn = 1""",
    met="""
  SELECT b.pair_id, no, gx, gy, x1 - sx1 AS x, y1 - sy1 AS y, x2 - x1 - (sx2 - sx1) AS u, y2 - y1 - (sy2 - sy1) AS v
  FROM b JOIN (SELECT *, gx + dx AS jx, gy + dy AS jy FROM seed, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy)) s
    ON b.pair_id = s.pair_id AND b.cx = jx AND b.cy = jy""",
    summed=f"""
  SELECT pair_id, gx, gy, cast(count(*) AS double) AS n, {_SUMS} FROM met WHERE abs(u) <= 2 AND abs(v) <= 2 GROUP BY ALL""",
    motion=_SOLVED.format(least=_least_squares("n"), source="summed"),
    tested="""
  SELECT met.pair_id, no, gx, gy FROM met JOIN motion m USING (pair_id, gx, gy)
  WHERE (a * x + b * y + c - met.u) * (a * x + b * y + c - met.u) + (d * x + e * y + f - met.v) * (d * x + e * y + f - met.v) <= 0.6e0 * 0.6e0""",
    supported="SELECT pair_id, gx, gy FROM tested GROUP BY ALL HAVING count(*) >= 12",
)
_oracle(
    "top_keypoints", ["corr"],
    """SELECT pair_id, chip, cast(rn AS int) AS rank, score, x1, y1, x2, y2 FROM (
         SELECT *, row_number() OVER (PARTITION BY pair_id, chip ORDER BY score DESC, x1, y1, x2, y2) AS rn
         FROM corr WHERE score >= 0.125e0) WHERE rn <= 100""",
)

# --- fit and report -------------------------------------------------------------------------

_P = 2147483647


def _fit_members(keys: str, source: str, most: int) -> dict[str, str]:
    """Models and residuals of every group, as defined for the affine fit."""
    on = " AND ".join(f"m.{k} = p.{k}" for k in keys.split(", "))

    def mod(value: str) -> str:
        return f"((({value}) % {_P}) + {_P}) % {_P}"

    factors = ((73856093, 19349663, 83492791, 39916801), (32452843, 49979687, 15485863, 67867967))
    steps = [mod(f"cast(floor({c} * 1024) AS bigint)") for c in ("x1", "y1", "x2", "y2")]
    mix1, mix2 = (" + ".join(f"({s}) * {f} % {_P}" for s, f in zip(steps, fs)) for fs in factors)
    det = "(qx - px) * (ry - py) - (rx - px) * (qy - py)"

    def row(u: str, v: str, base: str) -> tuple[str, str, str]:
        first = f"(({u} - {base}) * (ry - py) - ({v} - {base}) * (qy - py)) / det"
        second = f"(({v} - {base}) * (qx - px) - ({u} - {base}) * (rx - px)) / det"
        return first, second, f"{base} - {first} * px - {second} * py"

    a, b, c = row("qx2", "rx2", "px2")
    d, e, f = row("qy2", "ry2", "py2")
    return {
        "hashed": f"""
  SELECT *, (mix1 * mix1 + mix1 * 48271) % {_P} * 2147483648 + (mix2 * mix2 + mix2 * 16807) % {_P} AS hsh
  FROM (SELECT {keys}, x1, y1, x2, y2, ({mix1}) % {_P} AS mix1, ({mix2}) % {_P} AS mix2 FROM {source})""",
        "slots": f"""
  SELECT h, slot, (h * stride % {most} + slot * {most}) * ({1 << 62} // {3 * most}) AS target
  FROM (SELECT unnest(range({most})) AS h), (VALUES (0, 7919), (1, 104729), (2, 1299709)) AS s(slot, stride)""",
        "picks": f"""
  SELECT {keys}, h, slot, arg_min({{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}, ((hsh - target) + {1 << 62}) % {1 << 62}) AS pt
  FROM hashed, slots GROUP BY {keys}, h, slot""",
        "triples": f"""
  SELECT {', '.join(f'p.{k}' for k in keys.split(', '))}, h, p.pt.x1 AS px, p.pt.y1 AS py, p.pt.x2 AS px2, p.pt.y2 AS py2,
         q.pt.x1 AS qx, q.pt.y1 AS qy, q.pt.x2 AS qx2, q.pt.y2 AS qy2, r.pt.x1 AS rx, r.pt.y1 AS ry, r.pt.x2 AS rx2, r.pt.y2 AS ry2
  FROM picks p JOIN picks q USING ({keys}, h) JOIN picks r USING ({keys}, h)
  WHERE p.slot = 0 AND q.slot = 1 AND r.slot = 2""",
        "models": f"""
  SELECT {keys}, h, {a} AS a, {b} AS b, {c} AS c, {d} AS d, {e} AS e, {f} AS f
  FROM (SELECT *, {det} AS det FROM triples) WHERE det <> 0""",
        "res": f"""
  SELECT p.*, h, a, b, c, d, e, f,
         sqrt((a * x1 + b * y1 + c - x2) * (a * x1 + b * y1 + c - x2)
              + (d * x1 + e * y1 + f - y2) * (d * x1 + e * y1 + f - y2)) AS r
  FROM {source} p JOIN models m ON {on}""",
    }


def _hypotheses(confidence: float) -> int:
    return math.ceil(math.log(1 - confidence) / math.log(7 / 8))


def _grid(thresholds: list[float], confidences: list[float]) -> str:
    rows = [f"({t}e0, {c}e0, {_hypotheses(c)})" for t in thresholds for c in confidences]
    return f"(VALUES {', '.join(rows)}) AS g(ransac_threshold, ransac_confidence, cnt)"


_MODEL = ", ".join(f"{_r(c, 4)} AS m_{c}" for c in "abcdef")


def _winners(keys: str, grid: str, order: str) -> dict[str, str]:
    doublings = " + ".join(f"cast(r >= {64 * 2**j}e0 AS int)" for j in range(1, 21))
    step = f"(case when r < 64 then floor(r * 64) else 4096 + 64 * ({doublings}) + floor(r / pow(2e0, {doublings}) - 64) end)"
    return {
        "scored": f"""
  SELECT {keys}, h, a, b, c, d, e, f, ransac_threshold, ransac_confidence, count(*) AS n,
         count(*) FILTER (WHERE r <= ransac_threshold) AS inliers,
         min({step}) FILTER (WHERE at_most * 2 >= total) AS med
  FROM (SELECT res.*, count(*) OVER (PARTITION BY {keys}, h ORDER BY {step}) AS at_most,
               count(*) OVER (PARTITION BY {keys}, h) AS total FROM res), {grid}
  WHERE h < cnt GROUP BY ALL""",
        "won": f"""
  SELECT * FROM (SELECT *, row_number() OVER (
      PARTITION BY {keys}, ransac_threshold, ransac_confidence ORDER BY {order}, h) AS rn FROM scored)
  WHERE rn = 1""",
    }


_FIT_OUT = f"'4' AS ransac_method, ransac_threshold, ransac_confidence, cast(h AS int) AS h, n, inliers, {_MODEL}"
_CD = "pair_id, chip, detector"
_oracle(
    "ransac_affine", ["bounded"], f"SELECT {_CD}, {_FIT_OUT} FROM won",
    **_fit_members(_CD, "bounded", 35),
    **_winners(_CD, _grid([1, 2, 3], [0.91, 0.95, 0.99]), "inliers DESC"),
)
_oracle(
    "ransac_median", ["bounded"], f"SELECT pair_id, chip, {_FIT_OUT} FROM won",
    **_fit_members("pair_id, chip", "bounded", 23), **_winners("pair_id, chip", _grid([2], [0.95]), "med"),
)

_oracle(
    "ransac_refit", ["bounded"],
    f"""SELECT pair_id, chip, '4' AS ransac_method, ransac_threshold, ransac_confidence, cast(h AS int) AS h, total AS n,
          inliers, {', '.join(f"{_r(c, 4)} AS r_{c}" for c in 'abcdef')} FROM refined""",
    **_fit_members("pair_id, chip", "bounded", 23), **_winners("pair_id, chip", _grid([2], [0.95]), "inliers DESC"),
    near="""
  SELECT pair_id, chip, won.h, won.n AS total, inliers, ransac_threshold, ransac_confidence, x1 AS x, y1 AS y, x2 AS u, y2 AS v
  FROM res JOIN won USING (pair_id, chip, h) WHERE r <= 2""",
    summed=f"""
  SELECT pair_id, chip, h, total, inliers, ransac_threshold, ransac_confidence, count(*) AS n, {_SUMS} FROM near GROUP BY ALL""",
    refined=_SOLVED.format(least=_least_squares("n"), source="summed"),
)


def _consensus_members(source: str, pair: str, chip_inliers: str) -> dict[str, str]:
    keys = f"{pair}, chip"
    bins = "floor(across / 0.5e0) AS bu, floor(along / 0.5e0) AS bv"
    return {
        "chip_mode": f"""
  SELECT {keys}, (bu + 0.5e0) * 0.5e0 AS cx, (bv + 0.5e0) * 0.5e0 AS cy FROM (
    SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, bu, bv) AS rn
    FROM (SELECT {keys}, {bins}, count(*) AS n FROM {source} GROUP BY ALL)) WHERE rn = 1""",
        "pair_mode": f"""
  SELECT {pair}, (bu + 0.5e0) * 0.5e0 AS gx, (bv + 0.5e0) * 0.5e0 AS gy FROM (
    SELECT *, row_number() OVER (PARTITION BY {pair} ORDER BY n DESC, bu, bv) AS rn
    FROM (SELECT {pair}, {bins}, count(*) AS n FROM {source} GROUP BY ALL)) WHERE rn = 1""",
        "survivors": f"""
  SELECT {keys}, count(*) AS n, avg(across) AS across, avg(along) AS along
  FROM {chip_inliers} JOIN chip_mode USING ({keys}) JOIN pair_mode USING ({pair})
  GROUP BY {keys}, gx, gy
  HAVING count(*) >= 3 AND abs(avg(across) - gx) <= 5 AND abs(avg(along) - gy) <= 5""",
    }


_NEAR_MODE = "(SELECT s.* FROM {0} s JOIN chip_mode c ON {1} WHERE abs(across - cx) <= 5 AND abs(along - cy) <= 5)"
_AGREED = f"""SELECT pair_id, count(*) AS chips, cast(sum(n) AS bigint) AS n, {_r('avg(across)')} AS across,
  {_r('avg(along)')} AS along FROM survivors GROUP BY pair_id HAVING count(*) >= 2"""
_oracle(
    "chip_consensus", ["enough"], _AGREED,
    **_consensus_members(
        "enough", "pair_id", _NEAR_MODE.format("enough", "s.pair_id = c.pair_id AND s.chip = c.chip")
    ),
)
_oracle(
    "chip_consensus_fitted", ["clear"], _AGREED,
    **_fit_members("pair_id, chip", "clear", 35), **_winners("pair_id, chip", _grid([3], [0.99]), "inliers DESC"),
    fitted="""
  SELECT res.* FROM res JOIN won ON res.pair_id = won.pair_id AND res.chip = won.chip AND res.h = won.h
  WHERE r <= 3""",
    **_consensus_members("clear", "pair_id", "fitted"),
)
_oracle(
    "min_area", ["bounded"],
    """SELECT win, count(*) AS n, (max(x1) - min(x1)) * (max(y1) - min(y1)) AS area FROM bounded GROUP BY win
       HAVING (max(x1) - min(x1)) * (max(y1) - min(y1)) >= 20000""",
)
_oracle(
    "best_config", ["bounded"],
    """SELECT pair_id, chip, detector AS name, k AS inliers, rmse FROM (
         SELECT *, row_number() OVER (PARTITION BY pair_id, chip ORDER BY k DESC, rmse, detector) AS rn FROM rated)
       WHERE rn = 1""",
    **_fit_members(_CD, "bounded", 35), **_winners(_CD, _grid([3], [0.99]), "inliers DESC"),
    rated=f"""
  SELECT pair_id, chip, detector, count(*) AS k, {_r('sqrt(avg(r * r))')} AS rmse
  FROM (SELECT res.* FROM res JOIN won ON res.pair_id = won.pair_id AND res.chip = won.chip
          AND res.detector = won.detector AND res.h = won.h WHERE r <= 3) GROUP BY ALL""",
)
_oracle(
    "match_stats", ["clear"],
    f"""SELECT detector, source_pol, pair_id, count(*) AS n, {_r('avg(along)')} AS mean_along,
          {_r('avg(across)')} AS mean_across, {_r('stddev_pop(along)')} AS std_along,
          {_r('stddev_pop(across)')} AS std_across, {_r('sqrt(avg(distance * distance))')} AS rmse,
          {_r('quantile_cont(along, 0.5)')} AS median_along, {_r('quantile_cont(across, 0.5)')} AS median_across,
          {_r('quantile_cont(distance, 0.5)')} AS p50_distance, {_r('quantile_cont(distance, 0.9)')} AS p90_distance
        FROM (SELECT *, sqrt(across * across + along * along) AS distance FROM clear) GROUP BY ALL""",
)
_PS = "window_size, detector, source_pol, s1_ref_tag"
_oracle(
    "pol_summary", ["clear"],
    f"""SELECT {_PS}, cast({' + '.join(f'grouping({k})' for k in _PS.split(', '))} AS int) AS level, count(*) AS chips,
          cast(sum(n) AS bigint) AS n, {_r('avg(across)')} AS across, {_r('avg(along)')} AS along
        FROM survivors GROUP BY ROLLUP ({_PS})""",
    sized="SELECT *, 1024 AS window_size FROM clear",
    **_consensus_members(
        "sized", f"{_PS}, pair_id",
        _NEAR_MODE.format(
            "sized", " AND ".join(f"s.{k} = c.{k}" for k in f"{_PS}, pair_id, chip".split(", "))
        ),
    ),
)

# --- matchers, files, increments ------------------------------------------------------------

_SHIFT = "SELECT vec_id AS chip_id, cast(vec_id % 8 AS int) AS s FROM embeddings"
_oracle(
    "matcher_udf", [],
    """SELECT chip_id, tag, 
         cast((case when dx >= 0 then (8 - dx + step - 1) // step else (8 + dx) // step end) * (8 // step) AS bigint)
           AS n_inside, cast((8 // step) * (8 // step) AS bigint) AS n_raw,
         dx, cast(null AS varchar) AS error FROM (
         SELECT *, case when tag = 'phase-fine' then 1 else 2 end AS step FROM d,
           (SELECT unnest(['phase-fine', 'phase-coarse']) AS tag))""",
    s=_SHIFT, d="SELECT chip_id, case when s > 4 then s - 8 else s end AS dx FROM s",
)
_oracle(
    "registration_run", [],
    """SELECT chip_id, 'phase' AS tag, cast((8 - abs(dx)) * 8 AS bigint) AS n, cast(-dx AS double) AS across,
         0e0 AS along FROM d""",
    s=_SHIFT, d="SELECT chip_id, case when s > 4 then s - 8 else s end AS dx FROM s",
)
_RUN = "window_size, detector, source_pol, s1_ref_tag"
_oracle(
    "registration_report", ["cat"],
    f"""SELECT {_RUN}, windows, accepted, outcome, ransac_method, ransac_threshold, ransac_confidence, pairs,
          cast(chips AS bigint) AS chips, cast(inliers AS bigint) AS inliers, across, along, rmse
        FROM tried LEFT JOIN agreed USING ({_RUN})""",
    allowed="""
  SELECT tag, matcher_name, 1 + cast(right(matcher_name, 1) AS int) % 2 AS step FROM cat
  WHERE tag IN (SELECT tag FROM specs WHERE ordinal - 1 IN (SELECT n_nationkey FROM nation))""",
    c="""
  SELECT *, case when s > 4 then s - 8 else s end AS dx,
         cast(case when pair_id % 20 = 19 then 512 when pair_id % 3 = 0 then 2048 else 1024 end AS int) AS window_size,
         case when pair_id % 2 = 0 then 'HH' else 'HV' end AS source_pol,
         case when pair_id % 2 = 0 then 'VV' else 'VH' end AS s1_ref_tag
  FROM (SELECT *, (pair_id % 8 + (case when vec_id % 11 = 0 then 2 else 0 end)) % 8 AS s
        FROM (SELECT vec_id, case when vec_id % 50 = 0 then 1000 + vec_id else vec_id % 40 end AS pair_id FROM embeddings))""",
    w="""
  SELECT c.*, 'imw-' || tag AS detector, matcher_name IS NOT NULL AS loaded, 25e0 - 10 * dx AS across,
         (case when dx >= 0 then (8 - dx + step - 1) // step else (8 + dx) // step end) * (8 // step) AS n,
         (case when dx >= 0 then (7 - dx) // step * step else 8 - step - (-dx + step - 1) // step * step end) * (8 - step) AS area
  FROM c, allowed WHERE window_size NOT IN (SELECT 512 + 3584 * r_regionkey FROM region WHERE r_regionkey < 2)""",
    tried=f"""
  SELECT {_RUN}, count(*) AS windows, count(*) FILTER (WHERE loaded) AS accepted,
         case when bool_and(loaded) then 'ok' else 'load failed' end AS outcome FROM w GROUP BY ALL""",
    pair_mode=f"""
  SELECT {_RUN}, pair_id, across AS mode FROM (
    SELECT *, row_number() OVER (PARTITION BY {_RUN}, pair_id ORDER BY n DESC, across) AS rn
    FROM (SELECT {_RUN}, pair_id, across, sum(n) AS n FROM w WHERE loaded GROUP BY ALL)) WHERE rn = 1""",
    survivors=f"""
  SELECT w.* FROM w JOIN pair_mode USING ({_RUN}, pair_id) WHERE loaded AND n >= 3 AND area >= 13 AND across = mode""",
    pairs=f"""
  SELECT {_RUN}, pair_id, count(*) AS chips, sum(n) AS n, avg(across) AS across FROM survivors GROUP BY ALL
  HAVING count(*) >= (case when window_size >= 2000 then 1 else 2 end)""",
    agreed=f"""
  SELECT {_RUN}, '4' AS ransac_method, cast(t AS double) AS ransac_threshold, cf AS ransac_confidence, count(*) AS pairs,
         sum(chips) AS chips, sum(n) AS inliers, round(avg(across), 6) + 0e0 AS across, 25e0 AS along, 0e0 AS rmse
  FROM pairs, (SELECT unnest([1, 2, 3]) AS t), (SELECT unnest([0.91e0, 0.95e0, 0.99e0]) AS cf) GROUP BY ALL""",
)
_oracle(
    "record_files_roundtrip", ["record_points"],
    """SELECT 1024 AS window_size, 'imw-' || tag AS detector, pol AS source_pol, count(DISTINCT win) AS records,
         count(*) AS points, cast(sum(case when kp_no = 1 then global_scan end) AS bigint) AS scans,
         count(DISTINCT win) AS same_detector
       FROM (SELECT *, row_number() OVER (PARTITION BY win) AS kp_no FROM record_points) GROUP BY tag, pol""",
)
_oracle(
    "match_files_roundtrip", ["moved"],
    f"""SELECT 1024 AS window_size, 'imw-' || tag AS detector, pol AS source_pol, file_id || '.csv' AS file_name,
          cast(pair_id AS bigint) AS pair_id, cast(global_scan AS bigint) AS scan, cast(global_pix AS bigint) AS pix,
          ref AS s1_ref_tag, 1e0 AS ransac_threshold, 0.95e0 AS ransac_confidence, count(*) AS points,
          {_r('sum(distance)', 4)} AS distance,
          {', '.join(f'cast(sum({c} * 8) AS bigint) AS {c}' for c in ('x1', 'y1', 'x2', 'y2', 'map_x1', 'map_y2', 'along', 'across'))}
        FROM moved GROUP BY ALL""",
)
_oracle(
    "incremental_run", ["located"],
    """SELECT pair_id, chip, map_x1, map_y1, map_x2, map_y2, map_y1 - map_y2 AS along, map_x1 - map_x2 AS across
       FROM located""",
)
_oracle(
    "incremental_overlap", ["clear"],
    """SELECT DISTINCT win, pair_id, chip, x1, y1, x2, y2, map_y1 - map_y2 AS along, map_x1 - map_x2 AS across FROM located""",
    **{name: _FRAGMENTS[name] for name in ("placed", "located")},
)
_oracle(
    "bad_windows", [],
    """SELECT chip_id, tag, coalesce(gate, cause) AS reject_reason, case when gate IS NULL then error end AS error,
         cast(case when gate IS NULL AND cause IS NULL then 16 else 0 end AS bigint) AS points
       FROM g, m""",
    g="""
  SELECT vec_id AS chip_id, case vec_id % 10 when 4 then 'all_zero' when 5 then 'nan' when 6 then 'low_valid'
    when 7 then 'all_zero' when 8 then NULL when 9 then NULL else 'bad_shape' end AS gate FROM embeddings""",
    m="""
  SELECT * FROM (VALUES ('wide', NULL, NULL), ('flat', 'matcher_error', 'ValueError: points of shape (5,)'),
    ('uneven', 'ragged', NULL), ('outside', 'out_of_bounds', NULL), ('few', 'too_few', NULL), ('empty', 'no_points', NULL),
    ('raising', 'matcher_error', 'ValueError: cannot match'),
    ('missing', 'matcher_error', 'load failed: OSError: no weights')) AS v(tag, cause, error)""",
)
