"""Independent DuckDB SQL for each registered query.

Written directly from the operator specifications (not generated from
the Spark plans).  Doubles are rounded to 6 decimals on both sides;
counts are BIGINT and flags INT on both sides.
"""

from __future__ import annotations

# The unified candidate table derived from events (same arithmetic as
# transitlake.sources.fixtures), after projection to merged_* columns.
CANDIDATES = """
candidates AS (
  SELECT *,
    CASE WHEN disp_code IN ('FP','FA') THEN 'FALSE POSITIVE'
         WHEN disp_code IN ('PC','APC') THEN 'CANDIDATE'
         WHEN disp_code IN ('CP','KP') THEN 'CONFIRMED' END AS merged_koi_disposition
  FROM (
    SELECT event_id AS row_id,
      CASE WHEN p = 0 THEN 'KEPLER' ELSE 'TESS' END AS mission,
      CASE event_type WHEN 'click' THEN 'PC' WHEN 'error' THEN 'FP'
                      WHEN 'purchase' THEN 'CP' WHEN 'signup' THEN 'KP' ELSE NULL END AS disp_code,
      CAST(g * 7919 % 360000 AS DOUBLE) / 1000
        + CAST(p AS DOUBLE) * CASE WHEN g % 20 = 0 THEN CAST(0.0005 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS merged_ra,
      CAST(g * 104729 % 180000 AS DOUBLE) / 1000 - 90 AS merged_dec,
      CASE WHEN event_id % 97 = 0 THEN NULL ELSE CAST(g * 31 % 5000 AS DOUBLE) / 10 END AS merged_koi_period,
      CASE WHEN event_id % 11 = 0 THEN NULL ELSE value * 10 END AS merged_koi_depth,
      CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END AS merged_koi_depth_err1,
      CASE WHEN event_id % 13 = 0 THEN NULL ELSE -value / 2 END AS merged_koi_depth_err2,
      CAST(event_id % 24 AS DOUBLE) / 2 AS merged_koi_duration,
      CASE WHEN event_id % 17 = 0 THEN NULL ELSE value / 20 END AS merged_koi_prad,
      CAST(event_id % 7 AS DOUBLE) / 2 AS merged_koi_insol,
      CAST(event_id % 1200 AS DOUBLE) AS merged_koi_teq,
      CAST(3000 + user_id % 5 * 1000 + event_id % 600 AS DOUBLE) AS merged_koi_steff,
      CAST(35 + event_id % 12 AS DOUBLE) / 10 AS merged_koi_slogg,
      CASE WHEN event_id % 50 = 0 THEN CAST(-1 AS DOUBLE) ELSE CAST(1 + event_id % 30 AS DOUBLE) / 10 END AS merged_koi_srad
    FROM (SELECT *, event_id - event_id % 2 AS g, event_id % 2 AS p FROM events) b
  ) c
)"""

# Training preprocessing: labelled rows, impossible values nulled, label code.
TRAINING = CANDIDATES + """,
training AS (
  SELECT row_id, mission, merged_koi_disposition, merged_ra, merged_dec,
    CASE WHEN merged_koi_period > 0 THEN merged_koi_period END AS merged_koi_period,
    CASE WHEN merged_koi_depth > 0 THEN merged_koi_depth END AS merged_koi_depth,
    merged_koi_depth_err1, merged_koi_depth_err2,
    CASE WHEN merged_koi_duration > 0 THEN merged_koi_duration END AS merged_koi_duration,
    CASE WHEN merged_koi_prad > 0 THEN merged_koi_prad END AS merged_koi_prad,
    CASE WHEN merged_koi_insol > 0 THEN merged_koi_insol END AS merged_koi_insol,
    CASE WHEN merged_koi_teq > 0 THEN merged_koi_teq END AS merged_koi_teq,
    CASE WHEN merged_koi_steff > 0 THEN merged_koi_steff END AS merged_koi_steff,
    CASE WHEN merged_koi_slogg > 0 THEN merged_koi_slogg END AS merged_koi_slogg,
    CASE WHEN merged_koi_srad > 0 THEN merged_koi_srad END AS merged_koi_srad,
    CASE merged_koi_disposition WHEN 'CANDIDATE' THEN CAST(0 AS DOUBLE)
         WHEN 'CONFIRMED' THEN CAST(1 AS DOUBLE) ELSE CAST(2 AS DOUBLE) END AS label
  FROM candidates WHERE merged_koi_disposition IS NOT NULL
)"""

# Adjacent pairs in global (ra, dec, period, mission, row_id) order.
PAIRS = TRAINING + """,
positioned AS (
  SELECT * FROM training
  WHERE merged_ra IS NOT NULL AND merged_dec IS NOT NULL AND merged_koi_period IS NOT NULL
),
seq AS (
  SELECT row_id, mission, merged_koi_disposition AS disp, merged_ra AS ra, merged_dec AS dec,
    merged_koi_period AS per,
    LEAD(row_id) OVER w AS rid2, LEAD(mission) OVER w AS mis2,
    LEAD(merged_koi_disposition) OVER w AS disp2, LEAD(merged_ra) OVER w AS ra2,
    LEAD(merged_dec) OVER w AS dec2, LEAD(merged_koi_period) OVER w AS per2
  FROM positioned
  WINDOW w AS (ORDER BY merged_ra, merged_dec, merged_koi_period, mission, row_id)
),
ranked AS (
  SELECT *,
    CASE disp WHEN 'CONFIRMED' THEN 3 WHEN 'FALSE POSITIVE' THEN 2 WHEN 'CANDIDATE' THEN 1 ELSE 0 END AS p1,
    CASE disp2 WHEN 'CONFIRMED' THEN 3 WHEN 'FALSE POSITIVE' THEN 2 WHEN 'CANDIDATE' THEN 1 ELSE 0 END AS p2
  FROM seq
  WHERE rid2 IS NOT NULL AND abs(ra - ra2) < 0.001 AND abs(dec - dec2) < 0.001
    AND abs(per - per2) < 0.01 AND mission <> mis2
),
pairs AS (
  SELECT row_id AS row_id_1, rid2 AS row_id_2, mission AS mission_1, mis2 AS mission_2,
    disp AS disposition_1, disp2 AS disposition_2,
    CASE WHEN p1 > p2 OR (p1 = p2 AND (mission = 'TESS' OR mis2 <> 'TESS')) THEN row_id ELSE rid2 END AS keep_id,
    CASE WHEN p1 > p2 OR (p1 = p2 AND (mission = 'TESS' OR mis2 <> 'TESS')) THEN rid2 ELSE row_id END AS drop_id
  FROM ranked
),
deduped AS (
  SELECT * FROM positioned WHERE row_id NOT IN (SELECT drop_id FROM pairs)
)"""


def with_(cte: str, body: str) -> str:
    return "WITH " + cte.strip() + "\n" + body
