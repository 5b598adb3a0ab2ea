"""Registered split / sampling queries (J1-J6, J8) with rank-based oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from transitlake.operators import sampling as S
from transitlake.plans import oracle_sql as O
from transitlake.plans.catalog_queries import deduped_table as deduped

KEY = "md5(concat_ws(':', '42', CAST(row_id AS VARCHAR)))"

J1_CTE = O.PAIRS + f""",
cnt AS (SELECT mission, merged_koi_disposition, count(*) AS cnt FROM deduped GROUP BY 1, 2),
tot AS (SELECT sum(cnt) AS n, sum(cnt) FILTER (WHERE mission = 'TESS') AS nt_avail,
               sum(cnt) FILTER (WHERE mission = 'KEPLER') AS nk_avail FROM cnt),
s1 AS (SELECT *, CAST(floor(n * CAST(0.8 AS DOUBLE)) AS BIGINT) AS t FROM tot),
s2 AS (SELECT *, least(CAST(floor(t * CAST(0.55 AS DOUBLE)) AS BIGINT), nt_avail) AS nt1 FROM s1),
s3 AS (SELECT *, CASE WHEN t - nt1 > nk_avail THEN t - nk_avail ELSE nt1 END AS n_t,
              least(t - nt1, nk_avail) AS n_k FROM s2),
quota AS (
  SELECT c.mission, c.merged_koi_disposition,
    CAST(floor(CASE c.mission WHEN 'TESS' THEN s3.n_t ELSE s3.n_k END
               * (c.cnt / sum(c.cnt) OVER (PARTITION BY c.mission))) AS BIGINT) AS quota
  FROM cnt c, s3
),
j1 AS (
  SELECT d.row_id, d.mission, d.merged_koi_disposition,
    row_number() OVER (PARTITION BY d.mission, d.merged_koi_disposition ORDER BY {KEY}, d.row_id)
      <= q.quota AS is_train
  FROM deduped d JOIN quota q USING (mission, merged_koi_disposition)
)"""


def _j1(spark, sf_dir):
    return S.survey_first_split(deduped(spark, sf_dir))


def q_split_assignments(spark, sf_dir):
    return _j1(spark, sf_dir).select("row_id", "mission", "merged_koi_disposition", "is_train")


SQL_SPLIT_ASSIGNMENTS = O.with_(J1_CTE, "SELECT * FROM j1")


def q_split_summary(spark, sf_dir):
    return S.split_summary(_j1(spark, sf_dir))


SQL_SPLIT_SUMMARY = O.with_(J1_CTE, """
SELECT CASE WHEN is_train THEN 'train' ELSE 'test' END AS split, mission, merged_koi_disposition,
  count(*) AS count,
  round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY CASE WHEN is_train THEN 'train' ELSE 'test' END), 1)
    AS share_pct
FROM j1 GROUP BY 1, 2, 3""")


def q_stratified_split(spark, sf_dir):
    s = S.stratified_split(deduped(spark, sf_dir), by=["mission"])
    return s.select("row_id", "mission", "merged_koi_disposition", "is_train")


SQL_STRATIFIED_SPLIT = O.with_(O.PAIRS + f""",
c AS (SELECT mission, merged_koi_disposition, count(*) AS cnt FROM deduped GROUP BY 1, 2),
n AS (SELECT *, sum(cnt) OVER (PARTITION BY mission) AS n_all FROM c),
w AS (SELECT *, n_all - CAST(ceil(n_all * CAST(0.2 AS DOUBLE)) AS BIGINT) AS want FROM n),
f AS (SELECT *, CAST(floor(want * cnt / n_all) AS BIGINT) AS fl,
             want * cnt / n_all - floor(want * cnt / n_all) AS rem FROM w),
r AS (SELECT *, want - sum(fl) OVER (PARTITION BY mission) AS short,
             row_number() OVER (PARTITION BY mission ORDER BY rem DESC, mission, merged_koi_disposition) AS rr
      FROM f),
quota AS (SELECT mission, merged_koi_disposition, fl + CASE WHEN rr <= short THEN 1 ELSE 0 END AS quota FROM r)""",
f"""
SELECT d.row_id, d.mission, d.merged_koi_disposition,
  row_number() OVER (PARTITION BY d.mission, d.merged_koi_disposition ORDER BY {KEY}, d.row_id)
    <= q.quota AS is_train
FROM deduped d JOIN quota q USING (mission, merged_koi_disposition)""")


def _mix_sql(base: str) -> str:
    return O.with_(O.PAIRS + f""",
c AS (SELECT mission, count(*) AS cnt FROM deduped GROUP BY 1),
nb AS (SELECT CAST(floor(cnt * CAST(0.8 AS DOUBLE)) AS BIGINT) AS nb FROM c WHERE mission = '{base}'),
quota AS (SELECT c.mission, CASE WHEN c.mission = '{base}' THEN nb.nb
                  ELSE least(CAST(floor(nb.nb * CAST(0.25 AS DOUBLE)) AS BIGINT), c.cnt) END AS quota
          FROM c, nb)""", f"""
SELECT d.row_id, d.mission,
  row_number() OVER (PARTITION BY d.mission ORDER BY {KEY}, d.row_id) <= q.quota AS is_train
FROM deduped d JOIN quota q USING (mission)""")


def q_mixed_split_kepler(spark, sf_dir):
    return S.survey_mix_split(deduped(spark, sf_dir), base_survey="KEPLER").select(
        "row_id", "mission", "is_train")


def q_mixed_split_tess(spark, sf_dir):
    return S.survey_mix_split(deduped(spark, sf_dir), base_survey="TESS").select(
        "row_id", "mission", "is_train")


def q_ratio_sample(spark, sf_dir):
    """J5 at the 80/20 TESS/KEPLER ratio: the sample, then its 80/20
    stratified split per survey; counts by (survey, class, set)."""
    smp = S.ratio_sample(deduped(spark, sf_dir), tess_ratio=0.8, total=8000)
    sp = S.stratified_split(smp, by=["mission"])
    return sp.groupBy("mission", "merged_koi_disposition", "is_train").agg(
        F.count(F.lit(1)).alias("count"))


SQL_RATIO_SAMPLE = O.with_(O.PAIRS + f""",
c AS (SELECT mission, count(*) AS cnt FROM deduped GROUP BY 1),
q0 AS (SELECT mission, least(CASE mission WHEN 'TESS' THEN 6400 WHEN 'KEPLER' THEN 1600 ELSE 0 END, cnt)
       AS quota FROM c),
smp AS (
  SELECT d.* FROM (
    SELECT *, row_number() OVER (PARTITION BY mission ORDER BY {KEY}, row_id) AS rn FROM deduped) d
  JOIN q0 USING (mission) WHERE d.rn <= q0.quota
),
c2 AS (SELECT mission, merged_koi_disposition, count(*) AS cnt FROM smp GROUP BY 1, 2),
n AS (SELECT *, sum(cnt) OVER (PARTITION BY mission) AS n_all FROM c2),
w AS (SELECT *, n_all - CAST(ceil(n_all * CAST(0.2 AS DOUBLE)) AS BIGINT) AS want FROM n),
f AS (SELECT *, CAST(floor(want * cnt / n_all) AS BIGINT) AS fl,
             want * cnt / n_all - floor(want * cnt / n_all) AS rem FROM w),
r AS (SELECT *, want - sum(fl) OVER (PARTITION BY mission) AS short,
             row_number() OVER (PARTITION BY mission ORDER BY rem DESC, mission, merged_koi_disposition) AS rr
      FROM f),
quota AS (SELECT mission, merged_koi_disposition, fl + CASE WHEN rr <= short THEN 1 ELSE 0 END AS quota FROM r),
sp AS (
  SELECT s.mission, s.merged_koi_disposition,
    row_number() OVER (PARTITION BY s.mission, s.merged_koi_disposition ORDER BY {KEY}, s.row_id)
      <= q.quota AS is_train
  FROM smp s JOIN quota q USING (mission, merged_koi_disposition)
)""", """
SELECT mission, merged_koi_disposition, is_train, count(*) AS count FROM sp GROUP BY 1, 2, 3""")


def q_balanced_sample(spark, sf_dir):
    d = deduped(spark, sf_dir)
    b = S.capped_sample(d.where(F.col("mission") == "KEPLER"), ["merged_koi_disposition"], 500)
    return b.select("row_id", "merged_koi_disposition")


SQL_BALANCED_SAMPLE = O.with_(O.PAIRS, f"""
SELECT row_id, merged_koi_disposition FROM (
  SELECT *, row_number() OVER (PARTITION BY merged_koi_disposition ORDER BY {KEY}, row_id) AS rn
  FROM deduped WHERE mission = 'KEPLER') t
WHERE rn <= 500""")


QUERIES = {
    "split_assignments": q_split_assignments,
    "split_summary": q_split_summary,
    "stratified_split": q_stratified_split,
    "mixed_split_kepler": q_mixed_split_kepler,
    "mixed_split_tess": q_mixed_split_tess,
    "ratio_sample": q_ratio_sample,
    "balanced_sample": q_balanced_sample,
}

ORACLE = {
    "split_assignments": SQL_SPLIT_ASSIGNMENTS,
    "split_summary": SQL_SPLIT_SUMMARY,
    "stratified_split": SQL_STRATIFIED_SPLIT,
    "mixed_split_kepler": _mix_sql("KEPLER"),
    "mixed_split_tess": _mix_sql("TESS"),
    "ratio_sample": SQL_RATIO_SAMPLE,
    "balanced_sample": SQL_BALANCED_SAMPLE,
}
