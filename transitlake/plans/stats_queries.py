"""Registered distribution-shift queries (E13-E15, G4) on the unified catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from transitlake.functions.expr import round_doubles
from transitlake.operators import stats as ST
from transitlake.operators.clean import drop_missing_target, min_present_filter
from transitlake.operators.report import top_k
from transitlake.plans import oracle_sql as O
from transitlake.sources import fixtures as X
from transitlake.sources.materialize import materialize

FEATURES = ["merged_ra", "merged_dec", "merged_koi_period", "merged_koi_depth",
            "merged_koi_depth_err1", "merged_koi_depth_err2", "merged_koi_duration",
            "merged_koi_prad", "merged_koi_insol", "merged_koi_teq", "merged_koi_steff",
            "merged_koi_slogg", "merged_koi_srad"]


def analysis_rows(spark, sf_dir, materialized: bool = False):
    """Labelled rows with at least half of the numeric features present."""
    c = X.candidates(spark, sf_dir)
    out = min_present_filter(drop_missing_target(c), FEATURES, 0.5)
    return materialize(out, "shift_rows") if materialized else out


CLEAN_CTE = O.CANDIDATES + """,
clean AS (
  SELECT * FROM candidates WHERE merged_koi_disposition IS NOT NULL AND ("""
CLEAN_CTE += " + ".join(f"CAST({c} IS NOT NULL AS INT)" for c in FEATURES) + """) >= 6.5
),
long AS (
  SELECT mission, feature, value FROM (
    UNPIVOT (SELECT mission, """ + ", ".join(FEATURES) + """ FROM clean)
    ON """ + ", ".join(FEATURES) + """ INTO NAME feature VALUE value)
  WHERE value IS NOT NULL
),
agg AS (
  SELECT feature, value, count(*) FILTER (WHERE mission = 'KEPLER') AS na,
         count(*) FILTER (WHERE mission = 'TESS') AS nb
  FROM long GROUP BY feature, value
),
ks AS (
  SELECT feature, n_a, n_b, max(abs(ca / n_a - cb / n_b)) AS d_stat FROM (
    SELECT feature, sum(na) OVER (PARTITION BY feature ORDER BY value) AS ca,
           sum(nb) OVER (PARTITION BY feature ORDER BY value) AS cb,
           sum(na) OVER (PARTITION BY feature) AS n_a, sum(nb) OVER (PARTITION BY feature) AS n_b
    FROM agg) t
  WHERE n_a >= 10 AND n_b >= 10
  GROUP BY feature, n_a, n_b
),
ksp AS (
  SELECT *, least(1.0, greatest(0.0, 2 * (
    SELECT sum(power(-1.0, k - 1) * exp(-2.0 * k * k * (d_stat * sqrt(n_a * n_b / (n_a + n_b)))
                                          * (d_stat * sqrt(n_a * n_b / (n_a + n_b)))))
    FROM range(1, 101) r(k)))) AS p_value
  FROM ks
)"""


def q_shift_moments(spark, sf_dir):
    return round_doubles(ST.shift_moments(analysis_rows(spark, sf_dir), FEATURES))


SQL_SHIFT_MOMENTS = O.with_(CLEAN_CTE, """
SELECT feature, round(ka, 6) AS kepler_mean, round(ks_, 6) AS kepler_std,
  round(ta, 6) AS tess_mean, round(ts_, 6) AS tess_std,
  round(abs(ka - ta) / (abs(ka) + 1e-10) * 100, 6) AS mean_diff_pct
FROM (
  SELECT feature, avg(value) FILTER (WHERE mission = 'KEPLER') AS ka,
    stddev_samp(value) FILTER (WHERE mission = 'KEPLER') AS ks_,
    count(*) FILTER (WHERE mission = 'KEPLER') AS kn,
    avg(value) FILTER (WHERE mission = 'TESS') AS ta,
    stddev_samp(value) FILTER (WHERE mission = 'TESS') AS ts_,
    count(*) FILTER (WHERE mission = 'TESS') AS tn
  FROM long GROUP BY feature) g
WHERE kn >= 10 AND tn >= 10""")


def q_ks_statistic(spark, sf_dir):
    return round_doubles(ST.ks_statistic(analysis_rows(spark, sf_dir), FEATURES))


SQL_KS_STATISTIC = O.with_(CLEAN_CTE, "SELECT feature, n_a, n_b, round(d_stat, 6) AS d_stat FROM ks")


def q_ks_test(spark, sf_dir):
    t = ST.ks_test(analysis_rows(spark, sf_dir), FEATURES, exact_rows=0)  # the limit, as in the SQL
    return round_doubles(t)


SQL_KS_TEST = O.with_(CLEAN_CTE, """
SELECT feature, n_a, n_b, round(d_stat, 6) AS d_stat, round(p_value, 6) AS p_value,
  p_value < 0.05 AS significant FROM ksp""")


def q_ks_exact(spark, sf_dir):
    """Exact small-sample p-values, as the negative decimal logarithm."""
    t = ST.ks_test(analysis_rows(spark, sf_dir), FEATURES).where(F.greatest("n_a", "n_b") <= ST.EXACT_ROWS)
    return round_doubles(t.select("feature", "n_a", "n_b", "d_stat", (-F.log10("p_value")).alias("neg_log10_p")))


def q_shift_summary(spark, sf_dir):
    return ST.shift_summary(ST.ks_test(analysis_rows(spark, sf_dir, materialized=True), FEATURES, exact_rows=0))


SQL_SHIFT_SUMMARY = O.with_(CLEAN_CTE, """
SELECT count(*) AS n_features, count(*) FILTER (WHERE p_value < 0.05) AS n_significant,
  round(count(*) FILTER (WHERE p_value < 0.05) * 100.0 / count(*), 1) AS share_significant_pct
FROM ksp""")


def q_top_shifted(spark, sf_dir):
    t = ST.ks_statistic(analysis_rows(spark, sf_dir), FEATURES)
    return round_doubles(top_k(t, "d_stat", 10, tie="feature"))


SQL_TOP_SHIFTED = O.with_(CLEAN_CTE, """
SELECT feature, n_a, n_b, round(d_stat, 6) AS d_stat FROM ks
ORDER BY d_stat DESC, feature LIMIT 10""")


QUERIES = {
    "shift_moments": q_shift_moments,
    "ks_statistic": q_ks_statistic,
    "ks_test": q_ks_test,
    "ks_exact": q_ks_exact,
    "shift_summary": q_shift_summary,
    "top_shifted": q_top_shifted,
}

ORACLE = {
    "shift_moments": SQL_SHIFT_MOMENTS,
    "ks_statistic": SQL_KS_STATISTIC,
    "ks_test": SQL_KS_TEST,
    "shift_summary": SQL_SHIFT_SUMMARY,
    "top_shifted": SQL_TOP_SHIFTED,
}
