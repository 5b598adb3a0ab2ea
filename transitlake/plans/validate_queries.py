"""Registered validation queries (V1-V7) on the unified candidate catalog."""

from __future__ import annotations

from transitlake.functions.expr import round_doubles
from transitlake.operators.validate import quality_report, validation_summary
from transitlake.plans import oracle_sql as O
from transitlake.schema import MINIMUM_REQUIRED, RECOMMENDED
from transitlake.sources import fixtures as X

# columns of the fixture catalog after projection to merged_*
_PRESENT = {"merged_koi_disposition", "merged_ra", "merged_dec", "merged_koi_period",
            "merged_koi_depth", "merged_koi_depth_err1", "merged_koi_depth_err2",
            "merged_koi_duration", "merged_koi_prad", "merged_koi_insol", "merged_koi_teq",
            "merged_koi_steff", "merged_koi_slogg", "merged_koi_srad"}


def q_quality_report(spark, sf_dir):
    return round_doubles(quality_report(X.candidates(spark, sf_dir)))


def _plan_values() -> str:
    rows = [f"('required_column', '{c}', {1.0 if c in _PRESENT else 0.0}, {str(c in _PRESENT).lower()})"
            for c in MINIMUM_REQUIRED]
    rows += [f"('recommended_column', '{c}', {1.0 if c in _PRESENT else 0.0}, {str(c in _PRESENT).lower()})"
             for c in RECOMMENDED]
    miss = sum(1 for c in RECOMMENDED if c not in _PRESENT)
    rows.append(f"('missing_recommended_count', NULL, {float(miss)}, {str(miss == 0).lower()})")
    return ",\n".join(rows)


_REC_PRESENT = [c for c in RECOMMENDED if c in _PRESENT]

REPORT_CTE = O.CANDIDATES + """,
report AS (
  SELECT * FROM (VALUES """ + _plan_values() + """) v(check_name, column_name, value, passed)
  UNION ALL SELECT 'row_count', NULL, CAST(count(*) AS DOUBLE), count(*) > 0 FROM candidates
  UNION ALL SELECT 'invalid_target_values', 'merged_koi_disposition',
    CAST(count(*) FILTER (WHERE merged_koi_disposition IS NOT NULL
         AND merged_koi_disposition NOT IN ('CANDIDATE', 'CONFIRMED', 'FALSE POSITIVE')) AS DOUBLE),
    count(*) FILTER (WHERE merged_koi_disposition IS NOT NULL
         AND merged_koi_disposition NOT IN ('CANDIDATE', 'CONFIRMED', 'FALSE POSITIVE')) = 0 FROM candidates
  UNION ALL SELECT 'target_nulls', 'merged_koi_disposition',
    CAST(count(*) FILTER (WHERE merged_koi_disposition IS NULL) AS DOUBLE),
    count(*) FILTER (WHERE merged_koi_disposition IS NULL) = 0 FROM candidates
""" + "".join(f"""  UNION ALL SELECT 'null_share', '{c}', avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END),
    avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) <= 0.9 FROM candidates
""" for c in _REC_PRESENT) + ")"

SQL_QUALITY_REPORT = O.with_(REPORT_CTE, "SELECT check_name, column_name, round(value, 6) AS value, passed FROM report")


def q_validation_summary(spark, sf_dir):
    return validation_summary(quality_report(X.candidates(spark, sf_dir)))


SQL_VALIDATION_SUMMARY = O.with_(REPORT_CTE, """
SELECT CAST(min(CASE WHEN check_name IN ('required_column', 'invalid_target_values') THEN CAST(passed AS INT) END)
            AS BOOLEAN) AS is_valid,
  count(*) FILTER (WHERE check_name = 'required_column' AND NOT passed) AS missing_required,
  count(*) FILTER (WHERE check_name = 'recommended_column' AND NOT passed) AS missing_recommended,
  count(*) FILTER (WHERE check_name IN ('target_nulls', 'null_share') AND NOT passed) AS issues
FROM report""")

QUERIES = {"quality_report": q_quality_report, "validation_summary": q_validation_summary}
ORACLE = {"quality_report": SQL_QUALITY_REPORT, "validation_summary": SQL_VALIDATION_SUMMARY}
