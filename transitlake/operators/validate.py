"""Catalog validation (V1-V7) as one long-form report.

Column presence checks are plan-time (``df.columns``); the data checks -
row count, target values outside the label set, target NULLs and the
NULL share of every recommended column - run as ONE aggregate pass.
Output rows: (check_name, column_name, value, passed).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitlake.schema import CLASSES, MINIMUM_REQUIRED, RECOMMENDED, TARGET

SPARSE_LIMIT = 0.90


def quality_report(df: DataFrame, target: str = TARGET) -> DataFrame:
    spark = df.sparkSession
    cols = set(df.columns)
    plan_rows = [("required_column", c, 1.0 if c in cols else 0.0, c in cols) for c in MINIMUM_REQUIRED]
    plan_rows += [("recommended_column", c, 1.0 if c in cols else 0.0, c in cols) for c in RECOMMENDED]
    missing_rec = sum(1 for c in RECOMMENDED if c not in cols)
    plan_rows.append(("missing_recommended_count", None, float(missing_rec), missing_rec == 0))
    plan = spark.createDataFrame(plan_rows, "check_name string, column_name string, value double, passed boolean")

    # every data check is one struct in ONE aggregate pass; the long form
    # comes from exploding that single row (no per-check re-aggregation)
    checks = [F.struct(F.lit("row_count").alias("check_name"),
                       F.lit(None).cast("string").alias("column_name"),
                       F.count(F.lit(1)).cast("double").alias("value"),
                       (F.count(F.lit(1)) > 0).alias("passed"))]
    if target in cols:
        t = F.col(target)
        bad = F.count(F.when(t.isNotNull() & ~t.isin(*CLASSES), 1))
        nulls = F.count(F.when(t.isNull(), 1))
        checks.append(F.struct(F.lit("invalid_target_values").alias("check_name"),
                               F.lit(target).alias("column_name"), bad.cast("double").alias("value"),
                               (bad == 0).alias("passed")))
        checks.append(F.struct(F.lit("target_nulls").alias("check_name"),
                               F.lit(target).alias("column_name"), nulls.cast("double").alias("value"),
                               (nulls == 0).alias("passed")))
    for c in [c for c in RECOMMENDED if c in cols]:
        share = F.avg(F.col(c).isNull().cast("double"))
        checks.append(F.struct(F.lit("null_share").alias("check_name"), F.lit(c).alias("column_name"),
                               share.alias("value"), (share <= SPARSE_LIMIT).alias("passed")))
    data = df.agg(F.array(*checks).alias("_c")).select(F.inline("_c"))
    return plan.unionByName(data)


def invalid_target_values(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Observed target values outside the label set."""
    return (df.select(target).where(F.col(target).isNotNull()).distinct()
              .where(~F.col(target).isin(*CLASSES)))


def validation_summary(report: DataFrame) -> DataFrame:
    """Report struct with the summary fields (V7): valid when every
    required column is present and the target has no invalid values."""
    blocking = F.col("check_name").isin("required_column", "invalid_target_values")
    return report.agg(
        F.min(F.when(blocking, F.col("passed").cast("int"))).cast("boolean").alias("is_valid"),
        F.count(F.when((F.col("check_name") == "required_column") & ~F.col("passed"), 1)).alias("missing_required"),
        F.count(F.when((F.col("check_name") == "recommended_column") & ~F.col("passed"), 1)).alias("missing_recommended"),
        F.count(F.when(F.col("check_name").isin("target_nulls", "null_share") & ~F.col("passed"), 1)).alias("issues"))
