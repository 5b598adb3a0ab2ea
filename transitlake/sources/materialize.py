"""Materialize a reused intermediate as a parquet table in the shared
checkpoint folder (``spark.checkpoint.dir``).

Used where one intermediate feeds several branches of a plan (the
preprocessed training table feeds split quotas, bucket histograms,
scaling statistics, model fits).  Writing it once cuts the lineage: later
stages read columnar files with pruning and pushdown instead of
recomputing shuffles, and a lost executor costs a re-read, not a
recompute.  Never a machine-local folder: the path comes from the
session's checkpoint setting, which a cluster points at shared storage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from transitlake.session import scratch_path


def materialize(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
