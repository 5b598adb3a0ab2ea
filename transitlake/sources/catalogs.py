"""Survey catalog scans and CSV sinks.

Catalog CSVs are read by NAME with declared types and no inference pass
over the data: the header gives the column names, every declared column
is converted with ``try_cast`` (a malformed number becomes NULL instead
of failing the job or turning the column into strings, trap T5), and
``_bad_fields`` counts the values a row lost that way.  Columns of the
file that are not declared are not read at all.  NaN / inf are
normalized to NULL at ingest (T1); a declared column missing from the
file is added as NULL (schema-tolerant).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transitlake.functions.expr import finite
from transitlake.schema import koi_catalog_schema, toi_catalog_schema

BAD = "_bad_fields"


def read_catalog_csv(spark: SparkSession, path: str, schema: T.StructType,
                     keep_bad_count: bool = True) -> DataFrame:
    """CSV scan with header and declared types (A1)."""
    raw = spark.read.option("header", True).option("comment", "#").csv(path)
    have = set(raw.columns)
    cols, bad = [], []
    for f in schema.fields:
        if f.name not in have:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        src = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            cols.append(src.alias(f.name))
            continue
        typed = src.try_cast(f.dataType)
        if isinstance(f.dataType, T.DoubleType):
            typed = finite(typed)
            lost = src.isNotNull() & typed.isNull() & ~F.lower(F.trim(src)).isin("nan", "inf", "-inf", "")
        else:
            lost = src.isNotNull() & typed.isNull()
        cols.append(typed.alias(f.name))
        bad.append(lost.cast("int"))
    if keep_bad_count:
        cols.append((sum(bad[1:], bad[0]) if bad else F.lit(0)).alias(BAD))
    return raw.select(*cols)


def read_koi_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_catalog_csv(spark, path, koi_catalog_schema())


def read_toi_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_catalog_csv(spark, path, toi_catalog_schema())


def write_csv(df: DataFrame, path: str, drop=("features", "habitability", "probability_map")) -> None:
    """CSV sink (A9): nested columns removed first; one file per partition
    (no coalesce(1) funnel through a single task)."""
    flat = df.drop(*[c for c in drop if c in df.columns])
    nested = [f.name for f in flat.schema.fields
              if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    flat.drop(*nested).write.mode("overwrite").option("header", True).csv(path)
