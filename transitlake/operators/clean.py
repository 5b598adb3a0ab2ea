"""Projection, filters and cleaning of the unified table.

Row-level steps are column expressions (no shuffle).  Column-level
decisions that depend on data (drop sparse columns) are *fitted*: one
aggregate pass computes every column's null share at once and returns
a tiny plan-time list.  D3 is the only shuffle here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transitlake.functions.expr import double_columns, finite, numeric_columns, pos
from transitlake.schema import (CLASSES, LEAKING_COLUMNS, MISSION, PHYSICAL_PROPERTIES,
                                ROW_ID, TARGET)


def select_merged(df: DataFrame, keep=(MISSION, ROW_ID)) -> DataFrame:
    """Keep ``merged*`` columns plus mission and row id."""
    cols = [c for c in df.columns if c.startswith("merged")]
    cols += [c for c in keep if c in df.columns]
    return df.select(*cols)


def drop_missing_target(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Training rows need a label."""
    return df.where(F.col(target).isNotNull())


def label_index(target: str = TARGET) -> Column:
    """Alphabetical label code (I5): CANDIDATE 0, CONFIRMED 1, FALSE POSITIVE 2."""
    c = F.col(target)
    out = None
    for i, name in enumerate(CLASSES):
        out = F.when(c == name, float(i)) if out is None else out.when(c == name, float(i))
    return out


def label_name(index: Column) -> Column:
    """Inverse of label_index."""
    out = None
    for i, name in enumerate(CLASSES):
        out = F.when(index == float(i), name) if out is None else out.when(index == float(i), name)
    return out


def null_impossible(df: DataFrame, props=PHYSICAL_PROPERTIES) -> DataFrame:
    """Value <= 0 -> NULL for the ten physical measurements (B8); the same
    expression also nulls NaN / inf (B9) so the column is read twice, not
    six times, when Catalyst inlines it."""
    have = [p for p in props if p in df.columns]
    return df.withColumns({p: pos(F.col(p)) for p in have})


def null_non_finite(df: DataFrame, skip=()) -> DataFrame:
    """NaN and +/-inf -> NULL on every floating column (B9, trap T1)."""
    return df.withColumns({c: finite(F.col(c)) for c in double_columns(df) if c not in skip})


def drop_leaking(df: DataFrame, cols=LEAKING_COLUMNS) -> DataFrame:
    """Drop survey-identifying columns (B10); absent names are ignored."""
    return df.drop(*[c for c in cols if c in df.columns])


def drop_error_columns(df: DataFrame) -> DataFrame:
    """Drop every column whose lower-cased name contains ``_err``."""
    return df.drop(*[c for c in df.columns if "_err" in c.lower()])


def null_share(df: DataFrame, cols=None) -> DataFrame:
    """Share of NULLs per column, long form (E11), in one aggregate pass."""
    cols = list(cols or df.columns)
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    return row.selectExpr(f"stack({len(cols)}, {stack}) as (column_name, null_share)")


def fit_sparse_columns(df: DataFrame, threshold: float = 0.90, cols=None,
                       exempt=(TARGET, "label", MISSION, ROW_ID)) -> list[str]:
    """Columns whose null share is strictly greater than ``threshold``
    (B11 at 0.90, B12 at 0.5).  Fitted on training data; the result is a
    plan-time list of names (one aggregate row crosses to the driver)."""
    cols = [c for c in (cols or df.columns) if c not in exempt]
    if not cols:
        return []
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols]).first()
    return [c for c in cols if row[c] is not None and row[c] > threshold]


def drop_columns(df: DataFrame, cols) -> DataFrame:
    return df.drop(*[c for c in cols if c in df.columns])


def numeric_feature_columns(df: DataFrame, exclude=(ROW_ID, "label")) -> list[str]:
    """Numeric columns by type."""
    return [c for c in numeric_columns(df) if c not in exclude]


def align_features(df: DataFrame, names: list[str], keep=(ROW_ID, MISSION)) -> DataFrame:
    """Reorder to the training feature list; missing -> NULL, extras dropped."""
    have = set(df.columns)
    cols = [F.col(c) for c in keep if c in have]
    cols += [F.col(n).cast("double").alias(n) if n in have
             else F.lit(None).cast("double").alias(n) for n in names]
    return df.select(*cols)


def available_features(df: DataFrame, target: str = TARGET) -> list[str]:
    """``merged_*`` columns except the target and raw copies."""
    return [c for c in df.columns
            if c.startswith("merged_") and c != target and "raw" not in c]


def auto_map_columns(input_cols: list[str], wanted: list[str]) -> dict[str, str | None]:
    """Suggest an input column for each wanted attribute (B16): the
    lower-cased exact match first, else the first input column where one
    name contains the other.  Plan-time only."""
    lowered = [(c, c.lower()) for c in input_cols]
    out: dict[str, str | None] = {}
    for w in wanted:
        wl = w.lower()
        hit = next((c for c, cl in lowered if cl == wl), None)
        if hit is None:
            hit = next((c for c, cl in lowered if wl in cl or cl in wl), None)
        out[w] = hit
    return out


def apply_column_mapping(df: DataFrame, mapping: dict[str, str | None]) -> DataFrame:
    """Select + rename mapped columns; unmapped attributes are skipped."""
    return df.select(*[F.col(src).alias(dst) for dst, src in mapping.items() if src])


def prefix_merged(df: DataFrame, keep=(MISSION, ROW_ID)) -> DataFrame:
    """Rename every column to ``merged_<name>`` except mission / row id."""
    return df.withColumnsRenamed({c: f"merged_{c}" for c in df.columns
                                  if c not in keep and not c.startswith("merged_")})


def where_equals(df: DataFrame, filters: dict[str, object]) -> DataFrame:
    """Optional equality filters; the value 'All' (or None) means no filter."""
    conds = [F.col(c) == v for c, v in filters.items() if v is not None and v != "All"]
    return df.where(reduce(lambda a, b: a & b, conds)) if conds else df


def min_present_filter(df: DataFrame, features: list[str], share: float = 0.5) -> DataFrame:
    """Keep rows with at least ``share`` of the features non-NULL."""
    if not features:
        return df
    present = reduce(lambda a, b: a + b,
                     [F.col(c).isNotNull().cast("int") for c in features])
    return df.where(present >= F.lit(share * len(features)))


def drop_null_positions(df: DataFrame, cols=("merged_ra", "merged_dec", "merged_koi_period")) -> DataFrame:
    """Rows without position or period cannot be matched."""
    return df.dropna(subset=[c for c in cols if c in df.columns])


def exact_dedupe(df: DataFrame, id_col: str = ROW_ID) -> DataFrame:
    """Drop exact duplicate rows over all columns but the id; NULL equals
    NULL; the survivor is the smallest id, so the result does not depend
    on partitioning (D3).  One shuffle on the full row as key, with a
    map-side partial aggregate."""
    keys = [c for c in df.columns if c != id_col]
    if id_col not in df.columns:
        return df.dropDuplicates(keys)
    return df.groupBy(*keys).agg(F.min(id_col).alias(id_col)).select(*df.columns)


def training_frame(unified: DataFrame) -> DataFrame:
    """Common preprocessing before features."""
    df = select_merged(unified)
    df = drop_missing_target(df)
    df = null_non_finite(null_impossible(df), skip=PHYSICAL_PROPERTIES)
    df = exact_dedupe(df)
    return df.withColumn("label", label_index())


def inference_frame(unified: DataFrame) -> DataFrame:
    """Inference preprocessing: no target, no dedupe (quirks Q2 / Q13)."""
    df = select_merged(unified)
    df = df.drop(TARGET)
    return null_non_finite(null_impossible(df), skip=PHYSICAL_PROPERTIES)


def is_string(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.StringType)
