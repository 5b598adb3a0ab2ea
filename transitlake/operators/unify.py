"""Unify two survey catalogs under one schema.

Each side gets ``merged_<koi name>`` copies of whichever mapped columns it
has, a survey tag and a raw copy of its disposition; the two sides are
then unioned by name.  Pure projections plus one ``unionByName``: no
shuffle, and Catalyst prunes every raw column a later step does not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitlake.schema import DISPOSITION_CODES, MISSION, ROW_ID, TARGET, TOI_TO_KOI


def disposition_label(code: Column) -> Column:
    """Survey-B code -> unified label; unlisted codes -> NULL (B2)."""
    out = None
    for k, v in DISPOSITION_CODES:
        out = F.when(code == k, v) if out is None else out.when(code == k, v)
    return out


def _row_id(df: DataFrame, id_col: str | None, survey: str) -> Column:
    if id_col is None:
        # No natural key: a content hash; identical rows are told apart by
        # with_occurrence_ids() when the caller needs that.
        return F.xxhash64(F.lit(survey), *[F.col(c) for c in df.columns])
    dt = df.schema[id_col].dataType.simpleString()
    if dt in ("bigint", "int"):
        return F.col(id_col).cast("long")
    return F.xxhash64(F.lit(survey), F.col(id_col))


def koi_side(koi: DataFrame, koi_id: str | None = None) -> DataFrame:
    have = set(koi.columns)
    extra = []
    if "koi_disposition" in have:
        extra.append(F.col("koi_disposition").alias("koi_raw_disposition"))
    extra.append(F.lit("KEPLER").alias(MISSION))
    for _, k in TOI_TO_KOI:
        if k in have:
            extra.append(F.col(k).alias(f"merged_{k}"))
    extra.append(_row_id(koi, koi_id, "KEPLER").alias(ROW_ID))
    return koi.select("*", *extra)


def toi_side(toi: DataFrame, toi_id: str | None = None) -> DataFrame:
    have = set(toi.columns)
    extra = []
    if "tfopwg_disp" in have:
        extra.append(F.col("tfopwg_disp").alias("tess_raw_disposition"))
    extra.append(F.lit("TESS").alias(MISSION))
    for t, k in TOI_TO_KOI:
        if t not in have:
            continue
        if k == "koi_disposition":
            extra.append(disposition_label(F.col(t)).alias(TARGET))
        else:
            extra.append(F.col(t).alias(f"merged_{k}"))
    extra.append(_row_id(toi, toi_id, "TESS").alias(ROW_ID))
    return toi.select("*", *extra)


def unify_catalogs(koi: DataFrame, toi: DataFrame, koi_id: str | None = None,
                   toi_id: str | None = None) -> DataFrame:
    """Union by name of both surveys with unified ``merged_*`` columns.

    Integer natural keys of the two surveys must not collide; otherwise
    pass no id and a content hash (salted by survey) is used.
    """
    return koi_side(koi, koi_id).unionByName(toi_side(toi, toi_id),
                                             allowMissingColumns=True)


def merge_report(unified: DataFrame, koi_cols: int, toi_cols: int) -> DataFrame:
    """Merge statistics (E1): rows per survey plus column counts, one job.

    Column counts are plan-time facts passed in; rows come from one
    aggregate over the unified table.
    """
    merged = [c for c in unified.columns if c.startswith("merged_")]
    return unified.agg(
        F.count(F.when(F.col(MISSION) == "KEPLER", 1)).alias("kepler_rows"),
        F.count(F.when(F.col(MISSION) == "TESS", 1)).alias("tess_rows"),
        F.count(F.lit(1)).alias("merged_rows"),
    ).select(
        "kepler_rows", "tess_rows", "merged_rows",
        F.lit(koi_cols).alias("kepler_cols"),
        F.lit(toi_cols).alias("tess_cols"),
        F.lit(len(unified.columns)).alias("merged_cols"),
        F.lit(len(merged)).alias("unified_columns_created"),
    )


def unify_by_mapping(a: DataFrame, b: DataFrame, mapping: list[tuple[str, str, str]],
                     tag_a: str, tag_b: str, tag_col: str = "source") -> DataFrame:
    """General two-source union (B1, D1) for any pair of tables with
    parallel columns: ``mapping`` holds (name in a, name in b, unified
    name).  Only mapped columns are projected, so the scans read nothing
    else; numeric types widen in the union (int + double -> double)."""
    left = a.select(*[F.col(x).alias(u) for x, _, u in mapping], F.lit(tag_a).alias(tag_col))
    right = b.select(*[F.col(y).alias(u) for _, y, u in mapping], F.lit(tag_b).alias(tag_col))
    return left.unionByName(right, allowMissingColumns=True)
