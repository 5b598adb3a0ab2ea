"""Catalog-shaped inputs derived from the driver's ``events`` table.

The two survey catalogs the engine is built for are not shipped, so the
test fixtures derive them from ``events`` with pure column arithmetic:
every event becomes one candidate object; even event ids form survey A
(KOI names), odd ids survey B (TOI names).  Pairs (2k, 2k+1) share a sky
cell, and one in twenty pairs sits within the match tolerance, which
gives cross-survey twins.  The work grows linearly with ``events``.

``predictions`` is the history-table fixture, also derived from events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transitlake.sources.tables import read_table

_EVENT_TO_CODE = [("click", "PC"), ("error", "FP"), ("purchase", "CP"), ("signup", "KP")]
_CODE_TO_LABEL = [("PC", "CANDIDATE"), ("FP", "FALSE POSITIVE"), ("CP", "CONFIRMED"),
                  ("KP", "CONFIRMED")]


def _case(c: Column, pairs) -> Column:
    out = None
    for k, v in pairs:
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out


def _dbl(x) -> Column:
    return F.lit(x).cast("double")


def candidate_measurements(events: DataFrame) -> DataFrame:
    """One row per event with survey-neutral measurement names."""
    eid = F.col("event_id")
    g = eid - eid % 2
    p = eid % 2
    code = _case(F.col("event_type"), _EVENT_TO_CODE)
    ra = (g * 7919 % 360000).cast("double") / 1000 + p.cast("double") * F.when(
        g % 20 == 0, _dbl(0.0005)).otherwise(_dbl(0.5))
    return events.select(
        eid.alias("obj_id"),
        p.alias("p"),
        code.alias("disp_code"),
        ra.alias("ra"),
        ((g * 104729 % 180000).cast("double") / 1000 - 90).alias("dec"),
        F.when(eid % 97 == 0, F.lit(None).cast("double"))
         .otherwise((g * 31 % 5000).cast("double") / 10).alias("period"),
        F.when(eid % 11 == 0, F.lit(None).cast("double"))
         .otherwise(F.col("value") * 10).alias("depth"),
        F.when(eid % 13 == 0, F.lit(None).cast("double"))
         .otherwise(F.col("value")).alias("depth_err1"),
        F.when(eid % 13 == 0, F.lit(None).cast("double"))
         .otherwise(-F.col("value") / 2).alias("depth_err2"),
        ((eid % 24).cast("double") / 2).alias("duration"),
        F.when(eid % 17 == 0, F.lit(None).cast("double"))
         .otherwise(F.col("value") / 20).alias("prad"),
        ((eid % 7).cast("double") / 2).alias("insol"),
        (eid % 1200).cast("double").alias("teq"),
        (3000 + F.col("user_id") % 5 * 1000 + eid % 600).cast("double").alias("steff"),
        ((35 + eid % 12).cast("double") / 10).alias("slogg"),
        F.when(eid % 50 == 0, _dbl(-1))
         .otherwise((1 + eid % 30).cast("double") / 10).alias("srad"),
    )


def koi_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survey A (Kepler-shaped): even event ids, KOI column names, labels as text."""
    m = candidate_measurements(read_table(spark, sf_dir, "events")).where(F.col("p") == 0)
    return m.select(
        F.col("obj_id").alias("kepid"),
        _case(F.col("disp_code"), _CODE_TO_LABEL).alias("koi_disposition"),
        "ra", "dec",
        F.col("period").alias("koi_period"),
        F.col("depth").alias("koi_depth"),
        F.col("depth_err1").alias("koi_depth_err1"),
        F.col("depth_err2").alias("koi_depth_err2"),
        F.col("duration").alias("koi_duration"),
        F.col("prad").alias("koi_prad"),
        F.col("insol").alias("koi_insol"),
        F.col("teq").alias("koi_teq"),
        F.col("steff").alias("koi_steff"),
        F.col("slogg").alias("koi_slogg"),
        F.col("srad").alias("koi_srad"),
    )


def toi_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survey B (TESS-shaped): odd event ids, TOI column names, raw codes."""
    m = candidate_measurements(read_table(spark, sf_dir, "events")).where(F.col("p") == 1)
    return m.select(
        F.col("obj_id").alias("toi"),
        F.col("disp_code").alias("tfopwg_disp"),
        "ra", "dec",
        F.col("period").alias("pl_orbper"),
        F.col("depth").alias("pl_trandep"),
        F.col("depth_err1").alias("pl_trandeperr1"),
        F.col("depth_err2").alias("pl_trandeperr2"),
        F.col("duration").alias("pl_trandurh"),
        F.col("prad").alias("pl_rade"),
        F.col("insol").alias("pl_insol"),
        F.col("teq").alias("pl_eqt"),
        F.col("steff").alias("st_teff"),
        F.col("slogg").alias("st_logg"),
        F.col("srad").alias("st_rad"),
    )


def unified_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both fixture catalogs unified (B1-B4, D1); row_id is the event id."""
    from transitlake.operators.unify import unify_catalogs
    return unify_catalogs(koi_catalog(spark, sf_dir), toi_catalog(spark, sf_dir),
                          koi_id="kepid", toi_id="toi")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unified table projected to merged_* + mission + row_id."""
    from transitlake.operators.clean import select_merged
    return select_merged(unified_candidates(spark, sf_dir))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History-table fixture: one stored prediction per event.

    confidence is on the 0-100 scale, as the history reports assume.
    """
    ev = read_table(spark, sf_dir, "events")
    eid = F.col("event_id")
    label = _case(_case(F.col("event_type"), _EVENT_TO_CODE), _CODE_TO_LABEL)
    return ev.select(
        eid.cast("string").alias("id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.col("ts").alias("created_at"),
        F.when(eid % 4 == 0, "lightgbm").when(eid % 4 == 1, "catboost")
         .when(eid % 4 == 2, "random_forest").otherwise("mlp").alias("model_name"),
        F.from_json(F.col("props"), "map<string,double>").alias("features"),
        F.coalesce(label, F.lit("CANDIDATE")).alias("prediction"),
        (eid % 101).cast("double").alias("confidence"),
        F.when(F.coalesce(label, F.lit("CANDIDATE")).isin("CONFIRMED", "CANDIDATE"),
               F.col("value") / 5).alias("habitability_score"),
        F.col("ts").alias("saved_at"),
    )
