"""Names, fixed lookup values and declared schemas of the catalog model."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES - must equal the reference's for identical results.
# ---------------------------------------------------------------------------

# Survey B (TESS/TOI) column name -> survey A (Kepler/KOI) column name.
# The unified column is "merged_" + the KOI name.  Natural order, 33 pairs.
TOI_TO_KOI = [
    ("tfopwg_disp", "koi_disposition"),
    ("ra", "ra"),
    ("dec", "dec"),
    ("pl_tranmid", "koi_time0"),
    ("pl_tranmiderr1", "koi_time0_err1"),
    ("pl_tranmiderr2", "koi_time0_err2"),
    ("pl_orbper", "koi_period"),
    ("pl_orbpererr1", "koi_period_err1"),
    ("pl_orbpererr2", "koi_period_err2"),
    ("pl_trandurh", "koi_duration"),
    ("pl_trandurherr1", "koi_duration_err1"),
    ("pl_trandurherr2", "koi_duration_err2"),
    ("pl_trandep", "koi_depth"),
    ("pl_trandeperr1", "koi_depth_err1"),
    ("pl_trandeperr2", "koi_depth_err2"),
    ("pl_rade", "koi_prad"),
    ("pl_radeerr1", "koi_prad_err1"),
    ("pl_radeerr2", "koi_prad_err2"),
    ("pl_insol", "koi_insol"),
    ("pl_insolerr1", "koi_insol_err1"),
    ("pl_insolerr2", "koi_insol_err2"),
    ("pl_eqt", "koi_teq"),
    ("pl_eqterr1", "koi_teq_err1"),
    ("pl_eqterr2", "koi_teq_err2"),
    ("st_teff", "koi_steff"),
    ("st_tefferr1", "koi_steff_err1"),
    ("st_tefferr2", "koi_steff_err2"),
    ("st_logg", "koi_slogg"),
    ("st_loggerr1", "koi_slogg_err1"),
    ("st_loggerr2", "koi_slogg_err2"),
    ("st_rad", "koi_srad"),
    ("st_raderr1", "koi_srad_err1"),
    ("st_raderr2", "koi_srad_err2"),
]

# Survey B disposition code -> unified label.  Codes not listed -> NULL.
DISPOSITION_CODES = [
    ("FP", "FALSE POSITIVE"),
    ("FA", "FALSE POSITIVE"),
    ("PC", "CANDIDATE"),
    ("APC", "CANDIDATE"),
    ("CP", "CONFIRMED"),
    ("KP", "CONFIRMED"),
]

# Class labels in label-encoder order (alphabetical) -> index 0, 1, 2.
CLASSES = ["CANDIDATE", "CONFIRMED", "FALSE POSITIVE"]

# Winner rank of a cross-survey twin; labels not listed rank 0.
DISPOSITION_RANK = [("CONFIRMED", 3), ("FALSE POSITIVE", 2), ("CANDIDATE", 1)]

# Measurements whose value <= 0 is physically impossible (set to NULL).
PHYSICAL_PROPERTIES = [
    "merged_koi_prad", "merged_koi_srad", "merged_koi_teq", "merged_koi_steff",
    "merged_koi_period", "merged_koi_duration", "merged_koi_insol",
    "merged_koi_slogg", "merged_koi_time0", "merged_koi_depth",
]

# Columns that identify the survey rather than the object.
LEAKING_COLUMNS = [
    "merged_koi_time0", "merged_koi_time0_err1", "merged_koi_time0_err2",
    "merged_ra", "merged_dec",
]

# Validation: columns a catalog must have, and error columns it should have.
MINIMUM_REQUIRED = [
    "merged_koi_disposition", "merged_ra", "merged_dec", "merged_koi_period",
    "merged_koi_time0", "merged_koi_duration", "merged_koi_depth",
    "merged_koi_prad", "merged_koi_insol", "merged_koi_teq",
    "merged_koi_steff", "merged_koi_slogg", "merged_koi_srad",
]
RECOMMENDED = [
    "merged_koi_time0_err1", "merged_koi_time0_err2",
    "merged_koi_period_err1", "merged_koi_period_err2",
    "merged_koi_duration_err1", "merged_koi_duration_err2",
    "merged_koi_depth_err1", "merged_koi_depth_err2",
    "merged_koi_prad_err1", "merged_koi_prad_err2",
    "merged_koi_insol_err1", "merged_koi_insol_err2",
    "merged_koi_teq_err1", "merged_koi_teq_err2",
    "merged_koi_steff_err1", "merged_koi_steff_err2",
    "merged_koi_slogg_err1", "merged_koi_slogg_err2",
    "merged_koi_srad_err1", "merged_koi_srad_err2",
]

# Measurements with a relative-uncertainty feature.
UNCERTAINTY_BASES = ["prad", "period", "depth", "duration", "teq", "insol",
                     "steff", "slogg", "srad"]

# Features aligned per survey by the quantile-to-normal transform.
QUANTILE_NORMAL_FEATURES = [
    "merged_koi_insol", "merged_koi_prad", "merged_koi_srad",
    "merged_koi_steff", "merged_koi_period", "merged_koi_teq",
]

# ---------------------------------------------------------------------------
# Derived names and declared schemas.
# ---------------------------------------------------------------------------

TARGET = "merged_koi_disposition"
MISSION = "mission"
ROW_ID = "row_id"
MERGED_COLUMNS = [f"merged_{koi}" for _, koi in TOI_TO_KOI]
NUMERIC_MERGED = [c for c in MERGED_COLUMNS if c != TARGET]


def koi_catalog_schema() -> T.StructType:
    """Declared schema of a KOI-shaped CSV (only the columns we read)."""
    fields = [T.StructField("kepid", T.LongType())]
    for _, koi in TOI_TO_KOI:
        dt = T.StringType() if koi == "koi_disposition" else T.DoubleType()
        fields.append(T.StructField(koi, dt))
    return T.StructType(fields)


def toi_catalog_schema() -> T.StructType:
    """Declared schema of a TOI-shaped CSV (only the columns we read)."""
    fields = [T.StructField("toi", T.DoubleType())]
    for toi, _ in TOI_TO_KOI:
        dt = T.StringType() if toi == "tfopwg_disp" else T.DoubleType()
        fields.append(T.StructField(toi, dt))
    return T.StructType(fields)


PREDICTIONS_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("features", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("prediction", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("habitability_score", T.DoubleType()),
    T.StructField("saved_at", T.TimestampType()),
])

MODEL_METRICS_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("precision", T.DoubleType()),
    T.StructField("recall", T.DoubleType()),
    T.StructField("f1_score", T.DoubleType()),
    T.StructField("training_date", T.TimestampType()),
    T.StructField("metadata", T.StringType()),
])
