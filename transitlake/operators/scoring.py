"""Batch scoring of uploaded catalogs.

One lazy plan from the input scan to the write: map columns -> prefix ->
survey tag -> clean -> features -> align -> predict -> probabilities,
confidence, features map, habitability.  Scoring never deduplicates
(quirk Q13) and every output row keeps its input ``row_id``.

A forest costs a row many times what reading it costs, and a scan makes few
tasks of a small file or of large row groups: a batch is dealt evenly first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitlake.functions.features import add_features, catboost_features
from transitlake.functions.habitability import add_habitability
from transitlake.operators.clean import (apply_column_mapping, auto_map_columns, inference_frame,
                                         prefix_merged)
from transitlake.operators.models import ClassifierModel
from transitlake.schema import MISSION, ROW_ID

ORIGINAL = "Original_"


def features_map(cols: list[str]):
    """Row -> JSON object of the model's inputs; NaN / inf / NULL -> null,
    numbers as doubles (S7)."""
    vals = [F.when(F.abs(F.col(c).cast("double")) < F.lit(float("inf")), F.col(c).cast("double"))
            for c in cols]
    m = F.map_from_arrays(F.array(*[F.lit(c) for c in cols]), F.array(*vals))
    return F.to_json(m, {"ignoreNullFields": "false"})


def prepare_upload(df: DataFrame, wanted: list[str] | None = None,
                   mapping: dict | None = None, row_id: str = ROW_ID, originals: int = 5) -> DataFrame:
    """Map an uploaded frame onto the unified names (B16, B17, B18) and tag
    it with the UNKNOWN survey (B4).  ``row_id`` is carried through, and the
    upload's own first ``originals`` columns as ``Original_*`` (B27)."""
    given = [c for c in df.columns if c not in (row_id, MISSION)]
    own = [F.col(f"`{c}`").alias(f"{ORIGINAL}{c}") for c in given[:originals]]
    if mapping is None and wanted is not None:
        mapping = auto_map_columns(given, wanted)
    if mapping is not None:
        keep = [F.col(c) for c in (row_id, MISSION) if c in df.columns]
        out = df.select(*keep, *own, *[F.col(f"`{src}`").alias(dst) for dst, src in mapping.items() if src])
    else:
        out = df.select("*", *own)
    out = prefix_merged(out, keep=(MISSION, row_id, *[f"{ORIGINAL}{c}" for c in given]))
    if MISSION not in out.columns:
        out = out.withColumn(MISSION, F.lit("UNKNOWN"))
    return out


def score(model: ClassifierModel, unified: DataFrame, originals: int = 5) -> DataFrame:
    """Predictions for every input row (K11): one projection of the input, so
    as many rows come out as go in whatever their ids, and it runs on streams.
    Features that the input lacks are NULL (B15)."""
    if not unified.isStreaming:
        unified = unified.hint("rebalance")
    own = [c for c in unified.columns if c.startswith(ORIGINAL)]
    if not own and originals:
        first = [c for c in unified.columns if c not in (ROW_ID, MISSION)][:originals]
        unified = unified.withColumns({f"{ORIGINAL}{c}": F.col(c) for c in first})
        own = [f"{ORIGINAL}{c}" for c in first]
    # the preprocessing selects merged columns; the originals ride along as one
    if own:
        unified = unified.withColumn("merged__originals", F.struct(*own))
    x = add_features(inference_frame(unified))
    own_family = catboost_features(set(x.columns))  # only where the model was fitted with them
    x = x.withColumns({f: own_family[f] for f in model.prep.features if f in own_family})
    missing = [f for f in model.prep.features if f not in x.columns]
    x = x.withColumns({f: F.lit(None).cast("double") for f in missing})
    scored = add_habitability(model.transform(x), prediction_col="prediction")
    return scored.select(ROW_ID, MISSION, "prediction", "confidence", "probability_map",
                         features_map(model.prep.features).alias("features"),
                         "habitability_score", "habitability_tier",
                         *[F.col("merged__originals")[c].alias(c) for c in own])


def write_predictions_csv(scored: DataFrame, path: str) -> None:
    """CSV sink without nested columns (A9); one file per partition."""
    flat = scored.drop("probability_map")
    flat.write.mode("overwrite").option("header", True).csv(path)
