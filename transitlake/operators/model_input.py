"""The table a named model trains on and scores (K9: B11-B13, B10, H1-H33).

Feature families depend on the model (the ordered booster also gets the
CatBoost-style features, every model the uncertainty features); which columns
are dropped for being mostly NULL is fitted on the training rows only and is
kept in the model's feature list, so scoring needs no refit: it derives the
same families and aligns to that list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from transitlake.functions.expr import numeric_columns
from transitlake.functions.features import add_features
from transitlake.operators.clean import drop_error_columns, drop_leaking, fit_sparse_columns
from transitlake.schema import TARGET

# model name -> (feature families, drop error columns, null share beyond which a column goes)
PREPARATION = {
    "lightgbm": (dict(), False, 0.90),
    "catboost": (dict(catboost=True), False, 0.90),
    "random_forest": (dict(), True, 0.50),
    "mlp": (dict(), False, 0.90),
}


def model_frame(df: DataFrame, model_name: str) -> DataFrame:
    """``df`` with the model's feature families and without leaking and, for
    the forest, error columns."""
    families, no_errors, _ = PREPARATION[model_name]
    out = drop_leaking(add_features(df, **families))
    return drop_error_columns(out) if no_errors else out


def fit_feature_list(train: DataFrame, model_name: str) -> list[str]:
    """Numeric ``merged_*`` / ``feat_*`` / family columns that are not too
    sparse among the training rows, in column order."""
    families, _, share = PREPARATION[model_name]
    extra = set()
    if families:
        extra = set(add_features(train.select(*[c for c in train.columns if c.startswith("merged_")]), **families).columns)
    names = [c for c in numeric_columns(train)
             if (c.startswith(("merged_", "feat_")) or c in extra) and c not in (TARGET, "label")]
    sparse = set(fit_sparse_columns(train, share, names))
    return [c for c in names if c not in sparse]
