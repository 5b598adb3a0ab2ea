"""Registered model queries (K1-K7, K9, K11-K20).  Model outputs cannot be
reproduced by SQL, so these get the rows-only check; their sanity
(probabilities sum to 1, accuracy above the majority class) is asserted
in tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from transitlake.functions.expr import round_doubles
from transitlake.functions.features import add_features
from transitlake.operators import experiments as EX
from transitlake.operators import models as MD
from transitlake.operators.clean import drop_leaking
from transitlake.operators.metrics import classification_report, summary_metrics
from transitlake.operators.report import top_k
from transitlake.operators.sampling import stratified_split, survey_first_split
from transitlake.operators.scoring import score
from transitlake.plans.catalog_queries import deduped_table
from transitlake.sources import fixtures as X
from transitlake.sources.materialize import materialize
from transitlake.sources.tables import read_table

LABEL = "merged_koi_disposition"


def model_features(df) -> list[str]:
    """Numeric merged_* and feat_* columns (B14, B25) minus survey-leaking
    ones (B10)."""
    from transitlake.functions.expr import numeric_columns
    return [c for c in numeric_columns(df)
            if (c.startswith("merged_") or c.startswith("feat_")) and c != "label"]


def model_input(spark, sf_dir):
    """Preprocessed, deduplicated, featured training table with the J1
    split flag, written once (K9: persist after preprocessing)."""
    d = drop_leaking(add_features(deduped_table(spark, sf_dir)))
    s = materialize(survey_first_split(d), "model_input")
    return s, model_features(d)


def q_train_forest_candidates(spark, sf_dir):
    s, feats = model_input(spark, sf_dir)
    m = MD.fit_forest(s.where("is_train"), feats, LABEL, **MD.MODEL_PARAMS["random_forest"])
    scored = m.transform(s.where(~F.col("is_train")))
    return round_doubles(classification_report(scored, LABEL, "prediction"))


def q_train_boosted_candidates(spark, sf_dir):
    s, feats = model_input(spark, sf_dir)
    m = MD.fit_leafwise(s.where("is_train"), feats, LABEL, **MD.MODEL_PARAMS["lightgbm"])
    return round_doubles(summary_metrics(m.transform(s.where(~F.col("is_train"))), LABEL, "prediction"))


def q_train_ordered_candidates(spark, sf_dir):
    """K2 at the configured size, with the booster-style features."""
    d = drop_leaking(add_features(deduped_table(spark, sf_dir), catboost=True))
    s = materialize(survey_first_split(d), "ordered_input")
    m = MD.fit_oblivious(s.where("is_train"), model_features(s), LABEL, **MD.MODEL_PARAMS["catboost"])
    return round_doubles(summary_metrics(m.transform(s.where(~F.col("is_train"))), LABEL, "prediction"))


def q_train_mlp_candidates(spark, sf_dir):
    s, feats = model_input(spark, sf_dir)
    m = MD.fit_mlp(s.where("is_train"), feats, LABEL, **MD.MODEL_PARAMS["mlp"])
    return round_doubles(summary_metrics(m.transform(s.where(~F.col("is_train"))), LABEL, "prediction"))


def embeddings_frame(spark, sf_dir):
    """One column per vector entry; the width is the longest vector's
    (shorter ones get NULLs, imputed like any missing feature)."""
    e = read_table(spark, sf_dir, "embeddings")
    dims = e.agg(F.max(F.size("embedding"))).first()[0] or 0
    return e.select(F.col("vec_id").alias("row_id"), F.col("label").cast("string").alias("label"),
                    *[F.get("embedding", F.lit(i)).cast("double").alias(f"e_{i}") for i in range(dims)])


def q_train_mlp_embeddings(spark, sf_dir):
    e = embeddings_frame(spark, sf_dir).where(F.col("label").isNotNull())
    sp = materialize(stratified_split(e, target="label"), "embeddings_split")
    classes = [r.label for r in sp.select("label").distinct().orderBy("label").collect()]
    feats = [c for c in e.columns if c.startswith("e_")]
    m = MD.fit_mlp(sp.where("is_train"), feats, "label", classes=classes, hidden=(64, 32), max_iter=100)
    return round_doubles(summary_metrics(m.transform(sp.where(~F.col("is_train"))), "label",
                                         "prediction", classes))


def q_feature_importance(spark, sf_dir):
    s, feats = model_input(spark, sf_dir)
    m = MD.fit_forest(s.where("is_train"), feats, LABEL, **MD.MODEL_PARAMS["random_forest"])
    return round_doubles(top_k(m.feature_importance(spark), "importance", 20, tie="feature"))


def q_batch_score(spark, sf_dir):
    """Train on the split's training rows, then score the whole unified
    catalog as an inference frame (target dropped, no dedupe)."""
    s, feats = model_input(spark, sf_dir)
    m = MD.fit_forest(s.where("is_train"), feats, LABEL, **MD.MODEL_PARAMS["random_forest"])
    scored = score(m, X.candidates(spark, sf_dir))
    return round_doubles(scored.drop("probability_map"))


def q_survey_transfer(spark, sf_dir):
    s, feats = model_input(spark, sf_dir)
    return round_doubles(EX.survey_transfer(s, feats, LABEL))


def q_best_mix(spark, sf_dir):
    s, feats = model_input(spark, sf_dir)
    return round_doubles(EX.ratio_experiments(s, feats, LABEL, total=8000))


QUERIES = {
    "train_forest_candidates": q_train_forest_candidates,
    "train_boosted_candidates": q_train_boosted_candidates,
    "train_ordered_candidates": q_train_ordered_candidates,
    "train_mlp_candidates": q_train_mlp_candidates,
    "train_mlp_embeddings": q_train_mlp_embeddings,
    "feature_importance": q_feature_importance,
    "batch_score": q_batch_score,
    "survey_transfer": q_survey_transfer,
    "best_mix": q_best_mix,
}

ORACLE: dict = {}
