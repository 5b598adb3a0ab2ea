"""Cross-survey experiments.

Each experiment is a handful of model fits on filters of one written
training table (every split / sample is written once before the fits,
so MLlib's passes re-read files instead of recomputing the ranking); every evaluation is an aggregate (one row), and the
result table is the union of those rows - nothing is collected to the
driver except MLlib's own model state.
"""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from transitlake.operators import models as MD
from transitlake.operators.metrics import summary_metrics
from transitlake.operators.sampling import (capped_sample, ratio_sample, stratified_split,
                                            survey_mix_split)
from transitlake.schema import MISSION
from transitlake.sources.materialize import materialize

SURVEYS = ("KEPLER", "TESS")


# K5: leaf-wise trees of 31 leaves, at least 20 rows a leaf
K5 = dict(rounds=100, rate=0.1, leaves=31, max_depth=15, min_rows=20)
K5_REFIT = K5 | dict(rounds=150, rate=0.05)
EARLY_STOP_ROWS = 10_000  # more training rows than this: a tenth of them decides when to stop
EARLY_STOP = dict(validation_fraction=0.1, patience=10, tolerance=1e-7)


def _fit(train: DataFrame, feats, label, **fit_kw):
    stop = EARLY_STOP if train.count() > EARLY_STOP_ROWS else {}
    return MD.fit_leafwise(train, feats, label, impute=True, **K5 | stop | fit_kw)


def _fit_all(jobs: list) -> list:
    """Independent fits side by side; each is the same as alone."""
    spark = jobs[0][0].sparkSession
    with ThreadPool(len(jobs)) as pool:
        return pool.map(inheritable_thread_target(spark)(lambda job: _fit(*job[:3], **job[3])), jobs)


def _eval_row(model, test: DataFrame, label: str, **tags) -> DataFrame:
    s = summary_metrics(model.transform(test), label, "prediction", model.classes)
    return s.select(*[F.lit(v).alias(k) for k, v in tags.items()],
                    F.col("n").alias("test_n"), "accuracy", F.col("weighted_f1").alias("f1"))


def survey_transfer(df: DataFrame, feats, label: str, **fit_kw) -> DataFrame:
    """Per-survey baselines (K13) and cross-survey transfer both ways (K15),
    with the transfer gap (E24): within-survey accuracy minus accuracy on
    the other survey."""
    sp = materialize(stratified_split(df.drop("is_train"), target=label, by=[MISSION]), "exp_split")
    rows = []
    trains = [sp.where((F.col(MISSION) == s) & F.col("is_train")) for s in SURVEYS]
    for s, m in zip(SURVEYS, _fit_all([(t, feats, label, fit_kw) for t in trains])):
        other = [o for o in SURVEYS if o != s][0]
        rows.append(_eval_row(m, sp.where((F.col(MISSION) == s) & ~F.col("is_train")), label,
                              experiment=f"{s.lower()}_only", train_survey=s, eval_survey=s))
        rows.append(_eval_row(m, sp.where(F.col(MISSION) == other), label,
                              experiment=f"{s.lower()}_to_{other.lower()}", train_survey=s,
                              eval_survey=other))
    out = reduce(lambda a, b: a.unionByName(b), rows)
    w = Window.partitionBy("train_survey")
    base = F.max(F.when(F.col("eval_survey") == F.col("train_survey"), F.col("accuracy"))).over(w)
    return out.withColumn("transfer_gap",
                          F.when(F.col("eval_survey") != F.col("train_survey"), base - F.col("accuracy")))


def mixed_training(df: DataFrame, feats, label: str, base_survey: str = "KEPLER",
                   **fit_kw) -> DataFrame:
    """Mixed training (K14 with base KEPLER, K17 with base TESS): train on
    80% of the base survey plus a quarter as many rows of the other,
    evaluate on the held-out rows of each survey."""
    sp = materialize(survey_mix_split(df.drop("is_train"), base_survey=base_survey), "exp_mix")
    m = _fit(sp.where("is_train"), feats, label, **fit_kw)
    rows = [_eval_row(m, sp.where((F.col(MISSION) == s) & ~F.col("is_train")), label,
                      experiment=f"mixed_{base_survey.lower()}", eval_survey=s) for s in SURVEYS]
    return reduce(lambda a, b: a.unionByName(b), rows)


def refit_on_balanced(df: DataFrame, feats, label: str, base_survey: str = "TESS",
                      target_survey: str = "KEPLER", cap: int = 500, **fit_kw) -> DataFrame:
    """Option B (K18): a base model on one survey, then a fresh model on a
    balanced (<= cap per class) subset of the other, split 70/30, which is
    also evaluated back on the base survey's held-out rows."""
    base = df.where(F.col(MISSION) == base_survey).drop("is_train")
    bsp = materialize(stratified_split(base, target=label), "exp_base")
    bal = materialize(capped_sample(df.where(F.col(MISSION) == target_survey).drop("is_train"),
                                    [label], cap), "exp_balanced")
    tsp = materialize(stratified_split(bal, target=label, test_size=0.3), "exp_refit")
    m0, m1 = _fit_all([(bsp.where("is_train"), feats, label, fit_kw),
                       (tsp.where("is_train"), feats, label, K5_REFIT | fit_kw)])
    held_out = bsp.where(~F.col("is_train"))
    rows = [_eval_row(m0, held_out, label, experiment="base", eval_survey=base_survey),
            _eval_row(m1, tsp.where(~F.col("is_train")), label, experiment="refit_balanced",
                      eval_survey=target_survey),
            _eval_row(m1, held_out, label, experiment="refit_on_base", eval_survey=base_survey)]
    return reduce(lambda a, b: a.unionByName(b), rows)


def ratio_experiments(df: DataFrame, feats, label: str, ratios=(0.9, 0.8, 0.7, 0.6, 0.5),
                      total: int = 8000, **fit_kw) -> DataFrame:
    """Option C (K19): fixed-size survey mixes; per ratio a stratified 80/20
    split per survey, one model, accuracy / F1 on each survey's held-out
    rows, their mean F1 and gap; ``is_best`` marks the best mean F1 (E25)."""
    rows, splits = [], []
    for r in ratios:
        smp = materialize(ratio_sample(df.drop("is_train"), tess_ratio=r, total=total), "exp_ratio")
        splits.append(materialize(stratified_split(smp, target=label, by=[MISSION]), "exp_ratio_split"))
    models = _fit_all([(sp.where("is_train"), feats, label, fit_kw) for sp in splits])
    for r, sp, m in zip(ratios, splits, models):
        evals = {s: summary_metrics(m.transform(sp.where((F.col(MISSION) == s) & ~F.col("is_train"))),
                                    label, "prediction", m.classes)
                 .select(F.col("accuracy").alias(f"{s.lower()}_accuracy"),
                         F.col("weighted_f1").alias(f"{s.lower()}_f1"))
                 for s in SURVEYS}
        # two one-row aggregates side by side: equi-join on a constant key
        one = F.lit(1).alias("_k")
        row = evals["TESS"].select("*", one).join(evals["KEPLER"].select("*", one), "_k").drop("_k")
        rows.append(row.withColumn("tess_ratio", F.lit(r)))
    out = reduce(lambda a, b: a.unionByName(b), rows)
    out = out.withColumn("avg_f1", (F.col("tess_f1") + F.col("kepler_f1")) / 2) \
             .withColumn("survey_gap", F.abs(F.col("tess_accuracy") - F.col("kepler_accuracy")))
    best = F.max("avg_f1").over(Window.partitionBy())
    return out.withColumn("is_best", F.col("avg_f1") == best)


def results_table(df: DataFrame, feats, label: str, total: int = 8000, **fit_kw) -> DataFrame:
    """All experiments as one table (K20): experiment, eval_survey, test_n
    (NULL for the fixed-size mixes), accuracy, f1."""
    runs = [lambda: survey_transfer(df, feats, label, **fit_kw), lambda: refit_on_balanced(df, feats, label, **fit_kw),
            *[lambda s=s: mixed_training(df, feats, label, base_survey=s, **fit_kw) for s in SURVEYS],
            lambda: ratio_experiments(df, feats, label, total=total, **fit_kw)]
    with ThreadPool(len(runs)) as pool:  # independent of each other
        *plain, mixes = pool.map(inheritable_thread_target(df.sparkSession)(lambda run: run()), runs)
    names = ["experiment", "eval_survey", "test_n", "accuracy", "f1"]
    name = F.concat(F.lit("mix_"), F.round(F.col("tess_ratio") * 100).cast("int").cast("string"))
    sides = [mixes.select(name.alias("experiment"), F.lit(s).alias("eval_survey"), F.lit(None).cast("long").alias("test_n"),
                          F.col(f"{s.lower()}_accuracy").alias("accuracy"), F.col(f"{s.lower()}_f1").alias("f1")) for s in SURVEYS]
    return reduce(lambda a, b: a.unionByName(b), [*[p.select(*names) for p in plain], *sides])
