"""spark-submit entry points: train, score, report (K9, K11, 3.1-3.3).

    spark-submit -m transitlake.plans.jobs train --koi K.csv --toi T.csv \\
        --model random_forest --out /shared/models/rf --store /shared/store
    spark-submit -m transitlake.plans.jobs score --model-path /shared/models/rf \\
        --csv upload.csv --out /shared/scored --store /shared/store --user u1

Each job is one Spark plan per step; the preprocessed training table is
written once to the shared checkpoint folder and every fit reads it.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from transitlake.operators import models as MD
from transitlake.operators.clean import training_frame
from transitlake.operators.match import remove_cross_mission_duplicates
from transitlake.operators.metrics import summary_metrics
from transitlake.operators.model_input import fit_feature_list, model_frame
from transitlake.operators.sampling import survey_first_split
from transitlake.operators.scoring import prepare_upload, score
from transitlake.operators.unify import unify_catalogs
from transitlake.operators.validate import quality_report, validation_summary
from transitlake.schema import TARGET
from transitlake.session import get_spark
from transitlake.sources import store
from transitlake.sources.catalogs import read_koi_csv, read_toi_csv, write_csv
from transitlake.sources.materialize import materialize


def train_job(spark: SparkSession, koi_path: str, toi_path: str, model_name: str, out: str,
              store_root: str | None = None, **params):
    """Read both catalogs -> validate -> preprocess -> dedupe -> features ->
    split -> fit -> evaluate -> save (K9).  Returns (model, metrics df)."""
    unified = unify_catalogs(read_koi_csv(spark, koi_path).drop("_bad_fields"),
                             read_toi_csv(spark, toi_path).drop("_bad_fields"))
    report = validation_summary(quality_report(unified)).first()
    if not report["is_valid"]:
        raise ValueError(f"catalog failed validation: {report.asDict()}")
    prepped = model_frame(remove_cross_mission_duplicates(training_frame(unified)), model_name)
    table = materialize(survey_first_split(prepped), "train_input")
    feats = fit_feature_list(table.where("is_train"), model_name)
    fit = MD.FITTERS[model_name]
    kw = dict(MD.MODEL_PARAMS[model_name])
    kw.update(params)
    model = fit(table.where("is_train"), feats, TARGET, **kw)
    metrics = summary_metrics(model.transform(table.where(~F.col("is_train"))), TARGET, "prediction")
    model.save(out)
    if store_root:
        store.create_tables(spark, store_root)
        store.append_model_metrics(spark, store_root, model_name, metrics,
                                   json.dumps({"features": feats}))
    return model, metrics


def score_job(spark: SparkSession, model_path: str, csv_path: str, out: str,
              store_root: str | None = None, user_id: str | None = None, model_name: str = "model"):
    """Score an uploaded CSV (K11) -> CSV sink (A9) and optional store append (A4)."""
    model = MD.ClassifierModel.load(model_path)
    raw = spark.read.option("header", True).csv(csv_path)
    # written once, so that the row numbers are final; equal rows keep ids of their own
    raw = materialize(raw.withColumn("row_id", F.monotonically_increasing_id()), "upload")
    wanted = [f.replace("merged_", "") for f in model.prep.features if f.startswith("merged_")]
    up = prepare_upload(raw, wanted=wanted)
    up = up.select(*[F.col(c).try_cast("double").alias(c) if c.startswith("merged_") else F.col(c)
                     for c in up.columns])
    scored = materialize(score(model, up), "scored")
    write_csv(scored, out)
    if store_root and user_id:
        store.create_tables(spark, store_root)
        store.append_predictions(spark, store_root, scored, user_id, model_name)
    return scored


def main(argv=None):
    ap = argparse.ArgumentParser(prog="transitlake")
    sub = ap.add_subparsers(dest="cmd", required=True)
    t = sub.add_parser("train")
    t.add_argument("--koi", required=True)
    t.add_argument("--toi", required=True)
    t.add_argument("--model", default="random_forest", choices=sorted(MD.FITTERS))
    t.add_argument("--out", required=True)
    t.add_argument("--store")
    s = sub.add_parser("score")
    s.add_argument("--model-path", required=True)
    s.add_argument("--csv", required=True)
    s.add_argument("--out", required=True)
    s.add_argument("--store")
    s.add_argument("--user")
    a = ap.parse_args(argv)
    spark = get_spark()
    if a.cmd == "train":
        _, m = train_job(spark, a.koi, a.toi, a.model, a.out, a.store)
        m.show(truncate=False)
    else:
        score_job(spark, a.model_path, a.csv, a.out, a.store, a.user)


if __name__ == "__main__":
    main()
