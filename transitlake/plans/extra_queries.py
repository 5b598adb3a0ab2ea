"""Registered queries for the remaining projection / union / report
operators (B11, B16-B18, D1 on driver tables, G5) and the remaining
experiments (K17, K18)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from transitlake.functions.expr import round_doubles
from transitlake.operators import experiments as EX
from transitlake.operators.clean import fit_sparse_columns, null_share
from transitlake.operators.history import history_dates
from transitlake.operators.scoring import prepare_upload
from transitlake.operators.unify import unify_by_mapping
from transitlake.plans import oracle_sql as O
from transitlake.plans.model_queries import LABEL, model_input
from transitlake.plans.report_queries import PREDICTIONS
from transitlake.schema import TOI_TO_KOI
from transitlake.session import scratch_path
from transitlake.sources import fixtures as X
from transitlake.sources.tables import read_table

SPARSE_COLS = ["merged_koi_period", "merged_koi_depth", "merged_koi_depth_err1", "merged_koi_prad",
               "merged_koi_srad", "merged_koi_disposition"]


def q_sparse_columns(spark, sf_dir):
    """Per column the null share and whether the fitted drop
    list (share > threshold) contains it, at the 0.90 and 0.05 cuts."""
    c = X.candidates(spark, sf_dir)
    cols = [x for x in SPARSE_COLS if x != "merged_koi_disposition"]
    drop90 = set(fit_sparse_columns(c, 0.90, cols))
    drop05 = set(fit_sparse_columns(c, 0.05, cols))
    ns = null_share(c, cols)
    return round_doubles(ns.select(
        "column_name", "null_share",
        F.col("column_name").isin(*drop90 or [""]).alias("dropped_at_90"),
        F.col("column_name").isin(*drop05 or [""]).alias("dropped_at_05")))


SQL_SPARSE_COLUMNS = O.with_(O.CANDIDATES, "\nUNION ALL\n".join(f"""
SELECT '{c}' AS column_name, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_share,
  avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) > 0.9 AS dropped_at_90,
  avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) > 0.05 AS dropped_at_05
FROM candidates""" for c in SPARSE_COLS if c != "merged_koi_disposition"))


def q_history_dates(spark, sf_dir):
    return history_dates(X.predictions(spark, sf_dir))


SQL_HISTORY_DATES = O.with_(PREDICTIONS, """
SELECT DISTINCT CAST(created_at AS DATE) AS date FROM predictions ORDER BY 1 DESC""")

WANTED = ["koi_period", "koi_depth", "koi_duration", "koi_prad", "koi_insol", "koi_teq",
          "koi_steff", "koi_slogg", "koi_srad", "koi_time0"]


def q_upload_mapping(spark, sf_dir):
    """Both catalogs uploaded and mapped onto the unified names: the KOI-named
    one by auto column mapping (B16: exact, else substring; koi_time0 has no
    match and is skipped), the TOI-named one by the name pairs a user would
    choose (B17); merged_ prefix (B18), UNKNOWN survey tag (B4), and each
    upload's own first five columns as Original_* (B27)."""
    koi = prepare_upload(X.koi_catalog(spark, sf_dir).withColumnRenamed("kepid", "row_id"), wanted=WANTED)
    toi = X.toi_catalog(spark, sf_dir).withColumnRenamed("toi", "row_id")
    chosen = {k: t for t, k in TOI_TO_KOI if k in WANTED and t in toi.columns}
    return round_doubles(koi.unionByName(prepare_upload(toi, mapping=chosen), allowMissingColumns=True))


SQL_UPLOAD_MAPPING = O.with_(O.CANDIDATES, """
SELECT row_id, round(merged_koi_period, 6) AS merged_koi_period,
  round(merged_koi_depth, 6) AS merged_koi_depth, round(merged_koi_duration, 6) AS merged_koi_duration,
  round(merged_koi_prad, 6) AS merged_koi_prad, round(merged_koi_insol, 6) AS merged_koi_insol,
  round(merged_koi_teq, 6) AS merged_koi_teq, round(merged_koi_steff, 6) AS merged_koi_steff,
  round(merged_koi_slogg, 6) AS merged_koi_slogg, round(merged_koi_srad, 6) AS merged_koi_srad,
  'UNKNOWN' AS mission, round(merged_ra, 6) AS "Original_ra", round(merged_dec, 6) AS "Original_dec",
  CASE WHEN mission = 'KEPLER' THEN merged_koi_disposition END AS "Original_koi_disposition",
  CASE WHEN mission = 'KEPLER' THEN round(merged_koi_period, 6) END AS "Original_koi_period",
  CASE WHEN mission = 'KEPLER' THEN round(merged_koi_depth, 6) END AS "Original_koi_depth",
  CASE WHEN mission = 'TESS' THEN disp_code END AS "Original_tfopwg_disp",
  CASE WHEN mission = 'TESS' THEN round(merged_koi_period, 6) END AS "Original_pl_orbper",
  CASE WHEN mission = 'TESS' THEN round(merged_koi_depth, 6) END AS "Original_pl_trandep"
FROM candidates""")

PARTY_MAP = [("c_custkey", "s_suppkey", "party_key"), ("c_name", "s_name", "party_name"),
             ("c_nationkey", "s_nationkey", "nation_key"), ("c_acctbal", "s_acctbal", "acct_balance")]


def q_party_union(spark, sf_dir):
    """Two parallel-named driver tables unified and summarized per source
    and nation: the union operator on real tables (D1, E2)."""
    u = unify_by_mapping(read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "supplier"),
                         PARTY_MAP, "customer", "supplier")
    return round_doubles(u.groupBy("source", "nation_key").agg(
        F.count(F.lit(1)).alias("n_parties"), F.sum("acct_balance").alias("total_balance"),
        F.count(F.when(F.col("acct_balance") < 0, 1)).alias("n_negative")))


SQL_PARTY_UNION = """
SELECT source, nation_key, count(*) AS n_parties, round(sum(acct_balance), 6) AS total_balance,
  count(*) FILTER (WHERE acct_balance < 0) AS n_negative
FROM (SELECT 'customer' AS source, c_nationkey AS nation_key, c_acctbal AS acct_balance FROM customer
      UNION ALL
      SELECT 'supplier', s_nationkey, s_acctbal FROM supplier) u
GROUP BY 1, 2"""


def q_mixed_training_tess(spark, sf_dir):
    s, feats = model_input(spark, sf_dir)
    return round_doubles(EX.mixed_training(s, feats, LABEL, base_survey="TESS"))


def q_mixed_training_kepler(spark, sf_dir):
    s, feats = model_input(spark, sf_dir)
    return round_doubles(EX.mixed_training(s, feats, LABEL, base_survey="KEPLER"))


def q_refit_balanced(spark, sf_dir):
    s, feats = model_input(spark, sf_dir)
    return round_doubles(EX.refit_on_balanced(s, feats, LABEL))


def q_experiment_results(spark, sf_dir):
    """Every experiment's rows, written as CSV and read back."""
    s, feats = model_input(spark, sf_dir)
    table = EX.results_table(s, feats, LABEL)
    path = scratch_path(spark, f"experiments-{uuid.uuid4().hex}")
    table.write.option("header", True).csv(path)
    return round_doubles(spark.read.option("header", True).schema(table.schema).csv(path))


QUERIES = {
    "sparse_columns": q_sparse_columns,
    "history_dates": q_history_dates,
    "upload_mapping": q_upload_mapping,
    "party_union": q_party_union,
    "mixed_training_tess": q_mixed_training_tess,
    "mixed_training_kepler": q_mixed_training_kepler,
    "refit_balanced": q_refit_balanced,
    "experiment_results": q_experiment_results,
}

ORACLE = {
    "sparse_columns": SQL_SPARSE_COLUMNS,
    "history_dates": SQL_HISTORY_DATES,
    "upload_mapping": SQL_UPLOAD_MAPPING,
    "party_union": SQL_PARTY_UNION,
}
