"""Registered report queries: prediction history (A3, B21, E2-E7, E12,
E16, G1, S1) and dataset reports on the candidate catalog (E8-E11, E26)."""

from __future__ import annotations

from pyspark.sql import functions as F

from transitlake.functions.expr import round_doubles
from transitlake.operators import report as R
from transitlake.operators.clean import null_share
from transitlake.operators.history import user_history
from transitlake.plans import oracle_sql as O
from transitlake.plans.catalog_queries import training
from transitlake.sources import fixtures as X

PREDICTIONS = """
predictions AS (
  SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS user_id, ts AS created_at,
    CASE event_id % 4 WHEN 0 THEN 'lightgbm' WHEN 1 THEN 'catboost'
                      WHEN 2 THEN 'random_forest' ELSE 'mlp' END AS model_name,
    pred AS prediction,
    CAST(event_id % 101 AS DOUBLE) AS confidence,
    CASE WHEN pred IN ('CONFIRMED', 'CANDIDATE') THEN value / 5 END AS habitability_score
  FROM (SELECT *, coalesce(CASE event_type WHEN 'click' THEN 'CANDIDATE' WHEN 'error' THEN 'FALSE POSITIVE'
                           WHEN 'purchase' THEN 'CONFIRMED' WHEN 'signup' THEN 'CONFIRMED' END,
                           'CANDIDATE') AS pred FROM events) e
)"""


def q_prediction_shares(spark, sf_dir):
    return R.value_counts(X.predictions(spark, sf_dir), "prediction")


SQL_PREDICTION_SHARES = O.with_(PREDICTIONS, """
SELECT prediction, count(*) AS count,
  round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS share_pct
FROM predictions GROUP BY prediction""")


def q_daily_counts(spark, sf_dir):
    return R.counts_by_day(X.predictions(spark, sf_dir))


SQL_DAILY_COUNTS = O.with_(PREDICTIONS, """
SELECT CAST(created_at AS DATE) AS date, prediction, count(*) AS count
FROM predictions GROUP BY 1, 2""")


def q_daily_summary(spark, sf_dir):
    return round_doubles(R.daily_summary(X.predictions(spark, sf_dir)))


SQL_DAILY_SUMMARY = O.with_(PREDICTIONS, """
SELECT CAST(created_at AS DATE) AS date, count(*) AS total,
  count(*) FILTER (WHERE prediction = 'CANDIDATE') AS n_candidate,
  count(*) FILTER (WHERE prediction = 'CONFIRMED') AS n_confirmed,
  count(*) FILTER (WHERE prediction = 'FALSE POSITIVE') AS n_false_positive,
  round(avg(confidence), 6) AS mean_confidence
FROM predictions GROUP BY 1 ORDER BY 1 DESC""")


def q_headline_counts(spark, sf_dir):
    return R.headline_counts(X.predictions(spark, sf_dir))


SQL_HEADLINE_COUNTS = O.with_(PREDICTIONS, """
SELECT count(*) AS total,
  count(*) FILTER (WHERE prediction = 'CANDIDATE') AS n_candidate,
  count(*) FILTER (WHERE prediction = 'CONFIRMED') AS n_confirmed,
  count(*) FILTER (WHERE prediction = 'FALSE POSITIVE') AS n_false_positive
FROM predictions""")


def q_confidence_stats(spark, sf_dir):
    return round_doubles(R.confidence_stats(X.predictions(spark, sf_dir), scale=100.0))


SQL_CONFIDENCE_STATS = O.with_(PREDICTIONS, """
SELECT round(avg(confidence), 6) AS mean_confidence,
  round(median(confidence), 6) AS median_confidence,
  count(*) FILTER (WHERE confidence >= 80) AS n_high_confidence,
  count(*) FILTER (WHERE confidence < 50) AS n_low_confidence
FROM predictions""")


def q_confidence_by_model(spark, sf_dir):
    p = X.predictions(spark, sf_dir)
    agg = p.groupBy("model_name").agg(
        F.avg("confidence").alias("mean_confidence"),
        F.count(F.when(F.col("confidence") >= 80, 1)).alias("n_high_confidence"),
        F.count(F.when(F.col("confidence") < 50, 1)).alias("n_low_confidence"))
    return round_doubles(R.attach_percentiles(agg, p, ["model_name"],
                                              {"median_confidence": ("confidence", 0.5)}))


SQL_CONFIDENCE_BY_MODEL = O.with_(PREDICTIONS, """
SELECT model_name, round(avg(confidence), 6) AS mean_confidence,
  round(median(confidence), 6) AS median_confidence,
  count(*) FILTER (WHERE confidence >= 80) AS n_high_confidence,
  count(*) FILTER (WHERE confidence < 50) AS n_low_confidence
FROM predictions GROUP BY model_name""")


def q_confidence_histogram(spark, sf_dir):
    return round_doubles(R.histogram(X.predictions(spark, sf_dir), "confidence", max_bins=20))


# confidence spans 0..100 -> 100/20 = 5 on the 1-2-5 ladder
SQL_CONFIDENCE_HISTOGRAM = O.with_(PREDICTIONS, """
SELECT CAST(floor(confidence / 5.0) * 5.0 AS DOUBLE) AS bin_start, count(*) AS count,
  CAST(floor(confidence / 5.0) * 5.0 AS DOUBLE) + 5.0 AS bin_end
FROM predictions WHERE confidence IS NOT NULL GROUP BY 1""")


def q_habitability_histogram(spark, sf_dir):
    return round_doubles(R.histogram(X.predictions(spark, sf_dir), "habitability_score", step=10.0))


SQL_HABITABILITY_HISTOGRAM = O.with_(PREDICTIONS, """
SELECT CAST(floor(habitability_score / 10.0) * 10.0 AS DOUBLE) AS bin_start, count(*) AS count,
  CAST(floor(habitability_score / 10.0) * 10.0 AS DOUBLE) + 10.0 AS bin_end
FROM predictions WHERE habitability_score IS NOT NULL GROUP BY 1""")


def q_model_names(spark, sf_dir):
    return R.distinct_sorted(X.predictions(spark, sf_dir), "model_name")


SQL_MODEL_NAMES = O.with_(PREDICTIONS, "SELECT DISTINCT model_name FROM predictions ORDER BY 1")


def q_confirmed_history(spark, sf_dir):
    h = user_history(X.predictions(spark, sf_dir), prediction="CONFIRMED", model_name="All")
    return h.select("user_id", "id", "created_at", "model_name", "prediction",
                    F.date_format("created_at", "yyyy-MM-dd").alias("day"),
                    F.date_format("created_at", "HH:mm:ss").alias("time_of_day"),
                    "confidence")


SQL_CONFIRMED_HISTORY = O.with_(PREDICTIONS, """
SELECT user_id, id, created_at, model_name, prediction,
  strftime(created_at, '%Y-%m-%d') AS day, strftime(created_at, '%H:%M:%S') AS time_of_day,
  confidence
FROM predictions WHERE prediction = 'CONFIRMED'
ORDER BY user_id, created_at DESC, id DESC""")


# --- dataset reports on the candidate catalog ------------------------------

def q_quantile_ranges(spark, sf_dir):
    t = training(spark, sf_dir)
    return round_doubles(R.quantile_ranges(
        t, ["merged_koi_prad", "merged_koi_srad", "merged_koi_teq", "merged_koi_steff"]))


SQL_QUANTILE_RANGES = O.with_(O.TRAINING, """
SELECT 'merged_koi_prad' AS feature, round(quantile_cont(merged_koi_prad, 0.05), 6) AS q_low,
       round(quantile_cont(merged_koi_prad, 0.95), 6) AS q_high FROM training
UNION ALL SELECT 'merged_koi_srad', round(quantile_cont(merged_koi_srad, 0.05), 6),
       round(quantile_cont(merged_koi_srad, 0.95), 6) FROM training
UNION ALL SELECT 'merged_koi_teq', round(quantile_cont(merged_koi_teq, 0.05), 6),
       round(quantile_cont(merged_koi_teq, 0.95), 6) FROM training
UNION ALL SELECT 'merged_koi_steff', round(quantile_cont(merged_koi_steff, 0.05), 6),
       round(quantile_cont(merged_koi_steff, 0.95), 6) FROM training""")


def q_dataset_overview(spark, sf_dir):
    t = training(spark, sf_dir).drop("label")
    return R.dataset_overview(t, "merged_koi_disposition")


SQL_DATASET_OVERVIEW = O.with_(O.TRAINING, """
SELECT count(*) AS n_samples,
  count(*) FILTER (WHERE merged_koi_disposition = 'CANDIDATE') AS n_candidate,
  count(*) FILTER (WHERE merged_koi_disposition = 'CONFIRMED') AS n_confirmed,
  count(*) FILTER (WHERE merged_koi_disposition = 'FALSE POSITIVE') AS n_false_positive,
  16 AS n_columns
FROM training""")


DESCRIBE_COLS = ["merged_koi_period", "merged_koi_depth", "merged_koi_prad", "merged_koi_teq"]


def q_describe(spark, sf_dir):
    return round_doubles(R.describe(training(spark, sf_dir), DESCRIBE_COLS))


SQL_DESCRIBE = O.with_(O.TRAINING, "\nUNION ALL\n".join(f"""
SELECT '{c}' AS feature, count({c}) AS count, round(avg({c}), 6) AS mean,
  round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min,
  round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50,
  round(quantile_cont({c}, 0.75), 6) AS q75, round(max({c}), 6) AS max
FROM training""" for c in DESCRIBE_COLS))


NULL_SHARE_COLS = ["merged_koi_disposition", "merged_koi_period", "merged_koi_depth",
                   "merged_koi_depth_err1", "merged_koi_prad", "merged_koi_srad"]


def q_null_share(spark, sf_dir):
    c = X.candidates(spark, sf_dir)
    return round_doubles(null_share(c, NULL_SHARE_COLS))


SQL_NULL_SHARE = O.with_(O.CANDIDATES, "\nUNION ALL\n".join(f"""
SELECT '{c}' AS column_name, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_share
FROM candidates""" for c in NULL_SHARE_COLS))


# --- the same reports on orders (a second, larger input) -------------------

def _orders(spark, sf_dir):
    from transitlake.sources.tables import read_table
    return read_table(spark, sf_dir, "orders")


def q_orders_priority_shares(spark, sf_dir):
    return R.value_counts(_orders(spark, sf_dir), "o_orderpriority")


SQL_ORDERS_PRIORITY_SHARES = """
SELECT o_orderpriority, count(*) AS count,
  round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS share_pct
FROM orders GROUP BY o_orderpriority"""


def q_orders_daily_counts(spark, sf_dir):
    return R.counts_by_day(_orders(spark, sf_dir), ts="o_orderdate", col="o_orderstatus")


SQL_ORDERS_DAILY_COUNTS = """
SELECT CAST(o_orderdate AS DATE) AS date, o_orderstatus, count(*) AS count
FROM orders GROUP BY 1, 2"""


def q_orders_price_histogram(spark, sf_dir):
    return round_doubles(R.histogram(_orders(spark, sf_dir), "o_totalprice", max_bins=20))


# bin width: (max - min) / 20 rounded up on the 1-2-5 ladder
SQL_ORDERS_PRICE_HISTOGRAM = """
WITH r AS (SELECT (max(o_totalprice) - min(o_totalprice)) / 20 AS raw FROM orders),
m AS (SELECT raw, power(10, floor(log10(raw))) AS mag FROM r),
s AS (SELECT CASE WHEN mag >= raw THEN mag WHEN 2 * mag >= raw THEN 2 * mag
                  WHEN 5 * mag >= raw THEN 5 * mag ELSE 10 * mag END AS step FROM m)
SELECT round(CAST(floor(o_totalprice / step) * step AS DOUBLE), 6) AS bin_start, count(*) AS count,
  round(CAST(floor(o_totalprice / step) * step AS DOUBLE) + step, 6) AS bin_end
FROM orders, s WHERE o_totalprice IS NOT NULL GROUP BY floor(o_totalprice / step), step"""


def q_orders_price_ranges(spark, sf_dir):
    return round_doubles(R.quantile_ranges(_orders(spark, sf_dir), ["o_totalprice"]))


SQL_ORDERS_PRICE_RANGES = """
SELECT 'o_totalprice' AS feature, round(quantile_cont(o_totalprice, 0.05), 6) AS q_low,
       round(quantile_cont(o_totalprice, 0.95), 6) AS q_high FROM orders"""


QUERIES = {
    "orders_priority_shares": q_orders_priority_shares,
    "orders_daily_counts": q_orders_daily_counts,
    "orders_price_histogram": q_orders_price_histogram,
    "orders_price_ranges": q_orders_price_ranges,
    "prediction_shares": q_prediction_shares,
    "daily_counts": q_daily_counts,
    "daily_summary": q_daily_summary,
    "headline_counts": q_headline_counts,
    "confidence_stats": q_confidence_stats,
    "confidence_by_model": q_confidence_by_model,
    "confidence_histogram": q_confidence_histogram,
    "habitability_histogram": q_habitability_histogram,
    "model_names": q_model_names,
    "confirmed_history": q_confirmed_history,
    "quantile_ranges": q_quantile_ranges,
    "dataset_overview": q_dataset_overview,
    "describe": q_describe,
    "null_share": q_null_share,
}

ORACLE = {
    "orders_priority_shares": SQL_ORDERS_PRIORITY_SHARES,
    "orders_daily_counts": SQL_ORDERS_DAILY_COUNTS,
    "orders_price_histogram": SQL_ORDERS_PRICE_HISTOGRAM,
    "orders_price_ranges": SQL_ORDERS_PRICE_RANGES,
    "prediction_shares": SQL_PREDICTION_SHARES,
    "daily_counts": SQL_DAILY_COUNTS,
    "daily_summary": SQL_DAILY_SUMMARY,
    "headline_counts": SQL_HEADLINE_COUNTS,
    "confidence_stats": SQL_CONFIDENCE_STATS,
    "confidence_by_model": SQL_CONFIDENCE_BY_MODEL,
    "confidence_histogram": SQL_CONFIDENCE_HISTOGRAM,
    "habitability_histogram": SQL_HABITABILITY_HISTOGRAM,
    "model_names": SQL_MODEL_NAMES,
    "confirmed_history": SQL_CONFIRMED_HISTORY,
    "quantile_ranges": SQL_QUANTILE_RANGES,
    "dataset_overview": SQL_DATASET_OVERVIEW,
    "describe": SQL_DESCRIBE,
    "null_share": SQL_NULL_SHARE,
}
