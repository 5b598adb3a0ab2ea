"""Round trips through the predictions store and the scoring path, and
cleaning operators on inputs that trigger them (A4-A6, A8, A9, K11, D3, B9)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from transitlake.functions.expr import round_doubles
from transitlake.operators import models as MD
from transitlake.operators.clean import exact_dedupe, null_non_finite
from transitlake.operators.history import for_user
from transitlake.operators.scoring import prepare_upload, score, write_predictions_csv
from transitlake.plans.model_queries import LABEL, model_input
from transitlake.plans.oracle_sql import CANDIDATES, with_
from transitlake.session import scratch_path
from transitlake.sources import fixtures as X
from transitlake.sources import store
from transitlake.sources.tables import read_table

DELETED = "7"


def _fresh(spark, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def _history(spark, sf_dir):
    """The history fixture; every tenth row belongs to no user."""
    none = F.col("id").cast("long") % 10 == 0
    return X.predictions(spark, sf_dir).withColumn("user_id", F.when(~none, F.col("user_id")))


def q_store_delete_user(spark, sf_dir):
    """Create, append all history, delete one user, read back per user."""
    root = _fresh(spark, "store")
    store.create_tables(spark, root)
    store.append_rows(root, _history(spark, sf_dir))
    store.delete_user_predictions(spark, root, DELETED)
    left = store.read_predictions(spark, root)
    return left.groupBy(F.coalesce("user_id", F.lit("-")).alias("user_id")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(F.col("id").cast("long")).alias("min_id"))


def q_store_stream_replayed(spark, sf_dir):
    """The history as three batches of a stream, the last two run again as after
    a failure, beside a batch append; then one user deleted; read back."""
    root = _fresh(spark, "store")
    store.create_tables(spark, root)
    rows = _history(spark, sf_dir)
    part = F.col("id").cast("long") % 4
    store.append_rows(root, rows.where(part == 3))
    for number in (0, 1, 2, 1, 2):
        store.write_batch(root, rows.where(part == number), "uploads", number)
    store.delete_user_predictions(spark, root, DELETED)
    left = store.read_predictions(spark, root)
    return round_doubles(left.groupBy(F.coalesce("user_id", F.lit("-")).alias("user_id"), "prediction").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("id").cast("long")).alias("sum_id"),
        F.sum("confidence").alias("sum_confidence")))


def q_store_append_scored(spark, sf_dir):
    """Two scored batches appended for two users; one user's view of them."""
    root = _fresh(spark, "store")
    store.create_tables(spark, root)
    rows = X.predictions(spark, sf_dir).withColumn("features", F.to_json("features"))
    odd = F.col("id").cast("long") % 2 == 1
    store.append_predictions(spark, root, rows.where(odd), "u1", "forest")
    store.append_predictions(spark, root, rows.where(~odd), "u2", "forest")
    mine = for_user(store.read_predictions(spark, root, "u1"), "u1")
    return round_doubles(mine.groupBy("user_id", "prediction").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("confidence").alias("sum_confidence"),
        F.count("habitability_score").alias("n_scored")))


def _upload(spark, sf_dir):
    """The candidates as an upload: unmapped names, some rows twice, a
    training feature missing."""
    c = X.candidates(spark, sf_dir)
    up = c.select("row_id", F.col("merged_ra").alias("ra"), F.col("merged_koi_depth").alias("koi_depth"),
                  F.col("merged_koi_teq").alias("koi_teq"), F.lit("x").alias("note"))
    return up.union(up.where(F.col("row_id") % 10 == 0))


def q_score_contract(spark, sf_dir):
    """Every upload row once, with its own columns and probabilities that
    sum to one; through the CSV sink and back."""
    s, feats = model_input(spark, sf_dir)
    m = MD.fit_forest(s.where("is_train"), feats, LABEL, **MD.MODEL_PARAMS["random_forest"])
    wanted = [f.replace("merged_", "") for f in m.prep.features if f.startswith("merged_")]
    scored = score(m, prepare_upload(_upload(spark, sf_dir), wanted=wanted))
    total = F.aggregate(F.map_values("probability_map"), F.lit(0.0), lambda a, x: a + x)
    out = _fresh(spark, "scored-csv")
    write_predictions_csv(scored.withColumn("sums_to_one", (F.abs(total - 1) < 1e-6).cast("int")), out)
    back = spark.read.option("header", True).csv(out)
    return round_doubles(back.groupBy(F.col("row_id").cast("long").alias("row_id")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(F.col("Original_ra").cast("double")).alias("original_ra"),
        F.min("Original_note").alias("original_note"), F.min(F.col("sums_to_one").cast("int")).alias("sums_to_one"),
        F.max(F.get_json_object("features", "$.merged_koi_teq").cast("double")).alias("teq")))


def q_exact_duplicates(spark, sf_dir):
    """Rows that repeat under another id collapse to the smallest id (D3)."""
    c = X.candidates(spark, sf_dir)
    again = c.where(F.col("row_id") % 3 == 0).withColumn("row_id", F.col("row_id") + 10_000_000)
    return exact_dedupe(c.union(again)).groupBy("mission").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("row_id").alias("sum_row_id"))


def q_non_finite(spark, sf_dir):
    """Infinities and NaN become NULL, finite values stay."""
    e = read_table(spark, sf_dir, "events")
    v = (F.when(F.col("event_id") % 9 == 0, F.lit(float("inf"))).when(F.col("event_id") % 9 == 1, F.lit(float("-inf")))
         .when(F.col("event_id") % 9 == 2, F.lit(float("nan"))).otherwise(F.col("value")))
    df = null_non_finite(e.select("event_type", v.alias("merged_value")))
    return round_doubles(df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_rows"),
                                                      F.count("merged_value").alias("n_finite"),
                                                      F.max("merged_value").alias("max_value")))


QUERIES = {
    "store_delete_user": q_store_delete_user,
    "store_append_scored": q_store_append_scored,
    "store_stream_replayed": q_store_stream_replayed,
    "score_contract": q_score_contract,
    "exact_duplicates": q_exact_duplicates,
    "non_finite": q_non_finite,
}

ORACLE = {
    "store_delete_user": f"""
SELECT CASE WHEN event_id % 10 = 0 THEN '-' ELSE CAST(user_id AS VARCHAR) END AS user_id,
       count(*) AS n_rows, min(event_id) AS min_id
FROM events WHERE event_id % 10 = 0 OR CAST(user_id AS VARCHAR) <> '{DELETED}' GROUP BY 1""",
    "store_append_scored": """
SELECT 'u1' AS user_id, prediction, count(*) AS n_rows, round(sum(CAST(event_id % 101 AS DOUBLE)), 6) AS sum_confidence,
       count(CASE WHEN prediction IN ('CONFIRMED', 'CANDIDATE') THEN value END) AS n_scored
FROM (SELECT *, CASE event_type WHEN 'error' THEN 'FALSE POSITIVE' WHEN 'purchase' THEN 'CONFIRMED'
                                WHEN 'signup' THEN 'CONFIRMED' ELSE 'CANDIDATE' END AS prediction FROM events) p
WHERE event_id % 2 = 1 GROUP BY prediction""",
    "store_stream_replayed": f"""
SELECT user_id, prediction, count(*) AS n_rows, CAST(sum(event_id) AS BIGINT) AS sum_id,
       round(sum(CAST(event_id % 101 AS DOUBLE)), 6) AS sum_confidence
FROM (SELECT *, CASE event_type WHEN 'error' THEN 'FALSE POSITIVE' WHEN 'purchase' THEN 'CONFIRMED'
                                WHEN 'signup' THEN 'CONFIRMED' ELSE 'CANDIDATE' END AS prediction FROM
      (SELECT event_id, event_type, CASE WHEN event_id % 10 = 0 THEN '-' ELSE CAST(user_id AS VARCHAR) END AS user_id FROM events)) p
WHERE user_id <> '{DELETED}' GROUP BY 1, 2""",
    "score_contract": with_(CANDIDATES, """
SELECT row_id, CASE WHEN row_id % 10 = 0 THEN CAST(2 AS BIGINT) ELSE CAST(1 AS BIGINT) END AS n_rows,
       round(merged_ra, 6) AS original_ra, 'x' AS original_note, 1 AS sums_to_one,
       round(CASE WHEN merged_koi_teq > 0 THEN merged_koi_teq END, 6) AS teq
FROM candidates"""),
    "exact_duplicates": with_(CANDIDATES, """
SELECT mission, count(*) AS n_rows, CAST(sum(row_id) AS BIGINT) AS sum_row_id FROM candidates GROUP BY mission"""),
    "non_finite": """
SELECT event_type, count(*) AS n_rows, count(CASE WHEN event_id % 9 > 2 THEN value END) AS n_finite,
       round(max(CASE WHEN event_id % 9 > 2 THEN value END), 6) AS max_value
FROM events GROUP BY event_type""",
}
