"""The predictions / model-metrics store as Parquet tables.

Layout: ``predictions`` is partitioned by ``user_bucket`` (a hash bucket
of user_id) so a per-user read prunes to one folder, and a per-user
delete rewrites only that folder (dynamic partition overwrite).  Appends
are one batch write per scored batch - never a request per row.

Streams write to ``predictions_streamed``, partitioned further by stream and
batch number.  A batch that is run again (Structured Streaming replays the
batch that was under way at a failure, with the same rows) overwrites its own
partitions only, so each row is stored exactly once.  Reads and deletes cover
both tables.  A batch leaves up to 64 files, so triggers should be minutes
rather than seconds apart.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transitlake.schema import MODEL_METRICS_SCHEMA, PREDICTIONS_SCHEMA

USER_BUCKETS = 64
STORED_SCHEMA = T.StructType(list(PREDICTIONS_SCHEMA.fields)
                             + [T.StructField("user_bucket", T.IntegerType())])

STREAMED_SCHEMA = T.StructType(list(STORED_SCHEMA.fields) + [T.StructField("stream", T.StringType()),
                                                             T.StructField("batch", T.LongType())])


def user_bucket(user_col="user_id"):
    return F.pmod(F.xxhash64(F.col(user_col)), F.lit(USER_BUCKETS)).cast("int")


def create_tables(spark: SparkSession, root: str) -> None:
    """Create empty tables if absent."""
    pred = f"{root}/predictions"
    met = f"{root}/model_metrics"
    if not _exists(spark, pred):
        (spark.createDataFrame([], PREDICTIONS_SCHEMA).withColumn("user_bucket", user_bucket())
         .write.mode("overwrite").partitionBy("user_bucket").parquet(pred))
    if not _exists(spark, met):
        spark.createDataFrame([], MODEL_METRICS_SCHEMA).write.mode("overwrite").parquet(met)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def append_rows(root: str, rows: DataFrame) -> None:
    """Append history rows (PREDICTIONS_SCHEMA names) to their users' buckets."""
    (rows.select(*[F.col(f.name).cast(f.dataType) for f in PREDICTIONS_SCHEMA.fields])
     .withColumn("user_bucket", user_bucket())
     .write.mode("append").partitionBy("user_bucket").parquet(f"{root}/predictions"))


def _streamed(root: str) -> str:
    return f"{root}/predictions_streamed"


def write_batch(root: str, rows: DataFrame, stream: str, batch: int) -> None:
    """Store the history rows of one batch of a stream; running it again with
    the same rows replaces them."""
    (rows.select(*[F.col(f.name).cast(f.dataType) for f in PREDICTIONS_SCHEMA.fields])
     .withColumns({"user_bucket": user_bucket(), "stream": F.lit(stream), "batch": F.lit(batch).cast("long")})
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("user_bucket", "stream", "batch").parquet(_streamed(root)))


def append_stream(rows: DataFrame, root: str, stream: str, checkpoint: str, **trigger):
    """Start a query that appends a stream of history rows (PREDICTIONS_SCHEMA
    names) exactly once.  ``stream`` names it in the store: one name per
    checkpoint folder, as batch numbers start anew with a new one."""
    return (rows.writeStream.foreachBatch(lambda batch, number: write_batch(root, batch, stream, number))
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def append_predictions(spark: SparkSession, root: str, scored: DataFrame, user_id: str,
                       model_name: str) -> None:
    """Append one scored batch (A4): id, user, timestamps, features map,
    prediction, confidence (0-1), habitability score."""
    append_rows(root, scored.select(
        F.expr("uuid()").alias("id"),
        F.lit(str(user_id)).alias("user_id"),
        F.current_timestamp().alias("created_at"),
        F.lit(model_name).alias("model_name"),
        F.from_json(F.col("features"), "map<string,double>").alias("features"),
        F.col("prediction"),
        F.col("confidence").cast("double"),
        F.col("habitability_score").cast("double"),
        F.current_timestamp().alias("saved_at"),
    ))


def read_predictions(spark: SparkSession, root: str, user_id: str | None = None) -> DataFrame:
    """Read the table; with a user the bucket filter prunes partitions and
    the user filter is pushed into the scan (A3, A8)."""
    df = spark.read.schema(STORED_SCHEMA).parquet(f"{root}/predictions")
    if _exists(spark, _streamed(root)):
        df = df.unionByName(spark.read.schema(STREAMED_SCHEMA).parquet(_streamed(root)).drop("stream", "batch"))
    if user_id is not None:
        df = df.where((F.col("user_bucket") == _bucket_of(spark, user_id))
                      & (F.col("user_id") == F.lit(str(user_id))))
    return df


def _bucket_of(spark: SparkSession, user_id: str):
    """The user's bucket as a constant expression: Catalyst folds it, so
    the partition filter prunes folders at planning time (no job)."""
    return F.pmod(F.xxhash64(F.lit(str(user_id))), F.lit(USER_BUCKETS)).cast("int")


def delete_user_predictions(spark: SparkSession, root: str, user_id: str) -> None:
    """Delete a user's rows (A5): rewrite only that user's bucket folder
    with dynamic partition overwrite; other buckets are untouched.  The
    bucket is staged to a fresh folder first so the overwrite never reads
    the files it replaces."""
    b = _bucket_of(spark, user_id)
    path = f"{root}/predictions"
    keep = spark.read.schema(STORED_SCHEMA).parquet(path).where((F.col("user_bucket") == b)
                                          & ~F.col("user_id").eqNullSafe(F.lit(str(user_id))))
    stage = f"{root}/_staging/{uuid.uuid4().hex}"
    keep.write.mode("overwrite").partitionBy("user_bucket").parquet(stage)
    staged = spark.read.schema(STORED_SCHEMA).parquet(stage)
    prev = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        if staged.limit(1).count() == 0:
            # nothing left in the bucket: overwrite it with an empty partition
            _drop_bucket(spark, path, b)
        else:
            staged.write.mode("overwrite").partitionBy("user_bucket").parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", prev)
        _remove(spark, stage)
    if _exists(spark, _streamed(root)):
        _delete_streamed(spark, root, user_id)


def _delete_streamed(spark: SparkSession, root: str, user_id: str) -> None:
    """Rewrite the batches of the user's bucket that hold rows of the user; a
    batch of no other user's rows goes with its folder."""
    path, parts = _streamed(root), ["stream", "batch"]
    bucket = spark.read.schema(STREAMED_SCHEMA).parquet(path).where(F.col("user_bucket") == _bucket_of(spark, user_id))
    theirs = F.col("user_id").eqNullSafe(F.lit(str(user_id)))
    touched = bucket.groupBy("user_bucket", *parts).agg(F.max(theirs).alias("holds"), F.min(theirs).alias("only")).where("holds")
    folders = touched.collect()  # names of batches, not rows
    stage = f"{root}/_staging/{uuid.uuid4().hex}"
    keep = bucket.join(touched.select(*parts), parts, "left_semi").where(~theirs)
    keep.select(*STREAMED_SCHEMA.names).write.mode("overwrite").parquet(stage)
    (spark.read.schema(STREAMED_SCHEMA).parquet(stage).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("user_bucket", *parts).parquet(path))
    for r in folders:
        if r.only:
            _remove(spark, f"{path}/user_bucket={r.user_bucket}/stream={r.stream}/batch={r.batch}")
    _remove(spark, stage)


def _drop_bucket(spark: SparkSession, path: str, bucket: int) -> None:
    b = spark.range(1).select(bucket).first()[0]
    _remove(spark, f"{path}/user_bucket={b}")


def _remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(p):
        fs.delete(p, True)


def append_model_metrics(spark: SparkSession, root: str, model_name: str, metrics: DataFrame,
                         metadata_json: str = "{}") -> None:
    """Append one training run's metrics row (A12) from a summary_metrics frame."""
    row = metrics.select(
        F.expr("uuid()").alias("id"), F.lit(model_name).alias("model_name"),
        F.col("accuracy"), F.col("weighted_precision").alias("precision"),
        F.col("weighted_recall").alias("recall"), F.col("weighted_f1").alias("f1_score"),
        F.current_timestamp().alias("training_date"), F.lit(metadata_json).alias("metadata"))
    row.write.mode("append").parquet(f"{root}/model_metrics")
