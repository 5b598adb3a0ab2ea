"""Scoring keeps every row once, on uploads with equal rows, missing features
and malformed numbers; it runs on streams; deletes keep other users' rows."""

import json
import tempfile

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def forest(spark):
    from transitlake.operators import models as MD
    from transitlake.plans.model_queries import model_input
    s, feats = model_input(spark, SF_SMALL)
    return MD.fit_forest(s.where("is_train"), feats, "merged_koi_disposition", num_trees=3, max_depth=3)


def test_score_job_on_a_messy_upload(spark, forest):
    from transitlake.plans.jobs import score_job
    d = tempfile.mkdtemp(prefix="tl-score-", dir="/tmp")
    forest.save(f"{d}/model")
    with open(f"{d}/up.csv", "w") as f:
        f.write("name,koi_period,koi_prad,note\na,3.5,1.2,x\na,3.5,1.2,x\nb,abc,2.0,y\nc,,,\n")
    rows = score_job(spark, f"{d}/model", f"{d}/up.csv", f"{d}/out").collect()
    assert len(rows) == 4 and len({r.row_id for r in rows}) == 4
    assert sorted(r.Original_name for r in rows) == ["a", "a", "b", "c"]
    by_name = {r.Original_name: r for r in rows}
    assert by_name["b"].Original_koi_period == "abc"
    assert json.loads(by_name["b"].features)["merged_koi_period"] is None
    assert json.loads(by_name["a"].features)["merged_koi_prad"] == 1.2
    assert all(abs(sum(r.probability_map.values()) - 1) < 1e-6 for r in rows)


def test_equal_ids_do_not_multiply(spark, forest):
    from transitlake.operators.scoring import score
    up = spark.createDataFrame([(1, "UNKNOWN", 3.0)] * 4, "row_id long, mission string, merged_koi_period double")
    assert score(forest, up).count() == 4


def test_rows_of_one_partition_are_dealt(spark, forest):
    from transitlake.operators.scoring import score
    up = spark.range(0, 400, 1, 1).select(F.col("id").alias("row_id"), F.lit("UNKNOWN").alias("mission"),
                                          F.col("id").cast("double").alias("merged_koi_period"))
    key = "spark.sql.adaptive.coalescePartitions.enabled"  # would join partitions as small as these
    spark.conf.set(key, "false")
    try:
        sizes = score(forest, up).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set(key, "true")
    assert len(sizes) == 4 and sum(r["count"] for r in sizes) == 400


def test_vectors_of_many_zeros_score_as_dense_ones(spark, forest):
    from pyspark.ml.functions import vector_to_array
    up = spark.range(60).select("id", *[F.when(F.col("id") % 7 > i, F.col("id") * (i + 1.0)).otherwise(0.0).alias(f)
                                        for i, f in enumerate(forest.prep.features)])
    packed = forest.models[0].setProbabilityCol("p").transform(forest.prep.transform(up))
    assert "SparseVector" in {type(r.features).__name__ for r in packed.select("features").collect()}
    want = {r.id: r.p for r in packed.select("id", vector_to_array("p").alias("p")).collect()}
    assert {r.id: r.probabilities for r in forest.transform(up).collect()} == want


def test_score_stream_starts(spark, forest):
    from transitlake.streaming.scoring_stream import score_stream
    d = tempfile.mkdtemp(prefix="tl-stream-", dir="/tmp")
    up = spark.createDataFrame([(i, "UNKNOWN", float(i)) for i in range(5)], "row_id long, mission string, merged_koi_period double")
    up.write.parquet(f"{d}/in")
    q = (score_stream(forest, spark.readStream.schema(up.schema).parquet(f"{d}/in")).writeStream.format("memory")
         .queryName("tl_scored").option("checkpointLocation", f"{d}/ckpt").start())
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT count(*), count(prediction) FROM tl_scored").first()[:] == (5, 5)


def test_delete_keeps_rows_without_a_user(spark, forest):
    import os
    from transitlake.sources import store
    root = tempfile.mkdtemp(prefix="tl-store-", dir="/tmp")
    store.create_tables(spark, root)
    mine = store.read_predictions(spark, root)
    b = spark.range(1).select(store._bucket_of(spark, "u1")).first()[0]
    extra = spark.createDataFrame([("1", "u1"), ("2", None)], "id string, user_id string").withColumn("user_bucket", F.lit(b))
    for f in mine.schema:
        if f.name not in extra.columns:
            extra = extra.withColumn(f.name, F.lit(None).cast(f.dataType))
    extra.select(mine.columns).write.mode("append").partitionBy("user_bucket").parquet(f"{root}/predictions")
    store.delete_user_predictions(spark, root, "u1")
    assert [r.id for r in store.read_predictions(spark, root).collect()] == ["2"]
    assert not os.listdir(f"{root}/_staging")


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from transitlake.session import ensure_checkpoint_dir

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session())


@pytest.mark.parametrize("name, params", [("random_forest", dict(num_trees=3, max_depth=3)),
                                          ("catboost", dict(rounds=2, depth=2))])
def test_train_save_load_score(spark, name, params):
    """The train job's preparation follows the model's name and travels with
    the saved model."""
    from transitlake.plans.jobs import score_job, train_job
    from transitlake.sources import fixtures as X
    d = tempfile.mkdtemp(prefix="tl-train-", dir="/tmp")
    X.koi_catalog(spark, SF_SMALL).write.option("header", True).csv(f"{d}/koi")
    X.toi_catalog(spark, SF_SMALL).write.option("header", True).csv(f"{d}/toi")
    model, metrics = train_job(spark, f"{d}/koi", f"{d}/toi", name, f"{d}/model", **params)
    feats = model.prep.features
    assert any("_err" in f for f in feats) == (name == "catboost")
    assert ("radius_ratio_squared" in feats) == (name == "catboost")
    assert metrics.first()["accuracy"] > 0
    upload = X.koi_catalog(spark, SF_SMALL).drop("koi_disposition", "koi_duration")
    upload.write.option("header", True).csv(f"{d}/upload")
    rows = score_job(spark, f"{d}/model", f"{d}/upload", f"{d}/scored")
    assert rows.count() == upload.count()
    assert rows.where("prediction is null").count() == 0


def test_sparse_columns_are_fitted_on_training_rows(spark):
    from transitlake.operators.model_input import fit_feature_list
    train = spark.createDataFrame([(i, "KEPLER", 1.0 if i == 0 else None, 2.0, 1.0 if i < 4 else None) for i in range(10)],
                                  "row_id long, mission string, merged_a double, merged_b double, merged_c double")
    assert fit_feature_list(train, "lightgbm") == ["merged_a", "merged_b", "merged_c"]
    assert fit_feature_list(train, "random_forest") == ["merged_b"]
