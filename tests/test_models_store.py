"""Model sanity (probabilities, accuracy above majority), persistence, the
prediction store and the streaming paths."""

import os
import tempfile

from pyspark.sql import functions as F

from tests.conftest import SF_MID


def test_mlp_embeddings_probabilities_and_learnability(spark):
    """The driver's embedding labels are independent of the vectors
    (nearest-centroid accuracy is at chance), so learnability is checked
    on a target that is a function of the embedding: which of the first
    three coordinates is largest."""
    from transitlake.operators import models as MD
    from transitlake.operators.sampling import stratified_split
    from transitlake.plans.model_queries import embeddings_frame
    e = embeddings_frame(spark, SF_MID)
    learnable = F.when((F.col("e_0") >= F.col("e_1")) & (F.col("e_0") >= F.col("e_2")), "a") \
        .when(F.col("e_1") >= F.col("e_2"), "b").otherwise("c")
    e = e.withColumn("target", learnable)
    sp = stratified_split(e, target="target").cache()
    feats = [f"e_{i}" for i in range(64)]
    m = MD.fit_mlp_lbfgs(sp.where("is_train"), feats, "target", classes=["a", "b", "c"],
                         hidden=(32,), max_iter=200)  # Adam with early stopping: test_mlp
    scored = m.transform(sp.where(~F.col("is_train"))).cache()
    sums = scored.select(F.aggregate("probabilities", F.lit(0.0), lambda a, b: a + b).alias("s"))
    assert sums.where(F.abs(F.col("s") - 1) > 1e-6).count() == 0
    acc = scored.where(F.col("prediction") == F.col("target")).count() / scored.count()
    majority = sp.groupBy("target").count().agg(F.max("count")).first()[0] / sp.count()
    assert acc > majority + 0.1


def test_forest_save_load_and_score(spark):
    from transitlake.operators import models as MD
    from transitlake.operators.scoring import score
    from transitlake.plans.model_queries import model_input
    from transitlake.sources import fixtures as X
    from transitlake.sources import store
    s, feats = model_input(spark, "/root/testdata/sf0.001")
    m = MD.fit_forest(s.where("is_train"), feats, "merged_koi_disposition", num_trees=5, max_depth=4)
    d = tempfile.mkdtemp(prefix="tl-model-", dir="/tmp")
    m.save(f"{d}/forest")
    m2 = MD.ClassifierModel.load(f"{d}/forest")
    cands = X.candidates(spark, "/root/testdata/sf0.001")
    a = score(m, cands).select("row_id", "prediction").orderBy("row_id").collect()
    b = score(m2, cands).select("row_id", "prediction").orderBy("row_id").collect()
    assert a == b and len(a) == cands.count()
    # store: create, append, per-user read, delete
    root = f"{d}/store"
    store.create_tables(spark, root)
    scored = score(m, cands)
    store.append_predictions(spark, root, scored, "u1", "random_forest")
    store.append_predictions(spark, root, scored.limit(3), "u2", "random_forest")
    assert store.read_predictions(spark, root, "u1").count() == cands.count()
    store.delete_user_predictions(spark, root, "u1")
    assert store.read_predictions(spark, root, "u1").count() == 0
    assert store.read_predictions(spark, root, "u2").count() == 3


def test_csv_scan_declared_schema(spark):
    from transitlake.schema import koi_catalog_schema
    from transitlake.sources.catalogs import read_catalog_csv
    d = tempfile.mkdtemp(prefix="tl-csv-", dir="/tmp")
    with open(os.path.join(d, "koi.csv"), "w") as f:
        f.write("kepid,koi_disposition,ra,dec,koi_period\n1,CONFIRMED,10.5,2.0,3.5\n2,CANDIDATE,abc,1.0,NaN\n")
    df = read_catalog_csv(spark, d, koi_catalog_schema()).orderBy("kepid").collect()
    assert df[0].ra == 10.5 and df[1].ra is None and df[1].koi_period is None
    assert df[1]["_bad_fields"] == 1 and df[0]["_bad_fields"] == 0


def test_daily_counts_stream(spark):
    from transitlake.sources import fixtures as X
    from transitlake.streaming.scoring_stream import daily_counts_stream
    d = tempfile.mkdtemp(prefix="tl-stream-", dir="/tmp")
    p = X.predictions(spark, "/root/testdata/sf0.001").select("created_at", "prediction")
    p.write.mode("overwrite").parquet(f"{d}/in")
    stream = spark.readStream.schema(p.schema).parquet(f"{d}/in")
    q = (daily_counts_stream(stream).writeStream.outputMode("complete").format("memory")
         .queryName("tl_daily").option("checkpointLocation", f"{d}/ckpt").start())
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT sum(count) FROM tl_daily").first()[0]
    assert got == p.count()


def test_a_replayed_stream_batch_adds_no_row(spark):
    """The stream is stopped after a batch was stored but before it was noted as
    done: the restart runs the batch again.  New files are appended once."""
    from transitlake.sources import fixtures as X, store
    d = tempfile.mkdtemp(prefix="tl-sink-", dir="/tmp")
    rows = X.predictions(spark, "/root/testdata/sf0.001")
    early = F.col("id").cast("long") % 3 > 0
    rows.where(early).write.parquet(f"{d}/in")
    store.create_tables(spark, f"{d}/store")
    stream = lambda: spark.readStream.schema(rows.schema).parquet(f"{d}/in")
    run = lambda: store.append_stream(stream(), f"{d}/store", "s", f"{d}/ckpt").awaitTermination()
    ids = lambda df: sorted(r.id for r in df.select("id").collect())
    run()
    assert ids(store.read_predictions(spark, f"{d}/store")) == ids(rows.where(early))
    for name in os.listdir(f"{d}/ckpt/commits"):
        if name.strip(".").startswith("0"):
            os.remove(f"{d}/ckpt/commits/{name}")
    run()
    assert ids(store.read_predictions(spark, f"{d}/store")) == ids(rows.where(early))
    rows.where(~early).write.mode("append").parquet(f"{d}/in")
    run()
    assert ids(store.read_predictions(spark, f"{d}/store")) == ids(rows)
    user = rows.where("user_id is not null").first().user_id
    store.delete_user_predictions(spark, f"{d}/store", user)
    assert ids(store.read_predictions(spark, f"{d}/store")) == ids(rows.where(F.col("user_id") != user))
    assert store.read_predictions(spark, f"{d}/store", user).count() == 0


def test_boosted_models_are_fitted_at_their_configured_sizes(spark, monkeypatch):
    from tests.conftest import SF_SMALL
    from transitlake.operators import experiments as EX
    from transitlake.operators import models as models_module
    from transitlake.plans import extra_queries, model_queries
    real, sizes = models_module.fit_leafwise, []

    def small(train, feats, label, **kw):
        sizes.append(kw)
        return real(train, feats[:3], label, **kw | dict(rounds=1, leaves=2))

    monkeypatch.setattr(models_module, "fit_leafwise", small)
    assert model_queries.q_train_boosted_candidates(spark, SF_SMALL).count() == 1
    assert sizes == [models_module.MODEL_PARAMS["lightgbm"]] and sizes[0]["rounds"] == 2000 and sizes[0]["patience"] == 150
    sizes.clear()
    assert extra_queries.q_refit_balanced(spark, SF_SMALL).count() == 3
    of = lambda *names: sorted(tuple(kw.get(n) for n in names) for kw in sizes)
    assert of("rounds", "leaves", "max_depth", "rate") == [(100, 31, 15, 0.1), (150, 31, 15, 0.05)]
    assert of("patience") == [(None,), (None,)]  # no early stop up to 10,000 rows
    assert EX.EARLY_STOP_ROWS == 10_000
    assert models_module.MODEL_PARAMS["catboost"] == dict(rounds=500, rate=0.05, depth=6, l2=3.0, bins=254, patience=50)
