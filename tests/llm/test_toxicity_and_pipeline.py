import zlib

import corpus_pipeline
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from transitlake.llm import toxicity
from transitlake.llm.common import write_table

SF_MID = "/root/testdata/sf0.01"


def test_scores_tell_held_out_labels_apart(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    labels = spark.read.parquet(f"{SF_MID}/labels.parquet").select("doc_id", "toxic")
    rows = toxicity.op3_toxicity(spark, SF_MID).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out]
    pos, neg = ([r.score for r in held if r.toxic == y] for y in (1, 0))
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert auc > 0.75
    assert sum(r.predicted and not r.toxic for r in held) <= 2


def test_held_out_labels_are_not_read(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet").select("doc_id", "toxic")
    used = toxicity.training_rows(docs, labels).collect()
    assert used and all(zlib.crc32(str(r.doc_id).encode()) % 3 != 1 for r in used)


def test_features():
    lexicon = toxicity.Lexicon({"idiot": 3.0, "vequ*": 2.0})
    at = lambda t: dict(zip(toxicity.FEATURES, toxicity.text_features(t, lexicon)))
    assert at("")["hit_density"] == 0 and at("VEQUILLE !!")["stem_density"] == 1
    assert at("you are an idiot")["near_second"] == 1 and at("an idiot")["near_second"] == 0
    assert at("an id1ot and an i d i o t")["obfuscated_hits"] > at("an id1ot")["obfuscated_hits"] > 0


def test_one_class_and_no_labels(spark, edge_docs, no_docs):
    for labelled in (edge_docs.select("doc_id", "text", F.lit(0).alias("toxic")), edge_docs.select("doc_id", "text", F.lit(1).alias("toxic")).where("false")):
        rows = toxicity.fit(labelled).score(edge_docs).collect()
        assert len(rows) == 16 and {r["__score"] for r in rows} == {0.0}
    model = toxicity.fit(toxicity.training_rows(spark.read.parquet(f"{SF_MID}/documents.parquet"),
                                                spark.read.parquet(f"{SF_MID}/labels.parquet").select("doc_id", "toxic")), rounds=3)
    carried = model.score(edge_docs, carry=["score", "toxic"])
    assert carried.columns == ["doc_id", "score", "toxic", "__score"] and carried.where("__score is null").count() == 0
    assert carried.count() == 16 and model.score(no_docs).count() == 0


def test_stages_on_edge_rows(spark, edge_docs, no_docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "sentencepiece"]
    for start in (edge_docs, no_docs):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            out = write_table(stage(spark, docs, SF_SMALL), "test-stage")
            if name != "sentencepiece":
                assert out.columns == start.columns
                assert out.count() <= docs.count()
            else:
                assert out.count() == docs.count()
            docs = out


def test_own_columns_named_like_inner_ones_are_carried(spark, edge_docs):
    """Each filtering stage keeps them as they are: none is overwritten, none makes it fail."""
    from pyspark.sql import functions as F
    docs = edge_docs.select("doc_id", "text", "lang")
    names = ["__row", "__TEXT", "__features", "__probability", "__raw", "__level", "__score", "__fp", "__first", "__least", "__runs",
             "__n_lines", "odd.name", "odd name", "own___row"]
    for name in names:
        docs = docs.withColumn(name, F.concat(F.lit(f"{name} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    docs = write_table(docs, "test-clash")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_SMALL)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows, name
        for r in rows:
            own = "none" if r[0] is None else str(r[0])
            assert list(r)[3:] == [f"{c} of {own}" for c in names], name


def test_decisions_take_effect(spark):
    passage = " ".join(f"shared{i}" for i in range(55))
    given = spark.read.parquet(f"{SF_MID}/documents.parquet")
    bench = spark.read.parquet(f"{SF_MID}/benchmark.parquet").orderBy("item_id").first().text
    own = lambda i, n=80: " ".join(f"own{i}x{k}" for k in range(n))
    body = own(6, 400)
    planted = [(100_001, own(1) + "\n" + passage + "\n" + own(2)), (100_002, own(3) + "\n" + passage + "\n" + own(4)),
               (100_003, own(5) + " " + bench + " " + own(7)), (100_004, body), (100_005, body.replace("own6x7 ", "own6x7b ")),
               (100_006, " ".join(["you idiot moron scum worthless trash"] * 20)), (100_007, own(8))]
    rows = spark.createDataFrame(planted, "doc_id long, text string").selectExpr(
        "doc_id", "text", "'en' as lang", "'planted' as source", "cast(length(text) as bigint) as n_chars")
    docs = given.unionByName(rows)
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = write_table(stage(spark, docs, SF_MID), "test-stage")
        steps[name] = {r.doc_id: r for r in docs.where("doc_id > 100000").collect()}
    assert 100_006 not in steps["toxicity"]
    assert "shared3 " in steps["line_dedup"][100_001].text and steps["line_dedup"][100_002].text == own(3) + "\n" + own(4)
    assert steps["line_dedup"][100_002].n_chars == len(own(3) + "\n" + own(4))
    assert {100_004, 100_005} & set(steps["simhash_near_dedup"]) == {100_004}
    assert 100_003 in steps["simhash_near_dedup"] and 100_003 not in steps["decontamination"]
    assert set(steps["sentencepiece"]) == {100_001, 100_002, 100_004, 100_007}
    assert steps["sentencepiece"][100_007].decoded == own(8)
