"""The corpus pipeline: five of the operators in ``transitlake.llm`` in a row.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet in the shared checkpoint folder and reread as the next
stage's ``docs``.  All but the last return the columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transitlake.llm import decontamination, line_dedup, sentencepiece_codec, simhash_trie, toxicity
from transitlake.llm.common import write_table
from transitlake.sources.tables import read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.clean(spark, docs, sf_dir)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are cut out of the texts; a document
    of nothing else goes.  ``n_chars`` follows the text."""
    kept = line_dedup.clean(docs)
    if "n_chars" in kept.columns:
        kept = kept.withColumn("n_chars", F.length(F.coalesce(F.col("text"), F.lit(""))).cast(docs.schema["n_chars"].dataType))
    return kept


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays."""
    return simhash_trie.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a benchmark item leaks into go."""
    return decontamination.clean(docs, read_table(spark, sf_dir, "benchmark").select("item_id", "text"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token_ids (with begin and end ids), n_tokens, decoded."""
    rows = sentencepiece_codec.encode_decode(docs, sentencepiece_codec.model_path())
    return rows.select("doc_id", "token_ids", F.size("token_ids").cast("long").alias("n_tokens"), "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentencepiece", tokenize),
]

ORACLE_SQL = None  # the model and the tokenizer have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
