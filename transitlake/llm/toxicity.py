"""Operator 3: toxicity by gradient-boosted trees over dense features.

1. A lexicon is learned from labelled texts: words, and word beginnings of
   four to seven letters, that occur in significantly more toxic than clean
   texts (signed G statistic).
2. Every text becomes a short dense vector: lexicon densities, how near
   second-person words stand to lexicon words, capitals, punctuation and
   obfuscation rates (``st*pid``, ``id1ot``, ``i d i o t``).
3. Gradient-boosted trees (MLlib) are fitted on two of three folds of the
   labelled rows, isotonic regression on the trees' probabilities of the third.
   For fitting, the features of a fold use a lexicon learned without it, so
   that trees do not trust words which only the lexicon's own texts show;
   scoring uses the lexicon of all folds.

Fitting reads at most about ``max_fit_rows`` labelled rows (a documented
bound, taken by hash of the id; the lexicon holds at most ``max_entries``
entries).  Scoring is one pass over all texts without a shuffle.

Rows: null or empty texts get the score of a text without any hit; labels that
are null are not used, repeated labels of an id count as toxic if any is;
without both classes among the labels every score is the share of toxic ones.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transitlake.llm.common import documents, map_texts, shielded, write_table
from transitlake.sources.tables import read_table

# fixed values: second-person words of the corpus's languages
SECOND_PERSON = frozenset("""you your yours yourself u ur du dich dir dein deine deinen euch euer ihr tu te toi ton ta tes vous
votre vos tú ti tus usted ustedes vosotros os su""".split())
WORD = re.compile(r"[^\W\d_]+")
TOKEN = re.compile(r"\S+")
# fixed values: what stands for a letter in an obfuscated word
LEET = str.maketrans("013457@$!€", "oieastasie")
OBFUSCATED = re.compile(r"(?<!\S)[^\W\d_]+(?:[0-9@$!€*.\-_]+[^\W\d_]+)+")
SPACED = re.compile(r"(?<!\S)[^\W\d_](?: [^\W\d_]){3,}(?!\S)")
STEMS = (4, 5, 6, 7)
FOLDS = 3
NEAR = 5
BLOCK = 50
FEATURES = ["log_words", "hit_density", "stem_density", "weight_density", "max_weight", "log_distinct", "log_hits",
            "densest_block", "second_density", "near_second", "upper_rate", "shout_rate", "punct_rate",
            "obfuscation_rate", "obfuscated_hits"]


class Lexicon:
    """Log odds of words and of word beginnings (terms that end in ``*``)."""

    def __init__(self, odds: dict[str, float]):
        self.words = {t: w for t, w in odds.items() if t[-1] != "*"}
        self.stems = {t[:-1]: w for t, w in odds.items() if t[-1] == "*"}
        self.heads = {t[:STEMS[0]] for t in self.stems}

    def stem(self, word: str) -> float:
        """Log odds of the word's beginning, 0 without any."""
        if len(word) <= STEMS[0] or word[:STEMS[0]] not in self.heads:
            return 0.0
        return max((self.stems.get(word[:k], 0.0) for k in STEMS if k < len(word)), default=0.0)


def _terms(text: str) -> set[str]:
    words = set(WORD.findall(text.lower()))
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k}


def count_terms(labelled: DataFrame) -> DataFrame:
    """``labelled``: text, toxic, fold.  Per term the toxic (a0, a1, ...) and
    clean (b0, b1, ...) texts of each fold, summed in the tasks first."""
    def count(batches):
        for batch in batches:
            seen = [Counter() for _ in range(2 * FOLDS)]
            for text, y, fold in zip(*(batch[c].to_pylist() for c in ("text", "toxic", "fold"))):
                seen[fold if y else FOLDS + fold].update(_terms(text or ""))
            terms = list(set().union(*seen))
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in seen)], names=names)

    sums = [f"{side}{k}" for side in "ab" for k in range(FOLDS)]
    names = ["term", *sums]
    schema = ", ".join(["term string", *(f"{c} long" for c in sums)])
    return (labelled.select("text", "toxic", "fold").mapInArrow(count, schema)
            .groupBy("term").agg(*[F.sum(c).alias(c) for c in sums]))


def learn_lexicon(terms: DataFrame, totals: list[tuple[int, int]], without: int | None, max_entries: int,
                  min_g: float = 20.0) -> Lexicon:
    """The best terms over all folds but ``without``; ``totals``: toxic and
    clean texts of each fold."""
    folds = [k for k in range(FOLDS) if k != without]
    n_toxic, n_clean = (sum(totals[k][i] for k in folds) for i in (0, 1))
    if not n_toxic or not n_clean:
        return Lexicon({})
    share = n_toxic / (n_toxic + n_clean)
    xlogx = lambda x, e: F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) / e)).otherwise(0.0)
    n = F.col("a") + F.col("b")
    best = (terms.select("term", *[sum(F.col(f"{s}{k}") for k in folds).alias(s) for s in "ab"]).where("a >= 3")
            .withColumn("g", 2 * (xlogx("a", n * share) + xlogx("b", n * (1 - share))))
            .where((F.col("g") >= min_g) & (F.col("a") > n * share))
            .orderBy(F.desc("g"), "term").limit(max_entries).collect())
    return Lexicon({r.term: math.log((r.a + 0.5) / (n_toxic + 1)) - math.log((r.b + 0.5) / (n_clean + 1)) for r in best})


def text_features(text: str, lexicon: Lexicon) -> list[float]:
    words = WORD.findall(text.lower())
    n = len(words) or 1
    known, stem = lexicon.words, lexicon.stem
    hits, weights, stem_hits = [], [], 0
    for i, w in enumerate(words):
        if w in known:
            hits.append(i)
            weights.append(known[w])
        elif (weight := stem(w)) > 0:
            hits.append(i)
            stem_hits += 1
            weights.append(weight)
    second = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    near = 0
    if hits and second:
        near = int((_gaps(hits, second) <= NEAR).sum())
    obscured = [m.replace("*", "").replace(".", "").replace("-", "").replace("_", "").translate(LEET)
                for m in (x.lower() for x in OBFUSCATED.findall(text) if not re.fullmatch(r"[^\W\d_]+(?:[.\-_][^\W\d_]+)*", x))]
    obscured += [m.replace(" ", "").lower() for m in SPACED.findall(text)]
    hidden = sum(o in known or stem(o) > 0 for o in obscured)
    letters = sum(map(len, words)) or 1
    upper = sum(1 for c in text if c.isupper())
    shout = sum(1 for t in TOKEN.findall(text) if len(t) > 2 and t.isupper()) if upper > 3 else 0
    densest = max(Counter(i // BLOCK for i in hits).values()) if hits else 0
    return [math.log1p(len(words)), len(hits) / n, stem_hits / n, sum(weights) / n, max(weights, default=0.0),
            math.log1p(len({words[i] for i in hits})), math.log1p(len(hits)), float(densest), len(second) / n,
            near / max(1, len(hits)), upper / letters, shout / n, (text.count("!") + text.count("?")) / n,
            len(obscured) / n, math.log1p(hidden)]


def _gaps(hits: list[int], second: list[int]) -> np.ndarray:
    """Per hit the distance to a nearest second-person word."""
    s, h = np.array(second), np.array(hits)
    right = np.clip(np.searchsorted(s, h), 0, len(s) - 1)
    return np.minimum(np.abs(s[right] - h), np.abs(s[np.maximum(right - 1, 0)] - h))


def featurize(df: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text",
              carry: list[str] | None = None) -> DataFrame:
    """id, ``carry``, __features (vector)."""
    from pyspark.ml.functions import array_to_vector

    def run(texts):
        return [pa.array([text_features(t, lexicon) for t in texts], pa.list_(pa.float64()))]

    rows = map_texts(df, id_col, text_col, "__dense array<double>", run, carry)
    return rows.withColumn("__features", array_to_vector("__dense")).drop("__dense")


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    trees: object  # None: one class only
    isotonic: object
    prior: float

    def score(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              carry: list[str] | None = None) -> DataFrame:
        """id, ``carry``, __score: calibrated probability of label 1.  A
        thousandth of it is the trees' own probability, which orders rows
        within a level of the isotonic fit."""
        from pyspark.ml.functions import vector_to_array

        if self.trees is None:
            return df.select(id_col, *(carry or []), F.lit(float(self.prior)).alias("__score"))
        rows = self.trees.transform(featurize(df, self.lexicon, id_col, text_col, carry))
        rows = self.isotonic.transform(rows.withColumn("__raw", vector_to_array("__probability")[1]))
        score = F.col("__level") * 0.999 + F.col("__raw") * 0.001
        return rows.select(id_col, *(carry or []), F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)).alias("__score"))


def fit(labelled: DataFrame, max_fit_rows: int = 20_000, max_entries: int = 2000, rounds: int = 25,
        depth: int = 4, seed: int = 7) -> ToxicityModel:
    """``labelled``: doc_id, text, toxic, one row per id."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    labelled = labelled.where("toxic in (0, 1)").withColumn("toxic", F.col("toxic").cast("int"))
    order = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 20))
    n = labelled.select("toxic").count()
    share = min(1.0, max_fit_rows / max(1, n))
    bound = write_table(labelled.select("doc_id", "text", "toxic", order.alias("h"), (order % FOLDS).cast("int").alias("fold"))
                        .where(F.col("h") < F.lit(math.ceil(share * (1 << 20)))), "toxicity-fit")
    by_fold = {r.fold: (r.a, r.n - r.a) for r in
               bound.groupBy("fold").agg(F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("n")).collect()}
    totals = [by_fold.get(k, (0, 0)) for k in range(FOLDS)]
    n_toxic, n_clean = map(sum, zip(*totals))
    if not n_toxic or not n_clean:
        return ToxicityModel(Lexicon({}), None, None, n_toxic / max(1, n_toxic + n_clean))
    terms = write_table(count_terms(bound), "toxicity-terms")
    lexicons = [learn_lexicon(terms, totals, k, max_entries) for k in (*range(FOLDS), None)]
    parts = [featurize(bound.where(F.col("fold") == k), lexicons[k], carry=["toxic", "fold"]) for k in range(FOLDS)]
    dense = write_table(reduce(DataFrame.union, parts).coalesce(4), "toxicity-features").coalesce(4).cache()
    try:
        trees = GBTClassifier(featuresCol="__features", labelCol="toxic", maxIter=rounds, maxDepth=depth, stepSize=0.2,
                              minInstancesPerNode=5, seed=seed, predictionCol="__predicted")
        trees.setProbabilityCol("__probability").setRawPredictionCol("__margin")
        last = F.col("fold") == FOLDS - 1
        grow = dense.where(~last) if sum(totals[0]) + sum(totals[1]) else dense
        hold = dense.where(last) if sum(totals[FOLDS - 1]) else dense
        trees = trees.fit(grow)
        held = trees.transform(hold).select(vector_to_array("__probability")[1].alias("__raw"), F.col("toxic").cast("double"))
        isotonic = IsotonicRegression(featuresCol="__raw", labelCol="toxic", predictionCol="__level").fit(held)
    finally:
        dense.unpersist()
    return ToxicityModel(lexicons[-1], trees, isotonic, n_toxic / (n_toxic + n_clean))


def held_out() -> Column:
    """Rows whose labels are never learned from."""
    return F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 3 == 1)


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic of labelled rows that may be learned from."""
    marks = (labels.where(~held_out() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    return docs.where(~held_out()).select("doc_id", "text").join(marks, "doc_id")


def scored(spark: SparkSession, docs: DataFrame, sf_dir: str, carry: list[str] | None = None) -> DataFrame:
    model = fit(training_rows(docs, read_table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    return model.score(docs, carry=carry)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str, threshold: float = 0.7) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more."""
    own, _, restore = shielded(docs)
    rows = scored(spark, own, sf_dir, carry=[c for c in own.columns if c != "doc_id"])
    return restore(rows.where(F.col("__score") < threshold).select(*own.columns))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, documents(spark, sf_dir), sf_dir)
    return rows.select("doc_id", held_out().alias("held_out"), F.col("__score").alias("score"),
                       (F.col("__score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLE: dict[str, str] = {}
