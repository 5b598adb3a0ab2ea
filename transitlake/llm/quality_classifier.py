"""Operator 12: quality by regularised quadratic discriminant analysis.

Every text becomes a short vector of transformed statistics: logs of sizes and
smoothed log odds of rates (symbols, capitals, digits, repeated words, word
pairs and lines, ...), so that no value is unbounded and a short text's rates
are drawn to the middle.  Each class gets a mean and a covariance, shrunk
towards the pooled one and that towards its diagonal.  A text's score is the
logistic of the difference of the classes' log densities: Mahalanobis distances
from cached inverse Cholesky factors, log determinants and log priors, times a
temperature.

Fitting reads all labelled rows, whatever their number: a class needs only the
sums of its rows, their vectors and the vectors' products, added up in the
tasks and then per fold.  Three folds by hash of the id give the amount of
shrinkage and the temperature: of a fixed grid the pair with the least log loss
of each fold under the other folds' moments.  The driver receives these sums,
their number fixed by the length of the vector.  Every text is read once:
its vector is written, joined with its label for fitting (vectors are shuffled,
never texts, and by the same kind of join at every size) and scored.

Rows: null texts are empty; an empty text gets the score of its vector (all
counts zero) like any other.  Labels that are null or neither 0 nor 1 are not
used, labels of an id that disagree count as 0; with one class only among the
labels every score is the share of ones, without labels 0.  Repeated rows each
give a row; extra columns are carried where asked for.
"""

from __future__ import annotations

import math
import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transitlake.llm.common import documents, map_texts, write_table
from transitlake.sources.tables import read_table

FOLDS = 3
FEATURES = ["log_words", "log_word_chars", "word_char_spread", "symbol_odds", "stop_odds", "mark_odds", "upper_odds", "digit_odds",
            "adjacent_odds", "top_word_odds", "distinct_odds", "pair_odds", "bare_odds", "line_odds", "log_line_words"]
SHRINK = [(c, d) for c in (0.02, 0.1, 0.3, 0.6, 0.9) for d in (0.01, 0.1, 0.4)]  # towards the pooled covariance, its diagonal
TEMPERATURES = (1.0, 0.6, 0.35, 0.2)
LETTER, UPPER, DIGIT, STOP, MARK, SYMBOL, SPACE = 1, 2, 3, 4, 5, 6, 7


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Kind of each code point of the basic plane; others count as letters."""
    out = np.full(1 << 16, LETTER, "u1")
    for code in range(1 << 16):
        ch = chr(code)
        group = unicodedata.category(ch)
        out[code] = (SPACE if ch.isspace() else UPPER if group == "Lu" else DIGIT if group[0] == "N" else STOP if ch in ".,;:"
                     else MARK if ch in "!?\"'()-" else SYMBOL if group[0] in "PSC" and group != "Cs" else LETTER)
    return out


def _per_text(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, weights=values, minlength=n)


def text_vectors(texts: list[str]) -> np.ndarray:
    """One row of FEATURES per text."""
    n = len(texts)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    kind = _kinds()[np.minimum(codes, (1 << 16) - 1)]
    owner = np.repeat(np.arange(n), [len(t) for t in texts])
    chars = np.bincount(owner * 8 + kind, minlength=8 * n).reshape(n, 8).astype(float)
    split = [t.split() for t in texts]
    n_words = np.array([len(w) for w in split], "i8")
    flat = [w for words in split for w in words]
    text_of = np.repeat(np.arange(n), n_words)
    ids = pa.array(flat, pa.string()).dictionary_encode().indices.to_numpy().astype("i8") if flat else np.zeros(0, "i8")
    size = np.array([len(w) for w in flat], float)
    bare = np.array([not any(map(str.isalnum, w)) for w in flat], float)
    wide = int(ids.max(initial=0)) + 1
    mine, times = np.unique(text_of * wide + ids, return_counts=True)
    distinct = np.bincount(mine // wide, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, mine // wide, times)
    same = text_of[1:] == text_of[:-1]
    adjacent = _per_text((ids[1:] == ids[:-1])[same].astype(float), text_of[1:][same], n)
    pair_owner = text_of[1:][same]
    _, pair = np.unique(ids[:-1][same] * wide + ids[1:][same], return_inverse=True)
    many = int(pair.max(initial=0)) + 1
    pairs, pair_times = np.unique(pair_owner * many + pair, return_counts=True)
    repeated = _per_text((pair_times - 1).astype(float), pairs // many, n)
    lines = [[x for x in t.split("\n") if x and not x.isspace()] for t in texts]
    n_lines = np.array([len(x) for x in lines], float)
    again = np.array([len(x) - len(set(x)) for x in lines], float)
    w = n_words.astype(float)
    some = np.maximum(w, 1)
    mean = _per_text(size, text_of, n) / some
    spread = np.sqrt(np.maximum(_per_text(size * size, text_of, n) / some - mean * mean, 0))
    odds = lambda k, of, a=0.5, b=10.0: np.log((k + a) / (np.maximum(of - k, 0) + b))
    letters = chars[:, LETTER] + chars[:, UPPER]
    return np.column_stack([
        np.log1p(w), np.log1p(mean), np.log1p(spread), odds(chars[:, SYMBOL], w), odds(chars[:, STOP], w, 1.0, 8.0),
        odds(chars[:, MARK], w), odds(chars[:, UPPER], letters, 2.0, 40.0), odds(chars[:, DIGIT], letters, 1.0, 60.0),
        odds(adjacent, w), odds(top, w, 1.0, 10.0), odds(w - distinct, w, 1.0, 5.0), odds(repeated, w),
        odds(_per_text(bare, text_of, n), w), odds(again, n_lines, 0.5, 3.0), np.log1p(w / np.maximum(n_lines, 1))])


@dataclass
class QualityModel:
    """Per class mean and inverse Cholesky factor; without factors a prior."""
    prior: float
    means: list = field(default_factory=list)
    whiten: list = field(default_factory=list)
    offsets: list = field(default_factory=list)  # log prior - half log determinant
    temperature: float = 1.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, priors included."""
        each = [o - 0.5 * np.square((x - m) @ w.T).sum(axis=1) for m, w, o in zip(self.means, self.whiten, self.offsets)]
        return each[1] - each[0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.temperature * self.margin(x), -500, 500)))

    def score(self, vectors: DataFrame) -> DataFrame:
        """``vectors`` with __score, the probability of label 1, for __x.  A
        column of that name gives way to it."""
        src = vectors.drop("__score")
        names = [*(c for c in src.columns if c != "__x"), "__score"]
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "__x"), "__score double"])

        def run(batches):
            for batch in batches:
                kept = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "__x"]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(self.probability(_column(batch, "__x")), pa.float64())], names=names)

        return src.mapInArrow(run, schema)


def vectors(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """id, ``carry`` and the text's vector __x, written as a table.  A carried
    column of that name gives way to it."""
    def run(texts):
        x = text_vectors(texts)
        ends = pa.array(np.arange(len(x) + 1, dtype="i4") * x.shape[1])
        return [pa.ListArray.from_arrays(ends, pa.array(x.ravel()))]

    return write_table(map_texts(df, id_col, text_col, "__x array<double>", run, [c for c in carry or [] if c != "__x"]), "quality-vectors")


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy().reshape(batch.num_rows, -1)


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return batch.column("fold").to_numpy(), batch.column("quality").to_numpy(), _column(batch, "__x")


def _sum_arrays(df: DataFrame, keys: list[str], run, width: int) -> dict:
    """Arrays that ``run`` makes of the tasks' batches, added up per key."""
    names = [*keys, "sums"]

    def partial(batches):
        held: dict = {}
        for batch in batches:
            if batch.num_rows:
                for key, value in run(batch):
                    held[key] = held[key] + value if key in held else value
        cols = [pa.array([k[i] for k in held], pa.int32()) for i in range(len(keys))]
        yield pa.RecordBatch.from_arrays([*cols, pa.array([v.tolist() for v in held.values()], pa.list_(pa.float64()))], names=names)

    parts = df.mapInArrow(partial, ", ".join([*(f"{k} int" for k in keys), "sums array<double>"]))
    sums = (parts.select(*keys, F.posexplode("sums").alias("i", "v")).groupBy(*keys, "i").agg(F.sum("v").alias("v"))
            .groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("all")))
    out = {tuple(r[k] for k in keys): np.array([e.v for e in r["all"]]) for r in sums.collect()}
    assert all(len(v) == width for v in out.values())
    return out


def class_moments(rows: DataFrame) -> dict:
    """(fold, class) -> row count, vector sum and product sum, in one array."""
    d = len(FEATURES)

    def run(batch):
        fold, y, x = _matrix(batch)
        for f in range(FOLDS):
            for c in (0, 1):
                part = x[(fold == f) & (y == c)]
                if len(part):
                    yield (f, c), np.concatenate([[len(part)], part.sum(axis=0), (part.T @ part).ravel()])

    return _sum_arrays(rows, ["fold", "quality"], run, 1 + d + d * d)


def discriminant(moments: dict, folds: list[int], shrink: tuple[float, float], temperature: float = 1.0) -> QualityModel:
    """The model of the rows of ``folds`` under one amount of shrinkage."""
    d = len(FEATURES)
    zero = np.zeros(1 + d + d * d)
    sums = [sum((moments.get((f, c), zero) for f in folds), zero) for c in (0, 1)]
    n = [s[0] for s in sums]
    if min(n) < 2:
        return QualityModel(n[1] / max(1.0, sum(n)))
    means = [s[1:1 + d] / s[0] for s in sums]
    scatter = [s[1 + d:].reshape(d, d) - s[0] * np.outer(m, m) for s, m in zip(sums, means)]
    to_pooled, to_diagonal = shrink
    pooled = sum(scatter) / sum(n)
    diagonal = np.maximum(np.diag(pooled), 1e-6)
    pooled = (1 - to_diagonal) * pooled + to_diagonal * np.diag(diagonal) + 1e-6 * np.diag(diagonal)
    model = QualityModel(n[1] / sum(n), means, temperature=temperature)
    for c in (0, 1):
        factor = np.linalg.cholesky((1 - to_pooled) * scatter[c] / n[c] + to_pooled * pooled)
        model.whiten.append(np.linalg.inv(factor))
        model.offsets.append(math.log(n[c] / sum(n)) - np.log(np.diag(factor)).sum())
    return model


def fit(labelled: DataFrame, seed: int = 11) -> QualityModel:
    """``labelled``: doc_id, __x, quality, one row per text."""
    fold = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(FOLDS)).cast("int")
    rows = write_table(labelled.where("quality in (0, 1)").select(fold.alias("fold"), F.col("quality").cast("int").alias("quality"), "__x"),
                       "quality-labelled")
    moments = class_moments(rows)
    everything = list(range(FOLDS))
    trials = [(f, s, discriminant(moments, [k for k in everything if k != f], shrink))
              for f in everything for s, shrink in enumerate(SHRINK)]
    if any(not m.means for _, _, m in trials):
        return discriminant(moments, everything, SHRINK[len(SHRINK) // 2])
    width = len(SHRINK) * len(TEMPERATURES)

    def losses(batch):
        fold, y, x = _matrix(batch)
        total = np.zeros((len(SHRINK), len(TEMPERATURES)))
        for f, s, model in trials:
            mine = fold == f
            margin = np.clip(model.margin(x[mine]) * np.where(y[mine] == 1, 1, -1), -1e6, 1e6)
            for t, temperature in enumerate(TEMPERATURES):
                total[s, t] += np.logaddexp(0, -temperature * margin).sum()
        yield (0,), total.ravel()

    best = int(np.argmin(_sum_arrays(rows, ["k"], losses, width)[(0,)]))
    return discriminant(moments, everything, SHRINK[best // len(TEMPERATURES)], TEMPERATURES[best % len(TEMPERATURES)])


def held_out() -> Column:
    """Rows whose labels are never learned from."""
    return F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 3 == 1)


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` (vectors) with the quality of labelled rows that may be learned from."""
    marks = (labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
             .groupBy("doc_id").agg(F.min("quality").alias("quality")))
    return docs.where(~held_out()).select("doc_id", "__x").join(marks.hint("merge"), "doc_id")


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = vectors(documents(spark, sf_dir))
    model = fit(training_rows(docs, read_table(spark, sf_dir, "labels").select("doc_id", "quality")))
    return model.score(docs).select("doc_id", held_out().alias("held_out"), F.col("__score").alias("score"),
                                    (F.col("__score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op12_quality": op12_quality}
ORACLE: dict[str, str] = {}
