"""Classification metrics as aggregates.

Everything derives from one ``groupBy(label, prediction).count()`` - a
table of at most k^2 rows - so the metric math never touches raw rows
twice.  Class lists are plan-time constants (the label encoder's
classes), which fixes the output schema even when a class is never
predicted.  zero_division = 0 everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transitlake.schema import CLASSES


def class_key(name: str) -> str:
    """Class name -> metric key: lower case, spaces to underscores."""
    return name.lower().replace(" ", "_")


def pair_counts(df: DataFrame, label: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(pred).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, label: str, pred: str, classes=CLASSES) -> DataFrame:
    """Rows: true class; one count column per predicted class."""
    pc = pair_counts(df, label, pred)
    wide = pc.groupBy("label").pivot("prediction", list(classes)).agg(F.sum("n"))
    cols = [F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("long").alias(f"pred_{class_key(c)}")
            for c in classes]
    return wide.select(F.col("label").alias("true_label"), *cols)


def per_class(df: DataFrame, label: str, pred: str, classes=CLASSES) -> DataFrame:
    """Per class: tp, support, predicted count, precision, recall, f1."""
    pc = pair_counts(df, label, pred)
    agg = pc.select(
        F.explode(F.array(*[F.lit(c) for c in classes])).alias("cls"), "label", "prediction", "n"
    ).groupBy("cls").agg(
        F.sum(F.when((F.col("label") == F.col("cls")) & (F.col("prediction") == F.col("cls")),
                     F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("label") == F.col("cls"), F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("prediction") == F.col("cls"), F.col("n")).otherwise(0)).alias("predicted"))
    p = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    out = agg.withColumn("precision", p).withColumn("recall", r)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))
                ).otherwise(0.0)
    return out.withColumn("f1", f1).withColumnRenamed("cls", "class")


def summary_metrics(df: DataFrame, label: str, pred: str, classes=CLASSES) -> DataFrame:
    """Accuracy; macro and support-weighted precision / recall / F1."""
    pcl = per_class(df, label, pred, classes)
    k = len(classes)
    return pcl.agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        (F.sum("precision") / k).alias("macro_precision"),
        (F.sum("recall") / k).alias("macro_recall"),
        (F.sum("f1") / k).alias("macro_f1"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("weighted_precision"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("weighted_recall"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
        F.sum("support").alias("n"))


def classification_report(df: DataFrame, label: str, pred: str, classes=CLASSES) -> DataFrame:
    """Full report (E19): one row per class plus 'macro avg' and
    'weighted avg' rows; columns precision, recall, f1, support."""
    pcl = per_class(df, label, pred, classes).select(
        "class", "precision", "recall", "f1", "support")
    s = summary_metrics(df, label, pred, classes)
    macro = s.select(F.lit("macro avg").alias("class"), F.col("macro_precision").alias("precision"),
                     F.col("macro_recall").alias("recall"), F.col("macro_f1").alias("f1"),
                     F.col("n").alias("support"))
    weighted = s.select(F.lit("weighted avg").alias("class"),
                        F.col("weighted_precision").alias("precision"),
                        F.col("weighted_recall").alias("recall"),
                        F.col("weighted_f1").alias("f1"), F.col("n").alias("support"))
    return pcl.unionByName(macro).unionByName(weighted)


def normalized_confusion(df: DataFrame, label: str, pred: str, classes=CLASSES) -> DataFrame:
    """Row-normalized matrix in percent and per-class accuracy."""
    cm = confusion_matrix(df, label, pred, classes)
    cols = [f"pred_{class_key(c)}" for c in classes]
    total = sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
    out = cm.withColumn("_t", total)
    pct = {f"{c}_pct": F.when(F.col("_t") > 0, F.col(c) * 100.0 / F.col("_t")).otherwise(0.0)
           for c in cols}
    diag = F.lit(0.0)
    for c in classes:
        diag = F.when(F.col("true_label") == c, F.col(f"pred_{class_key(c)}_pct")).otherwise(diag)
    return out.withColumns(pct).withColumn("class_accuracy_pct", diag).drop("_t", *cols)


def report_long(report: DataFrame) -> DataFrame:
    """Wide class report -> (class, metric, value)."""
    return report.select("class", "precision", "recall", "f1").unpivot(
        ["class"], ["precision", "recall", "f1"], "metric", "value")


def ovr_auc(df: DataFrame, label: str, prob_cols: dict, classes=CLASSES) -> DataFrame:
    """One-vs-rest ROC AUC per class and the support-weighted mean.

    Rank-sum with ties counted half, computed from counts per distinct
    score: AUC_c = sum_s pos_s * (neg_below_s + neg_at_s / 2) / (P * N).
    Scores are first aggregated per (class, score), so the running sum
    only sees distinct scores, and it runs per value block
    (stats.blocked_running_sums); ``prob_cols`` maps class -> score column.
    """
    parts = None
    for c in classes:
        part = df.select(F.lit(c).alias("cls"), F.col(prob_cols[c]).cast("double").alias("score"),
                         (F.col(label) == c).alias("pos"))
        parts = part if parts is None else parts.unionByName(part)
    by_score = parts.groupBy("cls", "score").agg(
        F.count(F.when(F.col("pos"), 1)).alias("p"), F.count(F.when(~F.col("pos"), 1)).alias("q"))
    # exclusive running count of negatives below each distinct score, by
    # value blocks so a class with ~N distinct scores is not one task
    from transitlake.operators.stats import blocked_running_sums
    # one group per named class: the boundaries and offsets are bounded by the call
    cum = blocked_running_sums(by_score, "cls", "score", ["q"], small=F.broadcast).withColumn(
        "q_below", F.col("cum_q") - F.col("q"))
    per = cum.groupBy("cls").agg(
        F.sum(F.col("p") * (F.col("q_below") + F.col("q") / 2.0)).alias("_s"),
        F.sum("p").alias("support"), F.sum("q").alias("negatives"))
    auc = F.when((F.col("support") > 0) & (F.col("negatives") > 0),
                 F.col("_s") / (F.col("support") * F.col("negatives")))
    per = per.select(F.col("cls").alias("class"), auc.alias("auc"), "support")
    wavg = per.agg((F.sum(F.col("auc") * F.col("support")) / F.sum("support")).alias("auc"),
                   F.sum("support").alias("support")).select(
        F.lit("weighted").alias("class"), "auc", "support")
    return per.unionByName(wavg)


def probability_map(prob_array, classes=CLASSES):
    """array<double> of class probabilities -> map class -> p."""
    return F.map_from_arrays(F.array(*[F.lit(c) for c in classes]), prob_array)


def argmax_label(prob_array, classes=CLASSES):
    """Class of the largest probability (first on ties)."""
    pos = F.array_position(prob_array, F.array_max(prob_array))
    return F.element_at(F.array(*[F.lit(c) for c in classes]), pos.cast("int"))
