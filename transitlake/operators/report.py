"""Aggregate reports: counts, shares, histograms, describe, history (E2-E12,
E16, E17, E26, G1-G5, A3, B21).

All are single ``groupBy``/``agg`` plans (partial + final hash aggregate,
one small shuffle).  Window functions only ever run over already
aggregated rows (a handful of groups), never over raw rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transitlake.schema import CLASSES


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Counts per value, descending (E2), with the share in percent,
    1 decimal (E3); the share window runs over the aggregated rows."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy())
    return counts.withColumn("share_pct", F.round(F.col("count") * 100.0 / total, 1))


def counts_by_day(df: DataFrame, ts: str = "created_at", col: str = "prediction") -> DataFrame:
    """Counts by (day, class)."""
    return df.groupBy(F.to_date(ts).alias("date"), col).agg(F.count(F.lit(1)).alias("count"))


def daily_summary(df: DataFrame, ts: str = "created_at", pred: str = "prediction",
                  conf: str = "confidence") -> DataFrame:
    """Per-day total, per-class counts and mean confidence (E5), newest first."""
    return (df.groupBy(F.to_date(ts).alias("date"))
              .agg(F.count(F.lit(1)).alias("total"),
                   *[F.count(F.when(F.col(pred) == c, 1)).alias(f"n_{c.lower().replace(' ', '_')}")
                     for c in CLASSES],
                   F.avg(conf).alias("mean_confidence"))
              .orderBy(F.desc("date")))


def headline_counts(df: DataFrame, pred: str = "prediction") -> DataFrame:
    """Total and per-class counters (E6) in one pass."""
    return df.agg(F.count(F.lit(1)).alias("total"),
                  *[F.count(F.when(F.col(pred) == c, 1)).alias(f"n_{c.lower().replace(' ', '_')}")
                    for c in CLASSES])


def attach_percentiles(agg: DataFrame, src: DataFrame, by, specs: dict,
                       columns=None) -> DataFrame:
    """Add exact percentiles to ``agg`` (one row per ``by`` group).

    ``specs`` maps an output name to (column, probability).  The values
    come from stats.exact_percentiles over ``src`` (no group's values are
    held in one task), are pivoted to one row per group, and are merged
    into ``agg`` by a union and a per-group ``max`` - no join, so global
    (``by=()``) stats plan no nested-loop join and NULL group keys stay
    matched.  ``columns`` fixes the output order."""
    from transitlake.operators.stats import exact_percentiles
    by = list(by)
    cols = sorted({c for c, _ in specs.values()})
    probs = sorted({float(q) for _, q in specs.values()})
    idx = {q: i for i, q in enumerate(probs)}
    ep = exact_percentiles(src, cols, probs, by)
    piv = ep.groupBy(*by).agg(*[
        F.max(F.when((F.col("feature") == c) & (F.col("prob_idx") == idx[float(q)]), F.col("value")))
         .alias(name) for name, (c, q) in specs.items()])
    merged = agg.unionByName(piv, allowMissingColumns=True)
    rest = [c for c in agg.columns if c not in by] + list(specs)
    out = merged.groupBy(*by).agg(*[F.max(c).alias(c) for c in rest])
    return out.select(*(columns or [*by, *rest]))


def confidence_stats(df: DataFrame, conf: str = "confidence", scale: float = 1.0) -> DataFrame:
    """Mean, exact median, count >= 80% and count < 50%.

    ``scale`` is the value that means 100% (1 for 0-1 storage, 100 for
    percent storage; quirk Q14)."""
    c = F.col(conf)
    agg = df.agg(F.avg(c).alias("mean_confidence"),
                 F.count(F.when(c >= 0.8 * scale, 1)).alias("n_high_confidence"),
                 F.count(F.when(c < 0.5 * scale, 1)).alias("n_low_confidence"))
    return attach_percentiles(agg, df, (), {"median_confidence": (conf, 0.5)},
                              ["mean_confidence", "median_confidence", "n_high_confidence",
                               "n_low_confidence"])


def quantile_ranges(df: DataFrame, cols, lo: float = 0.05, hi: float = 0.95,
                    exact: bool = True) -> DataFrame:
    """Low/high quantile per column with linear interpolation (E8), long form.

    Exact by default through the distributed exact percentile; ``exact=False``
    uses the ``percentile_approx`` sketch."""
    cols = list(cols)
    if not exact:
        aggs = [F.percentile_approx(F.col(c), F.array(F.lit(lo), F.lit(hi)), 10000).alias(c)
                for c in cols]
        stack = ", ".join(f"'{c}', `{c}`[0], `{c}`[1]" for c in cols)
        return df.agg(*aggs).selectExpr(f"stack({len(cols)}, {stack}) as (feature, q_low, q_high)")
    from transitlake.operators.stats import exact_percentiles
    ep = exact_percentiles(df, cols, [lo, hi])
    # every requested column gets a row, NULL quantiles for an all-NULL one
    names = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in cols])).alias("feature"))
    vals = ep.select("feature", F.when(F.col("prob_idx") == 0, F.col("value")).alias("q_low"),
                     F.when(F.col("prob_idx") == 1, F.col("value")).alias("q_high"))
    return (names.unionByName(vals, allowMissingColumns=True)
                 .groupBy("feature").agg(F.max("q_low").alias("q_low"), F.max("q_high").alias("q_high")))


def dataset_overview(df: DataFrame, target: str) -> DataFrame:
    """Samples, per-class counts and column count (E9), one aggregate."""
    return df.agg(F.count(F.lit(1)).alias("n_samples"),
                  *[F.count(F.when(F.col(target) == c, 1)).alias(f"n_{c.lower().replace(' ', '_')}")
                    for c in CLASSES],
                  F.lit(len(df.columns)).alias("n_columns"))


def describe(df: DataFrame, cols, exact: bool = True) -> DataFrame:
    """count, mean, sample std, min, quartiles, max per column (E10), long
    form; quartiles are exact (linear interpolation, distributed) by
    default, the percentile_approx sketch with ``exact=False``."""
    cols = list(cols)
    aggs = []
    for c in cols:
        x = F.col(c)
        fields = [F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
                  F.min(x).cast("double").alias("min"), F.max(x).cast("double").alias("max")]
        if not exact:
            fields.append(F.percentile_approx(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)),
                                              10000).alias("q"))
        aggs.append(F.struct(*fields).alias(c))
    row = df.agg(*aggs)
    q = (lambda c, i: f"`{c}`.q[{i}]") if not exact else (lambda c, i: "CAST(NULL AS DOUBLE)")
    stack = ", ".join(
        f"'{c}', `{c}`.count, `{c}`.mean, `{c}`.std, `{c}`.min, {q(c, 0)}, {q(c, 1)}, {q(c, 2)}, `{c}`.max"
        for c in cols)
    out = row.selectExpr(
        f"stack({len(cols)}, {stack}) as (feature, count, mean, std, min, q25, q50, q75, max)")
    if not exact:
        return out
    from transitlake.operators.stats import exact_percentiles
    ep = exact_percentiles(df, cols, [0.25, 0.5, 0.75])
    qs = ep.select("feature", *[F.when(F.col("prob_idx") == i, F.col("value")).alias(n)
                               for i, n in enumerate(("q25", "q50", "q75"))])
    order = ["feature", "count", "mean", "std", "min", "q25", "q50", "q75", "max"]
    return (out.unionByName(qs, allowMissingColumns=True).groupBy("feature")
               .agg(*[F.max(c).alias(c) for c in order[1:]]).select(*order))


def distinct_sorted(df: DataFrame, col: str) -> DataFrame:
    """Distinct values in order."""
    return df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col)


def nice_step(lo: float, hi: float, max_bins: int) -> float:
    """Bin width on a 1-2-5 ladder giving at most ``max_bins`` bins."""
    span = max(hi - lo, 1e-12)
    raw = span / max_bins
    mag = 10 ** math.floor(math.log10(raw))
    for m in (1, 2, 5, 10):
        if m * mag >= raw:
            return m * mag
    return 10 * mag


def histogram(df: DataFrame, col: str, step: float | None = None, max_bins: int = 20) -> DataFrame:
    """Counts per bin ``floor(x/step)*step`` (E16).  Without a step, the
    step comes from the column's min/max (one tiny aggregate row) on a
    1-2-5 ladder."""
    if step is None:
        mm = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
        if mm["lo"] is None:
            step = 1.0
        else:
            step = nice_step(float(mm["lo"]), float(mm["hi"]), max_bins)
    b = (F.floor(F.col(col) / F.lit(step)) * F.lit(step)).cast("double")
    return (df.where(F.col(col).isNotNull())
              .groupBy(b.alias("bin_start"))
              .agg(F.count(F.lit(1)).alias("count"))
              .withColumn("bin_end", F.col("bin_start") + F.lit(step)))


def habitability_summary(df: DataFrame, score: str = "habitability_score") -> DataFrame:
    """Scored rows, tier counters, max and mean (E17); NULLs are skipped."""
    s = F.col(score)
    return df.agg(F.count(s).alias("scored_rows"),
                  F.count(F.when(s >= 70, 1)).alias("n_high"),
                  F.count(F.when((s >= 40) & (s < 70), 1)).alias("n_moderate"),
                  F.count(F.when(s < 40, 1)).alias("n_low"),
                  F.max(s).alias("max_score"), F.avg(s).alias("mean_score"))


def top_k(df: DataFrame, col: str, k: int, tie: str = "row_id", ascending: bool = False) -> DataFrame:
    """Top k by ``col`` with a deterministic tie-breaker (G2-G4).  Spark
    plans orderBy+limit as TakeOrderedAndProject: each task keeps its own
    top k, so only k rows per partition travel."""
    order: Column = F.col(col).asc_nulls_last() if ascending else F.col(col).desc_nulls_last()
    return df.where(F.col(col).isNotNull()).orderBy(order, F.col(tie).asc()).limit(k)


def null_count(df: DataFrame, col: str) -> Column:
    """Count of NULLs in a column."""
    return F.count(F.when(F.col(col).isNull(), 1))


def preprocessing_comparison(original: DataFrame, processed: DataFrame) -> DataFrame:
    """Shape before and after preprocessing (B28): stage, n_rows, n_columns,
    column_list.  ``column_list`` is the original columns in schema order,
    and for the processed stage the added columns, sorted (empty when none
    were added).  Column sets are schema metadata (no job); each row count
    is one aggregate over its frame."""
    added = sorted(set(processed.columns) - set(original.columns))

    def stage(df, name, names):
        return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("stage"), "n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns"),
            F.lit(",".join(names)).alias("column_list"))

    return stage(original, "original", original.columns).unionByName(stage(processed, "processed", added))
