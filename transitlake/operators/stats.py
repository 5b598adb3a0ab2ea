"""Distribution shift between surveys.

Everything works on the long form (feature, survey, value) produced by
one ``unpivot``, so all features are handled by the same shuffles.

Two-sample Kolmogorov-Smirnov (E14), exact D:
  1. pre-aggregate to (feature, value, nA, nB) - a combinable shuffle that
     also collapses ties, which the empirical CDFs need anyway;
  2. cut each feature's value range into ``blocks`` ranges from
     approximate quantiles (a tiny table; boundaries only steer the work
     distribution, the result does not depend on them);
  3. per (feature, block) totals -> exclusive running offsets over the
     tiny block table;
  4. running sums inside each (feature, block) window plus the offset give
     the exact cumulative counts; D = max |cumA/NA - cumB/NB|.
A feature with 10^9 distinct values is therefore spread over ``blocks``
tasks instead of one window partition.  The p-value uses the asymptotic
Kolmogorov distribution (a column expression); D is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transitlake.schema import MISSION


def long_form(df: DataFrame, features: list[str], group: str = MISSION) -> DataFrame:
    """(feature, group, value) with NULL values dropped."""
    cols = df.select(group, *[F.col(c).cast("double").alias(c) for c in features])
    return (cols.unpivot([group], features, "feature", "value")
                .where(F.col("value").isNotNull()))


def shift_moments(df: DataFrame, features: list[str], a: str = "KEPLER", b: str = "TESS",
                  group: str = MISSION, min_count: int = 10) -> DataFrame:
    """Per feature: mean and sample std per survey, mean_diff_pct (E13);
    features with fewer than ``min_count`` values on either side are skipped."""
    lf = long_form(df, features, group).where(F.col(group).isin(a, b))
    g = lf.groupBy("feature").agg(
        F.avg(F.when(F.col(group) == a, F.col("value"))).alias("a_mean"),
        F.stddev_samp(F.when(F.col(group) == a, F.col("value"))).alias("a_std"),
        F.count(F.when(F.col(group) == a, 1)).alias("a_n"),
        F.avg(F.when(F.col(group) == b, F.col("value"))).alias("b_mean"),
        F.stddev_samp(F.when(F.col(group) == b, F.col("value"))).alias("b_std"),
        F.count(F.when(F.col(group) == b, 1)).alias("b_n"))
    g = g.where((F.col("a_n") >= min_count) & (F.col("b_n") >= min_count))
    diff = F.abs(F.col("a_mean") - F.col("b_mean")) / (F.abs(F.col("a_mean")) + F.lit(1e-10)) * 100
    la, lb = a.lower(), b.lower()
    return g.select("feature",
                    F.col("a_mean").alias(f"{la}_mean"), F.col("a_std").alias(f"{la}_std"),
                    F.col("b_mean").alias(f"{lb}_mean"), F.col("b_std").alias(f"{lb}_std"),
                    diff.alias("mean_diff_pct"))


def _count_below(bounds, value, n: int):
    """Number of entries of the sorted array ``bounds`` (length ``n``) that
    are below ``value`` - a balanced CASE tree (log2 n comparisons per
    row, inside whole-stage codegen) instead of a lambda over the array."""
    def tree(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(bounds[mid] < value, tree(mid + 1, hi)).otherwise(tree(lo, mid))
    return tree(0, n)


def _as_is(df: DataFrame) -> DataFrame:
    return df


def blocked_running_sums(agg: DataFrame, part: str, order: str, sums: list[str],
                         blocks: int = 64, small=_as_is) -> DataFrame:
    """Inclusive running sums ``cum_<c>`` of ``sums`` over ``order`` within
    each ``part`` group, without one window partition per group: values
    are cut into ``blocks`` ranges by approximate quantiles, per-block
    totals give exclusive offsets (tiny table), and the running sum runs
    per (group, block).  Exact for any boundaries; ``order`` values must
    be distinct within a group (pre-aggregated input).  ``small`` marks the
    boundaries and offsets (``blocks`` rows per group) for the join: pass
    ``F.broadcast`` where the number of groups is bounded, so that the
    values of one group are not gathered by its key."""
    probs = [i / blocks for i in range(1, blocks)]
    bounds = agg.groupBy(part).agg(F.percentile_approx(order, probs, 1000).alias("_bounds"))
    blk = (agg.join(small(bounds), part)
              .withColumn("_blk", _count_below(F.col("_bounds"), F.col(order), len(probs)))
              .drop("_bounds"))
    totals = blk.groupBy(part, "_blk").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    prior = Window.partitionBy(part).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(part, "_blk", *[F.coalesce(F.sum(f"_t_{c}").over(prior), F.lit(0))
                                            .alias(f"_o_{c}") for c in sums])
    run = Window.partitionBy(part, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = blk.join(small(offsets), [part, "_blk"])
    out = out.withColumns({f"cum_{c}": F.sum(c).over(run) + F.col(f"_o_{c}") for c in sums})
    return out.drop("_blk", *[f"_o_{c}" for c in sums])


def ks_statistic(df: DataFrame, features: list[str], a: str = "KEPLER", b: str = "TESS",
                 group: str = MISSION, min_count: int = 10, blocks: int = 64) -> DataFrame:
    """Exact two-sample KS D per feature: feature, n_a, n_b, d_stat."""
    lf = long_form(df, features, group).where(F.col(group).isin(a, b))
    agg = lf.groupBy("feature", "value").agg(
        F.count(F.when(F.col(group) == a, 1)).alias("na"),
        F.count(F.when(F.col(group) == b, 1)).alias("nb"))
    tot = agg.groupBy("feature").agg(F.sum("na").alias("_tot_a"), F.sum("nb").alias("_tot_b"))
    # one row per named feature, so the small sides are bounded by the call
    cum = blocked_running_sums(agg, "feature", "value", ["na", "nb"], blocks, F.broadcast).join(F.broadcast(tot), "feature")
    gap = F.abs(F.col("cum_na") / F.col("_tot_a") - F.col("cum_nb") / F.col("_tot_b"))
    return (cum.groupBy("feature").agg(F.max(gap).alias("d_stat"),
                                       F.first("_tot_a").alias("n_a"), F.first("_tot_b").alias("n_b"))
               .where((F.col("n_a") >= min_count) & (F.col("n_b") >= min_count))
               .select("feature", "n_a", "n_b", "d_stat"))


def ks_pvalue(d, n_a, n_b, terms: int = 100):
    """Asymptotic two-sided p-value 2 * sum_k (-1)^(k-1) exp(-2 k^2 L^2),
    L = D sqrt(n_a n_b / (n_a + n_b)), clipped to [0, 1]."""
    lam = d * F.sqrt(n_a * n_b / (n_a + n_b))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
        lambda acc, k: acc + F.pow(F.lit(-1.0), k - 1) * F.exp(-2.0 * k * k * lam * lam))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(2.0) * series))


EXACT_ROWS = 10_000  # samples up to this size get the exact p-value


def two_sample_tail(d: float, n_a: int, n_b: int) -> float:
    """P(D >= d) of the two-sided two-sample statistic when both samples come
    from one continuous distribution.

    The pooled order of the samples is a random lattice path from (0, 0) to
    (n_a, n_b), and D >= d if it leaves the band |i / n_a - j / n_b| < d.  The
    path is followed step by step: ``f`` is the chance of each i after t steps
    without having left, and what leaves is added up, so that a tiny p-value
    keeps all its digits."""
    edge, total, tail = round(d * n_a * n_b), n_a + n_b, 0.0
    if edge <= 0:
        return 1.0
    low, f = 0, np.ones(1)
    for t in range(total):
        i = np.arange(low, low + len(f))
        step = np.zeros(len(f) + 1)
        step[:-1] = f * ((n_b - (t - i)) / (total - t))
        step[1:] += f * ((n_a - i) / (total - t))
        i = np.arange(low, low + len(step))
        inside = np.abs(i * total - (t + 1) * n_a) < edge
        tail += float(step[~inside].sum())
        kept = np.flatnonzero(inside)
        if not len(kept):
            break
        low, f = low + int(kept[0]), step[kept[0]:kept[-1] + 1]
    return min(1.0, tail)


def ks_exact_pvalue(d, n_a, n_b, most: int = EXACT_ROWS):
    """Exact p-value; NULL where a sample has over ``most`` values.  One value
    per aggregated row (a feature), never per value."""
    @F.arrow_udf("double")
    def tail(d: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        rows = zip(d.to_pylist(), a.to_pylist(), b.to_pylist())
        return pa.array([two_sample_tail(x, m, n) if None not in (x, m, n) and max(m, n) <= most else None for x, m, n in rows], pa.float64())

    return tail(d, n_a, n_b)


def ks_test(df: DataFrame, features: list[str], alpha: float = 0.05, exact_rows: int = EXACT_ROWS, **kw) -> DataFrame:
    """KS D, p-value and significance flag per feature (E14): the exact p-value
    where both samples have at most ``exact_rows`` values, else the limit."""
    k = ks_statistic(df, features, **kw)
    p = ks_pvalue(F.col("d_stat"), F.col("n_a").cast("double"), F.col("n_b").cast("double"))
    if exact_rows:
        p = F.coalesce(ks_exact_pvalue(F.col("d_stat"), F.col("n_a"), F.col("n_b"), exact_rows), p)
    return k.withColumn("p_value", p).withColumn("significant", F.col("p_value") < alpha)


def shift_summary(ks: DataFrame) -> DataFrame:
    """Number and share of significantly shifted features."""
    return ks.agg(F.count(F.lit(1)).alias("n_features"),
                  F.count(F.when(F.col("significant"), 1)).alias("n_significant")).withColumn(
        "share_significant_pct",
        F.round(F.col("n_significant") * 100.0 / F.col("n_features"), 1))


def exact_percentiles(df: DataFrame, cols, probs, by=()) -> DataFrame:
    """Exact percentiles with Spark ``percentile`` semantics (linear
    interpolation between the closest ranks of the non-null values), for
    each column at each probability, per group ``by``.

    ``percentile`` / ``median`` keep a value -> count map of a whole group
    in one task; a group holding a third of 10^10 distinct values does not
    fit.  Here values are pre-aggregated to one row per distinct value
    (combinable shuffle), running counts come from per-value-block windows
    (blocked_running_sums), and the target ranks - one small row per
    (group, column, probability) - are matched to the value rows through an
    equi-join on the group key plus a rank-range filter.

    Output: *by, feature, prob_idx, value (no row for an all-NULL column).
    """
    by, cols, probs = list(by), list(cols), [float(p) for p in probs]
    stack = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
    long = df.select(*by, F.expr(f"stack({len(cols)}, {stack}) AS (feature, value)"))
    part = F.struct(*[F.col(b) for b in by], F.col("feature"))
    vals = (long.where(F.col("value").isNotNull())
                .groupBy(*by, "feature", "value").agg(F.count(F.lit(1)).alias("c"))
                .withColumn("_part", part))
    # without ``by`` there is a group per named column: bounded by the call
    small = _as_is if by else F.broadcast
    cum = blocked_running_sums(vals, "_part", "value", ["c"], small=small)
    pr = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("p")) for i, p in enumerate(probs)])
    targets = (vals.groupBy("_part").agg(F.sum("c").alias("_n"))
                   .select("_part", "_n", F.inline(pr))
                   .withColumn("_h", (F.col("_n") - 1).cast("double") * F.col("p"))
                   .select("_part", F.col("i").alias("prob_idx"), "_h",
                           F.floor("_h").alias("_l"), F.ceil("_h").alias("_u")))
    lo, hi = F.col("cum_c") - F.col("c"), F.col("cum_c") - 1
    hit = cum.select("_part", "value", lo.alias("_lo"), hi.alias("_hi")).join(small(targets), "_part")
    is_l = (F.col("_l") >= F.col("_lo")) & (F.col("_l") <= F.col("_hi"))
    is_u = (F.col("_u") >= F.col("_lo")) & (F.col("_u") <= F.col("_hi"))
    pts = (hit.where(is_l | is_u).groupBy("_part", "prob_idx")
              .agg(F.max(F.when(is_l, F.col("value"))).alias("_xl"),
                   F.max(F.when(is_u, F.col("value"))).alias("_xu"),
                   F.first("_h").alias("_h"), F.first("_l").alias("_l"), F.first("_u").alias("_u")))
    v = (F.when((F.col("_u") == F.col("_l")) | (F.col("_xl") == F.col("_xu")), F.col("_xl"))
          .otherwise((F.col("_u") - F.col("_h")) * F.col("_xl") + (F.col("_h") - F.col("_l")) * F.col("_xu")))
    return pts.select(*[F.col("_part")[b].alias(b) for b in by], F.col("_part.feature").alias("feature"),
                      "prob_idx", v.alias("value"))
