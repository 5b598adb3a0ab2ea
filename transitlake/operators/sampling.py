"""Exact, reproducible stratified sampling and splits.

Randomness is a hash, not an RNG: every row's order key is
``md5('<seed>:<row_id>')``, so a split is independent of partitioning,
re-runs identically after executor loss, and can be checked by any SQL
engine (``row_number() OVER (PARTITION BY stratum ORDER BY key, row_id)
<= quota``).

Scale: ranking whole strata would put each stratum (survey x class, a
handful of groups, one of them possibly a third of all rows) in one
task.  Instead the first 16 bits of the key give 65,536 buckets per
stratum; bucket counts are aggregated (a tiny table), cumulated, and the
bucket holding the quota boundary is found.  Rows below it are selected,
rows above it are not, and only the rows of that single cut bucket are
ranked - about count/65,536 rows per stratum.  The result is exactly
the top-``quota`` rows by (key, row_id) in every stratum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transitlake.schema import MISSION, ROW_ID, TARGET
from transitlake.sources.materialize import materialize

BUCKET_HEX = 4  # 16 bits -> 65,536 buckets
MAX_BROADCAST_STRATA = 100_000  # beyond it the same joins shuffle


def order_key(seed: int, row_id: str = ROW_ID) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row_id).cast("string")))


def select_by_quota(df: DataFrame, strata: list[str], quotas: DataFrame, seed: int = 42,
                    row_id: str = ROW_ID, flag: str = "selected") -> DataFrame:
    """Mark the first ``quota`` rows of each stratum in hash order.

    ``quotas`` has the strata columns plus an integer ``quota`` column
    (strata absent from it get quota 0).  Adds boolean ``flag``; keeps
    every input row (train/test are two filters on the flag, no join).
    """
    keyed = (df.withColumn("_k", order_key(seed, row_id))
               .withColumn("_b", F.conv(F.substring("_k", 1, BUCKET_HEX), 16, 10).cast("int")))
    # bucket histogram per stratum: at most 65,536 rows per stratum
    hist = keyed.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*strata).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumn("_cum", F.sum("_n").over(w))
    q = quotas.select(*strata, F.col("quota").cast("long").alias("quota"))
    hq = hist.join(q, on=strata, how="inner")
    # the cut bucket: first bucket whose cumulative count reaches the quota
    cut = (hq.where((F.col("_cum") >= F.col("quota")) & (F.col("_cum") - F.col("_n") < F.col("quota")))
             .select(*strata, F.col("_b").alias("_cut_b"),
                     (F.col("quota") - (F.col("_cum") - F.col("_n"))).alias("_need")))
    # quota >= stratum size: everything selected (cut past the last bucket)
    cuts = (q.join(cut, on=strata, how="left")
             .select(*strata, F.coalesce("_cut_b", F.when(F.col("quota") > 0, F.lit(1 << 30))
                                         .otherwise(F.lit(-1))).alias("_cut_b"),
                     F.coalesce("_need", F.lit(0)).alias("_need")))
    # one row per stratum, written so that its number is known before it is broadcast
    cuts = materialize(cuts, "cuts")
    few = F.broadcast if cuts.count() <= MAX_BROADCAST_STRATA else lambda x: x
    # the last selected key of each stratum: only rows of cut buckets are ranked
    edge = keyed.join(few(cuts), on=strata).where(F.col("_b") == F.col("_cut_b"))
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy("_k", row_id))
    last = (edge.withColumn("_r", rank).where(F.col("_r") == F.col("_need"))
                .select(*strata, F.struct("_k", F.col(row_id).alias("_id")).alias("_last")))
    bounds = materialize(cuts.join(last, on=strata, how="left").drop("_need"), "cut-keys")
    j = keyed.join(few(bounds), on=strata, how="left")
    at_cut = F.struct("_k", F.col(row_id).alias("_id")) <= F.col("_last")
    chosen = F.when(F.col("_b") < F.col("_cut_b"), F.lit(True)).when(F.col("_b") == F.col("_cut_b"), at_cut)
    return j.withColumn(flag, F.coalesce(chosen, F.lit(False))).drop("_k", "_b", "_cut_b", "_last")


def stratum_counts(df: DataFrame, strata: list[str]) -> DataFrame:
    return df.groupBy(*strata).agg(F.count(F.lit(1)).alias("cnt"))


def survey_first_quotas(df: DataFrame, tess_share: float = 0.55, train_share: float = 0.8,
                        mission: str = MISSION, target: str = TARGET) -> DataFrame:
    """Quotas of the survey-first split (J1) as a tiny DataFrame.

    T = int(0.8 N); nT = int(T * tess_share); nK = T - nT; if TESS is
    short nT = all TESS and nK = T - nT; then if KEPLER is short nK = all
    KEPLER and nT = T - nK.  Per class c of a survey s:
    int(n_s * (count_c / count_s)).  Window sums run over the aggregated
    (survey, class) rows only."""
    c = stratum_counts(df, [mission, target])
    allw = Window.partitionBy()
    n_total = F.sum("cnt").over(allw)
    n_tess = F.sum(F.when(F.col(mission) == "TESS", F.col("cnt")).otherwise(0)).over(allw)
    n_kep = F.sum(F.when(F.col(mission) == "KEPLER", F.col("cnt")).otherwise(0)).over(allw)
    c = c.withColumns({"_N": n_total, "_NT": n_tess, "_NK": n_kep,
                       "_S": F.sum("cnt").over(Window.partitionBy(mission))})
    t = F.floor(F.col("_N") * F.lit(train_share)).cast("long")
    c = c.withColumn("_T", t)
    nt0 = F.floor(F.col("_T") * F.lit(tess_share)).cast("long")
    c = c.withColumn("_nT", F.least(nt0, F.col("_NT")))
    c = c.withColumn("_nK", F.col("_T") - F.col("_nT"))
    c = c.withColumn("_nT", F.when(F.col("_nK") > F.col("_NK"), F.col("_T") - F.col("_NK"))
                     .otherwise(F.col("_nT")))
    c = c.withColumn("_nK", F.least(F.col("_nK"), F.col("_NK")))
    n_s = F.when(F.col(mission) == "TESS", F.col("_nT")).when(F.col(mission) == "KEPLER", F.col("_nK"))
    quota = F.floor(n_s * (F.col("cnt") / F.col("_S"))).cast("long")
    return c.select(mission, target, F.coalesce(quota, F.lit(0)).alias("quota"))


def survey_first_split(df: DataFrame, tess_share: float = 0.55, train_share: float = 0.8,
                       seed: int = 42, mission: str = MISSION, target: str = TARGET,
                       row_id: str = ROW_ID) -> DataFrame:
    """Exact survey x class stratified split (J1); adds ``is_train``."""
    q = survey_first_quotas(df, tess_share, train_share, mission, target)
    return select_by_quota(df, [mission, target], q, seed, row_id, "is_train")


def largest_remainder_quotas(df: DataFrame, strata: list[str], n_select_expr,
                             by=()) -> DataFrame:
    """Quotas proportional to stratum size that sum exactly to
    ``n_select_expr(N)`` within each group ``by`` (N = group size):
    floors, plus one unit for the largest remainders (ties by stratum
    key).  Windows run over the aggregated stratum rows only."""
    keys = list(by) + [s for s in strata if s not in by]
    c = stratum_counts(df, keys)
    gw = Window.partitionBy(*by) if by else Window.partitionBy()
    c = c.withColumn("_N", F.sum("cnt").over(gw))
    c = c.withColumn("_want", n_select_expr(F.col("_N")))
    exact = F.col("_want") * F.col("cnt") / F.col("_N")
    c = c.withColumn("_floor", F.floor(exact).cast("long")).withColumn("_rem", exact - F.floor(exact))
    c = c.withColumn("_short", F.col("_want") - F.sum("_floor").over(gw))
    order = gw.orderBy(F.desc("_rem"), *[F.col(k).asc() for k in keys])
    c = c.withColumn("_r", F.row_number().over(order))
    quota = F.col("_floor") + F.when(F.col("_r") <= F.col("_short"), 1).otherwise(0)
    return c.select(*keys, quota.alias("quota"))


def stratified_split(df: DataFrame, target: str = TARGET, test_size: float = 0.2,
                     seed: int = 42, row_id: str = ROW_ID, by=()) -> DataFrame:
    """Stratified train/test split (J2): per group ``by`` (default: whole
    frame) n_test = ceil(test_size * N); train quotas over classes by
    largest remainder; adds ``is_train``."""
    keys = list(by) + [target]
    quotas = largest_remainder_quotas(
        df, [target], lambda n: n - F.ceil(n * F.lit(test_size)).cast("long"), by=by)
    return select_by_quota(df, keys, quotas, seed, row_id, "is_train")


def survey_mix_split(df: DataFrame, base_survey: str = "KEPLER", base_share: float = 0.8,
                     other_ratio: float = 0.25, seed: int = 42, mission: str = MISSION,
                     row_id: str = ROW_ID) -> DataFrame:
    """Mixed training sets (J3 with base KEPLER, J4 with base TESS):
    n_base = int(base_share * base rows), n_other = int(other_ratio * n_base);
    random rows of each survey by hash order; adds ``is_train``."""
    c = stratum_counts(df, [mission])
    n_base = F.max(F.when(F.col(mission) == base_survey,
                          F.floor(F.col("cnt") * F.lit(base_share)))).over(Window.partitionBy())
    c = c.withColumn("_nb", n_base.cast("long"))
    quota = F.when(F.col(mission) == base_survey, F.col("_nb")).otherwise(
        F.least(F.floor(F.col("_nb") * F.lit(other_ratio)).cast("long"), F.col("cnt")))
    return select_by_quota(df, [mission], c.select(mission, quota.alias("quota")), seed, row_id,
                           "is_train")


def capped_sample(df: DataFrame, strata: list[str], cap: int, seed: int = 42,
                  row_id: str = ROW_ID) -> DataFrame:
    """min(stratum size, cap) rows per stratum (J6 balanced sample; with
    strata=[mission] and per-survey caps, the J5 ratio samples)."""
    q = stratum_counts(df, strata).select(*strata, F.least(F.col("cnt"), F.lit(cap)).alias("quota"))
    return select_by_quota(df, strata, q, seed, row_id, "selected").where("selected").drop("selected")


def ratio_sample(df: DataFrame, tess_ratio: float, total: int = 8000, seed: int = 42,
                 mission: str = MISSION, row_id: str = ROW_ID) -> DataFrame:
    """Fixed-size survey mix (J5): int(total*r) TESS and int(total*(1-r))
    KEPLER rows, each capped by availability."""
    c = stratum_counts(df, [mission])
    want = (F.when(F.col(mission) == "TESS", F.lit(int(total * tess_ratio)))
            .when(F.col(mission) == "KEPLER", F.lit(int(total * round(1 - tess_ratio, 10))))
            .otherwise(F.lit(0)))
    q = c.select(mission, F.least(want, F.col("cnt")).alias("quota"))
    return select_by_quota(df, [mission], q, seed, row_id, "selected").where("selected").drop("selected")


def split_summary(df: DataFrame, flag: str = "is_train", mission: str = MISSION,
                  target: str = TARGET) -> DataFrame:
    """Split verification (J8): counts and percent share within each set."""
    g = (df.withColumn("split", F.when(F.col(flag), "train").otherwise("test"))
           .groupBy("split", mission, target).agg(F.count(F.lit(1)).alias("count")))
    share = F.col("count") * 100.0 / F.sum("count").over(Window.partitionBy("split"))
    return g.withColumn("share_pct", F.round(share, 1))


def shuffled(df: DataFrame, seed: int = 42, row_id: str = ROW_ID) -> DataFrame:
    """Reproducible full shuffle (G6): order by the row's hash key."""
    return df.orderBy(order_key(seed, row_id), F.col(row_id))
