"""Fitted (stateful) transforms: fit on training rows, apply to any frame
(I1-I4, I6-I9).

The fitted state of each transform is tiny (a few numbers per column, or
a quantile grid per survey) and is computed by one aggregate; applying
it is a column expression, also for the quantile-to-normal map: a binary
search over the survey's grid and a rational inverse of the normal CDF.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transitlake.functions.normal import grid_place, probit, probit_argument
from transitlake.schema import MISSION, QUANTILE_NORMAL_FEATURES

STELLAR = ["merged_koi_steff", "merged_koi_slogg", "merged_koi_srad"]


def _short(col: str) -> str:
    return col.split("_")[-1]


# --- standard scaling (I1 stellar subset, I8 all features) -----------------

@dataclass
class StandardScalerModel:
    """Population-std scaling; NULL stays NULL; zero variance -> scale 1."""
    stats: dict = field(default_factory=dict)  # col -> (mean, std)
    prefix: str = "feat_norm_"
    short_names: bool = True

    def out_name(self, c: str) -> str:
        return self.prefix + (_short(c) if self.short_names else c)

    def transform(self, df: DataFrame) -> DataFrame:
        cols = {}
        for c, (m, s) in self.stats.items():
            if c in df.columns and m is not None:
                scale = s if (s is not None and s > 0) else 1.0
                cols[self.out_name(c)] = (F.col(c) - F.lit(m)) / F.lit(scale)
        return df.withColumns(cols) if cols else df


def fit_standard_scaler(df: DataFrame, cols, prefix: str = "feat_norm_",
                        short_names: bool = True) -> StandardScalerModel:
    have = [c for c in cols if c in df.columns]
    if not have:
        return StandardScalerModel({}, prefix, short_names)
    row = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c)
                   for c in have]).first()
    return StandardScalerModel({c: (row[c]["m"], row[c]["s"]) for c in have}, prefix, short_names)


def fit_stellar_scaler(df: DataFrame) -> StandardScalerModel:
    """feat_norm_{steff,slogg,srad}; absent columns are skipped."""
    return fit_standard_scaler(df, STELLAR)


# --- median imputation (I6, I7) --------------------------------------------

@dataclass
class MedianImputerModel:
    medians: dict = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        fill = {c: m for c, m in self.medians.items() if c in df.columns and m is not None}
        return df.fillna(fill) if fill else df


# accuracy of the percentile_approx sketch where a caller opts into it
APPROX_ACCURACY = 100_000


def fit_median_imputer(df: DataFrame, cols, exact: bool = True) -> MedianImputerModel:
    """Exact medians (linear interpolation) by the distributed exact
    percentile (stats.exact_percentiles), so no group's values are held in
    one task.  ``exact=False`` uses the percentile_approx sketch instead."""
    have = [c for c in cols if c in df.columns]
    if not have:
        return MedianImputerModel({})
    if not exact:
        row = df.agg(*[F.percentile_approx(c, 0.5, APPROX_ACCURACY).alias(c) for c in have]).first()
        return MedianImputerModel({c: row[c] for c in have})
    return MedianImputerModel(_exact_single(df, have, 0.5))


def _exact_single(df: DataFrame, cols, p: float) -> dict:
    """col -> exact percentile p (None for an all-NULL column); the
    collected result has one row per column."""
    from transitlake.operators.stats import exact_percentiles
    got = {r["feature"]: r["value"] for r in exact_percentiles(df, cols, [p]).collect()}
    return {c: got.get(c) for c in cols}


# --- robust scaling (I3b) --------------------------------------------------

@dataclass
class RobustScalerModel:
    stats: dict = field(default_factory=dict)  # col -> (median, mad)
    prefix: str = "feat_compress_"

    def transform(self, df: DataFrame) -> DataFrame:
        cols = {}
        for c, (med, mad) in self.stats.items():
            if c not in df.columns:
                continue
            if med is not None and mad is not None and mad > 0:
                cols[self.prefix + c] = (F.col(c) - F.lit(med)) / F.lit(mad)
            else:
                cols[self.prefix + c] = F.lit(0.0)
        return df.withColumns(cols) if cols else df


def fit_robust_scaler(df: DataFrame, cols) -> RobustScalerModel:
    """(x - median) / median(|x - median|), 0 when that MAD is 0.  Two
    distributed exact-median passes (the MAD needs the median)."""
    have = [c for c in cols if c in df.columns]
    if not have:
        return RobustScalerModel({})
    meds = _exact_single(df, have, 0.5)
    known = [c for c in have if meds[c] is not None]
    dev = df.select(*[F.abs(F.col(c) - F.lit(meds[c])).alias(c) for c in known])
    mads = _exact_single(dev, known, 0.5) if known else {}
    return RobustScalerModel({c: (meds[c], mads.get(c)) for c in have})


# --- log-bin quintiles (I3a) -----------------------------------------------

def signed_log1p(c):
    """sign(x) * ln(1 + |x|) with NULL treated as 0."""
    x = F.coalesce(c, F.lit(0.0))
    return F.signum(x) * F.log1p(F.abs(x))


@dataclass
class QuintileBinModel:
    edges: dict = field(default_factory=dict)  # col -> sorted distinct edges
    prefix: str = "feat_compress_"

    def transform(self, df: DataFrame) -> DataFrame:
        cols = {}
        for c, e in self.edges.items():
            if c not in df.columns:
                continue
            if not e or len(e) < 2:
                cols[self.prefix + c] = F.lit(0).cast("long")
                continue
            y = signed_log1p(F.col(c))
            arr = F.array(*[F.lit(float(v)) for v in e])
            idx = F.size(F.filter(arr, lambda b: b < y)) - 1
            # right-closed bins, lowest edge included; outside the fitted
            # range -> NULL (as an out-of-range cut)
            inside = (y >= F.lit(float(e[0]))) & (y <= F.lit(float(e[-1])))
            cols[self.prefix + c] = F.when(inside, F.greatest(idx, F.lit(0))).cast("long")
        return df.withColumns(cols) if cols else df


def fit_quintile_bins(df: DataFrame, cols, q: int = 5) -> QuintileBinModel:
    """Edges at the 0, 1/q, ..., 1 quantiles (linear interpolation) of
    sign(x) ln(1+|x|); duplicate edges dropped (I3a).  Fitted once on the
    training frame (quirk Q7: the reference recomputes them per frame)."""
    have = [c for c in cols if c in df.columns]
    if not have:
        return QuintileBinModel({})
    from transitlake.operators.stats import exact_percentiles
    probs = [i / q for i in range(q + 1)]
    y = df.select(*[signed_log1p(F.col(c)).alias(c) for c in have])
    edges: dict = {c: [] for c in have}
    for r in exact_percentiles(y, have, probs).collect():  # columns x (q+1) rows
        edges[r["feature"]].append(r["value"])
    return QuintileBinModel({c: sorted(set(e)) for c, e in edges.items()})


# --- per-survey quantile-to-normal (I2) ------------------------------------

def _free_prefix(df: DataFrame, prefix: str) -> str:
    """``prefix``, lengthened until no column of ``df`` begins with it."""
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


@dataclass
class QuantileNormalModel:
    """grids[feature][survey] -> sorted quantile array (<= 1000 points).

    ``transform`` adds ``feat_qn_<feature>``: the value's place in its survey's
    grid (0 to 1, interpolated; the middle of a run of equal grid points), as a
    standard normal score clipped at the probability 1e-7.  NULL and NaN stay
    NULL; a survey without a grid scores 0.

    A value's place is found by MLlib's ``Bucketizer`` (a binary search over the
    distinct grid points of its survey), and what it needs of the grid there
    comes from a broadcast join with one row per survey (features x <= 1000
    points: the fitted state, whatever the data's size).  No Python runs per row."""
    grids: dict = field(default_factory=dict)
    group: str = MISSION

    def transform(self, df: DataFrame) -> DataFrame:
        feats = [f for f in self.grids if f in df.columns and self.grids[f]]
        if not feats:
            return df
        from pyspark.ml.feature import Bucketizer
        pre = _free_prefix(df, "__qn_")
        surveys = sorted({s for f in feats for s in self.grids[f]})
        points = {(s, f): grid_points(self.grids[f][s]) for f in feats for s in self.grids[f]}
        schema = T.StructType([T.StructField(f"{pre}key", df.schema[self.group].dataType)] + [
            T.StructField(f"{pre}grid{i}", T.ArrayType(POINT)) for i in range(len(feats))])
        table = df.sparkSession.createDataFrame([(s, *(points.get((s, f)) for f in feats)) for s in surveys], schema)

        out = df.join(F.broadcast(table), F.col(self.group) == F.col(f"{pre}key"), "left")
        add = lambda part, made: out.withColumns({f"{pre}{part}{i}": made(i) for i in range(len(feats))})
        col = lambda part, i: F.col(f"{pre}{part}{i}")
        value = [F.col(f).cast("double") for f in feats]
        out = add("x", lambda i: F.when(~F.isnan(value[i]), value[i]))
        # one search per survey and feature; a row of another survey has NULL there
        own = {(s, f): (f"{pre}in{j}", f"{pre}n{j}") for j, (s, f) in enumerate(points)}
        out = out.withColumns({own[s, f][0]: F.when(F.col(self.group) == s, col("x", feats.index(f))) for s, f in points})
        ends = float("-inf"), float("inf")
        out = Bucketizer(inputCols=[a for a, _ in own.values()], outputCols=[b for _, b in own.values()], handleInvalid="keep",
                         splitsArray=[[ends[0], *(p[0] for p in ps), ends[1]] for ps in points.values()]).transform(out)
        below = lambda i: F.coalesce(*[F.col(own[s, f][1]) for s, f in points if f == feats[i]])
        out = add("at", lambda i: F.get(col("grid", i), below(i).cast("int") - 1))
        out = add("p", lambda i: grid_place(col("x", i), col("at", i), F.get(col("grid", i), F.lit(0))["point"],
                                            F.get(col("grid", i), F.size(col("grid", i)) - 1)["point"]))
        out = add("r", lambda i: probit_argument(col("p", i)))
        out = out.withColumns({f"feat_qn_{f}": F.when(col("grid", i).isNull(), F.lit(0.0)).otherwise(probit(col("p", i), col("r", i)))
                               for i, f in enumerate(feats)})
        inner = [f"{pre}{part}{i}" for part in ("grid", "x", "at", "p", "r") for i in range(len(feats))]
        return out.drop(f"{pre}key", *inner, *[c for pair in own.values() for c in pair])


POINT = T.StructType([T.StructField(c, T.DoubleType()) for c in ("point", "hit", "share", "slope")])


def grid_points(grid: list) -> list[tuple]:
    """The distinct points of a sorted grid whose entries stand for evenly
    spaced probabilities.  ``hit``: the place of a value equal to the point, the
    middle of its run of equal entries; ``share`` and ``slope``: the line from
    the run's end to the next point."""
    last = len(grid) - 1
    place = [1.0 if k == last else k / last for k in range(len(grid))]
    starts = [k for k in range(len(grid)) if k == 0 or grid[k] != grid[k - 1]]
    out = []
    for first, after in zip(starts, [*starts[1:], None]):
        end = last if after is None else after - 1
        slope = 0.0 if after is None else (place[after] - place[end]) / (grid[after] - grid[end])
        out.append((float(grid[first]), (place[first] + place[end]) / 2, place[end], slope))
    return out


def quantile_grids(df: DataFrame, features, group: str = MISSION,
                   n_quantiles: int = 1000) -> DataFrame:
    """Exact per-(group, feature) quantile grids as one distributed plan.

    For a group with R rows the grid has m = min(n_quantiles, R) points at
    the probabilities of ``numpy.linspace(0, 1, m)`` (0.5 when m = 1), each
    the linearly interpolated percentile of the feature's non-null values,
    bit for bit as Spark's ``percentile`` computes it.  ``percentile``
    itself rebuilds its cumulative-count array for every probability, which
    is O(distinct values x m) inside one task per group; here the values
    are pre-aggregated to (group, feature, value, count), running counts
    come from per-value-block windows (stats.blocked_running_sums), and
    each distinct value emits only the grid points whose lower or upper
    rank falls on it (about 3m rows per group and feature in total).

    Output: group, feature, grid (array of m doubles in probability order).
    """
    from transitlake.operators.stats import blocked_running_sums
    feats = list(features)
    src = df.where(F.col(group).isNotNull())
    stack = ", ".join(f"'{f}', CAST(`{f}` AS DOUBLE)" for f in feats)
    long = src.select(F.col(group).alias("_grp"),
                      F.expr(f"stack({len(feats)}, {stack}) AS (_feat, value)"))
    vals = (long.where(F.col("value").isNotNull())
                .groupBy("_grp", "_feat", "value").agg(F.count(F.lit(1)).alias("c"))
                .withColumn("_part", F.struct("_grp", "_feat")))
    # one row per (group, feature): non-null count n, grid size m
    rows = src.groupBy(F.col(group).alias("_grp")).agg(F.count(F.lit(1)).alias("_rows"))
    info = (vals.groupBy("_grp", "_feat").agg(F.sum("c").alias("_n"))
                .join(rows, "_grp")
                .withColumn("_m", F.least(F.lit(n_quantiles).cast("long"), F.col("_rows"))))
    cum = blocked_running_sums(vals, "_part", "value", ["c"]).join(info, ["_grp", "_feat"])
    lo, hi = F.col("cum_c") - F.col("c"), F.col("cum_c") - 1          # 0-based ranks of this value
    m, n = F.col("_m"), F.col("_n")
    scale = (m - 1).cast("double") / (n - 1).cast("double")
    k_first = F.when(m == 1, F.lit(0)).when(n == 1, F.lit(0)).otherwise(
        F.greatest(F.lit(0), F.ceil((lo - 1).cast("double") * scale)))
    k_last = F.when(m == 1, F.lit(0)).when(n == 1, m - 1).otherwise(
        F.least(m - 1, F.floor((hi + 1).cast("double") * scale)))
    cand = (cum.where(k_first <= k_last)
               .select("_grp", "_feat", "value", "_m", "_n",
                       lo.alias("_lo"), hi.alias("_hi"),
                       F.explode(F.sequence(k_first.cast("long"), k_last.cast("long"))).alias("k")))
    # the probability and rank exactly as numpy.linspace and percentile form them
    p = (F.when(F.col("_m") == 1, F.lit(0.5))
          .when(F.col("k") == F.col("_m") - 1, F.lit(1.0))
          .otherwise(F.col("k").cast("double") * (F.lit(1.0) / (F.col("_m") - 1).cast("double"))))
    h = (F.col("_n") - 1).cast("double") * p
    cand = cand.withColumns({"_h": h, "_l": F.floor(h), "_u": F.ceil(h)})
    is_l = (F.col("_l") >= F.col("_lo")) & (F.col("_l") <= F.col("_hi"))
    is_u = (F.col("_u") >= F.col("_lo")) & (F.col("_u") <= F.col("_hi"))
    pts = (cand.where(is_l | is_u)
               .groupBy("_grp", "_feat", "k")
               .agg(F.max(F.when(is_l, F.col("value"))).alias("_xl"),
                    F.max(F.when(is_u, F.col("value"))).alias("_xu"),
                    F.first("_h").alias("_h"), F.first("_l").alias("_l"), F.first("_u").alias("_u")))
    v = (F.when((F.col("_u") == F.col("_l")) | (F.col("_xl") == F.col("_xu")), F.col("_xl"))
          .otherwise((F.col("_u") - F.col("_h")) * F.col("_xl") + (F.col("_h") - F.col("_l")) * F.col("_xu")))
    grid = (pts.groupBy("_grp", "_feat")
               .agg(F.sort_array(F.collect_list(F.struct("k", v.alias("v")))).alias("_g")))
    return grid.select(F.col("_grp").alias(group), F.col("_feat").alias("feature"),
                       F.transform("_g", lambda e: e["v"]).alias("grid"))


def fit_quantile_normal(df: DataFrame, features=QUANTILE_NORMAL_FEATURES, n_quantiles: int = 1000,
                        group: str = MISSION) -> QuantileNormalModel:
    """Per survey and feature: the exact quantile grid at n = min(1000, rows
    of the survey) evenly spaced probabilities (quantile_grids, one
    distributed plan).  The collected result (surveys x features x n
    doubles) is the model.  Fits on all rows - the reference itself fits
    on a 10,000-row subsample."""
    have = [f for f in features if f in df.columns]
    if not have:
        return QuantileNormalModel({}, group)
    grids: dict = {f: {} for f in have}
    for r in quantile_grids(df, have, group, n_quantiles).collect():
        grids[r["feature"]][r[group]] = list(r["grid"])
    return QuantileNormalModel(grids, group)


# --- PCA over the aligned features (I4) ------------------------------------

def fit_domain_pca(df: DataFrame, k: int = 10, prefixes=("feat_qn_", "feat_compress_", "feat_norm_")):
    """Centered PCA over the survey-aligned features; skipped (None) when
    fewer than k such features exist.  MLlib PCA does not center, so the
    column means are subtracted first; NULLs are imputed with 0 (the
    centered mean)."""
    from pyspark.ml.feature import PCA, VectorAssembler
    feats = [c for c in df.columns if any(c.startswith(p) for p in prefixes)]
    if len(feats) < k:
        return None
    means = df.agg(*[F.avg(c).alias(c) for c in feats]).first()
    centered = df.select(*[(F.coalesce(F.col(c), F.lit(means[c])) - F.lit(means[c] or 0.0)).alias(c)
                           for c in feats])
    va = VectorAssembler(inputCols=feats, outputCol="_v")
    model = PCA(k=k, inputCol="_v", outputCol="_pc").fit(va.transform(centered))
    return {"features": feats, "means": {c: means[c] for c in feats}, "pca": model, "k": k}


def apply_domain_pca(df: DataFrame, fitted) -> DataFrame:
    if fitted is None:
        return df
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    feats, means = fitted["features"], fitted["means"]
    centered = df.withColumns({f"_c_{c}": F.coalesce(F.col(c), F.lit(means[c])) - F.lit(means[c] or 0.0)
                               for c in feats})
    va = VectorAssembler(inputCols=[f"_c_{c}" for c in feats], outputCol="_v")
    out = fitted["pca"].transform(va.transform(centered))
    arr = vector_to_array(F.col("_pc"))
    out = out.withColumns({f"feat_domain_pc_{i + 1}": arr[i] for i in range(fitted["k"])})
    return out.drop("_v", "_pc", *[f"_c_{c}" for c in feats])
