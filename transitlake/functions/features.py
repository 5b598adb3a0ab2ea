"""Derived physics, signal-to-noise and uncertainty features.

Each family declares the columns it needs and is skipped when one is
missing (schema-tolerant, decided at plan time from ``df.columns``).
All families are emitted in ONE ``withColumns`` so Catalyst builds one
Project: no chain of 40 ``withColumn`` calls, no Python per row.
Flags are int and 0 for NULL input; logs and ratios are NULL where their
guard fails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitlake.functions.expr import finite, flag, log10_pos, safe_div
from transitlake.schema import UNCERTAINTY_BASES

M = "merged_koi_"


def _c(name: str) -> Column:
    return F.col(M + name)


def multiplicity_features(cols: set) -> dict:
    """H1-H4 (needs merged_multiplicity, which the unify step never makes)."""
    if "merged_multiplicity" not in cols:
        return {}
    m = F.col("merged_multiplicity")
    return {
        "feat_is_single_system": flag(m == 1),
        "feat_is_multi_planet_system": flag(m > 1),
        "feat_is_high_multiplicity": flag(m > 2),
        "feat_log_multiplicity": F.when(m > -1, F.log1p(m)),
    }


def orbital_features(cols: set) -> dict:
    """H8-H10."""
    if M + "period" not in cols:
        return {}
    p = _c("period")
    return {
        "feat_log_period": log10_pos(p),
        "feat_is_ultra_short_period": flag(p < 1.0),
        "feat_is_habitable_zone_period": flag((p > 50) & (p < 400)),
    }


def duration_features(cols: set) -> dict:
    """H11."""
    if not {M + "duration", M + "period"} <= cols:
        return {}
    d, p = _c("duration"), _c("period")
    return {"feat_duration_ratio": F.when((p > 0) & (d > 0), d / (F.lit(24.0) * p))}


def depth_features(cols: set) -> dict:
    """H12-H14.  The mean-error SNR (H13) needs both errors, and whenever
    depth_err1 exists it is overwritten by depth / err1 (H14), so H14 is
    the only form that can reach the output."""
    out = {}
    if M + "depth" not in cols:
        return out
    d = _c("depth")
    out["feat_log_depth"] = log10_pos(d)
    if M + "depth_err1" in cols:
        e1 = _c("depth_err1")
        out["feat_depth_snr"] = F.when((e1 > 0) & (d > 0), d / e1)
    return out


def radius_features(cols: set) -> dict:
    """H15-H16."""
    out = {}
    if {M + "prad", M + "srad"} <= cols:
        pr, sr = _c("prad"), _c("srad")
        out["feat_radius_ratio"] = F.when((sr > 0) & (pr > 0), pr / sr)
    if M + "prad" in cols:
        out["feat_log_prad"] = log10_pos(_c("prad"))
    return out


def environment_features(cols: set) -> dict:
    """H17-H19."""
    out = {}
    if M + "insol" in cols:
        s = _c("insol")
        out["feat_log_insol"] = log10_pos(s)
        out["feat_is_habitable_zone"] = flag((s > 0.32) & (s < 1.78))
    if M + "teq" in cols:
        out["feat_log_teq"] = log10_pos(_c("teq"))
    return out


def physics_features(cols: set) -> dict:
    """H5-H7."""
    out = {}
    if {M + "teq", M + "steff"} <= cols:
        out["feat_temp_ratio"] = safe_div(_c("teq"), _c("steff"))
    if {M + "teq", M + "insol"} <= cols:
        theo = finite(F.lit(280.0) * F.pow(_c("insol"), F.lit(0.25)))
        out["feat_teq_theoretical"] = theo
        out["feat_teq_discrepancy"] = _c("teq") - theo
    return out


def snr_features(cols: set) -> dict:
    """H21-H23 (H14 is emitted by depth_features)."""
    out = {}
    for name, base in (("feat_duration_snr", "duration"), ("feat_period_snr", "period"),
                       ("feat_prad_snr", "prad")):
        if {M + base, M + base + "_err1"} <= cols:
            v, e = _c(base), _c(base + "_err1")
            out[name] = F.when((e > 0) & (v > 0), v / e)
    return out


def uncertainty_features(cols: set) -> dict:
    """log10(mean |error| / |value| + 1e-6) where value != 0 and both
    errors are present.  Off in the default chain (quirk Q3)."""
    out = {}
    for b in UNCERTAINTY_BASES:
        v, e1, e2 = M + b, M + b + "_err1", M + b + "_err2"
        if {v, e1, e2} <= cols:
            cv, c1, c2 = F.col(v), F.col(e1), F.col(e2)
            ok = cv.isNotNull() & (cv != 0) & c1.isNotNull() & c2.isNotNull()
            rel = ((F.abs(c1) + F.abs(c2)) / 2) / F.abs(cv)
            out[f"feat_{b}_rel_uncertainty"] = F.when(ok, F.log10(rel + F.lit(1e-6)))
    return out


def catboost_features(cols: set) -> dict:
    """The extra features of the ordered-boosting model config."""
    out = {}
    if {M + "prad", M + "srad"} <= cols:
        pr, sr = _c("prad"), _c("srad")
        out["radius_ratio_squared"] = F.when((sr > 0) & (pr > 0), F.pow(pr / sr, 2))
    if {M + "period", M + "srad"} <= cols:
        out["orbital_distance_proxy"] = finite(F.pow(_c("period"), F.lit(2.0 / 3.0)))
    if {M + "insol", M + "teq"} <= cols:
        out["energy_balance"] = safe_div(_c("insol"), _c("teq") + F.lit(1e-5))
    if {M + "srad", M + "steff"} <= cols:
        out["stellar_luminosity_proxy"] = F.pow(_c("srad"), 2) * F.pow(_c("steff"), 4)
    if {M + "slogg", M + "srad"} <= cols:
        out["stellar_mass_proxy"] = _c("slogg") * F.pow(_c("srad"), 2)
    if {M + "duration", M + "period"} <= cols:
        out["duration_period_ratio"] = safe_div(_c("duration"), _c("period") + F.lit(1e-5))
    if M + "depth" in cols:
        d = F.coalesce(_c("depth"), F.lit(0.0))
        out["log_transit_depth"] = F.when(d > -1, F.log1p(d))
    if M + "insol" in cols:
        s = _c("insol")
        # right-closed bins (-inf, .25] (.25, 1.78] (1.78, inf)
        out["habitable_zone_indicator"] = (F.when(s <= 0.25, 0.0).when(s <= 1.78, 1.0)
                                           .when(s.isNotNull(), 2.0))
    if M + "prad" in cols:
        r = _c("prad")
        out["planet_size_category"] = (F.when(r <= 0, None).when(r <= 1.5, 0.0)
                                       .when(r <= 2.0, 1.0).when(r <= 6.0, 2.0)
                                       .when(r.isNotNull(), 3.0))
    if {M + "depth", M + "duration"} <= cols:
        out["signal_strength_proxy"] = _c("depth") * _c("duration")
    return out


# Reference order: multiplicity, orbital, duration, depth, radius,
# environment, physics, snr.
DEFAULT_FAMILIES = [multiplicity_features, orbital_features, duration_features,
                    depth_features, radius_features, environment_features,
                    physics_features, snr_features]


def add_features(df: DataFrame, uncertainty: bool = False, catboost: bool = False) -> DataFrame:
    """Add every applicable feature in a single projection."""
    cols = set(df.columns)
    exprs: dict = {}
    for fam in DEFAULT_FAMILIES:
        exprs.update(fam(cols))
    if uncertainty:
        exprs.update(uncertainty_features(cols))
    if catboost:
        exprs.update(catboost_features(cols))
    return df.withColumns(exprs) if exprs else df


def feature_names(df: DataFrame, **kw) -> list[str]:
    return [c for c in add_features(df, **kw).columns if c not in df.columns]
