"""Habitability score (L1-L9) as pure column expressions.

Five components, each 0-100, weighted into a total.  A NULL or 0 input
scores 0; ranges are inclusive and the first matching branch wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# FIXED VALUES: component weights, unit and optimal-range texts.
WEIGHTS = {"temperature": 0.30, "radius": 0.25, "insolation": 0.25,
           "stellar_temp": 0.15, "orbital_stability": 0.05}
COMPONENTS = [
    ("Temperature", "temperature", "koi_teq", "K", "273-373 K"),
    ("Planet Radius", "radius", "koi_prad", "Earth radii", "0.5-2.0 R⊕"),
    ("Insolation Flux", "insolation", "koi_insol", "Earth flux", "0.3-1.8 S⊕"),
    ("Stellar Temperature", "stellar_temp", "koi_steff", "K", "4000-7000 K"),
    ("Orbital Stability", "orbital_stability", "koi_period", "days", "10-500 days"),
]
TIERS = [(70.0, "High"), (40.0, "Moderate")]
STATUS = [(70.0, "Favorable"), (40.0, "Marginal")]


def _gauss(x: Column, center: float, width: float) -> Column:
    return F.lit(100.0) * F.exp(-F.pow((x - F.lit(center)) / F.lit(width), 2))


def _between(x: Column, lo: float, hi: float) -> Column:
    return (x >= lo) & (x <= hi)


def temperature_score(t: Column) -> Column:
    t = F.coalesce(t, F.lit(0.0))
    return (F.when(t == 0, 0.0)
            .when(_between(t, 273, 373), 100.0)
            .when(_between(t, 200, 450),
                  F.when(t < 273, _gauss(t, 273, 50)).otherwise(_gauss(t, 373, 50)))
            .otherwise(F.greatest(F.lit(0.0), _gauss(t, 323, 100))))


def radius_score(r: Column) -> Column:
    r = F.coalesce(r, F.lit(0.0))
    return (F.when(r == 0, 0.0)
            .when(_between(r, 0.5, 2.0), 100.0)
            .when(_between(r, 0.3, 3.0),
                  F.when(r < 0.5, F.lit(100.0) * (r / 0.5)).otherwise(_gauss(r, 2.0, 1.0)))
            .otherwise(F.greatest(F.lit(0.0), _gauss(r, 1.25, 2.0))))


def insolation_score(s: Column) -> Column:
    s = F.coalesce(s, F.lit(0.0))
    return (F.when(s == 0, 0.0)
            .when(_between(s, 0.3, 1.8), 100.0)
            .when(_between(s, 0.1, 3.0),
                  F.when(s < 0.3, F.lit(100.0) * (s / 0.3)).otherwise(_gauss(s, 1.8, 1.5)))
            .otherwise(F.greatest(F.lit(0.0), _gauss(s, 1.0, 2.0))))


def stellar_temp_score(t: Column) -> Column:
    t = F.coalesce(t, F.lit(0.0))
    return (F.when(t == 0, 0.0)
            .when(_between(t, 4000, 7000), 100.0)
            .when(_between(t, 3000, 8000),
                  F.when(t < 4000, F.lit(100.0) * ((t - 3000) / 1000))
                  .otherwise(_gauss(t, 7000, 1000)))
            .otherwise(F.greatest(F.lit(0.0), _gauss(t, 5500, 2000))))


def orbital_score(p: Column) -> Column:
    p = F.coalesce(p, F.lit(0.0))
    return (F.when(p == 0, 0.0)
            .when(_between(p, 10, 500), 100.0)
            .when(_between(p, 1, 1000),
                  F.when(p < 10, F.lit(100.0) * (p / 10)).otherwise(_gauss(p, 500, 300)))
            .otherwise(50.0))


SCORERS = {"temperature": temperature_score, "radius": radius_score,
           "insolation": insolation_score, "stellar_temp": stellar_temp_score,
           "orbital_stability": orbital_score}


def _input(df_cols: set, base: str, prefix: str) -> Column:
    name = prefix + base
    return F.col(name).cast("double") if name in df_cols else F.lit(None).cast("double")


def component_scores(df: DataFrame, prefix: str = "merged_") -> dict[str, Column]:
    cols = set(df.columns)
    return {key: SCORERS[key](_input(cols, base, prefix))
            for _, key, base, _, _ in COMPONENTS}


def total_score(scores: dict[str, Column]) -> Column:
    """Weighted sum of the unrounded components, rounded to 1 decimal."""
    s = None
    for k, w in WEIGHTS.items():
        term = scores[k] * F.lit(w)
        s = term if s is None else s + term
    return F.round(s, 1)


def tier(score: Column, cuts=TIERS, low: str = "Low") -> Column:
    """>= 70 High, >= 40 Moderate, else Low (L8); NULL stays NULL."""
    out = None
    for cut, name in cuts:
        out = F.when(score >= cut, name) if out is None else out.when(score >= cut, name)
    return out.when(score.isNotNull(), low)


def add_habitability(df: DataFrame, prefix: str = "merged_", prediction_col: str | None = None,
                     breakdown: bool = False) -> DataFrame:
    """Add ``hab_<component>`` scores, ``habitability_score`` and the tier.

    With ``prediction_col`` the score is kept only for rows predicted
    CONFIRMED or CANDIDATE (L9).  ``breakdown`` adds the nested struct
    (L7): total plus an array of per-component structs.
    """
    sc = component_scores(df, prefix)
    total = total_score(sc)
    if prediction_col:
        total = F.when(F.col(prediction_col).isin("CONFIRMED", "CANDIDATE"), total)
    cols = {f"hab_{k}": v for k, v in sc.items()}
    cols["habitability_score"] = total
    out = df.withColumns(cols).withColumn("habitability_tier", tier(F.col("habitability_score")))
    if breakdown:
        have = set(df.columns)
        comps = F.array(*[
            F.struct(F.lit(label).alias("name"),
                     F.round(F.col(f"hab_{key}"), 1).alias("score"),
                     F.coalesce(_input(have, base, prefix), F.lit(0.0)).alias("value"),
                     F.lit(unit).alias("unit"), F.lit(opt).alias("optimal"),
                     tier(F.col(f"hab_{key}"), STATUS, "Unfavorable").alias("status"))
            for label, key, base, unit, opt in COMPONENTS])
        out = out.withColumn("habitability", F.struct(
            F.col("habitability_score").alias("total_score"), comps.alias("components")))
    return out
