"""Quantile place and inverse normal CDF as column expressions.

Arguments that an expression uses several times should be columns of an earlier
projection, so that they are not computed again at each use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOUND = 1e-7                         # values within it of an end of the grid count as beyond it
CLIP = BOUND - 2.220446049250313e-16  # smallest probability, less one spacing of doubles at 1

# Wichura's rational approximations (algorithm AS 241, PPND16), highest power first.
CENTRAL = ([2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457,
            13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608],
           [5226.495278852545925, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867,
            5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0])
TAIL = ([7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258,
         3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734],
        [1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459,
         0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0])
CENTRE_WIDTH, CENTRE_SHIFT, TAIL_SHIFT = 0.425, 0.180625, 1.6


def _polynomial(coefficients: list[float], r: Column) -> Column:
    total = F.lit(coefficients[0])
    for c in coefficients[1:]:
        total = total * r + F.lit(c)
    return total


def _is_central(p: Column) -> Column:
    return F.abs(p - 0.5) <= CENTRE_WIDTH


def probit_argument(p: Column) -> Column:
    """The variable of the approximation that serves ``p``."""
    return (F.when(_is_central(p), F.lit(CENTRE_SHIFT) - (p - 0.5) * (p - 0.5))
            .otherwise(F.sqrt(-F.log(F.least(p, 1 - p))) - TAIL_SHIFT))


def probit(p: Column, r: Column) -> Column:
    """Inverse standard normal CDF of ``p`` (1.4e-11 to 1 less that), with ``r``
    its ``probit_argument``; relative error about 1e-16."""
    central = (p - 0.5) * _polynomial(CENTRAL[0], r) / _polynomial(CENTRAL[1], r)
    tail = F.signum(p - 0.5) * _polynomial(TAIL[0], r) / _polynomial(TAIL[1], r)
    return F.when(_is_central(p), central).otherwise(tail)


def grid_place(x: Column, at: Column, low: Column, high: Column) -> Column:
    """Place (CLIP to 1 - CLIP) of ``x`` on a grid from ``low`` to ``high``; ``at``
    is the last grid point at or below ``x``: a struct of point, hit (the place of
    a value equal to it), share and slope (the line on to the next point).  NULL
    for a NULL x."""
    inside = F.when(x == at["point"], at["hit"]).otherwise(at["share"] + at["slope"] * (x - at["point"]))
    return (F.when(x.isNull(), F.lit(None).cast("double"))
            .when(x + BOUND > high, F.lit(1 - CLIP)).when(x - BOUND < low, F.lit(CLIP))
            .otherwise(F.greatest(F.least(inside, F.lit(1 - CLIP)), F.lit(CLIP))))
