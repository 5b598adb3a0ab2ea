"""Small column-expression helpers shared by the operators.

All of them stay inside whole-stage codegen (no Python per row).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = float("inf")


def flag(cond: Column) -> Column:
    """0/1 int flag; a NULL comparison counts as 0 (missing is never true)."""
    return F.coalesce(cond.cast("int"), F.lit(0))


def pos(c: Column) -> Column:
    """The value where it is > 0 and finite, else NULL.  Spark (like
    DuckDB) orders NaN above +inf, so ``c < inf`` drops NaN and inf in
    one comparison and the input is referenced only twice."""
    return F.when((c > 0) & (c < F.lit(INF)), c)


def finite(c: Column) -> Column:
    """NULL for NaN and +/-inf, the value otherwise (abs(NaN) is NaN,
    which is not < inf)."""
    return F.when(F.abs(c) < F.lit(INF), c)


def log10_pos(c: Column) -> Column:
    return F.when(c > 0, F.log10(c))


def safe_div(a: Column, b: Column) -> Column:
    """a / b with NULL instead of a division-by-zero error or inf."""
    return finite(F.try_divide(a, b))


def r6(c: Column, digits: int = 6) -> Column:
    """Round to ``digits`` decimals for value comparison across engines.

    Computed as round(x * 10^d) / 10^d: the product is one IEEE operation
    both engines do alike, and rounding an exact double half away from
    zero is then identical too (rounding the binary value at the 6th
    decimal directly differs between engines on exact ties)."""
    scale = float(10 ** digits)
    return F.round(c * F.lit(scale), 0) / F.lit(scale)


def double_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (used at the edge of oracle-checked queries)."""
    dbl = set(double_columns(df))
    return df.select(*[r6(F.col(c), digits).alias(c) if c in dbl else F.col(c)
                       for c in df.columns])
