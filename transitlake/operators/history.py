"""Prediction history: per-user reads, filters and ordering.

The store itself (append / delete / create) is in ``sources.store``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitlake.operators.clean import where_equals


def for_user(df: DataFrame, user_id: str | None) -> DataFrame:
    """Per-user visibility rule (A8): a user sees only their own rows.
    With the store partitioned by user bucket this prunes files."""
    if user_id is None:
        return df
    return df.where(F.col("user_id") == F.lit(str(user_id)))


def user_history(df: DataFrame, user_id: str | None = None, prediction: str | None = "All",
                 model_name: str | None = "All") -> DataFrame:
    """History newest first (A3, G1) with optional equality filters.

    Without ``user_id`` every user's history is returned, ordered by user
    then newest first.  The ordering is a global range-partitioned sort on
    (user, time, id), so a user with a huge history is spread over many
    tasks instead of landing in one window partition."""
    h = where_equals(for_user(df, user_id), {"prediction": prediction, "model_name": model_name})
    return h.orderBy(F.col("user_id").asc(), F.col("created_at").desc(), F.col("id").desc())


def history_dates(df: DataFrame, ts: str = "created_at") -> DataFrame:
    """Distinct days, newest first."""
    return df.select(F.to_date(ts).alias("date")).distinct().orderBy(F.desc("date"))
