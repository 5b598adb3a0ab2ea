"""transitlake: a Spark-native engine for planet-candidate catalogs.

Every operator is a ``DataFrame -> DataFrame`` function (or a small
fit/transform pair whose fitted state is itself a tiny DataFrame).
Nothing collects data rows to the driver; only plan-time metadata
(column names, a handful of fitted constants) crosses that boundary.
"""

from transitlake.session import get_spark, ensure_checkpoint_dir

__all__ = ["get_spark", "ensure_checkpoint_dir"]
