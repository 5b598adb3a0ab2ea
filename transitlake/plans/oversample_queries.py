"""Minority oversampling on the deduplicated training table."""

from __future__ import annotations

from pyspark.sql import functions as F

from transitlake.functions.expr import r6
from transitlake.operators.fitted import fit_median_imputer
from transitlake.operators.oversample import oversample
from transitlake.plans import oracle_sql as O
from transitlake.plans.catalog_queries import deduped_table
from transitlake.schema import TARGET
from transitlake.sources.materialize import materialize

FEATURES = ["merged_koi_period", "merged_koi_duration", "merged_koi_teq", "merged_koi_steff", "merged_koi_slogg", "merged_koi_srad"]


def q_oversampled_training(spark, sf_dir):
    """Every class filled up to the largest; medians in place of NULLs first."""
    d = materialize(deduped_table(spark, sf_dir).select("row_id", TARGET, *FEATURES), "oversample_input")
    medians = fit_median_imputer(d, FEATURES).medians
    filled = d.select("row_id", TARGET, *[F.coalesce(F.col(f), F.lit(medians[f]).cast("double")).alias(f) for f in FEATURES])
    out = oversample(filled, TARGET, FEATURES)
    return out.select(TARGET, "row_id", "copy", "neighbour_id", *[r6(F.col(f)).alias(f) for f in FEATURES])


def _list(form: str, sep: str = ", ") -> str:
    return sep.join(form.format(f=f) for f in FEATURES)


HASH = "md5(concat_ws(':', '42', CAST(b.row_id AS VARCHAR), CAST(b.copy AS VARCHAR)))"
SQL_OVERSAMPLED_TRAINING = O.with_(O.PAIRS + f""",
filled AS (SELECT row_id, {TARGET}, {_list('coalesce({f}, (SELECT median({f}) FROM deduped)) AS {f}')} FROM deduped),
sizes AS (SELECT {TARGET}, count(*) AS n, max(count(*)) OVER () - count(*) AS need FROM filled GROUP BY 1),
short AS (
  SELECT f.*, s.need // s.n AS whole, s.need % s.n AS more,
    row_number() OVER (PARTITION BY {TARGET} ORDER BY md5(concat_ws(':', '42', CAST(row_id AS VARCHAR))), row_id) AS place
  FROM filled f JOIN sizes s USING ({TARGET}) WHERE s.need > 0),
base AS (SELECT *, CAST(unnest(range(whole + CAST(place <= more AS INT))) AS INT) AS copy FROM short),
near AS (
  SELECT a.row_id, b.row_id AS id, {_list('b.{f}')},
    row_number() OVER (PARTITION BY a.row_id ORDER BY {_list('(a.{f} - b.{f}) * (a.{f} - b.{f})', ' + ')}, b.row_id) AS place,
    count(*) OVER (PARTITION BY a.row_id) AS found
  FROM short a JOIN short b ON a.{TARGET} = b.{TARGET} AND a.row_id <> b.row_id
  WHERE a.whole > 0 OR a.place <= a.more),
drawn AS (
  SELECT b.*, CAST('0x' || substr({HASH}, 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u,
    CAST('0x' || substr({HASH}, 9, 8) AS BIGINT) AS pick
  FROM base b)""", f"""
SELECT {TARGET}, row_id, CAST(NULL AS INT) AS copy, CAST(NULL AS BIGINT) AS neighbour_id,
  {_list('round({f} * 1e6) / 1e6 AS {f}')} FROM filled
UNION ALL
SELECT d.{TARGET}, d.row_id, d.copy, n.id,
  {_list('round((d.{f} + d.u * (coalesce(n.{f}, d.{f}) - d.{f})) * 1e6) / 1e6')}
FROM drawn d LEFT JOIN near n ON n.row_id = d.row_id AND n.place = 1 + d.pick % least(5, n.found)""")

QUERIES = {"oversampled_training": q_oversampled_training}
ORACLE = {"oversampled_training": SQL_OVERSAMPLED_TRAINING}
