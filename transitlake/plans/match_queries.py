"""The near-duplicate match on a second, larger table (C1-C3 on lineitem).

The match operator is generic over its column names.  Here a line item's
extended price, quantity and discount play position and period, the line
status plays the survey and the return flag the disposition (no flag
ranks above another, so each pair keeps its first row).  Rows carry a
surrogate id: (l_orderkey, l_linenumber) repeats in this data, while
(l_orderkey, l_linenumber, l_partkey, l_suppkey) is unique, so the id is
those four keys as text - built per row, ordered the same way in both
engines, with no window or numbering pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transitlake.functions.expr import round_doubles
from transitlake.operators.match import dup_pairs, remove_cross_mission_duplicates
from transitlake.sources.tables import read_table

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
COLUMNS = dict(ra="l_extendedprice", dec="l_quantity", period="l_discount",
               mission="l_linestatus", disposition="l_returnflag", row_id="line_id")
# price within 5.0, same quantity, discount within one step
TOLERANCES = dict(ra_tol=5.0, dec_tol=0.5, period_tol=0.015, cell_width=20.0)


def keyed_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    return li.withColumn("line_id", F.concat_ws("-", *[F.col(k).cast("string") for k in KEYS]))


def q_lineitem_dup_pairs(spark, sf_dir):
    return dup_pairs(keyed_lineitem(spark, sf_dir), **COLUMNS, **TOLERANCES)


def q_lineitem_survivors(spark, sf_dir):
    kept = remove_cross_mission_duplicates(keyed_lineitem(spark, sf_dir), **COLUMNS, **TOLERANCES)
    return round_doubles(kept.groupBy("l_linestatus", "l_returnflag").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("line_id").alias("min_line_id"),
        F.max("line_id").alias("max_line_id"), F.sum("l_quantity").alias("sum_quantity")))


LINEITEM_PAIRS = """
li AS (
  SELECT *, concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
                      CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)) AS line_id
  FROM lineitem
),
positioned AS (
  SELECT * FROM li
  WHERE l_extendedprice IS NOT NULL AND l_quantity IS NOT NULL AND l_discount IS NOT NULL
),
seq AS (
  SELECT line_id AS rid, l_linestatus AS mis, l_returnflag AS disp, l_extendedprice AS ra,
    l_quantity AS dec, l_discount AS per,
    LEAD(line_id) OVER w AS rid2, LEAD(l_linestatus) OVER w AS mis2,
    LEAD(l_returnflag) OVER w AS disp2, LEAD(l_extendedprice) OVER w AS ra2,
    LEAD(l_quantity) OVER w AS dec2, LEAD(l_discount) OVER w AS per2
  FROM positioned
  WINDOW w AS (ORDER BY l_extendedprice, l_quantity, l_discount, l_linestatus, line_id)
),
ranked AS (
  SELECT *,
    CASE disp WHEN 'CONFIRMED' THEN 3 WHEN 'FALSE POSITIVE' THEN 2 WHEN 'CANDIDATE' THEN 1 ELSE 0 END AS p1,
    CASE disp2 WHEN 'CONFIRMED' THEN 3 WHEN 'FALSE POSITIVE' THEN 2 WHEN 'CANDIDATE' THEN 1 ELSE 0 END AS p2
  FROM seq
  WHERE rid2 IS NOT NULL AND abs(ra - ra2) < 5.0 AND abs(dec - dec2) < 0.5
    AND abs(per - per2) < 0.015 AND mis <> mis2
),
pairs AS (
  SELECT rid AS row_id_1, rid2 AS row_id_2, mis AS mission_1, mis2 AS mission_2,
    disp AS disposition_1, disp2 AS disposition_2,
    CASE WHEN p1 > p2 OR (p1 = p2 AND (mis = 'TESS' OR mis2 <> 'TESS')) THEN rid ELSE rid2 END AS keep_id,
    CASE WHEN p1 > p2 OR (p1 = p2 AND (mis = 'TESS' OR mis2 <> 'TESS')) THEN rid2 ELSE rid END AS drop_id
  FROM ranked
)"""

SQL_LINEITEM_DUP_PAIRS = "WITH " + LINEITEM_PAIRS.strip() + "\nSELECT * FROM pairs"

SQL_LINEITEM_SURVIVORS = "WITH " + LINEITEM_PAIRS.strip() + """
SELECT l_linestatus, l_returnflag, count(*) AS n_rows, min(line_id) AS min_line_id,
       max(line_id) AS max_line_id, round(sum(l_quantity), 6) AS sum_quantity
FROM positioned WHERE line_id NOT IN (SELECT drop_id FROM pairs)
GROUP BY l_linestatus, l_returnflag"""

QUERIES = {
    "lineitem_dup_pairs": q_lineitem_dup_pairs,
    "lineitem_survivors": q_lineitem_survivors,
}

ORACLE = {
    "lineitem_dup_pairs": SQL_LINEITEM_DUP_PAIRS,
    "lineitem_survivors": SQL_LINEITEM_SURVIVORS,
}
