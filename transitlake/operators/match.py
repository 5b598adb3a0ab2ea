"""Cross-survey near-duplicate match.

Specification: order all rows by (ra, dec, period) - ties broken by
(mission, row_id) - and compare each row with its successor; the pair is
a twin when |d ra| < ra_tol, |d dec| < dec_tol, |d period| < period_tol
(all strict) and the missions differ.  In each pair the better
disposition wins (CONFIRMED > FALSE POSITIVE > CANDIDATE > other), a tie
goes to the TESS row, else to the first row.  The union of all losers is
removed.

Scale: a global ``orderBy`` window would run in one task.  The default
``"range"`` strategy range-partitions on the full sort key, which is unique
because it ends in row_id, so partitions are balanced whatever the ra
distribution (a third of all rows at one ra included).  Each sorted
partition is read once as a stream that compares every row with the one
before it and gives out the close pairs and, as boundaries, its first and
last row.  That output is written once to the shared folder; the last row
of a partition is then compared with the first of the next non-empty one
from the boundaries, aggregated to one row per partition.  Pairs and
boundaries come from one pass over one exchange, so the answer does not
depend on how often Spark runs or reuses an exchange, and rows are
shuffled once.

``"cells"`` (right-ascension cells with halo rows, see ``_halo_frame``) is
kept for inputs known to be spread out.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transitlake.schema import DISPOSITION_RANK, MISSION, ROW_ID, TARGET
from transitlake.sources.materialize import materialize

RA, DEC, PERIOD = "merged_ra", "merged_dec", "merged_koi_period"


def disposition_rank(c):
    out = None
    for name, r in DISPOSITION_RANK:
        out = F.when(c == name, r) if out is None else out.when(c == name, r)
    return out.otherwise(0)


def _halo_frame(df: DataFrame, ra: str, ra_tol: float, cell_width: float) -> DataFrame:
    """Each row once as core in its cell, and once more as halo in the
    previous cell when it lies within 2*ra_tol of the cell start.  One
    pass over the input (explode), not a union that scans it twice."""
    cell = F.floor(F.col(ra) / F.lit(cell_width))
    with_cell = df.withColumn("_c", cell)
    near_start = F.col(ra) - F.col("_c") * F.lit(cell_width) < F.lit(2 * ra_tol)
    copies = F.when(near_start, F.array(
        F.struct(F.col("_c").alias("cell"), F.lit(True).alias("core")),
        F.struct((F.col("_c") - 1).alias("cell"), F.lit(False).alias("core")),
    )).otherwise(F.array(F.struct(F.col("_c").alias("cell"), F.lit(True).alias("core"))))
    out = with_cell.select("*", F.inline(copies)).drop("_c")
    return out.withColumnRenamed("cell", "_cell").withColumnRenamed("core", "_core")


def positioned(df: DataFrame, ra: str = RA, dec: str = DEC, period: str = PERIOD) -> DataFrame:
    """Rows with position and period."""
    return df.where(F.col(ra).isNotNull() & F.col(dec).isNotNull() & F.col(period).isNotNull())


_ORDER = ("ra", "dec", "per", "mis", "rid")
_ROW = ("rid", "ra", "dec", "per", "mis", "disp")


def _adjacent_by_cells(base: DataFrame, ra_tol: float, cell_width: float) -> DataFrame:
    """Each row with its global successor ``_n`` (cells + halo)."""
    framed = _halo_frame(base, "ra", ra_tol, cell_width)
    w = Window.partitionBy("_cell").orderBy(*_ORDER)
    adj = framed.withColumn("_n", F.lead(F.struct(*_ROW)).over(w))
    return adj.where(F.col("_core") & F.col("_n").isNotNull()).drop("_cell", "_core")


def _neighbour_pass(base: DataFrame, partitions: int, ra_tol: float, dec_tol: float,
                    period_tol: float) -> DataFrame:
    """Close neighbours (kind "pair") and boundary rows (kind "first", "last")
    of each range partition, in one streaming pass."""
    types = dict(base.dtypes)
    one = [f"{c} {types[c]}" for c in _ROW]
    schema = ", ".join(["kind string", "part int", *one, *[f"n_{c} {types[c]}" for c in _ROW]])
    names = ["kind", "part", *_ROW, *[f"n_{c}" for c in _ROW]]

    def run(batches):
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if last is None:
                yield _labelled("first", batch.slice(0, 1), None)
                table = pa.Table.from_batches([batch])
            else:
                table = pa.Table.from_batches([last, batch])
            table = table.combine_chunks()
            here, after = table.slice(0, table.num_rows - 1), table.slice(1)
            close = pc.not_equal(here["mis"], after["mis"])
            for c, tol in (("ra", ra_tol), ("dec", dec_tol), ("per", period_tol)):
                close = pc.and_(close, pc.less(pc.abs(pc.subtract(_double(here[c]), _double(after[c]))), tol))
            close = pc.fill_null(close, False)
            if pc.any(close).as_py():
                yield _labelled("pair", here.filter(close), after.filter(close))
            last = batch.slice(batch.num_rows - 1)
        if last is not None:
            yield _labelled("last", last, None)

    def _labelled(kind, here, after):
        n = here.num_rows
        part = TaskContext.get().partitionId()
        columns = [pa.array([kind] * n), pa.array([part] * n, pa.int32()), *(_flat(here.column(c)) for c in _ROW)]
        columns += [_flat(after.column(c)) if after is not None else pa.nulls(n, _flat(here.column(c)).type) for c in _ROW]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def _double(column):
        return pc.cast(column, pa.float64(), safe=False)

    def _flat(column):
        if isinstance(column, pa.ChunkedArray):
            return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
        return column

    return (base.select(*_ROW).repartitionByRange(partitions, *_ORDER).sortWithinPartitions(*_ORDER)
            .mapInArrow(run, schema))


def _adjacent_by_ranges(base: DataFrame, partitions: int, *tolerances: float) -> DataFrame:
    """Each row with a close global successor ``_n``, and every boundary row
    with its own."""
    found = materialize(_neighbour_pass(base, partitions, *tolerances), "neighbours")
    inner = found.where("kind = 'pair'").select(*_ROW, F.struct(*[F.col(f"n_{c}").alias(c) for c in _ROW]).alias("_n"))
    whole = F.struct(*_ORDER, "disp")
    edges = (found.where("kind <> 'pair'").groupBy("part")
             .agg(F.min(F.when(F.col("kind") == "first", whole)).alias("_f"),
                  F.max(F.when(F.col("kind") == "last", whole)).alias("_l")))
    # one row per partition
    over = edges.withColumn("_g", F.lead("_f").over(Window.orderBy("_f"))).where(F.col("_g").isNotNull())
    over = over.select(*[F.col("_l")[c].alias(c) for c in _ROW], F.struct(*[F.col("_g")[c].alias(c) for c in _ROW]).alias("_n"))
    return inner.unionByName(over)


def dup_pairs(df: DataFrame, ra_tol: float = 0.001, dec_tol: float = 0.001,
              period_tol: float = 0.01, cell_width: float = 0.1,
              ra: str = RA, dec: str = DEC, period: str = PERIOD,
              mission: str = MISSION, disposition: str = TARGET,
              row_id: str = ROW_ID, strategy: str = "range",
              partitions: int | None = None) -> DataFrame:
    """Adjacent cross-survey twins with winner and loser.

    ``strategy``: "range" (default, skew-proof) or "cells".  Output: row_id_1, row_id_2,
    mission_1, mission_2, disposition_1, disposition_2, keep_id, drop_id.
    """
    if cell_width <= 2 * ra_tol:
        raise ValueError("cell_width must exceed 2 * ra_tol")
    base = (positioned(df, ra, dec, period)
              .select(F.col(row_id).alias("rid"), F.col(ra).alias("ra"), F.col(dec).alias("dec"),
                      F.col(period).alias("per"), F.col(mission).alias("mis"),
                      F.col(disposition).alias("disp")))
    if strategy == "cells":
        adj = _adjacent_by_cells(base, ra_tol, cell_width)
    elif strategy == "range":
        n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        adj = _adjacent_by_ranges(base, n, ra_tol, dec_tol, period_tol)
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    pairs = adj.where(
        (F.abs(F.col("ra") - F.col("_n.ra")) < ra_tol)
        & (F.abs(F.col("dec") - F.col("_n.dec")) < dec_tol)
        & (F.abs(F.col("per") - F.col("_n.per")) < period_tol)
        & (F.col("mis") != F.col("_n.mis")))
    p1, p2 = disposition_rank(F.col("disp")), disposition_rank(F.col("_n.disp"))
    first_wins = (p1 > p2) | ((p1 == p2) & ((F.col("mis") == "TESS") | (F.col("_n.mis") != "TESS")))
    return pairs.select(
        F.col("rid").alias("row_id_1"), F.col("_n.rid").alias("row_id_2"),
        F.col("mis").alias("mission_1"), F.col("_n.mis").alias("mission_2"),
        F.col("disp").alias("disposition_1"), F.col("_n.disp").alias("disposition_2"),
        F.when(first_wins, F.col("rid")).otherwise(F.col("_n.rid")).alias("keep_id"),
        F.when(first_wins, F.col("_n.rid")).otherwise(F.col("rid")).alias("drop_id"),
    )


def remove_cross_mission_duplicates(df: DataFrame, row_id: str = ROW_ID, required=None,
                                    **kw) -> DataFrame:
    """Drop rows without position/period, then every loser of any pair.

    Column names default to the catalog's and follow ``kw`` (ra, dec,
    period, mission, disposition), so any table can be deduplicated.
    Schema-tolerant: if a required column is missing (e.g. an inference
    frame without a target) the frame is returned unchanged.  The losers
    are removed with a left-anti join on row id; AQE turns it into a
    broadcast join at runtime when the loser set is small, and keeps the
    sort-merge join when it is not.
    """
    ra, dec, period = kw.get("ra", RA), kw.get("dec", DEC), kw.get("period", PERIOD)
    if required is None:
        required = (ra, dec, period, kw.get("mission", MISSION), kw.get("disposition", TARGET))
    if not all(c in df.columns for c in required):
        return df
    kept = positioned(df, ra, dec, period)
    losers = dup_pairs(kept, row_id=row_id, **kw).select(F.col("drop_id").alias(row_id)).distinct()
    return kept.join(losers, on=row_id, how="left_anti")
