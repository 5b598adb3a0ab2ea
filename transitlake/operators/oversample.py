"""Minority oversampling by interpolation between neighbours.

Every class is filled up to the size of the largest.  A class short of ``need``
rows gives each of its n rows need / n synthetic copies, and one more to the
first need % n rows in hash order.  A copy lies on the line from its row to one
of the row's ``k`` nearest neighbours of the same class; which neighbour and how
far come from a hash of (seed, row, copy), so the table is the same on every run
and in any SQL engine.

Neighbours are exact (Euclidean; ties by row id) and found without comparing
all pairs:

1. Equal feature vectors of a class become one point that keeps its first k + 1
   row ids, so a group of copies costs one point.
2. Points are dealt to cells by cuts at medians of some of them (taken in hash
   order), as in a k-d tree.  A cell's own points give each of them k + 1 rows
   within some distance; the largest of these is the cell's reach.  Only points
   within the reach of the cell's box can be neighbours: exactly those are sent.
3. Cells are searched side by side.  The points of a large cell are dealt over
   several tasks, each with the cell's candidates.  A task cuts its candidates
   in the same way and compares a group of points with those within its reach.

A box is never farther than a point in it, after rounding too: the squares of
the gaps are added up in the order of the features as those of the points are.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transitlake.operators.sampling import order_key, select_by_quota
from transitlake.schema import ROW_ID
from transitlake.sources.materialize import materialize

CELL_POINTS = 1000  # aimed at; a class has some 2 * MAX_CELLS cells at most
MAX_CELLS = 4096
SAMPLE = 8  # points a cell that the cuts are taken from
LEAF = 64  # points that a task compares with the same candidates
TASK_POINTS = 20_000
CHUNK = 1 << 21  # distances held at once
SENT = 1 << 16  # rows of a batch


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, rows of a x rows of b, added up in feature order."""
    out = np.zeros((len(a), len(b)))
    for f in range(a.shape[1]):
        gap = a[:, f, None] - b[None, :, f]
        out += gap * gap
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _gaps(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x from a box."""
    out = np.zeros(len(x))
    for f in range(x.shape[1]):
        gap = np.maximum(np.maximum(low[f] - x[:, f], x[:, f] - high[f]), 0)
        out += gap * gap
    return out


def cuts(x: np.ndarray, size: int, least: int, number=None):
    """Nested (feature, value, low side, high side); a part that has at most
    ``size`` points, or no cut that leaves ``least`` on both sides, is a number."""
    number = count() if number is None else number
    if len(x) > size:
        for f in np.argsort(x.min(axis=0) - x.max(axis=0), kind="stable"):
            column = x[:, f]
            value = np.partition(column, (len(x) - 1) // 2)[(len(x) - 1) // 2]
            if (column > value).sum() < least and (column < value).any():
                value = column[column < value].max()
            low = column <= value
            if least <= low.sum() <= len(x) - least:
                return int(f), float(value), cuts(x[low], size, least, number), cuts(x[~low], size, least, number)
    return next(number)


def parts_of(x: np.ndarray, tree) -> dict[int, np.ndarray]:
    """Part -> its rows of x, for the parts that have any."""
    out, todo = {}, [(tree, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if not isinstance(node, tuple):
            out[node] = rows
            continue
        f, value, low, high = node
        goes = x[rows, f] <= value
        todo += [(side, r) for side, r in ((low, rows[goes]), (high, rows[~goes])) if len(r)]
    return out


def boxes(tree, of: dict):
    """(low, high, reach, part, sides) of every node of a tree from those of its
    parts, ``of``: part -> (low, high, reach); None without points."""
    if not isinstance(tree, tuple):
        return (*of[tree], tree, ()) if tree in of else None
    sides = [s for s in (boxes(t, of) for t in tree[2:]) if s]
    if len(sides) < 2:
        return sides[0] if sides else None
    a, b = sides
    return np.minimum(a[0], b[0]), np.maximum(a[1], b[1]), max(a[2], b[2]), None, sides


def reached(x: np.ndarray, box) -> list[tuple[int, np.ndarray]]:
    """(part, rows of x within its reach)."""
    out, todo = [], [(box, np.arange(len(x)))] if box else []
    while todo:
        (low, high, reach, part, sides), rows = todo.pop()
        rows = rows[_gaps(x[rows], low, high) <= reach]
        if len(rows):
            out += [] if sides else [(part, rows)]
            todo += [(s, rows) for s in sides]
    return out


def _edge(d: np.ndarray, k: int) -> np.ndarray:
    """Each row's k + 1 st smallest entry; infinite where there are fewer."""
    return np.partition(d, k, axis=1)[:, k] if d.shape[1] > k else np.full(len(d), np.inf)


def groups(q: np.ndarray, c: np.ndarray, times: np.ndarray, k: int):
    """The rows of q in groups, each with the rows of c (``times`` rows of the
    table each) among which the k + 1 nearest of all its rows lie."""
    tree = cuts(c, LEAF, k + 1)
    near = parts_of(c, tree)
    for part, rows in parts_of(q, tree).items():
        some = near[part]
        reach = _edge(np.repeat(_squares(q[rows], c[some]), times[some], axis=1), k).max()
        yield rows, np.flatnonzero(_gaps(c, q[rows].min(axis=0), q[rows].max(axis=0)) <= reach)


def points(df: DataFrame, label: str, features: list[str], row_id: str, k: int) -> DataFrame:
    """class, vec, ids: the distinct vectors of each class with the first
    k + 1 ids of their rows."""
    rows = df.select(F.col(label).alias("class"), F.col(row_id).alias("id"), F.array(*[F.col(f).cast("double") for f in features]).alias("vec"))
    first = F.row_number().over(Window.partitionBy("class", "vec").orderBy("id"))
    return (rows.withColumn("_n", first).where(F.col("_n") <= k + 1)
            .groupBy("class", "vec").agg(F.array_sort(F.collect_list("id")).alias("ids")))


def class_neighbours(df: DataFrame, label: str, features: list[str], row_id: str = ROW_ID, k: int = 5) -> DataFrame:
    """class, vec, near: for every distinct vector of every class the k + 1
    nearest rows (id, vec), nearest first, rows of the vector itself included."""
    width = len(features)
    pts = materialize(points(df, label, features, row_id, k), "knn_points")
    sizes = {r["class"]: r["n"] for r in pts.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}
    trees = {}
    for c, n in sizes.items():
        cells = min(MAX_CELLS, max(1, n // CELL_POINTS))
        some = (pts.where(F.col("class").eqNullSafe(c)).orderBy(F.md5(F.col("ids")[0].cast("string")), F.col("ids")[0])
                .limit(cells * SAMPLE).select("vec").toArrow().column("vec").combine_chunks())
        trees[c] = cuts(_matrix(some, width), SAMPLE, 2) if cells > 1 else 0
    kind = pts.schema["class"].dataType.simpleString()
    id_kind = pts.schema["ids"].dataType.elementType.simpleString()

    def rows_of(batch):
        """Class -> its rows of a batch."""
        classes = batch.column("class").to_pylist()
        return {c: np.flatnonzero([v == c for v in classes]) for c in set(classes)}

    def assign(batches):
        for batch in batches:
            x, cell = _matrix(batch.column("vec"), width), np.zeros(batch.num_rows, "i4")
            for c, mine in rows_of(batch).items():
                for number, rows in parts_of(x[mine], trees[c]).items():
                    cell[mine[rows]] = number
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    dealt = materialize(pts.mapInArrow(assign, f"class {kind}, vec array<double>, ids array<{id_kind}>, cell int"), "knn_cells")

    def bound(table: pa.Table) -> pa.Table:
        """A cell's points, box and reach."""
        x = _matrix(table.column("vec").combine_chunks(), width)
        times = np.array([len(i) for i in table.column("ids").to_pylist()], "i8")
        reach = max(_edge(np.repeat(_squares(x[rows], x[some]), times[some], axis=1), k).max() for rows, some in groups(x, x, times, k))
        made = {"n": pa.array([len(x)], pa.int64()), "low": pa.array([x.min(axis=0).tolist()], pa.list_(pa.float64())),
                "high": pa.array([x.max(axis=0).tolist()], pa.list_(pa.float64())), "reach": pa.array([float(reach)], pa.float64())}
        return pa.table({"class": table.column("class").slice(0, 1), "cell": table.column("cell").slice(0, 1), **made})

    bounds = materialize(dealt.groupBy("class", "cell").applyInArrow(
        bound, f"class {kind}, cell int, n long, low array<double>, high array<double>, reach double"), "knn_bounds")
    of: dict = {c: {} for c in sizes}
    parts: dict = {c: {} for c in sizes}
    for r in bounds.collect():  # a row per cell
        of[r["class"]][r.cell] = np.array(r.low), np.array(r.high), r.reach
        parts[r["class"]][r.cell] = -(-r.n // TASK_POINTS)
    tops = {c: boxes(t, of[c]) for c, t in trees.items()}

    def send(batches):
        """Each point to every (cell, part) that may need it."""
        for batch in batches:
            x = _matrix(batch.column("vec"), width)
            for c, mine in rows_of(batch).items():
                found = reached(x[mine], tops[c])
                n = np.array([parts[c][cell] for cell, _ in found])
                size = np.array([len(rows) for _, rows in found])
                row = np.concatenate([np.tile(mine[rows], m) for (_, rows), m in zip(found, n)])
                cell = np.repeat(np.array([cell for cell, _ in found], "i4"), size * n)
                part = np.concatenate([np.repeat(np.arange(m, dtype="i4"), s) for m, s in zip(n, size)])
                for at in range(0, len(row), SENT):
                    upto = slice(at, at + SENT)
                    yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(row[upto])) for i in range(3)), pa.array(cell[upto]),
                                                      pa.array(part[upto])], names=["class", "vec", "ids", "cell", "part"])

    def search(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        q, c = (_matrix(t.column("vec").combine_chunks(), width) for t in (queries, candidates))
        ids = [(i, row) for row, many in enumerate(candidates.column("ids").to_pylist()) for i in many]
        ids.sort(key=lambda e: e[0])
        place = np.array([row for _, row in ids], "i8")  # rows in the order of their ids
        owner, picked = [np.zeros(0, "i8")], [np.zeros(0, "i8")]
        for rows, some in groups(q, c, np.bincount(place, minlength=len(c)), k):
            keep = np.zeros(len(c), bool)
            keep[some] = True
            own = np.flatnonzero(keep[place])
            step = max(1, CHUNK // max(1, len(own)))
            for s in range(0, len(rows), step):
                d = _squares(q[rows[s:s + step]], c[some])[:, np.searchsorted(some, place[own])]
                row, at = np.nonzero(d <= _edge(d, k)[:, None])
                order = np.lexsort((d[row, at], row))  # stable: ties by id
                row, at = row[order], at[order]
                first = np.arange(len(row)) - np.searchsorted(row, row) <= k
                owner.append(rows[s:s + step][row[first]])
                picked.append(own[at[first]])
        owner, picked = np.concatenate(owner), np.concatenate(picked)
        picked = picked[np.argsort(owner, kind="stable")]
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(picked) + 1, dtype="i4") * width), pa.array(c[place[picked]].ravel()))
        found = pa.StructArray.from_arrays([pa.array([ids[j][0] for j in picked], near_type.value_type.field(0).type), flat],
                                           fields=list(near_type.value_type))
        ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(q)))]).astype("i4")
        return pa.table({"class": queries.column("class"), "vec": queries.column("vec"),
                         "near": pa.ListArray.from_arrays(pa.array(ends), found, type=near_type)})

    near_type = pa.list_(pa.struct([pa.field("id", pts.select(F.col("ids")[0].alias("id")).limit(0).toArrow().schema.field("id").type),
                                    pa.field("vec", pa.list_(pa.float64()))]))
    b = bounds.select(F.col("class").alias("_c"), F.col("cell").alias("_cell"), F.ceil(F.col("n") / TASK_POINTS).alias("_parts"))
    part = F.pmod(F.xxhash64("vec"), F.col("_parts")).cast("int")
    queries = dealt.join(F.broadcast(b), F.col("class").eqNullSafe(F.col("_c")) & (F.col("cell") == F.col("_cell"))).select(
        "class", "vec", "cell", part.alias("part"))
    sent = dealt.select("class", "vec", "ids").mapInArrow(send, f"class {kind}, vec array<double>, ids array<{id_kind}>, cell int, part int")
    keys = ["class", "cell", "part"]
    return queries.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(
        search, f"class {kind}, vec array<double>, near array<struct<id:{id_kind},vec:array<double>>>")


def oversample(df: DataFrame, label: str, features: list[str], row_id: str = ROW_ID, k: int = 5, seed: int = 42) -> DataFrame:
    """label, row_id, copy, neighbour_id, features: the rows of ``df`` (copy
    and neighbour NULL) and the synthetic ones.  Features must not be NULL;
    rows without a label are left out.  A class of one row is copied as it is."""
    rows = materialize(df.where(F.col(label).isNotNull()).select(label, row_id, *[F.col(f).cast("double").alias(f) for f in features]), "oversample")
    sizes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    need = F.max("_n").over(Window.partitionBy()) - F.col("_n")  # one row per class
    plan = materialize(sizes.withColumn("_need", need).where(F.col("_need") > 0), "oversample_need")
    original = rows.select(label, row_id, F.lit(None).cast("int").alias("copy"),
                           F.lit(None).cast(rows.schema[row_id].dataType).alias("neighbour_id"), *features)
    if plan.isEmpty():
        return original
    short = rows.join(plan.select(label), label, "left_semi")
    near = class_neighbours(short, label, features, row_id, k)
    picked = select_by_quota(short, [label], plan.select(label, (F.col("_need") % F.col("_n")).alias("quota")), seed, row_id, "_more")
    copies = F.expr("_need div _n").cast("int") + F.col("_more").cast("int")
    base = picked.join(plan, label).withColumn("_copies", copies).where("_copies > 0").withColumn("vec", F.array(*features))
    base = base.join(near.withColumnRenamed("class", label), [label, "vec"])
    other = F.slice(F.filter("near", lambda e: e["id"] != F.col(row_id)), 1, k)
    base = base.withColumn("near", other).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row_id).cast("string"), F.col("copy").cast("string")))
    part = lambda at: F.conv(F.substring(h, at, 8), 16, 10).cast("long")
    base = base.withColumns({"_u": part(1) / F.lit(float(1 << 32)), "_to": F.when(
        F.size("near") > 0, F.get("near", (part(9) % F.greatest(F.size("near"), F.lit(1))).cast("int")))})
    moved = [(F.col(f) + F.col("_u") * (F.coalesce(F.col("_to.vec")[i], F.col(f)) - F.col(f))).alias(f) for i, f in enumerate(features)]
    return original.unionByName(base.select(label, row_id, "copy", F.col("_to.id").alias("neighbour_id"), *moved))
