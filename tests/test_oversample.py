"""Exact neighbours within classes and the oversampled table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from transitlake.operators import oversample as OS


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(900, 3)) * rng.choice([0.1, 1, 5], size=(900, 1)), 1)
    x[300:420] = x[300]  # a group of copies
    label = np.where(np.arange(900) % 3 == 0, "a", np.where(np.arange(900) < 700, "b", "c"))
    made = [(i * 7 % 1000, str(c), *map(float, v)) for i, (c, v) in enumerate(zip(label, x))]
    return made, spark.createDataFrame(made, "row_id long, label string, x double, y double, z double").repartition(4)


def squares(v, w):
    out = 0.0
    for p, q in zip(v, w):  # in feature order; sum() would compensate
        out += (p - q) * (p - q)
    return out


def plain(made, k):
    out = {}
    for i, c, *v in made:
        d = sorted((squares(v, w), j) for j, e, *w in made if e == c and j != i)
        out[i] = [j for _, j in d[:k]]
    return out


@pytest.mark.parametrize("cell,task", [(1000, 20_000), (20, 7)])
def test_neighbours_equal_brute_force(rows, monkeypatch, cell, task):
    made, df = rows
    monkeypatch.setattr(OS, "CELL_POINTS", cell)
    monkeypatch.setattr(OS, "TASK_POINTS", task)
    near = {(r["class"], tuple(r.vec)): [e.id for e in r.near] for r in OS.class_neighbours(df, "label", ["x", "y", "z"]).collect()}
    want = plain(made, 5)
    for i, c, *v in made:
        assert [j for j in near[c, tuple(v)] if j != i][:5] == want[i]


def test_classes_become_equal_and_copies_lie_between(rows):
    made, df = rows
    out = OS.oversample(df, "label", ["x", "y", "z"])
    counts = {r.label: r["count"] for r in out.groupBy("label").count().collect()}
    assert len(set(counts.values())) == 1 and len(counts) == 3
    at, want = {i: v for i, _, *v in made}, plain(made, 5)
    got = out.where("copy is not null").collect()
    assert len({(r.row_id, r["copy"]) for r in got}) == len(got) > 0
    for r in got:
        assert r.neighbour_id in want[r.row_id]
        for f, p, q in zip(("x", "y", "z"), at[r.row_id], at[r.neighbour_id]):
            assert min(p, q) - 1e-9 <= r[f] <= max(p, q) + 1e-9
    assert out.where("copy is null").count() == len(made)


def test_single_row_classes_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (2, "b", 1.0), (3, "b", 2.0), (4, None, 2.0)], "row_id long, label string, x double")
    got = OS.oversample(df, "label", ["x"]).where("copy is not null").collect()
    assert [(r.row_id, r.label, r.neighbour_id, r.x) for r in got] == [(1, "a", None, 0.5)]
    assert OS.oversample(df.where("false"), "label", ["x"]).count() == 0
    even = df.where("row_id in (1, 2)")
    assert OS.oversample(even, "label", ["x"]).where(F.col("copy").isNotNull()).count() == 0


def test_points_are_compared_with_near_ones_only(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.uniform(size=(4000, 3))
    compared, seen = 0, []
    for rows, some in OS.groups(x, x, np.ones(len(x), "i8"), 5):
        seen += rows.tolist()
        compared += len(rows) * len(some)
        d = OS._squares(x[rows], x)
        nearest = np.argsort(d, axis=1, kind="stable")[:, :6]
        assert np.isin(nearest, some).all()
    assert sorted(seen) == list(range(len(x))) and compared < 0.2 * len(x) ** 2
    tree = OS.cuts(x[:200], 8, 2)
    parts = OS.parts_of(x, tree)
    of = {c: (x[r].min(axis=0), x[r].max(axis=0), 0.001) for c, r in parts.items()}
    found = dict(OS.reached(x, OS.boxes(tree, of)))
    assert all(np.array_equal(found[c], np.flatnonzero(OS._gaps(x, *of[c][:2]) <= 0.001)) for c in parts)


def test_equal_distances_go_by_id_across_cells(spark, monkeypatch):
    monkeypatch.setattr(OS, "CELL_POINTS", 20)
    made = [(i * 37 % 343, "a", float(i % 7), float(i // 7 % 7), float(i // 49)) for i in range(343)]
    df = spark.createDataFrame(made, "row_id long, label string, x double, y double, z double")
    want = plain(made, 5)
    near = {tuple(r.vec): [e.id for e in r.near] for r in OS.class_neighbours(df, "label", ["x", "y", "z"]).collect()}
    assert all([j for j in near[tuple(v)] if j != i][:5] == want[i] for i, _, *v in made)
