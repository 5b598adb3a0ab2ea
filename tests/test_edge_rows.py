"""Hand-made edge rows (unit tests for the semantics of each operator)."""

import math

import numpy as np

import pytest
from pyspark.sql import functions as F

from transitlake.functions.features import add_features, catboost_features, uncertainty_features
from transitlake.functions.habitability import add_habitability
from transitlake.operators.clean import exact_dedupe, fit_sparse_columns, null_impossible
from transitlake.functions.normal import probit, probit_argument
from transitlake.operators.fitted import QuantileNormalModel, fit_quantile_normal
from transitlake.operators.match import dup_pairs, remove_cross_mission_duplicates
from transitlake.operators.sampling import survey_first_split

COLS = "row_id long, mission string, merged_koi_disposition string, merged_ra double, merged_dec double, merged_koi_period double"


def frame(spark, rows):
    return spark.createDataFrame(rows, COLS)


def survivors(spark, rows, **kw):
    return sorted(r.row_id for r in remove_cross_mission_duplicates(frame(spark, rows), **kw).collect())


def test_equal_rank_keeps_tess(spark):
    rows = [(1, "KEPLER", "CANDIDATE", 10.0, 5.0, 3.0), (2, "TESS", "CANDIDATE", 10.0005, 5.0, 3.0)]
    assert survivors(spark, rows) == [2]


def test_unequal_rank_keeps_better(spark):
    rows = [(1, "KEPLER", "CONFIRMED", 10.0, 5.0, 3.0), (2, "TESS", "CANDIDATE", 10.0005, 5.0, 3.0)]
    assert survivors(spark, rows) == [1]


def test_unknown_disposition_loses(spark):
    rows = [(1, "KEPLER", "CANDIDATE", 10.0, 5.0, 3.0), (2, "TESS", None, 10.0005, 5.0, 3.0)]
    assert survivors(spark, rows) == [1]


def test_chain_k_t_k(spark):
    rows = [(1, "KEPLER", "CANDIDATE", 10.0, 5.0, 3.0), (2, "TESS", "CANDIDATE", 10.0003, 5.0, 3.0),
            (3, "KEPLER", "CANDIDATE", 10.0006, 5.0, 3.0)]
    assert survivors(spark, rows) == [2]


def test_union_of_losers(spark):
    rows = [(1, "KEPLER", "CONFIRMED", 10.0, 5.0, 3.0), (2, "TESS", "CANDIDATE", 10.0003, 5.0, 3.0),
            (3, "KEPLER", None, 10.0006, 5.0, 3.0)]
    assert survivors(spark, rows) == [1]


def test_same_mission_kept(spark):
    rows = [(1, "KEPLER", "CANDIDATE", 10.0, 5.0, 3.0), (2, "KEPLER", "CANDIDATE", 10.0005, 5.0, 3.0)]
    assert survivors(spark, rows) == [1, 2]


def test_tolerance_is_strict(spark):
    rows = [(1, "KEPLER", "CANDIDATE", 0.5, 5.0, 3.0), (2, "TESS", "CANDIDATE", 0.5 + 0.0010000001, 5.0, 3.0)]
    assert survivors(spark, rows) == [1, 2]


def test_null_position_removed_and_no_target_skips(spark):
    rows = [(1, "KEPLER", "CANDIDATE", None, 5.0, 3.0), (2, "TESS", "CANDIDATE", 20.0, 5.0, 3.0)]
    assert survivors(spark, rows) == [2]
    inference = frame(spark, rows).drop("merged_koi_disposition")
    assert remove_cross_mission_duplicates(inference).count() == 2


def test_halo_across_cell_boundary(spark):
    # pair straddles the 0.1-degree cell edge at 10.1
    rows = [(1, "KEPLER", "CANDIDATE", 10.0999, 5.0, 3.0), (2, "TESS", "CANDIDATE", 10.1003, 5.0, 3.0)]
    assert survivors(spark, rows) == [2]
    for w in (0.01, 0.1, 1.0, 45.0):
        assert dup_pairs(frame(spark, rows), cell_width=w, strategy="cells").count() == 1


def test_cell_width_invariance(spark):
    from transitlake.plans.catalog_queries import training
    t = training(spark, "/root/testdata/sf0.01")
    base = sorted(tuple(r) for r in dup_pairs(t, strategy="cells").collect())
    assert len(base) == 292
    for w in (0.005, 1.0, 360.0):
        assert sorted(tuple(r) for r in dup_pairs(t, cell_width=w, strategy="cells").collect()) == base
    assert sorted(tuple(r) for r in dup_pairs(t.repartition(13), strategy="cells").collect()) == base
    for n in (1, 7, 64):
        got = dup_pairs(t, strategy="range", partitions=n)
        assert sorted(tuple(r) for r in got.collect()) == base


def _brute_pairs(rows, ra_tol=0.001, dec_tol=0.001, period_tol=0.01):
    """Global-order scan in plain Python (the specification)."""
    rank = {"CONFIRMED": 3, "FALSE POSITIVE": 2, "CANDIDATE": 1}
    pos = sorted((r for r in rows if None not in (r[3], r[4], r[5])), key=lambda r: (r[3], r[4], r[5], r[1], r[0]))
    out = []
    for a, b in zip(pos, pos[1:]):
        if abs(a[3] - b[3]) < ra_tol and abs(a[4] - b[4]) < dec_tol and abs(a[5] - b[5]) < period_tol and a[1] != b[1]:
            p1, p2 = rank.get(a[2], 0), rank.get(b[2], 0)
            first = p1 > p2 or (p1 == p2 and (a[1] == "TESS" or b[1] != "TESS"))
            out.append((a[0], b[0], (a[0] if first else b[0]), (b[0] if first else a[0])))
    return sorted(out)


def test_hot_ra_range_strategy_matches_brute_force(spark):
    # a third of all rows share one ra value: no cell width can split them,
    # the range strategy spreads them over partitions by the full key
    rows = []
    for i in range(600):
        mis = "KEPLER" if i % 2 == 0 else "TESS"
        disp = ("CONFIRMED", "CANDIDATE", "FALSE POSITIVE", None)[i % 4]
        if i % 3 == 0:
            rows.append((i, mis, disp, 42.0, 5.0 + (i // 6) * 0.0004, 3.0 + (i % 5) * 0.004))
        else:
            rows.append((i, mis, disp, 10.0 + (i * 37 % 600) * 0.0007, 5.0 + (i % 7) * 0.0005, 3.0))
    want = _brute_pairs(rows)
    assert len(want) > 20
    for strategy, n in (("cells", None), ("range", 1), ("range", 5), ("range", 33)):
        got = dup_pairs(frame(spark, rows), strategy=strategy, partitions=n)
        assert sorted((r.row_id_1, r.row_id_2, r.keep_id, r.drop_id) for r in got.collect()) == want
    # partial sampling of range bounds and no exchange reuse change nothing
    for key, value in (("spark.sql.exchange.reuse", "false"),
                       ("spark.sql.execution.rangeExchange.sampleSizePerPartition", "2")):
        before = spark.conf.get(key)
        spark.conf.set(key, value)
        try:
            for n in (3, 100, 300):
                got = dup_pairs(frame(spark, rows).repartition(7), partitions=n)
                assert sorted((r.row_id_1, r.row_id_2, r.keep_id, r.drop_id) for r in got.collect()) == want
        finally:
            spark.conf.set(key, before)


def test_feature_nulls_and_flags(spark):
    df = spark.createDataFrame([(None, 0.25, 1.5), (60.0, 1.78, 2.0), (0.5, 0.0, 6.0)],
                               "merged_koi_period double, merged_koi_insol double, merged_koi_prad double")
    r = add_features(df).collect()
    assert r[0].feat_is_ultra_short_period == 0 and r[0].feat_log_period is None
    assert r[1].feat_is_habitable_zone_period == 1 and r[2].feat_is_ultra_short_period == 1
    assert r[2].feat_log_insol is None
    cb = df.select(*[v.alias(k) for k, v in catboost_features(set(df.columns)).items()]).collect()
    assert [x.habitable_zone_indicator for x in cb] == [0.0, 1.0, 0.0]
    assert [x.planet_size_category for x in cb] == [0.0, 1.0, 2.0]


def test_rel_uncertainty_guards(spark):
    df = spark.createDataFrame([(0.0, 1.0, 1.0), (2.0, None, 1.0), (2.0, 1.0, -1.0)],
                               "merged_koi_prad double, merged_koi_prad_err1 double, merged_koi_prad_err2 double")
    out = df.select(*[v.alias(k) for k, v in uncertainty_features(set(df.columns)).items()]).collect()
    assert out[0][0] is None and out[1][0] is None
    assert out[2][0] == pytest.approx(math.log10(0.5 + 1e-6))


def test_habitability_edges(spark):
    rows = [(200.0, 0.3, 1.0, 5000.0, 1.0), (273.0, 0.5, 0.3, 4000.0, 10.0), (373.0, 2.0, 1.8, 7000.0, 500.0),
            (450.0, 3.0, 3.0, 8000.0, 1000.0), (451.0, 0.0, None, 9000.0, 1001.0)]
    df = spark.createDataFrame(rows, "merged_koi_teq double, merged_koi_prad double, merged_koi_insol double, "
                                     "merged_koi_steff double, merged_koi_period double")
    r = add_habitability(df).collect()
    assert r[0].hab_temperature == pytest.approx(100 * math.exp(-((273 - 200) / 50) ** 2))
    assert r[1].hab_temperature == 100.0 and r[2].hab_temperature == 100.0
    assert r[3].hab_temperature == pytest.approx(100 * math.exp(-((450 - 373) / 50) ** 2))
    assert r[4].hab_temperature == pytest.approx(100 * math.exp(-((451 - 323) / 100) ** 2))
    assert r[0].hab_radius == pytest.approx(60.0) and r[2].hab_radius == 100.0
    assert r[4].hab_radius == 0.0 and r[4].hab_insolation == 0.0
    assert r[4].hab_orbital_stability == 50.0 and r[3].hab_orbital_stability == pytest.approx(
        100 * math.exp(-((1000 - 500) / 300) ** 2))


def test_ninety_percent_null_kept(spark):
    df = spark.createDataFrame([(float(i) if i == 0 else None, 1.0) for i in range(10)], "a double, b double")
    assert fit_sparse_columns(df, 0.90) == []
    df2 = spark.createDataFrame([(None, 1.0) for _ in range(10)], "a double, b double")
    assert fit_sparse_columns(df2, 0.90) == ["a"]


def test_impossible_values_nulled(spark):
    df = spark.createDataFrame([(-1.0, float("nan")), (0.0, float("inf")), (2.0, 3.0)],
                               "merged_koi_prad double, merged_koi_srad double")
    r = null_impossible(df).collect()
    assert [x.merged_koi_prad for x in r] == [None, None, 2.0]
    assert [x.merged_koi_srad for x in r] == [None, None, 3.0]


def test_exact_dedupe_null_safe(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, "a"), (3, 1.0, "a")], "row_id long, x double, y string")
    assert sorted(r.row_id for r in exact_dedupe(df).collect()) == [1, 3]


def test_split_shortage_and_exact_quotas(spark):
    rows = [(i, "TESS" if i < 20 else "KEPLER", "CANDIDATE" if i % 2 else "CONFIRMED", 0.0, 0.0, 1.0)
            for i in range(200)]
    s = survey_first_split(frame(spark, rows)).cache()
    assert s.count() == 200
    tr = {(r.mission): r["count"] for r in s.where("is_train").groupBy("mission").count().collect()}
    # T = 160; TESS has only 20 -> all of it; KEPLER fills 140
    assert tr == {"TESS": 20, "KEPLER": 140}


def test_quantile_normal_unseen_survey_and_monotone(spark):
    rows = [(i, "KEPLER", float(i)) for i in range(100)] + [(1000, "UNKNOWN", 5.0), (1001, "KEPLER", None)]
    df = spark.createDataFrame(rows, "row_id long, mission string, merged_koi_prad double")
    m = fit_quantile_normal(df.where("mission = 'KEPLER'"), ["merged_koi_prad"])
    out = {r.row_id: r.feat_qn_merged_koi_prad for r in m.transform(df).collect()}
    assert out[1000] == 0.0
    assert out[1001] is None or math.isnan(out[1001])
    vals = [out[i] for i in range(100)]
    assert all(b >= a for a, b in zip(vals, vals[1:]))
    assert abs(vals[50] + vals[49]) < 1e-9
    middle = QuantileNormalModel({"x": {"KEPLER": [float(i) for i in range(100)]}})
    one = spark.createDataFrame([("KEPLER", 49.5)], "mission string, x double")
    assert middle.transform(one).first().feat_qn_x == pytest.approx(0.0, abs=1e-12)
    p = F.lit(0.975)
    assert spark.range(1).select(probit(p, probit_argument(p))).first()[0] == pytest.approx(1.959963984540054, rel=1e-12)


def test_probit_is_the_inverse_normal(spark):
    from statistics import NormalDist
    ps = [1e-7, 1e-5, 0.001, 0.02, 0.075, 0.0750001, 0.3, 0.5, 0.6, 0.925, 0.99, 1 - 1e-7]
    df = spark.createDataFrame([(p,) for p in ps], "p double").withColumn("r", probit_argument(F.col("p")))
    for row in df.select("p", probit(F.col("p"), F.col("r")).alias("z")).collect():
        assert row.z == pytest.approx(NormalDist().inv_cdf(row.p), rel=1e-13, abs=1e-15)


def _plain_score(x, grid):
    """One value at a time, by walking the whole grid."""
    from statistics import NormalDist
    if x is None or math.isnan(x):
        return None
    clip, n = 1e-7 - 2.220446049250313e-16, len(grid)
    if x + 1e-7 > grid[-1]:
        place = 1.0
    elif x - 1e-7 < grid[0]:
        place = 0.0
    else:
        place = 0.0
        for side in (max(k for k in range(n) if grid[k] <= x), min(k for k in range(n) if grid[k] >= x)):
            if grid[side] == x:
                place += side / (n - 1) / 2
            else:
                low = side if grid[side] < x else side - 1
                place += (low + (x - grid[low]) / (grid[low + 1] - grid[low])) / (n - 1) / 2
    return NormalDist().inv_cdf(min(max(place, clip), 1 - clip))


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 999, 1000, 1025])
def test_quantile_normal_equals_a_plain_walk(spark, n):
    """Ties inside the grid and at its ends, grids of any length, values on,
    between and beyond the points; own columns named like the inner ones."""
    import random
    rnd = random.Random(n)
    grids = {"A": sorted(rnd.choice([float(rnd.randint(0, 40)), rnd.uniform(0, 40)]) for _ in range(n)),
             "B": sorted(float(rnd.randint(0, 3)) for _ in range(max(1, n // 2)))}
    inf = float("inf")
    values = [None, float("nan"), inf, -inf, -1.0, 0.0, 40.0, 41.0, *map(float, range(0, 41, 5)), *(rnd.uniform(-1, 41) for _ in range(40))]
    rows = [(s, v, v) for s in ("A", "B", "C", None) for v in values]
    df = spark.createDataFrame(rows, "mission string, x double, __qn_x0 double")
    out = QuantileNormalModel({"x": grids, "absent": grids}).transform(df)
    assert out.columns == [*df.columns, "feat_qn_x"]
    got = sorted(((r.mission, str(r.x)), r.feat_qn_x) for r in out.collect() if r.mission in grids)
    want = sorted(((s, str(v)), _plain_score(v, grids[s])) for s, v, _ in rows if s in grids)
    assert [k for k, _ in got] == [k for k, _ in want]
    for (key, a), (_, b) in zip(got, want):
        assert (a is None) == (b is None), key
        if a is not None:
            assert a == pytest.approx(b, rel=1e-9, abs=1e-9), key
    assert all(r.feat_qn_x == 0.0 for r in out.collect() if r.mission not in grids)


def test_blocked_running_sums_equal_window(spark):
    from pyspark.sql import Window
    from transitlake.operators.stats import blocked_running_sums
    # 3 groups x 3000 distinct values, uneven weights: every block boundary is crossed
    df = (spark.range(9000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 9001).cast("double").alias("v"),
                                   (F.col("id") % 5 + 1).alias("a"), (F.col("id") % 2).alias("b")))
    got = blocked_running_sums(df, "g", "v", ["a", "b"], blocks=16)
    w = Window.partitionBy("g").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("g", "v", F.sum("a").over(w).alias("wa"), F.sum("b").over(w).alias("wb"))
    bad = got.join(want, ["g", "v"]).where((F.col("cum_a") != F.col("wa")) | (F.col("cum_b") != F.col("wb")))
    assert got.count() == 9000 and bad.count() == 0


def test_quantile_grids_equal_spark_percentile(spark):
    from transitlake.operators.fitted import quantile_grids
    rows = [("A", float(i % 17) if i % 5 else None, float(i) * 0.37 if i < 250 else 3.0) for i in range(400)]
    rows += [("B", 1.5, None), ("C", None, 2.0), ("C", None, 2.0), ("C", None, 7.0)]
    df = spark.createDataFrame(rows, "mission string, x double, y double")
    for nq in (1000, 7, 2):
        got = {(r.mission, r.feature): list(r.grid) for r in quantile_grids(df, ["x", "y"], n_quantiles=nq).collect()}
        for g, cnt in {"A": 400, "B": 1, "C": 3}.items():
            m = max(1, min(nq, cnt))
            probs = [float(p) for p in np.linspace(0, 1, m)] if m > 1 else [0.5]
            want = df.where(F.col("mission") == g).agg(F.percentile("x", probs).alias("x"),
                                                        F.percentile("y", probs).alias("y")).first()
            for f in ("x", "y"):
                assert got.get((g, f)) == want[f], (nq, g, f)


def test_exact_percentiles_equal_spark_percentile(spark):
    from transitlake.operators.stats import exact_percentiles
    rows = [("A" if i % 3 else "B", float(i % 17) if i % 5 else None, float(i) * 0.37 if i < 250 else 3.0, None)
            for i in range(400)] + [("C", 1.5, None, None), (None, 2.5, 4.0, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double, z double")
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    for by in ([], ["g"]):
        got = {(tuple(r[b] for b in by), r.feature, r.prob_idx): r.value
               for r in exact_percentiles(df, ["x", "y", "z"], probs, by).collect()}
        for r in df.groupBy(*by).agg(*[F.percentile(c, probs).alias(c) for c in ("x", "y", "z")]).collect():
            key = tuple(r[b] for b in by)
            for c in ("x", "y", "z"):
                for i in range(len(probs)):
                    assert got.get((key, c, i)) == (r[c][i] if r[c] is not None else None), (by, key, c, i)
