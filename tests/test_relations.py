"""Local chart, raw model, references and error rows as relations, against plain arrays."""

import numpy as np
import panel_brute
import pytest
from pyspark.sql import functions as F

from gausstide.functions import linalg as la
from gausstide.operators import evaluation, local_chart, raw_model, references, scoring, splits, states
from gausstide.plans import views as v

SF = "/root/testdata/sf0.001"
KEYS = ["origin", "horizon", "target_index", "method"]
LOSSES = ["raw_rmse", "w2", "min_pred_eig"]


def spd(d, rng, n=None, low=0.2):
    a = rng.normal(size=(d, d) if n is None else (n, d, d))
    return a @ np.swapaxes(a, -1, -2) / d + low * np.eye(d)


def frame(spark, means, covs, **more):
    rows = [(t, m.tolist(), c.reshape(-1).tolist(), *more.values()) for t, (m, c) in enumerate(zip(means, covs, strict=True))]
    return spark.createDataFrame(rows, ["t", "mean", "cov", *more]).withColumn("t", F.col("t").cast("int"))


# ---- exact barycenters


@pytest.mark.parametrize("d", [2, 5, 30])
@pytest.mark.parametrize("condition", [1e2, 1e4, 1e6, 1e8])
def test_barycenter_of_equal_matrices(d, condition):
    q, _ = np.linalg.qr(np.random.default_rng(d).normal(size=(d, d)))
    c = la.sym((q * np.logspace(0, -np.log10(condition), d)) @ q.T)
    s = references.exact_barycenter(np.stack([c] * 3))
    assert np.linalg.norm(s - c) <= 1e-9 * np.linalg.norm(c)
    assert np.allclose(np.linalg.eigvalsh(s), np.linalg.eigvalsh(c), rtol=1e-7, atol=0)


def test_barycenter_of_commuting_matrices_keeps_small_eigenvalues():
    rng = np.random.default_rng(1)
    w = 10 ** rng.uniform(-7.5, 0, size=(9, 6))
    s = references.exact_barycenter(np.stack([np.diag(x) for x in w]))
    assert np.allclose(np.diag(s), np.sqrt(w).mean(0) ** 2, rtol=1e-7, atol=0)


def test_floors_of_the_strict_layer():
    a = np.diag([1.0, 5e-8])[None]
    assert np.allclose(la.strict_floored(a), a, atol=1e-20) and np.allclose(la.strict_power(a, 0.5)[0, 1, 1], np.sqrt(5e-8))
    assert np.allclose(la.resolved(np.diag([1.0, 0.0])[None])[0, 1, 1], 1e-8 + 8 * 64 * np.finfo(float).eps * 2)


def test_singular_values_when_the_first_driver_fails(monkeypatch):
    rng = np.random.default_rng(2)
    a, real, calls = spd(4, rng, 3), np.linalg.svd, []

    def flaky(x, *args, **kw):
        calls.append(x.ndim)
        if x.ndim > 2:
            raise np.linalg.LinAlgError("no convergence")
        return real(x, *args, **kw)

    want = la.product_root(la.strict_power(a, 0.5), la.strict_power(a, 0.5))
    monkeypatch.setattr(np.linalg, "svd", flaky)
    assert np.allclose(la.product_root(la.strict_power(a, 0.5), la.strict_power(a, 0.5)), want) and calls == [3, 2, 2, 2]


def test_grouped_barycenters(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for g, (d, n) in enumerate([(3, 40), (2, 7), (5, 25), (2, 1)]):
        c = spd(d, rng, n)
        want[g] = references.barycenter(c), references.exact_barycenter(c)
        rows += [(g, i, [0.0] * d, x.reshape(-1).tolist()) for i, x in enumerate(c)]
    rows.append((9, 0, [0.0] * 2, [float("nan"), 0.0, 0.0, 1.0]))
    df = spark.createDataFrame(rows, "g int, t int, mean array<double>, cov array<double>").repartition(5)
    good = df.filter("g < 9")
    for exact in (False, True):
        got = {r.g: r for r in references.grouped_barycenters(good, ["g"], exact).collect()}
        assert set(got) == set(want) and all(r.error is None for r in got.values())
        for g, both in want.items():
            assert np.allclose(got[g].ref_cov, both[exact].reshape(-1), atol=1e-8)
        small, large = ({r.g: r for r in references.group_references(good, ["g"], exact, large=n).collect()} for n in (1000, 10))
        assert all(np.allclose(small[g].ref_cov, large[g].ref_cov, atol=1e-8) and small[g].ref_mean == large[g].ref_mean for g in want)


def test_first_states_only(spark):
    rng = np.random.default_rng(4)
    m, c = rng.normal(size=(30, 2)), spd(2, rng, 30)
    got = references.group_references(frame(spark, m, c, s="a").repartition(4), ["s"], first=11).first()
    assert np.allclose(got.ref_cov, references.barycenter(c[:11]).reshape(-1)) and np.allclose(got.ref_mean, m.mean(0))


# ---- rolling references


@pytest.mark.parametrize(("length", "refresh"), [(6, 5), (6, 1), (4, 9), (5, 5)])
def test_segments_give_the_serial_result(spark, length, refresh):
    rng = np.random.default_rng(5)
    walk = 0.02 * rng.normal(size=(61, 2, 2)).cumsum(0)
    m, c = rng.normal(size=(61, 2)), spd(2, rng) + 0.1 * (walk @ np.swapaxes(walk, 1, 2))
    c[33] = 40 * np.eye(2)
    threshold = 1e-13 if refresh == 9 else 1e-4
    serial = references.RollingReference(length, refresh, threshold=threshold)
    want = [serial.at(t, m[t - length + 1 : t + 1], c[t - length + 1 : t + 1]) for t in range(length - 1, 61)]
    df = frame(spark, m, c, s="a")
    assert references.segments(df, length, refresh).groupBy("segment").count().count() > 3
    got = references.rolling_references(df, ["s"], length, refresh, threshold=threshold).orderBy("t").collect()
    assert [(r.t, r.refreshed, r.fallback) for r in got] == [(w["t"], w["refreshed"], w["fallback"]) for w in want]
    assert all(np.allclose(r.ref_cov, w["ref_cov"], atol=1e-12) and np.allclose(r.ref_mean, w["ref_mean"]) for r, w in zip(got, want, strict=True))
    if refresh == 9:
        assert any(w["fallback"] for w in want)


def test_a_changed_history_is_refused():
    rng = np.random.default_rng(6)
    m, c = rng.normal(size=(8, 2)), spd(2, rng, 8)
    rolling = references.RollingReference(4)
    rolling.at(3, m[:4], c[:4])
    changed = c.copy()
    changed[2] *= 1.01
    with pytest.raises(ValueError, match="changed"):
        rolling.at(4, m[1:5], changed[1:5])
    with pytest.raises(ValueError, match="4 states"):
        rolling.at(4, m[:5], c[:5])
    assert rolling.at(4, m[1:5], c[1:5])["t"] == 4


def test_a_gap_in_the_states_is_refused(spark):
    rng = np.random.default_rng(7)
    df = frame(spark, rng.normal(size=(9, 2)), spd(2, rng, 9), s="a").filter("t <> 4")
    with pytest.raises(Exception, match="without gaps"):
        references.rolling_references(df, ["s"], 3).collect()


# ---- the panel


def both_panels(spark, s, x, splits_, horizons, methods, window, step, d):
    raw = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, x array<double>")
    made = evaluation.target_panel(s, splits_, horizons, methods, raw, window, step, d=d).toPandas()
    want = panel_brute.panel(s.toPandas(), splits_, horizons, methods, x, window, step)
    return (f.sort_values(KEYS).reset_index(drop=True) for f in (made, want))


def same_panels(a, b):
    assert len(a) == len(b) > 0 and a[KEYS].astype(str).equals(b[KEYS].astype(str))
    for c in ("ridge", "window_length"):
        assert np.array_equal(a[c].to_numpy(float), b[c].to_numpy(float), equal_nan=True)
    assert np.allclose(a[LOSSES], b[LOSSES], rtol=1e-5, atol=1e-7)
    assert np.allclose(a["reference_residual"].to_numpy(float), b["reference_residual"].to_numpy(float), atol=1e-9, equal_nan=True)
    assert a["reference_refreshed"].tolist() == b["reference_refreshed"].tolist()


def test_local_chart_and_raw_rows_equal_arrays(spark):
    s2 = v.S2(spark, "/root/testdata/sf0.01").select("t", "mean", "cov").persist()
    x = np.array([r.x for r in states.vectors(v.E2(spark, "/root/testdata/sf0.01")).orderBy("i").collect()])
    same_panels(*both_panels(spark, s2, x, v.SPLITS[:2], [3, 5], ["transport_local", "raw_var"], v.WINDOW, v.STEP, 2))


def test_panel_in_three_dimensions(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "WINDOWS", [5, 8])
    monkeypatch.setattr(panel_brute, "WINDOWS", [5, 8])
    rng = np.random.default_rng(8)
    x = np.zeros((200, 3))
    for i in range(1, 200):
        x[i] = x[i - 1] @ np.array([[0.5, 0.2, 0], [0, 0.4, 0.1], [0.1, 0, 0.3]]) + rng.normal(size=3)
    grid = spark.createDataFrame([(i, "abc"[k], float(x[i, k])) for i in range(200) for k in range(3)], "i int, k string, c double")
    s = states.hopping_states(grid, 12, 4, 200).select("t", "mean", "cov").persist()
    monkeypatch.setattr(panel_brute.local_forecasts, "__defaults__", ([5, 8], panel_brute.RIDGES))
    same_panels(*both_panels(spark, s, x, [(0, 20, 30, 38), (1, 28, 38, 46)], [1, 3], ["persistence", "euclidean", "transport_local", "raw_var"], 12, 4, 3))


def test_tuning_table(spark):
    s = v.S2(spark, SF).select("t", "mean", "cov").persist()
    tuning = evaluation.local_tuning(s, v.SPLITS[:2], [3]).toPandas()
    assert len(tuning) == 2 * 3 * 7 and tuning["error"].isna().all()
    one = tuning[tuning.origin == 0]
    assert set(one.validation_target_start) == {74} and set(one.validation_target_stop) == {87} and set(one.n_validation_targets) == {13}


def test_a_bad_state_costs_its_own_forecasts(spark):
    rng = np.random.default_rng(9)
    m, c = rng.normal(size=(40, 2)), spd(2, rng, 40)
    c[22, 0, 0] = np.nan
    s = frame(spark, m, c)
    table = splits.split_table(spark, [(0, 12, 18, 30), (1, 20, 26, 32), (2, 30, 35, 40)])
    scored = local_chart.scored_forecasts(s, table, [1], 2, [3, 5], [0.1, 1.0])
    rows = local_chart.local_panel(scored, table, [1], 5).toPandas()
    bad = rows[rows.error.notna()]
    assert len(rows) == 12 + 6 + 5 and len(bad) > 0
    first = rows[rows.origin == 0]
    length = int(first.window_length.iloc[0])
    touched = first.source.between(22, 22 + length - 1) | (first.target == 22)
    assert (first.error.notna() == touched).all() and first[touched].raw_rmse.isna().all()
    assert rows[rows.origin == 1].error.eq("no candidate passed validation").all() and rows[rows.origin == 2].error.isna().all()
    assert rows[rows.origin == 2].w2.notna().all()
    tuning = local_chart.tuning_table(scored, table, [1], 5).toPandas()
    assert tuning[tuning.origin == 1].error.notna().all() and tuning[tuning.origin == 1].validation_raw_rmse.isna().all()


def test_tried_matrix_functions(spark):
    rows = [([1.0, 0.0, 0.0, 1.0],), ([float("nan"), 0.0, 0.0, 1.0],), (None,), ([4.0, 0.0, 0.0, 9.0],), ([4.0],)]
    got = [r.t for r in spark.createDataFrame(rows, "c array<double>").coalesce(1).select(la.tried("strict_root", "c").alias("t")).collect()]
    assert got[0].value == [1, 0, 0, 1] and got[3].value == [2, 0, 0, 3] and got[4].value == [2] and got[2].value is None and got[2].error is None
    assert got[1].value is None and got[1].error.startswith("NumericalError") and all(got[i].error is None for i in (0, 3, 4))


def test_an_unsolvable_raw_model_costs_its_own_rows(spark):
    x = np.ones((80, 2))  # no spread: without a penalty the equations are singular
    raw = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, x array<double>")
    sums = raw_model.normal_sums(raw, [40])
    ridges = spark.createDataFrame([(40, 0.0), (40, 1.0)], "end int, ridge double")
    wanted = ridges.crossJoin(spark.createDataFrame([(0, 1, 8)], "origin int, horizon int, source int"))
    got = {r.ridge: r for r in raw_model.raw_forecasts(raw, wanted, raw_model.power_table(sums, ridges, 4), 6, 4).collect()}
    assert got[0.0].mean is None and "Singular" in got[0.0].error
    assert got[1.0].error is None and np.allclose(got[1.0].mean, [1, 1])


# ---- series as a key


def test_series_share_one_plan(spark):
    rng = np.random.default_rng(10)
    rows = [(s, i, k, float(rng.normal())) for s in range(40) for i in range(30) for k in "ab"]
    grid = spark.createDataFrame(rows, "s int, i int, k string, c double")
    whole = states.hopping_states(grid, 10, 5, 30, by=["s"])
    got = {(r.s, r.t): r for r in whole.collect()}
    assert len(got) == 40 * 5
    one = {r.t: r for r in states.hopping_states(grid.filter("s = 7").drop("s"), 10, 5, 30).collect()}
    assert all(np.allclose(got[7, t].cov, r.cov) and got[7, t].n == r.n for t, r in one.items())
    assert whole._jdf.queryExecution().optimizedPlan().toString().count("Relation") + whole._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 1
    means, cells = states.tidy(whole, ["s"])
    back = states.from_tidy(means, cells, ["s"]).collect()
    assert all(np.allclose(got[r.s, r.t].cov, r.cov) for r in back) and len(back) == 200
    assert states.adjacent(whole, ["s"]).count() == 40 * 4
    blocks = states.block_states(grid, 7, 30, by=["s"])
    assert blocks.groupBy("s").count().filter("count = 4").count() == 40
