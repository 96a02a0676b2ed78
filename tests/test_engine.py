from itertools import permutations

import duckdb
import numpy as np
import pandas as pd
import panel_brute
import pytest
from pyspark.sql import functions as F

from gausstide.functions import closed_forms as cf
from gausstide.functions import linalg as la
from gausstide.operators import autoregression as ar
from gausstide.operators import charts, evaluation, grid, inference, references, reporting, splits, states
from gausstide.plans import catalogue
from gausstide.plans import views as v
from gausstide.sources import files

SF = "/root/testdata/sf0.01"
#: Queries whose SQL the tests compare; the driver compares all of them.
COMPARED = ["hourly_grid_filled", "key_scores", "interpolated_series", "median_imputed_stream", "hopping_covariances", "block_states_shrunk", "month_splits", "loss_quantiles", "bures_d2", "transport_map_d2", "encode_cholesky_d2", "var_diag_ridge_argmin", "raw_var_diag", "barycenter_1d", "holm_adjust", "argmin_baseline_join", "shrinkage_choice_d2", "recursive_scores", "rolling_run", "rolling_comparison", "raw_var_scores", "panel_records", "panel_effects", "reference_choice", "covariance_pc_lag1", "strict_transport_d2", "group_summary", "mean_error_cells", "sensor_profile", "table_differences", "origin_block_intervals", "overlap_average_series", "overlap_average_overlapping", "commutator_d2"]


def spd(d, rng, n=None):
    a = rng.normal(size=(*((n,) if n else ()), d, d + 3))
    return a @ la.mt(a) / (d + 3) + 0.1 * np.eye(d)


@pytest.mark.parametrize("name", COMPARED)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in "customer orders lineitem events embeddings".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    a, b = catalogue.queries()[name](spark, SF).toPandas(), con.execute(catalogue.oracle_sql()[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns) and len(a) == len(b)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True).astype(str) for x in (a, b))
    assert a.equals(b)


def test_top_keys_over_all_ship_days(spark):
    test_against_sql(spark, "top_n_keys_all_days")
    lines = pd.read_parquet(f"{SF}/lineitem.parquet", columns=["l_shipdate", "l_suppkey"]).dropna()
    whole = lines.groupby(lines["l_suppkey"].astype(str)).size()
    got = catalogue.queries()["top_n_keys_all_days"](spark, SF).collect()
    assert len(got) == 10 and all(r.total == whole[r.k] for r in got)


@pytest.mark.parametrize("d", [1, 2, 5, 30])
def test_matrix_invariants(d):
    rng = np.random.default_rng(d)
    a, b = spd(d, rng, 6), spd(d, rng, 6)
    t = la.transport(a, b)
    assert np.allclose(t @ a @ t, b, atol=1e-7)
    assert np.allclose(la.bures(a, a), 0, atol=1e-7) and np.allclose(la.bures(a, b), la.bures(b, a), atol=1e-8)
    c = spd(d, rng, 6)
    r = lambda x, y: np.sqrt(la.bures(x, y))
    assert (r(a, c) <= r(a, b) + r(b, c) + 1e-8).all()
    assert np.allclose(la.expm(la.logm(a)), a, atol=1e-8)
    x, y = np.array([np.diag(rng.uniform(0.2, 2, d)) for _ in range(2)])
    assert np.isclose(la.bures(x[None], y[None])[0], ((np.sqrt(np.diag(x)) - np.sqrt(np.diag(y))) ** 2).sum())
    assert la.is_spd(a).all() and not la.is_spd(-a).any()


@pytest.mark.parametrize("method", sorted(charts.CHARTS))
def test_chart_round_trips(method):
    rng = np.random.default_rng(4)
    m, c, ref = rng.normal(size=(8, 4)), spd(4, rng, 8), spd(4, rng)
    # the fixed chart shrinks maps whose least eigenvalue is under its margin, so stay near the reference
    c = la.geodesic(np.broadcast_to(ref, c.shape), c, 0.5)
    z = charts.encode_arrays(method, m, c, m[0], ref)
    bm, bc = charts.decode_arrays(method, z, 4, m[0], ref)
    assert z.shape == (8, 14) and np.allclose(bm, m) and np.allclose(bc, c, atol=1e-6)


def test_barycenters(spark):
    rng = np.random.default_rng(7)
    c = spd(5, rng, 40)
    plain, exact = references.barycenter(c), references.exact_barycenter(c)
    assert np.allclose(plain, exact, atol=1e-7) and references._gap(references.fixed_point(c, exact), exact) < 1e-8


def test_rolling_reference_order():
    rng = np.random.default_rng(8)
    m, c = rng.normal(size=(20, 3)), spd(3, rng, 20)
    warm, exact = references.RollingReference(6, refresh=5), references.RollingReference(6, refresh=1)
    for t in range(5, 20):
        a, b = (x.at(t, m[t - 5 : t + 1], c[t - 5 : t + 1]) for x in (warm, exact))
        assert np.allclose(a["ref_cov"], b["ref_cov"], atol=1e-2) and np.allclose(a["ref_mean"], m[t - 5 : t + 1].mean(0))
        assert a["refreshed"] == (t == 5 or t % 5 == 0)
    with pytest.raises(ValueError):
        warm.at(25, m[:6], c[:6])


def test_autoregressions():
    rng = np.random.default_rng(9)
    z = rng.normal(size=(30, 50)).cumsum(0) * 0.1
    a, b = ar.fit_full(z, 0.1), ar.fit_dual(z, 0.1)
    assert np.allclose(a[1], b[1], atol=1e-10)
    mu, d = ar.fit_diag_arrays(z, 0.1)
    assert np.allclose(ar.predict((mu, d), z[-1], 4), mu + np.diag(d) ** 4 * (z[-1] - mu))
    w = ar.fit_raw(z[:, :3], 1e-9)
    step = w[0] + z[-1, :3] @ w[1:]
    assert np.allclose(ar.predict_raw_window(z[:, :3], w, 30, 28, 3), np.vstack([z[28:, :3], step]))


def test_splits():
    assert splits.rolling_origins(364)[-1] == (4, 299, 353, 364) and len(splits.rolling_origins(364)) == 5
    assert splits.rolling_origins(175) == [(0, 61, 87, 111), (1, 85, 111, 135), (2, 109, 135, 159), (3, 133, 159, 175)]
    assert sum(s[3] - s[2] for s in splits.rolling_origins(364)) == 183
    assert splits.rolling_origins(60) == []


def test_holm_and_bootstrap(spark):
    rows = spark.createDataFrame([("a", 0.01), ("a", 0.04), ("a", 0.03), ("b", 0.9)], "f string, p double")
    got = {(r.f, r.p): r.adjusted for r in inference.holm(rows, "p", ["f"]).collect()}
    assert got == pytest.approx({("a", 0.01): 0.03, ("a", 0.03): 0.06, ("a", 0.04): 0.06, ("b", 0.9): 0.9})
    v = np.arange(10.0)
    assert np.allclose(inference.block_means([v], 10, 3, 1), v.mean())
    assert abs(inference.circular_means(v, 3, 4000, np.random.default_rng(1)).mean() - v.mean()) < 0.1


def test_block_means_keep_the_stream():
    def one_by_one(by_origin, block, draws, seed):
        rng = np.random.default_rng(seed)
        out = []
        for _ in range(draws):
            parts = []
            for v in by_origin:
                size, left = min(block, len(v)), len(v)
                while left > 0:
                    at = int(rng.choice(len(v) - size + 1))
                    parts.append(v[at : at + min(size, left)])
                    left -= size
            out.append(np.concatenate(parts).mean())
        return np.array(out)

    rng = np.random.default_rng(6)
    v = [rng.normal(size=n) for n in (24, 16, 5, 2, 1)]
    for block in (3, 6):
        assert np.allclose(inference.block_means(v, block, 50, 9), one_by_one(v, block, 50, 9), atol=1e-12)


def test_registered_panel_and_inference_are_whole(spark):
    q, sf = catalogue.queries(), "/root/testdata/sf0.001"
    panel = q["target_panel"](spark, sf).toPandas()
    cells = {(s[0], h, m) for s in catalogue.v.SPLITS for h in catalogue.HORIZONS for m in evaluation.METHODS}
    assert set(zip(panel.origin, panel.horizon, panel.method, strict=True)) == cells
    assert len(panel) == sum(s[3] - s[2] for s in catalogue.v.SPLITS) * len(catalogue.HORIZONS) * len(evaluation.METHODS)
    got = q["paired_inference"](spark, sf).toPandas()
    assert len(got) == (2 * 5 + 1) * 2 * 3 and set(got[got.family == "others"].comparator) == {"persistence", "raw_var", "euclidean", "cholesky", "log_euclidean"}
    count = got.p * 10_001  # of 10,000 draws
    assert np.allclose(count, count.round(), atol=1e-6) and not np.allclose(got.p * 401, (got.p * 401).round(), atol=1e-6)
    r = got[(got.target == "transport_local") & (got.comparator == "raw_var") & (got.metric == "raw_rmse") & (got.horizon == 4)].iloc[0]
    wide = panel[panel.horizon == 4].pivot(index=["origin", "target_index"], columns="method", values="raw_rmse")
    assert r["n"] == len(wide) and np.isclose(r["mean"], (wide.transport_local - wide.raw_var).mean())


def test_pooled_covariance_has_all_coordinates(spark):
    e = pd.read_parquet(f"{SF}/embeddings.parquet")
    for r in catalogue.queries()["covariance_pooled_by_label"](spark, SF).collect():
        x = np.stack(e[e.label == r.t].embedding).astype(float)
        c = np.cov(x, rowvar=False)
        c = 0.8 * c + 0.2 * np.trace(c) / x.shape[1] * np.eye(x.shape[1])
        assert x.shape[1] == 64 and r.n == len(x) and r.spd and np.isclose(r.condition, np.linalg.cond(c), rtol=1e-6)


def test_panel_checks(spark):
    panel = spark.createDataFrame([(0, 3, 10, "x", 1.0, 1.0), (0, 3, 10, "x", 1.0, 1.0), (1, 3, 10, "y", float("nan"), 1.0), (0, 3, 11, "x", 1.0, 1.0)], "origin int, horizon int, target_index int, method string, raw_rmse double, w2 double")
    found = {r.problem: r.n for r in evaluation.panel_problems(panel, ["x", "y"]).collect()}
    assert found == {"duplicate key": 1, "missing target": 1, "loss not finite": 1}


def test_states_match_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 3))
    g = spark.createDataFrame([(i, f"k{j}", float(x[i, j])) for i in range(40) for j in range(3)], "i int, k string, c double")
    got = states.hopping_states(g, 12, 5, 40, ridge=1e-5, floor=True).orderBy("t").collect()
    assert [r.t for r in got] == list(range(6))
    for r in got:
        w = x[r.t * 5 : r.t * 5 + 12]
        assert np.allclose(r.mean, w.mean(0)) and np.allclose(np.reshape(r.cov, (3, 3)), np.cov(w, rowvar=False) + 1e-5 * np.eye(3), atol=1e-9)
    assert states.hopping_states(g, 50, 5, 40).count() == 0


def test_grid_cleaning(spark):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("nonsense", "a"), (None, "b"), ("2024-01-01 02:59:59", None), ("2024-01-01 02:00:00", "b")], "ts string, k string")
    g = grid.filled_grid(grid.counts(rows, "ts", "k"), "2024-01-01 00:00:00", 3)
    assert sorted((r.i, r.k, r.c) for r in g.collect()) == [(0, "a", 1.0), (0, "b", 0.0), (1, "a", 0.0), (1, "b", 0.0), (2, "a", 0.0), (2, "b", 1.0)]
    assert files.grid_problems(g, 4).collect()[0].problem == "missing step"
    with pytest.raises(ValueError):
        grid.top_keys(g, 3, 5)


def test_sources_and_sinks(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "m.zip", "w") as z:
        z.writestr("trips.csv", "ride,started_at,start_station_name\n1,2024-01-01 00:00:01,A\n2,bad,B\n")
        z.writestr("__MACOSX/trips.csv", "x\n1\n")
        z.writestr("other.csv", "a,b\n1,2\n")
    assert sorted(r.k for r in files.read_trip_archives(spark, [str(tmp_path / "m.zip")]).collect()) == ["A", "B"]
    s = spark.createDataFrame([(0, [1.0, 2.0], [1.0, 0.5, 0.5, 2.0])], "t int, mean array<double>, cov array<double>")
    files.write_states(s, str(tmp_path / "states"))
    assert files.read_states(spark, str(tmp_path / "states")).first().cov == [1.0, 0.5, 0.5, 2.0]
    with pytest.raises(Exception):
        files.write_states(s, str(tmp_path / "states"))
    m = files.manifest(spark, [str(tmp_path / "m.zip")])
    assert files.altered(m, m).count() == 0 and files.altered(m, m.withColumn("bytes", F.lit(1))).count() == 1


def test_streaming_counts_equal_batch(spark, tmp_path):
    from gausstide.streaming import rolling

    ev = spark.read.parquet(f"{SF}/events.parquet").select("ts", "event_type")
    ev.filter("day(ts) <= 3").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))
    q = rolling.stream_counts(stream, "ts", "event_type").writeStream.format("memory").queryName("counted").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = {(r.ts, r.k): r.n for r in spark.table("counted").collect()}
    want = {(r.ts, r.k): r.n for r in grid.counts(spark.read.parquet(str(tmp_path / "in")), "ts", "event_type").collect()}
    assert got and all(want[k] == n for k, n in got.items()) and len(got) >= 0.9 * len(want)


def test_streaming_reference_equals_batch(spark, tmp_path):
    from gausstide.streaming import rolling

    rng = np.random.default_rng(5)
    rows = [("s", t, rng.normal(size=2).tolist(), spd(2, rng).reshape(-1).tolist()) for t in range(14)]
    schema = "series string, t int, mean array<double>, cov array<double>"
    for i, part in enumerate((rows[:8], rows[8:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = rolling.stream_references(stream, 5, refresh=3).writeStream.format("parquet").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start(str(tmp_path / "out"))
        q.awaitTermination(180)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("t").toPandas()
    want = references.rolling_references(spark.createDataFrame(rows, schema), ["series"], 5, refresh=3).orderBy("t").toPandas()
    assert got["t"].tolist() == want["t"].tolist() == list(range(4, 14))
    assert np.allclose(np.stack(got["ref_cov"]), np.stack(want["ref_cov"]), atol=1e-9)


def test_strict_layer_on_near_singular_matrices():
    for d in (5, 30):
        rng = np.random.default_rng(d)
        q, _ = np.linalg.qr(rng.normal(size=(d, d)))
        near = (q * np.r_[np.full(d - 1, 1.0), 1e-6]) @ q.T
        good = spd(d, rng)
        t = la.strict_transport(near[None], good[None])[0]
        assert la.is_spd(t) and np.allclose(t @ near @ t, good, atol=1e-6)
        assert np.allclose(la.strict_transport(good[None], near[None])[0], la.transport(good[None], near[None])[0], atol=1e-5)
        flat = (q * np.r_[np.full(d - 1, 1e9), 0.0]) @ q.T
        w = np.linalg.eigvalsh(la.resolved(flat[None])[0])
        assert w[0] > 0 and w[0] >= 1e-7 + 4 * 64 * np.finfo(float).eps * d * 1e9
        projected, roots = la.prepared(np.stack([near, good]))
        assert np.allclose(roots @ roots, projected, atol=1e-9)
    for bad, error in ((np.full((2, 2), np.nan), la.NumericalError), (np.eye(2) * 1j, TypeError), (np.eye(2) > 0, TypeError), (np.zeros((2, 3)), ValueError), (np.zeros((0, 0)), ValueError)):
        with pytest.raises(error):
            la.strict_matrices(bad)
    with pytest.raises(la.NumericalError):
        la.strict_power(np.diag([1.0, -1.0]), 0.5)


def test_misaligned_tries_every_order():
    q, _ = np.linalg.qr(np.random.default_rng(3).normal(size=(4, 4)))
    values, direction = np.array([0.2, 0.7, 1.5, 3.0]), np.diag([1.0, 2.0, 4.0, 8.0])
    got = la.misaligned(q, values, direction)
    size = lambda m: np.linalg.norm(m @ direction - direction @ m)
    others = [(q * values[list(o)]) @ q.T for o in permutations(range(4))]
    assert np.isclose(size(got), max(map(size, others))) and np.allclose(np.linalg.eigvalsh(got), values)


def test_native_products_equal_numpy(spark):
    rng = np.random.default_rng(5)
    rows = [(d, spd(d, rng).reshape(-1).tolist(), spd(d, rng).reshape(-1).tolist()) for d in (1, 2, 5)]
    df = spark.createDataFrame(rows, "d int, a array<double>, b array<double>")
    for r in df.withColumn("size", la.commutator_size("a", "b")).collect():
        x, y = (np.array(v).reshape(r.d, r.d) for v in (r.a, r.b))
        assert np.isclose(r["size"], la.commutator(x, y), atol=1e-12)


def test_closed_forms_equal_the_general_functions(spark):
    rng = np.random.default_rng(6)
    mats = [spd(2, rng) for _ in range(6)] + [np.array([[1.0, 1.0], [1.0, 1.0]]), np.array([[1.0, 2.0], [2.0, 1.0]]), np.diag([-1.0, -2.0])]
    df = spark.createDataFrame([(m.reshape(-1).tolist(),) for m in mats], "m array<double>").withColumn("f", cf.floored("m", 1e-3))
    assert all(np.allclose(np.array(r.f).reshape(2, 2), la.floored(np.array(r.m).reshape(2, 2), 1e-3), atol=1e-12) for r in df.collect())


def test_decode_reports_the_raw_eigenvalue(spark):
    ref = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0, 0.0, 1.0])], "ref_mean array<double>, ref_cov array<double>")
    z = spark.createDataFrame([(0, "transport_fixed", [0.0, 0.0, -2.0, 0.0, 0.5]), (1, "transport_fixed", [1.0, 2.0, 0.5, 0.0, 0.0])], "t int, method string, z array<double>")
    got = {r.t: r for r in charts.decode(z, ref).collect()}
    assert np.isclose(got[0].low, -1.0) and got[0].repaired and np.isclose(got[1].low, 1.0) and not got[1].repaired


def test_reporting_checks(spark):
    for bad in (0, -1, True, 1.0, "1"):
        with pytest.raises(ValueError):
            reporting.positive_integer(bad, "n")
    rows = spark.createDataFrame([(1, "a"), (1, "b")], "x int, y string")
    assert reporting.exactly_one(rows, x=1, y="a").count() == 1
    for wanted in ({"x": 1}, {"x": 2}):
        with pytest.raises(ValueError):
            reporting.exactly_one(rows, **wanted)
    assert reporting.table_differences(rows, rows, ["y"], ["x"]).count() == 0


def test_hopping_states_of_long_overlaps(spark):
    """Panes against direct sums, where neither length divides the other, and with thinning."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(50, 2))
    df = spark.createDataFrame([(i, k, float(x[i, j])) for i in range(50) for j, k in enumerate("ab")], "i int, k string, c double")
    for window, step, most in ((9, 6, 900), (4, 7, 900), (9, 6, 4)):
        n = (50 - window) // step + 1
        got = {r.t: r for r in states.hopping_states(df, window, step, 50, 0.0, most=most).collect()}
        kept = states.thinned(n, most)
        assert sorted(got) == list(range(len(kept)))
        for j, t in enumerate(kept):
            w = x[t * step : t * step + window]
            assert np.allclose(got[j].mean, w.mean(0)) and np.allclose(np.array(got[j].cov).reshape(2, 2), np.cov(w.T))


@pytest.mark.parametrize("diagonal", [False, True])
def test_fixed_panel_equals_arrays(spark, diagonal):
    s2 = v.S2(spark, SF).persist()
    methods = ["persistence", "euclidean", "cholesky", "log_euclidean", "transport_fixed"]
    keys = ["origin", "horizon", "target_index", "method"]
    a = evaluation.target_panel(s2, v.SPLITS[:2], [3, 5], methods, diagonal=diagonal).toPandas()
    a, b = (f.sort_values(keys).reset_index(drop=True) for f in (a, panel_brute.panel(s2.toPandas(), v.SPLITS[:2], [3, 5], methods, diagonal=diagonal)))
    assert len(a) == len(b) > 0 and a[keys].astype(str).equals(b[keys].astype(str)) and np.array_equal(a["ridge"].to_numpy(float), b["ridge"].to_numpy(float), equal_nan=True)
    assert np.allclose(a[["raw_rmse", "w2", "min_pred_eig"]], b[["raw_rmse", "w2", "min_pred_eig"]], rtol=1e-6, atol=1e-8)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 100
    out = e.entry(spark)
    assert out.columns == ["origin", "method", "w2", "raw_rmse", "n"] and out.count() == 8
