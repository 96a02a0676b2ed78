"""Archives, packages, dense numbers, panels of members, block likelihoods."""

import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from gausstide.functions import linalg as la
from gausstide.operators import evaluation, grid, scoring
from gausstide.sources import files


def test_archive_members_are_partitions(spark, tmp_path):
    head = "ride,started_at,start_station_id,rideable\n"
    with zipfile.ZipFile(tmp_path / "m.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for m in range(4):
            z.writestr(f"trips_{m}.csv", head + "".join(f"{i},2024-01-0{m + 1} 00:00:{i % 60:02d},S{i % 7},bike\n" for i in range(50)))
        z.writestr("__MACOSX/._trips_0.csv", "x")
        z.writestr("notes.txt", "x")
        z.writestr("other.csv", "a,b\n1,2\n")
        z.writestr("named.csv", "started_at,start_station_name\n2024-02-01 00:00:00,Main\n2024-02-01 00:00:00,\n")
    df = files.read_trip_archives(spark, [str(tmp_path / "m.zip")])
    assert df.columns == ["ts", "k"] and df.count() == 202 and df.filter("k is null").count() == 1
    assert df.select(F.spark_partition_id().alias("p")).distinct().count() == 5
    assert df.filter("k = 'Main'").count() == 1
    with zipfile.ZipFile(tmp_path / "none.zip", "w") as z:
        z.writestr("notes.txt", "x")
    with pytest.raises(Exception, match="no CSV member"):
        files.read_trip_archives(spark, [str(tmp_path / "none.zip")]).count()


def test_large_members_are_streamed(spark, tmp_path):
    """A member of many chunks (240 MB unpacked), of which one column is read."""
    line = b"2024-01-01 00:00:00,S1," + b"x" * 170 + b"\n"
    with zipfile.ZipFile(tmp_path / "big.zip", "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z, z.open("big.csv", "w", force_zip64=True) as f:
        f.write(b"started_at,start_station_id,text\n")
        for _ in range(120):
            f.write(line * 10_000)
    assert files.read_trip_archives(spark, [str(tmp_path / "big.zip")]).filter("k = 'S1'").count() == 1_200_000


def package(folder, stations=("a", "b"), rows=None, columns=None, fit_end=3, profile=None):
    folder.mkdir(parents=True)
    rows = rows if rows is not None else [(f"2024-01-01 0{h}:00:00", h, 2 * h) for h in range(6)]
    (folder / files.COUNTS).write_text("\n".join([",".join(columns or ("timestamp", *stations)), *(",".join(map(str, r)) for r in rows)]))
    (folder / files.PROFILE).write_text("\n".join(["station_rank,station_id", *(f"{i},{s}" for i, s in enumerate(profile or stations))]))
    (folder / files.MANIFEST).write_text(json.dumps({"processing": {"standardization_block_hours": fit_end}}))
    return str(folder)


def test_package_loader(spark, tmp_path):
    cells, stations, fit_end = files.load_package(spark, package(tmp_path / "good"), "2024-01-01 00:00:00", 6)
    assert stations == ["a", "b"] and fit_end == 3
    assert sorted((r.i, r.k, r.c) for r in cells.collect()) == sorted([(h, "a", float(h)) for h in range(6)] + [(h, "b", 2.0 * h) for h in range(6)])
    good = [(f"2024-01-01 0{h}:00:00", h, 2 * h) for h in range(6)]
    damaged = {
        "missing hour: 1": {"rows": good[:5]},
        "repeated hour: 1": {"rows": [*good, good[2]]},
        "row outside the calendar: 2": {"rows": [*good, ("2024-01-01 00:30:00", 1, 1), ("then", 1, 1)]},
        "negative: 1": {"rows": [(good[0][0], -1, 0), *good[1:]]},
        "not whole: 1": {"rows": [(good[0][0], 0.5, 0), *good[1:]]},
        "not finite: 2": {"rows": [(good[0][0], "NaN", ""), *good[1:]]},
        "columns differ from the profile: 1": {"columns": ("timestamp", "b", "a")},
        "repeated station: 1": {"profile": ("a", "a")},
        "fitting block outside the calendar: 1": {"fit_end": 7},
    }
    for i, (problem, how) in enumerate(damaged.items()):
        with pytest.raises(ValueError, match=problem):
            files.load_package(spark, package(tmp_path / str(i), **how), "2024-01-01 00:00:00", 6)


def test_row_manifest(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "i int, s string")
    one, two = (files.row_manifest({"t": df, "u": df.limit(0)}).collect() for df in (a, a.orderBy(F.desc("i"))))
    assert one == two and one[0]["rows"] == 2 and one[0]["columns"] == "i,s"
    assert files.row_manifest({"t": a.withColumn("i", F.col("i") + 1)}).first().content != one[0].content


def test_dense_numbers(spark):
    rng = np.random.default_rng(1)
    values = rng.permutation(5000).tolist()
    df = spark.createDataFrame([(int(x), None if x % 9 == 0 else f"k{x % 5}") for x in values], "v long, k string").repartition(7)
    out = grid.numbered(df, ["v"])
    got = out.orderBy("v").collect()
    assert [r.i for r in got] == list(range(5000)) and out.columns == ["v", "k", "i"]
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
    by_key = grid.numbered(df, ["k", "v"], "n", first=1).collect()
    assert [r.v for r in sorted(by_key, key=lambda r: r.n)] == [r.v for r in sorted(by_key, key=lambda r: (r.k is not None, r.k or "", r.v))]
    assert grid.numbered(df.limit(0), ["v"]).count() == 0


def test_panels_take_members_of_their_own_cluster(spark):
    rows = [(i, 0, [0.0, 0.1 * i]) for i in range(25)] + [(100 + i, 1, [3.0, 0.1 * i]) for i in range(6)]
    points = spark.createDataFrame(rows, "id long, cluster int, x array<double>")
    centres = spark.createDataFrame([(0, [0.0, 0.0]), (1, [3.0, 0.0])], "cluster int, x array<double>")
    got = evaluation.nearest_members(points, centres, 6).collect()
    assert {r.id for r in got if r.cluster == 1} == set(range(100, 106)) and {r.id for r in got if r.cluster == 0} == set(range(6))
    with pytest.raises(Exception, match="cluster 1 has fewer than 20"):
        evaluation.nearest_members(points, centres, 20).collect()
    with pytest.raises(ValueError, match="fewer than 40 usable"):
        evaluation.spatial_panels(points.drop("cluster"), 2, 20, 1)
    with pytest.raises(Exception, match="fewer than 10 members"):
        evaluation.spatial_panels(points.drop("cluster"), 2, 10, 1).collect()
    panels = evaluation.spatial_panels(points.drop("cluster"), 2, 6, 1, points.filter("id <> 3")).collect()
    assert len({r.id for r in panels}) == 12 and 3 not in {r.id for r in panels}


def test_eligible_keys(spark):
    rows = [(i, k, c) for i in range(100) for k, c in (("good", 5.0 + i % 7), ("flat", 3.0), ("gaps", 0.0 if i % 10 == 0 else 1.0 + i), ("null", None if i < 2 else float(i)))]
    df = spark.createDataFrame(rows, "i int, k string, c double")
    assert {r.k for r in grid.eligible_keys(df, 100).collect()} == {"good"}
    assert {r.k for r in grid.eligible_keys(df, 100, coverage=0.9).collect()} == {"good", "gaps", "null"}


def test_whole_counts(spark):
    df = spark.createDataFrame([(0, "a", 1.0), (0, "b", 2.0 + 1e-13), (1, "a", 0.0)], "i int, k string, c double")
    assert sorted(map(tuple, grid.whole_counts(df, ["a", "b"]).collect())) == [(0, 1, 2), (1, 0, 0)]
    with pytest.raises(Exception, match="not whole"):
        grid.whole_counts(df.withColumn("c", F.col("c") + 0.4), ["a", "b"]).collect()


@pytest.mark.parametrize("d", [2, 20])
def test_block_likelihood(spark, d):
    rng = np.random.default_rng(d)
    x = rng.normal(size=(40, d))
    a = rng.normal(size=(3, d, d))
    covs, means = a @ np.swapaxes(a, 1, 2) / d + 0.5 * np.eye(d), rng.normal(size=(3, d))
    raw = spark.createDataFrame([(1, i, r.tolist()) for i, r in enumerate(x)], "panel int, i int, x array<double>")
    made = spark.createDataFrame([(1, 2, t, means[t].tolist(), covs[t].reshape(-1).tolist()) for t in range(3)], "panel int, horizon int, source int, mean array<double>, cov array<double>")
    got = {r.source: r.raw_nll for r in scoring.block_likelihood(made, raw, ["panel"], 8, 4, d).collect()}
    for t in range(3):
        rows = x[(t + 2) * 4 : (t + 2) * 4 + 8] - means[t]
        want = 0.5 * (d * np.log(2 * np.pi) + np.linalg.slogdet(covs[t])[1] + np.einsum("ni,ij,nj->n", rows, np.linalg.inv(covs[t]), rows)).mean()
        assert np.isclose(got[t], want, rtol=1e-9)


def test_likelihood_lifts_what_is_not_definite():
    one = lambda a: np.asarray(a, float)[None]
    got = la.gaussian_nll(one([0, 0]), one([[1, 0], [0, 0]]), one([0, 0]), one([[1, 0], [0, 0]]))
    assert np.isfinite(got).all()


def test_panel_outputs_and_states_by_panel(spark, tmp_path):
    panel = spark.createDataFrame([(0, 3, "transport_local", 1.5, 0.1), (0, 3, "persistence", 2.5, None)], "origin int, horizon int, method string, w2 double, reference_residual double")
    small = spark.createDataFrame([(1, "x")], "a int, b string")
    files.write_panel_outputs(str(tmp_path / "out"), panel, small, small, small)
    assert spark.read.csv(str(tmp_path / "out/losses"), header=True).count() == 2
    diagnostics = spark.read.csv(str(tmp_path / "out/diagnostics"), header=True)
    assert diagnostics.columns == ["origin", "horizon", "reference_residual"] and diagnostics.count() == 1
    states = spark.createDataFrame([(p, t, [0.1 * p, 1 / 3], [1.0, 2e-17 * t, 2e-17 * t, 1e300]) for p in (1, 2) for t in range(3)], "panel int, t int, mean array<double>, cov array<double>")
    files.write_states(states, str(tmp_path / "states"), ["panel"])
    back = files.read_states(spark, str(tmp_path / "states"), "panel int")
    assert sorted(map(tuple, back.select("panel", "t", "mean", "cov").collect())) == sorted(map(tuple, states.collect()))


def test_streams_and_states_in_units_of_the_data(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3)) * [1.0, 5.0, 0.0] + [10.0, -3.0, 2.0]
    rows = [(i, "abc"[k], None if (i, k) == (20, 1) else float(x[i, k])) for i in range(60) for k in range(3)]
    stream, profile = grid.standardised_stream(spark.createDataFrame(rows, "i int, k string, c double"), 40, "rmse", "things")
    got = {r.k: r for r in profile.collect()}
    assert set(got) == {"a", "b"} and got["a"].fit_raw_end == 40 and np.isclose(got["a"].center, x[:40, 0].mean()) and np.isclose(got["a"].scale, x[:40, 0].std())
    from gausstide.operators import states

    made = grid.destandardised_states(states.hopping_states(stream, 12, 6, 60, 0.0), profile).orderBy("t").collect()
    x[20, 1] = (x[19, 1] + x[21, 1]) / 2
    for r in made:
        w = x[r.t * 6 : r.t * 6 + 12, :2]
        assert np.allclose(r.mean, w.mean(0)) and np.allclose(np.reshape(r["cov"], (2, 2)), np.cov(w.T))


def test_state_problems(spark):
    good = [1.0, 0.5, 0.5, 2.0]
    rows = [([0.0, 0.0], good), ([0.0], good), ([0.0, None], good), ([0.0, 0.0], None), ([0.0, float("inf")], good), ([0.0, 0.0], [1.0, 0.5, 0.4, 2.0]), ([0.0, 0.0], [1.0, 2.0, 2.0, 1.0]), ([0.0, 0.0], [float("nan")] * 4)]
    got = {r.problem: r.n for r in evaluation.state_problems(spark.createDataFrame(rows, "mean array<double>, cov array<double>"), 2).collect()}
    assert got == {"size": 2, "not finite": 3, "not symmetric": 1, "not definite": 1}
    assert evaluation.state_problems(spark.createDataFrame(rows[:1], "mean array<double>, cov array<double>"), 2).count() == 0
