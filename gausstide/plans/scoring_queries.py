"""Queries of the evaluation relations and tables, with SQL of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gausstide.functions import linalg as la
from gausstide.operators import autoregression as ar
from gausstide.operators import charts, grid, inference, local_chart, raw_model, references, reporting, scoring, splits, states
from gausstide.plans import views as v
from gausstide.plans.views import rounded, sql
from gausstide.session import checkpointed

QUERIES: dict = {}
SQL: dict = {}
HORIZONS, PANEL_HORIZONS = [3, 4, 5], [1, 3, 6]
FIT, VAL = 105, 140
LINEAR = ["euclidean", "cholesky"]
CHARTS = ["euclidean", "cholesky", "log_euclidean", "transport_fixed"]


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return add


def _digits(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: rounded(c, digits) for c in columns})


def _sql_digits(columns: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0::double as {c}" for c in columns)


# ---- SQL of the linear charts for d = 2: coordinates, diagonal models, forecasts, decoded states, losses


def _z(states_: str, keys: str) -> str:
    one = "select {keys}, '{method}' as method, t, unnest([0,1,2,3,4]) as k, unnest([mx, my, {z}]) as z from {s}"
    parts = [one.format(keys=keys, method=m, z=z, s=states_) for m, z in (("euclidean", "a, b, d"), ("cholesky", "ln(sqrt(a)), b/sqrt(a), ln(sqrt(d - b*b/a))"))]
    return f"z as ({' union all '.join(parts)})"


def _fit(name: str, keys: str, rows: str) -> str:
    p = f"partition by {keys}, method, k"
    return f"""{name} as (select {keys}, method, k, max(mu) as mu, max(n) - 1 as m, sum(x*y) as xy, sum(x*x) as xx from (select *, z - mu as y, lag(z) over ({p} order by t) - mu as x
 from (select *, avg(z) over ({p}) as mu, count(*) over ({p}) as n from {rows})) group by {keys}, method, k)"""


def _decode(name: str, keys: str, forecast: str) -> str:
    """States pa, pb, pd (floored) with means m0, m1 from rows (keys, method, horizon, source, k, zh)."""
    return f"""{name}0 as (select {keys}, method, horizon, source, max(case when k = 0 then zh end) as m0, max(case when k = 1 then zh end) as m1, max(case when k = 2 then zh end) as z2, max(case when k = 3 then zh end) as z3, max(case when k = 4 then zh end) as z4 from {forecast} group by all),
 {name}1 as (select *, case when method = 'euclidean' then z2 else exp(2*z2) end as a0, case when method = 'euclidean' then z3 else exp(z2)*z3 end as b0, case when method = 'euclidean' then z4 else z3*z3 + exp(2*z4) end as d0 from {name}0),
 {name}2 as (select *, (a0 + d0)/2 - sqrt(pow((a0 - d0)/2, 2) + b0*b0) as l1, (a0 + d0)/2 + sqrt(pow((a0 - d0)/2, 2) + b0*b0) as l2 from {name}1),
 {name} as (select {keys}, method, horizon, source, m0, m1, case when l1 >= 1e-8 then a0 when l2 <= 1e-8 then 1e-8 else a0 + (1e-8 - l1)/(l2 - l1)*(l2 - a0) end as pa,
  case when l1 >= 1e-8 then b0 when l2 <= 1e-8 then 0 else b0 - (1e-8 - l1)/(l2 - l1)*b0 end as pb, case when l1 >= 1e-8 then d0 when l2 <= 1e-8 then 1e-8 else d0 + (1e-8 - l1)/(l2 - l1)*(l2 - d0) end as pd from {name}2)"""


def _loss(name: str, keys: str, made: str, states_: str, on: str) -> str:
    return f"""{name} as (select *, mean_part + cov_part as w2, sqrt(mean_part / 2) as raw_rmse from (select {keys}, method, horizon, source, m0, m1, pa, pb, pd, source + horizon as target, pow(m0 - q.mx, 2) + pow(m1 - q.my, 2) as mean_part,
  greatest(pa + pd + q.a + q.d - 2*sqrt(pa*q.a + 2*pb*q.b + pd*q.d + 2*sqrt((pa*pd - pb*pb)*(q.a*q.d - q.b*q.b))), 0) as cov_part,
  0.5*(2*ln(2*pi()) + ln(pa*pd - pb*pb) + (pd*q.a - 2*pb*q.b + pa*q.d)/(pa*pd - pb*pb) + (pd*pow(q.mx - m0, 2) - 2*pb*(q.mx - m0)*(q.my - m1) + pa*pow(q.my - m1, 2))/(pa*pd - pb*pb)) as log_score,
  (pa + pd)/2 - sqrt(pow((pa - pd)/2, 2) + pb*pb) as low from {made} f join {states_} q on q.t = f.source + f.horizon {on}))"""


def _scores(rows: str, by: str) -> str:
    stats = ", ".join(f"avg({c}) as {c}_mean, median({c}) as {c}_median, quantile_cont({c}, 0.9) as {c}_q90" for c in ("w2", "log_score", "raw_rmse"))
    return f"select {by}, {stats}, count(*) as n_pairs, min(low) as min_pred_eig from {rows} group by {by}"


SCORES = [f"{c}_{s}" for c in ("w2", "log_score", "raw_rmse") for s in ("mean", "median", "q90")] + ["min_pred_eig"]


# ---- rolling origins on S2 (EVAL-1, 2, 3, 5)


def _origin_scores(spark, sf_dir, low, high, methods=LINEAR, by=("origin", "horizon", "method")) -> DataFrame:
    """Scores of the linear charts at a ridge of 0.01, fitted before each origin's val_end, and of persistence."""
    s2 = checkpointed(v.S2(spark, sf_dir))
    ref = s2.filter("t = 0").select(F.col("mean").alias("ref_mean"), F.col("cov").alias("ref_cov"))
    table = splits.split_table(spark, v.SPLITS)
    origins = s2.crossJoin(F.broadcast(table.select("origin", "val_end")))
    coords = checkpointed(scoring.coordinates(origins.drop("val_end"), table.select("origin").crossJoin(F.broadcast(ref)), methods, ["origin"]))
    fit = coords.join(F.broadcast(table.select("origin", "val_end")), "origin").filter("t < val_end")
    model = ar.fit_diagonal(fit, v.STATES, 0.01, ["origin", "method", "k"])
    sources = scoring.ranges(table, HORIZONS, low, high).select("origin", "horizon", "source")
    made = scoring.chart_forecasts(coords, model, table.select("origin").crossJoin(F.broadcast(ref)), sources, ["origin"], ["method", "horizon"])
    both = made.unionByName(scoring.persistence_forecasts(origins.drop("val_end"), sources, ["origin"]).select(*made.columns))
    return scoring.score_summary(scoring.losses(both, origins.drop("val_end"), ["origin"], 2), list(by))


def _origin_sql(low: str, high: str, tail: str) -> str:
    """CTEs up to ``sc``, the scores by origin, horizon and method, then ``tail``."""
    parts = [
        _z("s2", "0 as one").replace("0 as one, ", ""),
        "zo as (select sp.origin, z.* from z join sp on z.t < sp.val_end)",
        _fit("mo", "origin", "zo"),
        f"so as (select origin, horizon, unnest(range({low}, {high})) as source from sp, (select unnest([3,4,5]) as horizon))",
        "fc as (select mo.origin, mo.method, so.horizon, so.source, mo.k, mu + pow(xy / (xx + m*0.01), so.horizon) * (z.z - mu) as zh from mo join so using (origin) join z on z.method = mo.method and z.k = mo.k and z.t = so.source)",
        _decode("dc", "origin", "fc"),
        "al as (select * from dc union all select origin, 'persistence', horizon, source, mx, my, a, b, d from so join s2 on s2.t = so.source)",
        _loss("lo", "origin", "al", "s2", ""),
        f"sc as ({_scores('lo', 'origin, horizon, method')})",
    ]
    return sql(", ".join(parts)[len("") :] + " " + tail, "e", "s2", "sp").replace("\nz as (", ",\nz as (", 1)


_SC = f"select origin::int as origin, horizon::int as horizon, method, {_sql_digits(SCORES, 4)}, n_pairs::bigint as n_pairs from sc"


@query(_origin_sql("val_end", "test_end", _SC))
def recursive_scores(spark, sf_dir):
    return _digits(_origin_scores(spark, sf_dir, F.col("val_end"), F.col("test_end")), SCORES, 4)


@query(_origin_sql("val_end - horizon", "test_end - horizon", _SC))
def future_block_scores(spark, sf_dir):
    return _digits(_origin_scores(spark, sf_dir, F.col("val_end") - F.col("horizon"), F.col("test_end") - F.col("horizon")), SCORES, 4)


METHODS = ["persistence", "euclidean", "cholesky", "long_memory"]
NEEDS = {"cholesky": 70}


def _run(spark, sf_dir):
    scores = _origin_scores(spark, sf_dir, F.col("val_end") - F.col("horizon"), F.col("test_end") - F.col("horizon"))
    return scoring.rolling_run(splits.split_table(spark, v.SPLITS), HORIZONS, METHODS, scores, NEEDS)


_RUN = """, ru as (select origin, h.horizon, me.method, w2_mean, raw_rmse_mean, n_pairs, case when fit_end < least then 'needs ' || least || ' states to fit' when w2_mean is null or isnan(w2_mean) or isinf(w2_mean) then 'no finite score' end as error
 from sp cross join (select unnest([3,4,5]) as horizon) h cross join (values ('persistence', 0), ('euclidean', 0), ('cholesky', 70), ('long_memory', 0)) me(method, least) left join sc using (origin, horizon, method) where test_end > val_end + h.horizon),
 rr as (select origin, horizon, method, case when error is null then w2_mean end as w2_mean, case when error is null then raw_rmse_mean end as raw_rmse_mean, case when error is null then n_pairs end as n_pairs, error from ru) """


@query(_origin_sql("val_end - horizon", "test_end - horizon", _RUN + "select origin::int as origin, horizon::int as horizon, method, round(w2_mean, 4) + 0.0::double as w2_mean, round(raw_rmse_mean, 4) + 0.0::double as raw_rmse_mean, coalesce(n_pairs, 0)::bigint as n_pairs, error from rr"))
def rolling_run(spark, sf_dir):
    """Two charts and persistence; cholesky asks for more states than the first origin has, and long_memory has no scorer: both leave error rows."""
    return _digits(_run(spark, sf_dir), ["w2_mean", "raw_rmse_mean"], 4).select("origin", "horizon", "method", "w2_mean", "raw_rmse_mean", F.coalesce("n_pairs", F.lit(0).cast("long")).alias("n_pairs"), "error")


# ---- a chart that fails on a state, and every candidate reference as a model of its own (EVAL-5, TUN-7)

_BAD = 50
_FLOORED = """lx as (select t, mx, my, a, b, d, (a + d)/2 - sqrt(pow((a - d)/2, 2) + b*b) as l1, (a + d)/2 + sqrt(pow((a - d)/2, 2) + b*b) as l2 from sx),
 sf as (select t, mx, my, case when l1 >= 1e-8 then a else a + (1e-8 - l1)/(l2 - l1)*(l2 - a) end as a, case when l1 >= 1e-8 then b else b - (1e-8 - l1)/(l2 - l1)*b end as b, case when l1 >= 1e-8 then d else d + (1e-8 - l1)/(l2 - l1)*(l2 - d) end as d from lx)"""


def _errors_sql() -> str:
    parts = [
        f"sx as (select t, mx, my, a, case when t = {_BAD} then 1.5*sqrt(a*d) else b end as b, d from s2)",
        _FLOORED,
        "z as (select 'euclidean' as method, t, unnest([0,1,2,3,4]) as k, unnest([mx, my, a, b, d]) as z from sx)",
        "zo as (select sp.origin, z.* from z join sp on z.t < sp.val_end)",
        _fit("mo", "origin", "zo"),
        "so as (select origin, horizon, unnest(range(val_end - horizon, test_end - horizon)) as source from sp, (select unnest([3,4,5]) as horizon))",
        "fc as (select mo.origin, mo.method, so.horizon, so.source, mo.k, mu + pow(xy / (xx + m*0.01), so.horizon) * (z.z - mu) as zh from mo join so using (origin) join z on z.method = mo.method and z.k = mo.k and z.t = so.source)",
        _decode("dc", "origin", "fc"),
        "al as (select * from dc union all select origin, 'persistence', horizon, source, mx, my, a, b, d from so join sf on sf.t = so.source)",
        _loss("lo", "origin", "al", "sf", ""),
        f"sc as ({_scores('lo', 'origin, horizon, method')})",
    ]
    tail = "select origin::int as origin, h.horizon::int as horizon, me.method, round(w2_mean, 4) + 0.0::double as w2_mean, round(raw_rmse_mean, 4) + 0.0::double as raw_rmse_mean, case when me.method = 'log_strict' then 'NumericalError: a logarithm needs positive eigenvalues' end as error from sp cross join (select unnest([3,4,5]) as horizon) h cross join (values ('persistence'), ('euclidean'), ('log_strict')) me(method) left join sc on sc.origin = sp.origin and sc.horizon = h.horizon and sc.method = me.method where test_end > val_end + h.horizon"
    return sql(", ".join(parts) + " " + tail.replace("select origin::int", "select sp.origin::int", 1), "e", "s2", "sp").replace("\nsx as (", ",\nsx as (", 1)


@query(_errors_sql())
def rolling_run_errors(spark, sf_dir):
    """One covariance of the series is indefinite: the chart without a floor fails on it and leaves error rows with its reason; the other methods, and the truth, see it projected and are scored in the same run."""
    s2 = v.S2(spark, sf_dir)
    at = lambda i: F.get("cov", F.lit(i))
    broken = F.array(at(0), 1.5 * F.sqrt(at(0) * at(3)), 1.5 * F.sqrt(at(0) * at(3)), at(3))
    raw = checkpointed(s2.withColumn("cov", F.when(F.col("t") == _BAD, broken).otherwise(F.col("cov"))).select("t", "mean", "cov"))
    known = raw.withColumn("cov", la.state_floor("cov"))
    table = splits.split_table(spark, v.SPLITS)
    ends, refs = F.broadcast(table.select("origin", "val_end")), table.select("origin").crossJoin(F.broadcast(raw.filter("t = 0").select(F.col("mean").alias("ref_mean"), F.col("cov").alias("ref_cov"))))
    coded = checkpointed(charts.encode(raw.crossJoin(F.broadcast(table.select("origin"))), refs, ["euclidean", "log_strict"], ["origin"], errors=True))
    failures = scoring.chart_errors(coded, table, ["origin", "method"])
    coords = coded.join(F.broadcast(failures), ["origin", "method"], "left_anti").select("origin", "method", "t", F.posexplode("z").alias("k", "z"))
    model = ar.fit_diagonal(coords.join(ends, "origin").filter("t < val_end"), v.STATES, 0.01, ["origin", "method", "k"])
    sources = scoring.ranges(table, HORIZONS, F.col("val_end") - F.col("horizon"), F.col("test_end") - F.col("horizon")).select("origin", "horizon", "source")
    made = scoring.chart_forecasts(coords, model, refs, sources, ["origin"], ["method", "horizon"])
    both = made.unionByName(scoring.persistence_forecasts(known.crossJoin(F.broadcast(table.select("origin"))), sources, ["origin"]).select(*made.columns))
    scores = scoring.score_summary(scoring.losses(both, known, [], 2), ["origin", "horizon", "method"])
    out = scoring.rolling_run(table, HORIZONS, ["persistence", "euclidean", "log_strict"], scores, failures=failures)
    return _digits(out, ["w2_mean", "raw_rmse_mean"], 4).select("origin", "horizon", "method", "w2_mean", "raw_rmse_mean", "error")


_REF_RIDGES = [1e-3, 1e-1, 10.0]
_FORMED = ["pooled", "diagonal", "identity", "sample_0", "sample_1", "sample_2", "sample_3"]


def _references_sql() -> str:
    """The transport chart for d = 2: T = A^-1 # B in closed form, coordinates T - I, C = (I + H) A (I + H)."""
    lib = """av as (select origin, fit_end, avg(mx) as rx, avg(my) as ry, avg(a) as ra, avg(b) as rb, avg(d) as rd from s2 join sp on t < fit_end group by all),
 lib as (select origin, 'pooled' as reference, 0 as place, rx, ry, ra, rb, rd from av union all select origin, 'diagonal', 2, rx, ry, ra, 0, rd from av union all select origin, 'identity', 3, rx, ry, (ra + rd)/2, 0, (ra + rd)/2 from av
  union all select origin, 'sample_' || j, 5 + j, mx, my, a, b, d from sp cross join (select unnest([0,1,2,3]) as j) js join s2 on t = (j * (fit_end - 1)) // 3)"""
    parts = [
        lib,
        "e0 as (select lib.*, t, mx - rx as ux, my - ry as uy, a, b, d, sqrt(ra*rd - rb*rb) as q1, sqrt(a*d - b*b) as q2 from lib cross join s2)",
        "e1 as (select *, 1/q1 as al, rd/q1 + a/q2 as pa, -rb/q1 + b/q2 as pb, ra/q1 + d/q2 as pd from e0)",
        "e2 as (select *, sqrt(al*q2)/sqrt(pa*pd - pb*pb) as f from e1)",
        "z as (select origin, reference as method, t, unnest([0,1,2,3,4]) as k, unnest([ux, uy, f*pa - 1, f*pb, f*pd - 1]) as z from e2)",
        "zf as (select z.* from z join sp using (origin) where t < fit_end), zv as (select z.* from z join sp using (origin) where t < val_end)",
        _fit("mf", "origin", "zf"),
        _fit("mv", "origin", "zv"),
        "so as (select origin, horizon, 'v' as part, unnest(range(fit_end - horizon, val_end - horizon)) as source from sp, (select unnest([3,5]) as horizon) union all select origin, horizon, 't', unnest(range(val_end - horizon, test_end - horizon)) from sp, (select unnest([3,5]) as horizon))",
        "fa as (select m.origin, m.method, so.part, so.horizon, ridge, so.source, m.k, mu + pow(xy / (xx + m*ridge), so.horizon) * (z.z - mu) as zh from (select *, 'v' as part from mf union all select *, 't' from mv) m join so on so.origin = m.origin and so.part = m.part cross join (select unnest([0.001, 0.1, 10.0]::double[]) as ridge) join z on z.origin = m.origin and z.method = m.method and z.k = m.k and z.t = so.source)",
        "d0 as (select origin, method, part, horizon, ridge, source, " + ", ".join(f"max(case when k = {i} then zh end) as z{i}" for i in range(5)) + " from fa group by all)",
        "d1 as (select *, (z2 + z4)/2 - sqrt(pow((z2 - z4)/2, 2) + z3*z3) as low from d0)",
        "d2 as (select *, case when low < 0 and 1 + low < 0.05 then 0.95/abs(low) else 1 end as sh from d1)",
        "d3 as (select d2.*, l.rx, l.ry, 1 + sh*z2 as u, sh*z3 as w, 1 + sh*z4 as y, ra, rb, rd from d2 join lib l on l.origin = d2.origin and l.reference = d2.method)",
        "d4 as (select *, u*(u*ra + w*rb) + w*(u*rb + w*rd) as pa, u*(w*ra + y*rb) + w*(w*rb + y*rd) as pb, w*(w*ra + y*rb) + y*(w*rb + y*rd) as pd, rx + z0 as m0, ry + z1 as m1 from d3)",
        """lo as (select *, pow(m0 - q.mx, 2) + pow(m1 - q.my, 2) as mp, greatest(pa + pd + q.a + q.d - 2*sqrt(pa*q.a + 2*pb*q.b + pd*q.d + 2*sqrt((pa*pd - pb*pb)*(q.a*q.d - q.b*q.b))), 0) as cp,
  0.5*(2*ln(2*pi()) + ln(pa*pd - pb*pb) + (pd*q.a - 2*pb*q.b + pa*q.d)/(pa*pd - pb*pb) + (pd*pow(q.mx - m0, 2) - 2*pb*(q.mx - m0)*(q.my - m1) + pa*pow(q.my - m1, 2))/(pa*pd - pb*pb)) as ls from d4 join s2 q on q.t = d4.source + d4.horizon)""",
        "sc as (select origin, method, part, horizon, ridge, avg(mp + cp) as w2, avg(ls) as log_score, avg(sqrt(mp/2)) as raw_rmse, count(*) as n from lo group by all)",
        "ch as (select * from (select *, row_number() over (partition by origin, method, horizon order by round(w2, 9), ridge) as r from sc where part = 'v') where r = 1)",
        "jo as (select ch.origin, ch.horizon, ch.method as reference, ch.ridge, ch.w2 as val_w2_mean, ch.log_score as val_log_score_mean, ch.raw_rmse as val_raw_rmse_mean, te.w2 as test_w2_mean, te.log_score as test_log_score_mean, te.raw_rmse as test_raw_rmse_mean, te.n as n_test_pairs, place from ch join sc te on te.part = 't' and te.origin = ch.origin and te.method = ch.method and te.horizon = ch.horizon and te.ridge = ch.ridge join lib on lib.origin = ch.origin and lib.reference = ch.method)",
    ]
    digits = _sql_digits([f"{p}_{m}_mean" for p in ("val", "test") for m in scoring.METRICS], 5)
    tail = f"select origin::int as origin, horizon::int as horizon, reference, ridge, {digits}, n_test_pairs::bigint as n_test_pairs, row_number() over (partition by origin, horizon order by round(val_w2_mean, 9), place) = 1 as selected from jo"
    return sql(", ".join(parts) + " " + tail, "e", "s2", "sp").replace("\nav as (", ",\nav as (", 1)


def _library(spark, s2: DataFrame) -> DataFrame:
    table = splits.split_table(spark, v.SPLITS)
    rows = s2.crossJoin(F.broadcast(table.select("origin", "fit_end"))).filter("t < fit_end")
    place = F.array_position(F.array(*map(F.lit, references.LIBRARY)), F.col("name"))
    return references.library(rows, ["origin"]).select("origin", F.col("name").alias("reference"), place.cast("int").alias("place"), "ref_mean", "ref_cov")


@query(_references_sql())
def reference_run_d2(spark, sf_dir):
    """The candidates of the library that SQL can form, each fitted, tuned, tested and ranked."""
    s2 = checkpointed(v.S2(spark, sf_dir))
    out = scoring.reference_run(s2, splits.split_table(spark, v.SPLITS), [3, 5], _library(spark, s2).filter(F.col("reference").isin(_FORMED)), 2, _REF_RIDGES)
    means = [f"{p}_{m}_mean" for p in ("val", "test") for m in scoring.METRICS]
    return _digits(out, means, 5).select("origin", "horizon", "reference", "ridge", *means, "n_test_pairs", "selected")


@query()
def reference_library_run(spark, sf_dir):
    """The whole library, all horizons and ridges."""
    s2 = checkpointed(v.S2(spark, sf_dir))
    return scoring.reference_run(s2, splits.split_table(spark, v.SPLITS), HORIZONS, _library(spark, s2), 2)


# ---- the local chart where it has a closed form: one dimension (EVAL-7, REF-5, TUN-4)

_LENGTHS, _LOCAL_RIDGES, _LOCAL_HORIZONS = [24, 48], [1e-3, 1e-1, 10.0], [3, 5]


def _local_sql() -> str:
    """In one dimension the reference is (mean of roots) squared, the map a ratio of roots, and the model 2 x 2."""
    step = lambda n, a, b: f"{n} as (select *, {a}*a00 + {b}*a10 as {n}u, {a}*a01 + {b}*a11 as {n}w from {{}})"
    chain, before = [], "md"
    for i in range(1, 6):
        u, w = ("zu", "zw") if i == 1 else (f"p{i - 1}u", f"p{i - 1}w")
        chain.append(step(f"p{i}", u, w).format(before))
        before = f"p{i}"
    parts = [
        "s1 as (select t, mx as m, sqrt(a) as r from s2)",
        "wn as (select source, length, q.t, q.m, q.r, avg(m) over w as rm, avg(r) over w as rr from (select t as source, unnest([24, 48]) as length from s1) k join s1 q on q.t > source - length and q.t <= source where source >= length - 1 window w as (partition by source, length))",
        "zz as (select source, length, t, rm, rr, m - rm as u, r/rr - 1 as w from wn)",
        "lg as (select *, lag(u) over (partition by source, length order by t) as bu, lag(w) over (partition by source, length order by t) as bw from zz)",
        "sm as (select source, length, max(rm) as rm, max(rr) as rr, sum(bu*bu) as suu, sum(bu*bw) as suw, sum(bw*bw) as sww, sum(bu*u) as cuu, sum(bu*w) as cuw, sum(bw*u) as cwu, sum(bw*w) as cww, max(case when t = source then u end) as zu, max(case when t = source then w end) as zw from lg group by all)",
        "md as (select *, (e*cuu - suw*cwu)/dt as a00, (e*cuw - suw*cww)/dt as a01, (d*cwu - suw*cuu)/dt as a10, (d*cww - suw*cuw)/dt as a11 from (select *, d*e - suw*suw as dt from (select sm.*, ridge, suu + (length - 1)*ridge as d, sww + (length - 1)*ridge as e from sm cross join (select unnest([0.001, 0.1, 10.0]::double[]) as ridge))))",
        *chain,
        "fc as (select source, length, ridge, horizon, rm + case horizon when 3 then p3u else p5u end as fm, rr * greatest(1 + case horizon when 3 then p3w else p5w end, 1e-8) as fr from p5 cross join (select unnest([3, 5]) as horizon))",
        "ls as (select fc.*, source + horizon as target, abs(fm - q.m) as rmse, pow(fm - q.m, 2) + pow(fr - q.r, 2) as w2 from fc join s1 q on q.t = source + horizon)",
        "tu as (select origin, horizon, length, ridge, avg(rmse) as loss from ls join sp on source >= greatest(fit_end - horizon, 47) and source < val_end - horizon group by all)",
        "ch as (select * from (select *, row_number() over (partition by origin, horizon order by loss, length, ridge desc) as k from tu) where k = 1)",
    ]
    tail = "select ch.origin::int as origin, ch.horizon::int as horizon, target::int as target, ch.length::int as window_length, ch.ridge, round(rmse, 5) + 0.0::double as raw_rmse, round(w2, 5) + 0.0::double as w2 from ch join sp on sp.origin = ch.origin join ls on ls.horizon = ch.horizon and ls.length = ch.length and ls.ridge = ch.ridge and source >= val_end - ch.horizon and source < test_end - ch.horizon"
    return sql(", ".join(parts) + " " + tail, "e", "s2", "sp").replace("\ns1 as (", ",\ns1 as (", 1)


@query(_local_sql())
def local_chart_d1(spark, sf_dir):
    """The whole of the local chart for one event type: references, coordinates, models, tuning, and the test targets under the chosen window and ridge."""
    one = v.S2(spark, sf_dir).select("t", F.slice("mean", 1, 1).alias("mean"), F.slice("cov", 1, 1).alias("cov"))
    table = splits.split_table(spark, v.SPLITS)
    scored = local_chart.scored_forecasts(checkpointed(one), table, _LOCAL_HORIZONS, 1, _LENGTHS, _LOCAL_RIDGES)
    rows = local_chart.local_panel(scored, table, _LOCAL_HORIZONS, max(_LENGTHS))
    return _digits(rows, ["raw_rmse", "w2"], 5).select("origin", "horizon", "target", "window_length", "ridge", "raw_rmse", "w2")


# ---- raw rows, full model for d = 2 (AR-5, AR-6, EVAL-4)


@query(
    sql(
        """rw as (select i, max(case when k = 'click' then c end) as x, max(case when k = 'view' then c end) as y from e where k in ('click', 'view') group by i),
pr as (select i, lag(x) over (order by i) as px, lag(y) over (order by i) as py, x, y from rw),
ft as (select origin, avg(px) as ax, avg(py) as ay, avg(x) as bx, avg(y) as by_, sum(px*px) - sum(px)*sum(px)/count(*) + 0.1 as sxx, sum(px*py) - sum(px)*sum(py)/count(*) as sxy, sum(py*py) - sum(py)*sum(py)/count(*) + 0.1 as syy,
  sum(px*x) - sum(px)*sum(x)/count(*) as cxx, sum(px*y) - sum(px)*sum(y)/count(*) as cxy, sum(py*x) - sum(py)*sum(x)/count(*) as cyx, sum(py*y) - sum(py)*sum(y)/count(*) as cyy
  from pr join sp on i < (val_end - 1)*4 + 24 where px is not null group by origin),
we as (select origin, ax, ay, bx, by_, (syy*cxx - sxy*cyx)/dt as w00, (syy*cxy - sxy*cyy)/dt as w01, (sxx*cyx - sxy*cxx)/dt as w10, (sxx*cyy - sxy*cxy)/dt as w11 from (select *, sxx*syy - sxy*sxy as dt from ft)),
wb as (select *, bx - ax*w00 - ay*w10 as i0, by_ - ax*w01 - ay*w11 as i1 from we)""".replace("rw as", ", rw as", 1)
        + """, so as (select origin, horizon, unnest(range(val_end - horizon, test_end - horizon)) as source from sp, (select unnest([3,4,5]) as horizon)),
st as (select origin, horizon, source, source*4 + 23 as last, (source + horizon)*4 as start from so),
rc as (select st.*, i, x, y from st join rw on i = last union all select r.origin, horizon, source, last, start, i + 1, i0 + x*w00 + y*w10, i1 + x*w01 + y*w11 from rc r join wb on wb.origin = r.origin where i + 1 < start + 24),
al as (select origin, horizon, source, i, x, y from rc where i >= start and i > last union all select origin, horizon, source, rw.i, x, y from st join rw on rw.i >= start and rw.i <= last)
select origin::int as origin, horizon::int as horizon, source::int as source, round(avg(x), 5) + 0.0::double as m0, round(avg(y), 5) + 0.0::double as m1, round(covar_samp(x, x) + 1e-8, 4) + 0.0::double as a, round(covar_samp(x, y), 4) + 0.0::double as b, round(covar_samp(y, y) + 1e-8, 4) + 0.0::double as d from al group by all""",
        "e",
        "sp",
    )
    .replace("with ", "with recursive ", 1)
    .replace("\n, rw as", ",\nrw as", 1)
)
def raw_model_d2(spark, sf_dir):
    """Full vector autoregression of the raw rows at a ridge of 0.1 fitted before each origin's val_end: the states of all test targets."""
    raw = checkpointed(states.vectors(v.E2(spark, sf_dir)))
    table = splits.split_table(spark, v.SPLITS)
    ends = [(s[2] - 1) * v.STEP + v.WINDOW for s in v.SPLITS]
    tests = scoring.ranges(table, HORIZONS, F.col("val_end") - F.col("horizon"), F.col("test_end") - F.col("horizon"))
    wanted = tests.select("origin", raw_model.raw_end("val_end", v.WINDOW, v.STEP).cast("int").alias("end"), F.lit(0.1).alias("ridge"), "horizon", "source")
    powers = raw_model.power_table(raw_model.normal_sums(raw, ends), wanted.select("end", "ridge").distinct(), max(HORIZONS) * v.STEP)
    made = raw_model.raw_forecasts(raw, wanted, powers, v.WINDOW, v.STEP)
    at = lambda c, i: F.get(c, F.lit(i))
    return made.select("origin", "horizon", "source", rounded(at("mean", 0), 5).alias("m0"), rounded(at("mean", 1), 5).alias("m1"), *(rounded(at("cov", i), 4).alias(n) for i, n in ((0, "a"), (1, "b"), (3, "d"))))


# ---- tables over replicates (AGG-7, AGG-9): origins in their place


@query(_origin_sql("val_end", "test_end", ", ra as (select s.horizon, s.method, s.w2_mean / greatest(b.w2_mean, 1e-12) as r from sc s join sc b on b.origin = s.origin and b.horizon = s.horizon and b.method = 'persistence') select horizon::int as horizon, method, count(*)::bigint as n_rep, round(avg(r), 5) + 0.0::double as ratio_mean, round(stddev_samp(r)/sqrt(count(*)), 5) + 0.0::double as ratio_se from ra group by all"))
def replicated_ratios(spark, sf_dir):
    rows = _origin_scores(spark, sf_dir, F.col("val_end"), F.col("test_end"))
    return _digits(reporting.replicated_ratios(rows, ["horizon"], ["origin"], "w2_mean"), ["ratio_mean", "ratio_se"], 5)


@query(_origin_sql("val_end", "test_end", ", ra as (select s.horizon, 100*(s.w2_mean / greatest(b.w2_mean, 1e-14) - 1) as c from sc s join sc b on b.origin = s.origin and b.horizon = s.horizon and b.method = 'cholesky' where s.method = 'euclidean'), rb as (select horizon, avg(c) as mean_change, stddev_samp(c)/sqrt(count(*)) as se, avg((c < 0)::int) as win_rate, count(*) as n from ra group by all) select horizon::int as horizon, round(mean_change, 4) + 0.0::double as mean_change, round(se, 4) + 0.0::double as se, round(mean_change - 1.96*se, 4) + 0.0::double as low, round(mean_change + 1.96*se, 4) + 0.0::double as high, win_rate, n::bigint as n from rb"))
def paired_decision(spark, sf_dir):
    rows = _origin_scores(spark, sf_dir, F.col("val_end"), F.col("test_end"))
    return _digits(reporting.paired_decision(rows, ["horizon"], ["origin"], "w2_mean", "euclidean", "cholesky"), ["mean_change", "se", "low", "high"], 4)


_GAINS = ["mean_gain", "median_gain", "mean_reduction", "median_reduction", "positive_rate", "best_rate"]
_COMPARE = """, co as (select o.origin, o.horizon, t.w2_mean as target_loss, b as best_other_loss from rr t join (select origin, horizon, min(w2_mean) as b from rr where method <> 'euclidean' and w2_mean is not null group by all) o using (origin, horizon) where t.method = 'euclidean' and t.w2_mean is not null),
 cm as (select horizon, avg(g) as mean_gain, median(g) as median_gain, avg(r) as mean_reduction, median(r) as median_reduction, avg((g > 0)::int) as positive_rate, avg((target_loss <= best_other_loss)::int) as best_rate, count(*) as n_jobs
 from (select *, best_other_loss - target_loss as r, (best_other_loss - target_loss) / greatest(abs(best_other_loss), 1e-12) as g from co) group by horizon) """


@query(_origin_sql("val_end - horizon", "test_end - horizon", _RUN + _COMPARE + f"select horizon::int as horizon, {_sql_digits(_GAINS, 4)}, n_jobs::bigint as n_jobs from cm"))
def rolling_comparison(spark, sf_dir):
    pairs = scoring.rolling_comparison(_run(spark, sf_dir), ["origin", "horizon"], "euclidean", "w2_mean")
    return _digits(scoring.comparison_summary(pairs, ["horizon"]), _GAINS, 4)


@query(
    sql(
        """select start::int as start, stop::int as stop, horizon::int as horizon, round(avg(pow(p.mx - q.mx, 2) + pow(p.my - q.my, 2) + greatest(p.a + p.d + q.a + q.d - 2*sqrt(p.a*q.a + 2*p.b*q.b + p.d*q.d + 2*sqrt((p.a*p.d - p.b*p.b)*(q.a*q.d - q.b*q.b))), 0)), 5) as w2
 from (values (61, 87), (87, 175)) iv(start, stop) cross join (select unnest([1,3,6]) as horizon) join s2 p on p.t >= start and p.t < stop - horizon join s2 q on q.t = p.t + horizon group by all""",
        "e",
        "s2",
    )
)
def interval_w2(spark, sf_dir):
    """Mean W2 of persistence over sources in [start, stop - h)."""
    iv = spark.createDataFrame([(61, 87), (87, 175)], "start int, stop int")
    s2 = v.S2(spark, sf_dir)
    sources = scoring.ranges(iv, PANEL_HORIZONS, F.col("start"), F.col("stop") - F.col("horizon"))
    both = s2.withColumn("one", F.lit(1))
    made = scoring.persistence_forecasts(both, sources.withColumn("one", F.lit(1)).select("one", "horizon", "source").distinct(), ["one"])
    rows = scoring.losses(made, both, ["one"], 2).select("horizon", "source", "w2")
    return sources.join(rows, ["horizon", "source"]).groupBy("start", "stop", "horizon").agg(rounded(F.avg("w2"), 5).alias("w2"))


@query(
    sql(
        """, mo0 as (select origin, k, count(*) as n, sum(x) as sx, sum(c) as sy, sum(x*c) as sxy, sum(x*x) as sxx from (select origin, k, c, lag(c) over (partition by origin, k order by i) as x from e join sp on i < (val_end - 1)*4 + 24 where k in ('click', 'view')) where x is not null group by all),
 mo as (select origin, k, slope, (sy - slope*sx)/n as intercept from (select *, (n*sxy - sx*sy)/(n*(sxx + 0.1) - sx*sx) as slope from mo0)),
 so as (select origin, horizon, unnest(range(val_end, test_end)) as source from sp, (select unnest([3,4,5]) as horizon)),
 rw as (select so.origin, so.horizon, so.source, mo.k, g.i, case when g.i < source*4 + 24 then e.c else pow(slope, g.i - (source*4 + 24) + 1)*e.c + intercept*(1 - pow(slope, g.i - (source*4 + 24) + 1))/(1 - slope) end as c
  from so join (select unnest(range(720)) as i) g on g.i >= (source + horizon)*4 and g.i < (source + horizon)*4 + 24 join mo using (origin) join e on e.k = mo.k and e.i = least(g.i, source*4 + 23) where source + horizon < 175),
 pv as (select origin, horizon, source, i, max(case when k = 'click' then c end) as x, max(case when k = 'view' then c end) as y from rw group by all),
 p0 as (select origin, horizon, source, avg(x) as m0, avg(y) as m1, covar_samp(x, x) + 1e-8 as a0, covar_samp(x, y) as b0, covar_samp(y, y) + 1e-8 as d0 from pv group by all)
 select origin::int as origin, horizon::int as horizon, round(avg(sqrt((pow(m0 - mx, 2) + pow(m1 - my, 2)) / 2)), 5) as raw_rmse, round(avg(pow(m0 - mx, 2) + pow(m1 - my, 2) + greatest(a0 + d0 + a + d - 2*sqrt(a0*a + 2*b0*b + d0*d + 2*sqrt(greatest(a0*d0 - b0*b0, 1e-300)*(a*d - b*b))), 0)), 3) as w2, count(*)::bigint as n from p0 join s2 on t = source + horizon group by all""",
        "e",
        "s2",
        "sp",
    ).replace("\n, mo0", ",\nmo0", 1)
)
def raw_var_scores(spark, sf_dir):
    """Diagonal autoregression of the raw rows, scored on the states of the predicted windows."""
    e2, s2, table = v.E2(spark, sf_dir), v.S2(spark, sf_dir), splits.split_table(spark, v.SPLITS)
    models = [ar.fit_raw_diagonal(e2, (val_end - 1) * v.STEP + v.WINDOW, 0.1).withColumn("origin", F.lit(origin)) for origin, _, val_end, _ in v.SPLITS]
    sources = scoring.ranges(table, HORIZONS, F.col("val_end"), F.col("test_end")).select("origin", "horizon", "source").filter(F.col("source") + F.col("horizon") < v.STATES)
    made = scoring.raw_window_forecasts(e2, grid.union_all(models), sources, v.WINDOW, v.STEP)
    rows = scoring.losses(made.withColumn("one", F.lit(1)), s2.withColumn("one", F.lit(1)), ["one"], 2)
    return rows.groupBy("origin", "horizon").agg(rounded(F.avg("raw_rmse"), 5).alias("raw_rmse"), rounded(F.avg("w2"), 3).alias("w2"), F.count("*").alias("n"))


# ---- panels (TUN-6, EVAL-10, LOSS-5, LOSS-7, INF-7, INF-8, AGG-12)


def _panel(spark, sf_dir, methods):
    p = checkpointed(v.P(spark, sf_dir))
    if set(methods) <= set(LINEAR):
        ref = p.filter("t = 0").select("panel", F.col("mean").alias("ref_mean"), F.col("cov").alias("ref_cov"))
    else:
        ref = references.group_references(p.filter(F.col("t") < FIT), ["panel"])
    ref = checkpointed(ref)  # read by every encoding and decoding
    coords = checkpointed(scoring.coordinates(p, ref, methods, ["panel"]))
    choice = scoring.panel_choice(p, coords, ref, ["panel"], 2, FIT, VAL, PANEL_HORIZONS)
    return p, coords, ref, choice


def _records(spark, sf_dir, methods=LINEAR):
    p, coords, ref, choice = _panel(spark, sf_dir, methods)
    made = scoring.panel_forecasts(p, coords, ref, checkpointed(choice), ["panel"], VAL, v.STATES, PANEL_HORIZONS)
    made = scoring.block_likelihood(checkpointed(made), v.PX(spark, sf_dir), ["panel"], v.WINDOW, v.STEP)
    return checkpointed(scoring.losses(made, p, ["panel"], 2))  # a fact table that summaries and bootstraps read several times


_PANEL_FIT = [
    _z("ps", "panel"),
    _fit("fv", "panel", f"(select * from z where t < {FIT})"),
    f"cd as (select z.panel, z.method, horizon, ridge, z.t as source, z.k, mu + pow(xy / (xx + m*ridge), horizon) * (z.z - mu) as zh from z join fv using (panel, method, k) cross join (select unnest([1,3,6]) as horizon) cross join (select unnest([1e-4,1e-3,1e-2,1e-1,1.0,10.0]) as ridge) where z.t >= {FIT} and z.t < {VAL} - horizon)",
    _decode("cc", "panel, ridge", "cd"),
    _loss("cl", "f.panel, ridge", "cc", "ps", "and q.panel = f.panel"),
    "ch as (select panel, method, horizon, ridge, loss from (select *, row_number() over (partition by panel, method, horizon order by round(loss, 9), ridge) as r from (select panel, method, horizon, ridge, avg(w2) as loss from cl group by all)) where r = 1)",
]
_PANEL = [
    *_PANEL_FIT,
    _fit("ft", "panel", f"(select * from z where t < {VAL})"),
    f"pf as (select z.panel, z.method, horizon, z.t as source, z.k, mu + pow(xy / (xx + m*ridge), horizon) * (z.z - mu) as zh from z join ft using (panel, method, k) join ch using (panel, method) where z.t >= {VAL} and z.t < 175 - horizon)",
    _decode("pd0", "panel", "pf"),
    f"pa0 as (select * from pd0 union all select panel, 'persistence', horizon, t, mx, my, a, b, d from ps cross join (select unnest([1,3,6]) as horizon) where t >= {VAL} and t < 175 - horizon)",
    _loss("pl", "f.panel", "pa0", "ps", "and q.panel = f.panel"),
    """nl0 as (select *, (pa + pd)/2 - sqrt(pow((pa - pd)/2, 2) + pb*pb) as l1, (pa + pd)/2 + sqrt(pow((pa - pd)/2, 2) + pb*pb) as l2 from pl),
 nl as (select * exclude (pa, pb, pd), case when l1 >= 1e-7 then pa when l2 <= 1e-7 then 1e-7 else pa + (1e-7 - l1)/(l2 - l1)*(l2 - pa) end as pa, case when l1 >= 1e-7 then pb when l2 <= 1e-7 then 0 else pb - (1e-7 - l1)/(l2 - l1)*pb end as pb, case when l1 >= 1e-7 then pd when l2 <= 1e-7 then 1e-7 else pd + (1e-7 - l1)/(l2 - l1)*(l2 - pd) end as pd from nl0),
 re as (select nl.panel, method, horizon, source, target, any_value(mean_part) as mean_part, any_value(cov_part) as cov_part, any_value(w2) as w2, any_value(raw_rmse) as raw_rmse,
  avg(0.5*(2*ln(2*pi()) + ln(pa*pd - pb*pb) + (pd*pow(x - m0, 2) - 2*pb*(x - m0)*(y - m1) + pa*pow(y - m1, 2))/(pa*pd - pb*pb))) as raw_nll from nl join pv on pv.panel = nl.panel and pv.i >= target*4 and pv.i < target*4 + 24 group by all)""",
]


def _panel_sql(parts: list[str], tail: str) -> str:
    return "with " + ",\n".join([v.SQL["e"], v.SQL["ps"], *parts]) + "\n" + tail


@query(_panel_sql(_PANEL_FIT, "select panel::int as panel, method, horizon::int as horizon, ridge, round(loss, 5) as loss from ch"))
def panel_ridge_choice(spark, sf_dir):
    *_, choice = _panel(spark, sf_dir, LINEAR)
    return _digits(choice, ["loss"], 5)


_PARTS = ["mean_part", "cov_part", "w2", "raw_rmse", "raw_nll"]


@query(_panel_sql(_PANEL, f"select panel::int as panel, method, horizon::int as horizon, source::int as source, target::int as target, {_sql_digits(_PARTS, 4)} from re"))
def panel_records(spark, sf_dir):
    rows = _records(spark, sf_dir).select("panel", "method", "horizon", "source", "target", *_PARTS)
    return _digits(rows, _PARTS, 4)


_METRICS = ["w2", "cov_part", "raw_rmse"]
_CIRCULAR = """nb as (select g, v, i, n from (select g, v, row_number() over (partition by g order by source) - 1 as i, count(*) over (partition by g) as n from gr)),
 sh as (select g, n, (((i - j) % n) + n) % n as start, v, j from nb cross join (select unnest(range(7)) as j)),
 bs as (select g, start, sum(v) as whole, sum(case when j < (n - 1) % 7 + 1 then v end) as cut from sh group by all),
 dr as (select g, n, r, b, ('0x' || substr(md5('20260731:' || g || ':' || r || ':' || b), 1, 8))::bigint % n as start, b = ceil(n / 7) as final from (select distinct g, n from nb) cross join (select unnest(range(1, 2001)) as r) cross join (select unnest(range(1, 40)) as b) where b <= ceil(n / 7)),
 mm as (select g, r, sum(case when final then cut else whole end) / max(n) as m from dr join bs using (g, start) group by g, r),
 iv as (select g, stddev_samp(m) as se, quantile_cont(m, 0.025) as low, quantile_cont(m, 0.975) as high from mm group by g),
 gm as (select g, avg(v) as mean, count(*) as n from gr group by g)"""
_LONG = "lg as (select panel, method, horizon, source, unnest(['w2', 'cov_part', 'raw_rmse']) as metric, unnest([w2, cov_part, raw_rmse]) as value from re)"
_CONTRASTS = "gr as (select a.horizon || ':' || a.metric || ':' || b.method as g, a.horizon, a.metric, b.method as comparator, a.source, avg(a.value - b.value) as v from lg a join lg b on a.panel = b.panel and a.horizon = b.horizon and a.source = b.source and a.metric = b.metric where a.method = 'cholesky' and b.method <> 'cholesky' and a.metric <> 'raw_rmse' group by all)"
_MEANS = "gr as (select method || ':' || horizon || ':' || metric as g, method, horizon, metric, source, avg(value) as v from lg group by all)"
_INTERVAL = ["mean", "se", "low", "high"]


@query(_panel_sql([*_PANEL, _LONG, _CONTRASTS, _CIRCULAR], f"select horizon::int as horizon, metric, comparator, {_sql_digits(_INTERVAL, 4)}, n::bigint as n from gm join iv using (g) join (select distinct g, horizon, metric, comparator from gr) using (g)"))
def panel_effects(spark, sf_dir):
    """Cholesky against the other methods, paired by source and averaged over panels, with circular block intervals."""
    rows = checkpointed(scoring.panel_contrasts(_records(spark, sf_dir), "cholesky", ["w2", "cov_part"]))
    return _digits(inference.circular_intervals_at_scale(rows, ["horizon", "metric", "comparator"], "difference", "source"), _INTERVAL, 4)


def _method_intervals(records):
    return inference.circular_intervals_at_scale(checkpointed(scoring.panel_means(records, _METRICS)), ["method", "horizon", "metric"], "value", "source")


@query(_panel_sql([*_PANEL, _LONG, _MEANS, _CIRCULAR], f"select method, horizon::int as horizon, metric, {_sql_digits(_INTERVAL, 4)}, n::bigint as n from gm join iv using (g) join (select distinct g, method, horizon, metric from gr) using (g)"))
def panel_method_intervals(spark, sf_dir):
    return _digits(_method_intervals(_records(spark, sf_dir)), _INTERVAL, 4)


_WIDE = [f"{m}_{s}" for m in _METRICS for s in ("mean", "median")] + [f"{m}_{s}" for m in _METRICS for s in ("se", "low", "high")]


@query(
    _panel_sql(
        [*_PANEL, _LONG, _MEANS, _CIRCULAR, "wi as (select method, horizon, metric, se, low, high from iv join (select distinct g, method, horizon, metric from gr) using (g))", "su as (select method, horizon, count(*) as n, " + ", ".join(f"avg({m}) as {m}_mean, median({m}) as {m}_median" for m in _METRICS) + " from re group by all)"],
        f"select method, horizon::int as horizon, n::bigint as n, {_sql_digits(_WIDE, 4)} from su join (select method, horizon, " + ", ".join(f"max(case when metric = '{m}' then {s} end) as {m}_{s}" for m in _METRICS for s in ("se", "low", "high")) + " from wi group by all) using (method, horizon)",
    )
)
def panel_summary(spark, sf_dir):
    records = _records(spark, sf_dir)
    return _digits(scoring.with_intervals(records, _method_intervals(records), _METRICS), _WIDE, 4)


@query()
def panel_evaluation(spark, sf_dir):
    """All four charts and persistence, the transport chart at the barycenter of each panel's fitting states."""
    return _records(spark, sf_dir, CHARTS).select("panel", "method", "horizon", "source", "target", *_PARTS, "log_score", "low")


# ---- references and diagnostics (TUN-7, AGG-16, AGG-17)


@query(
    sql(
        """, ca as (select 'mean' as reference, 1 as place, avg(a) as a0, avg(b) as b0, avg(d) as d0 from s2 where t < 61 union all select 'first', 2, a, b, d from s2 where t = 0 union all select 'last', 3, a, b, d from s2 where t = 60 union all select 'diagonal', 4, avg(a), 0, avg(d) from s2 where t < 61),
 di as (select reference, place, avg(greatest(a0 + d0 + a + d - 2*sqrt(a0*a + 2*b0*b + d0*d + 2*sqrt((a0*d0 - b0*b0)*(a*d - b*b))), 0)) as loss from ca cross join s2 where t >= 61 and t < 87 group by all)
 select origin::int as origin, reference, round(loss, 5) as loss from (select 0 as origin, *, row_number() over (order by round(loss, 9), place) as r from di) where r = 1""",
        "e",
        "s2",
    ).replace("\n, ca", ",\nca", 1)
)
def reference_choice(spark, sf_dir):
    """Of four candidate reference covariances the one nearest to the validation states; the first of equal ones."""
    s2 = v.S2(spark, sf_dir)
    cell = lambda i: F.get("cov", F.lit(i))
    mean = s2.filter("t < 61").agg(*(F.avg(cell(i)).alias(f"c{i}") for i in range(4)))
    rows = [
        mean.select(F.lit("mean").alias("reference"), F.lit(1).alias("place"), F.array("c0", "c1", "c2", "c3").alias("ref")),
        s2.filter("t = 0").select(F.lit("first"), F.lit(2), "cov"),
        s2.filter("t = 60").select(F.lit("last"), F.lit(3), "cov"),
        mean.select(F.lit("diagonal"), F.lit(4), F.array("c0", F.lit(0.0), F.lit(0.0), "c3")),
    ]
    candidates = rows[0].union(rows[1]).union(rows[2]).union(rows[3])
    both = s2.filter("t >= 61 and t < 87").crossJoin(F.broadcast(candidates))
    scores = both.withColumn("bures", scoring.geometry(2).bures("ref", "cov")).groupBy("reference", "place").agg(F.avg("bures").alias("loss"))
    return scoring.best(scores.withColumn("origin", F.lit(0)), ["origin"], "loss", ["place"]).select("origin", "reference", rounded("loss", 5).alias("loss"))


_B = "greatest(a1 + d1 + a2 + d2 - 2*sqrt(a1*a2 + 2*b1*b2 + d1*d2 + 2*sqrt((a1*d1 - b1*b1)*(a2*d2 - b2*b2))), 0)"


@query(sql(f"select round(median(m + c), 5) as median_w2, round(sum(c) / greatest(sum(m + c), 1e-12), 6) as covariance_share from (select pow(m1 - n1, 2) + pow(m2 - n2, 2) as m, {_B} as c from adj)", "e", "s2", "adj"))
def adjacent_decomposition(spark, sf_dir):
    out = scoring.adjacent_decomposition(states.adjacent(v.S2(spark, sf_dir)), 2)
    return out.select(rounded("median_w2", 5).alias("median_w2"), rounded("covariance_share").alias("covariance_share"))


@query()
def reference_shift(spark, sf_dir):
    """Distance of the barycenters of the first and the second half, over the median adjacent distance."""
    s2 = v.S2(spark, sf_dir)
    halves = references.group_references(s2.withColumn("half", F.when(F.col("t") < v.STATES // 2, "early").otherwise("late")), ["half"])
    wide = halves.groupBy().pivot("half", ["early", "late"]).agg(F.first("ref_cov"))
    step = scoring.adjacent_decomposition(states.adjacent(s2), 2)
    return wide.crossJoin(F.broadcast(step)).select((scoring.geometry(2).bures("early", "late") / F.greatest("median_w2", F.lit(1e-12))).alias("shift"), "median_w2", "covariance_share")


@query(
    "with recursive "
    + v.SQL["e"]
    + ",\n"
    + v.SQL["s2"]
    + """,
 cv as (select covar_samp(a, a) as aa, covar_samp(a, b) as ab, covar_samp(a, d) as ad, covar_samp(b, b) as bb, covar_samp(b, d) as bd, covar_samp(d, d) as dd from s2),
 pc as (select 0 as n, 1.0::double as x, 0.5::double as y, 0.9::double as w union all
  select n + 1, (aa*x + ab*y + ad*w)/s, (ab*x + bb*y + bd*w)/s, (ad*x + bd*y + dd*w)/s from (select pc.*, cv.*, sqrt(pow(aa*x + ab*y + ad*w, 2) + pow(ab*x + bb*y + bd*w, 2) + pow(ad*x + bd*y + dd*w, 2)) as s from pc, cv) where n < 2000),
 sc as (select t, a*x + b*y + d*w as y from s2, pc where n = 2000)
 select round(corr(p.y, q.y), 5) as lag_one from sc p join sc q on q.t = p.t + 1"""
)
def covariance_pc_lag1(spark, sf_dir):
    return scoring.component_lag_one(v.S2(spark, sf_dir), 2).select(rounded("lag_one", 5).alias("lag_one"))


# ---- the strict matrix layer (LA-8, LA-18, LA-19)


@query(sql("select t, round(f*pa, 5) as m0, round(f*pb, 5) + 0.0::double as m1, round(f*pd, 5) as m3 from tr", "e", "s2", "adj", "tr"))
def strict_transport_d2(spark, sf_dir):
    m = states.adjacent(v.S2(spark, sf_dir)).select("t", la.call("strict_transport", "before_cov", "cov").alias("m"))
    return m.select("t", *(rounded(F.get("m", F.lit(i)), 5).alias(f"m{i}") for i in (0, 1, 3)))


@query(sql("select t, round(p + q*a, 6) + 0.0::double as m0, round(q*b, 6) + 0.0::double as m1, round(p + q*d, 6) + 0.0::double as m3 from (select *, sqrt(l1) - q*l1 as p from (select *, (sqrt(l2) - sqrt(l1)) / (l2 - l1) as q from eig))", "e", "s2", "eig"))
def prepared_roots_d2(spark, sf_dir):
    m = v.S2(spark, sf_dir).select("t", la.call("strict_root", "cov").alias("m"))
    return m.select("t", *(rounded(F.get("m", F.lit(i))).alias(f"m{i}") for i in (0, 1, 3)))


@query(sql("select t, round(a - s + greatest(s - l1, 0), 6) + 0.0::double as m0, round(b, 6) + 0.0::double as m1, round(d - s + greatest(s - l1, 0), 6) + 0.0::double as m3 from (select *, l1 * (t % 2) * 0.5 as s from eig)", "e", "s2", "eig"))
def resolved_covariances_d2(spark, sf_dir):
    """Covariances moved towards singularity by half their smallest eigenvalue at odd steps; well above the floor nothing is lifted."""
    from gausstide.functions import closed_forms as cf

    s = cf.smallest_eigenvalue("cov") * (F.col("t") % 2) * 0.5
    moved = F.transform("cov", lambda x, i: x - F.when((i == 0) | (i == 3), s).otherwise(0.0))
    m = v.S2(spark, sf_dir).withColumn("cov", moved).select("t", la.call("resolved", "cov").alias("m"))
    return m.select("t", *(rounded(F.get("m", F.lit(i))).alias(f"m{i}") for i in (0, 1, 3)))


# ---- tables (AGG-6, 8, 18, PRJ-8, 10, 12, 13, SNK-7, 8, 9, 14, 15, REP-1, 2, EVAL-14, VAL-6, 10, INF-2, 5)


def _loss_rows(spark, sf_dir):
    o = v.read(spark, sf_dir, "orders")
    return o.groupBy((F.year("o_orderdate") - 1995).alias("origin"), F.month("o_orderdate").alias("target_index"), F.col("o_orderpriority").alias("method"), F.col("o_orderstatus").alias("regime")).agg(F.avg(F.floor("o_totalprice")).alias("loss"), F.sum((F.col("o_totalprice") > 400_000).cast("int")).cast("double").alias("repairs"))


_LR = "with lr as (select (year(o_orderdate) - 1995)::int as origin, month(o_orderdate)::int as target_index, o_orderpriority as method, o_orderstatus as regime, avg(floor(o_totalprice)) as loss, sum((o_totalprice > 400000)::int)::double as repairs from orders group by all) "
_GS = ["loss_mean", "loss_se", "loss_ci_low", "loss_ci_high", "repair_rate"]


@query(_LR + f"select regime, method, n_replications::bigint as n_replications, {_sql_digits(_GS, 5)} from (select *, loss_mean - 1.96*loss_se as loss_ci_low, loss_mean + 1.96*loss_se as loss_ci_high from (select regime, method, count(distinct origin) as n_replications, avg(loss) as loss_mean, case when count(*) > 1 then stddev_samp(loss)/sqrt(count(*)) end as loss_se, avg((repairs > 0)::int) as repair_rate from lr group by all))")
def group_summary(spark, sf_dir):
    out = reporting.group_summary(_loss_rows(spark, sf_dir), ["regime", "method"], ["loss"], "origin", "repairs")
    return _digits(out, _GS, 5)


@query("select l_returnflag as flag, min_by(l_shipdate, l_orderkey * 10 + l_linenumber)::varchar as label from lineitem where l_shipdate is not null group by all")
def group_labels(spark, sf_dir):
    rows = v.read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_shipdate").cast("string").alias("label"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return reporting.group_labels(rows, ["flag"], "label", "at")


@query("select * from (values ('1-URGENT', 1), ('3-MEDIUM', 2)) x(method, place) where method in (select o_orderpriority from orders where o_totalprice is not null)")
def available_methods(spark, sf_dir):
    rows = _loss_rows(spark, sf_dir)
    return reporting.available_methods(rows, ["1-URGENT", "3-MEDIUM", "none"], "loss")


@query(_LR + "select origin, target_index, method, selected_reference, round(loss, 4) as loss, 'priorities' as dataset_label from (select origin, target_index, regime, case when method = '1-URGENT' then 'target' else method end as method, case when regime = 'F' then 'barycenter' else 'mean' end as selected_reference, loss from lr where not starts_with(method, '1-') or regime = 'F')")
def normalised_methods(spark, sf_dir):
    rows = _loss_rows(spark, sf_dir).select("origin", "target_index", "method", F.when(F.col("regime") == "F", "barycenter").otherwise("mean").alias("selected_reference"), "loss")
    refs = rows.filter("method = '5-LOW'").select("origin", "target_index", F.lit("barycenter").alias("reference"), "loss")
    return _digits(reporting.normalised_methods(rows, refs, "1-", "1-URGENT", "barycenter", "target", "priorities"), ["loss"], 4)


@query("select origin::int as origin, fit_end::int as fit_end, 2 as dimension, 2 as dimension_arg, 175 as n_matrices, 3 as h0, 5 as q_dimension from (values (0,61),(1,85),(2,109),(3,133)) x(origin, fit_end)")
def run_metadata(spark, sf_dir):
    return reporting.run_metadata(splits.split_table(spark, v.SPLITS).select("origin", "fit_end"), 2, v.STATES, 3)


_CELLS = _LR + ", su as (select regime, method, avg(loss) as mean, case when count(*) > 1 then stddev_samp(loss)/sqrt(count(*)) end as se from lr group by all), ce as (select *, abs(mean - min(mean) over (partition by regime)) <= 1e-9*abs(min(mean) over (partition by regime)) + 1e-12 as best, printf('%.1f', round(mean, 1)) || coalesce(printf(' (%.1f)', round(se, 1)), '') as cell from su) "


def _cells(spark, sf_dir):
    out = _loss_rows(spark, sf_dir).groupBy("regime", "method").agg(F.avg("loss").alias("mean"), F.when(F.count("*") > 1, F.stddev_samp("loss") / F.sqrt(F.count("*"))).alias("se"))
    return reporting.mean_cells(out, ["regime"], "mean", "se", 1)


@query(_CELLS.replace(") , su", "), su") + "select regime, method, cell, best from ce")
def mean_error_cells(spark, sf_dir):
    return _cells(spark, sf_dir).select("regime", "method", "cell", "best")


@query(_CELLS.replace(") , su", "), su") + "select regime, " + ", ".join(f"max(case when method = '{m}' then case when best then '*' || cell || '*' else cell end end) as {n}" for m, n in (("1-URGENT", "urgent"), ("3-MEDIUM", "medium"), ("5-LOW", "low"))) + " from ce group by regime")
def method_table(spark, sf_dir):
    wide = reporting.method_table(_cells(spark, sf_dir), ["regime"], ["1-URGENT", "3-MEDIUM", "5-LOW"])
    return wide.withColumnsRenamed({"1-URGENT": "urgent", "3-MEDIUM": "medium", "5-LOW": "low"})


def _starts(spark):
    return spark.range(v.STATES).select(F.col("id").cast("int").alias("t"), (F.lit("2024-01-01").cast("timestamp") + F.make_interval(hours=F.col("id").cast("int") * v.STEP)).alias("start"))


_AT = "timestamp '2024-01-01' + to_hours(({})::int * 4)"


@query(sql(f"select origin::int as origin, fit_end::int as fit_end, val_end::int as val_end, test_end::int as test_end, {_AT.format('fit_end - 1')} as fit_last, {_AT.format('fit_end')} as val_first, {_AT.format('val_end')} as test_first, {_AT.format('test_end - 1')} as test_last from sp", "sp"))
def split_boundaries(spark, sf_dir):
    return reporting.split_boundaries(v.split_rows(spark, sf_dir), _starts(spark))


@query(sql(f"select origin::int as origin, horizon::int as horizon, source::int as source, (source + horizon)::int as target, {_AT.format('source')} as source_start, {_AT.format('source + horizon')} as target_start from src", "sp", "src"))
def source_times(spark, sf_dir):
    return reporting.source_times(splits.test_sources(v.split_rows(spark, sf_dir), HORIZONS), _starts(spark))


@query("select * from (values ('fit', 0, 104, 105), ('validation', 105, 139, 35), ('test', 140, 174, 35)) x(part, first, last, n)")
def partition_rows(spark, sf_dir):
    return reporting.partition_rows(v.state_count(spark, sf_dir).first().n, FIT, VAL, spark)


_PROFILE = ["valid_share", "median", "center", "scale", "raw_scale"]


@query(sql(f"select panel::int as panel, rank::int as rank, k, {_sql_digits(_PROFILE)} from (select panel, rank, k, avg((c > 0)::int) as valid_share, median(case when c > 0 then c end) as median, avg(f) as center, stddev_samp(f) as scale, stddev_samp(case when c > 0 then c end) as raw_scale from (select e.*, case when c > 0 then c else median(case when c > 0 then c end) over (partition by k) end as f from e where i < 432) join (values (1, 1, 'click'), (1, 2, 'view'), (2, 1, 'purchase'), (2, 2, 'signup')) p(panel, rank, k) using (k) group by all)", "e"))
def sensor_profile(spark, sf_dir):
    panels = spark.createDataFrame([(p, r + 1, k) for p, keys in v.PANELS.items() for r, k in enumerate(keys)], "panel int, rank int, k string")
    return _digits(reporting.sensor_profile(v.E(spark, sf_dir), panels, 432), _PROFILE)


@query(sql("select i, k, round((c - m)/s, 6) + 0.0::double as c from e join (select k, avg(c) as m, case when stddev_pop(c) >= 1e-8 then stddev_pop(c) else 1 end as s from e where i < 324 group by k) using (k)", "e"))
def block_standardised(spark, sf_dir):
    return _digits(reporting.block_standardised(v.E(spark, sf_dir), v.WINDOW), ["c"])


def _snapshot(spark, sf_dir):
    s2 = v.S2(spark, sf_dir).filter("t in (60, 61)").select(F.concat(F.lit("state_"), F.col("t").cast("string")).alias("method"), "mean", "cov")
    profile = grid.fit_profile(v.E2(spark, sf_dir), 264)
    return reporting.forecast_snapshot(s2, profile)


@query(sql("select 'state_' || t as method, rank::int as rank, k, round(m*scale + center, 6) + 0.0::double as mean from (select t, unnest([1,2]) as rank, unnest(['click','view']) as k, unnest([mx,my]) as m from s2 where t in (60,61)) join (select k, avg(c) as center, case when stddev_pop(c) >= 1e-8 then stddev_pop(c) else 1 end as scale from e where i < 264 group by k) using (k)", "e", "s2"))
def snapshot_means(spark, sf_dir):
    return _digits(_snapshot(spark, sf_dir)[0], ["mean"])


@query(sql("select 'state_' || t as method, unnest([0,0,1,1])::int as row, unnest([0,1,0,1])::int as col, unnest([1.0, round(b/sqrt(a*d), 6), round(b/sqrt(a*d), 6), 1.0])::double + 0.0::double as correlation from s2 where t in (60,61)", "e", "s2"))
def snapshot_correlations(spark, sf_dir):
    return _digits(_snapshot(spark, sf_dir)[1], ["correlation"])


@query(_LR + "select origin, target_index, method, regime, repairs from lr")
def without_column(spark, sf_dir):
    """A results table without the loss that is not to be published."""
    return _loss_rows(spark, sf_dir).drop("loss")


@query(_LR + "select distinct origin, regime from lr")
def distinct_records(spark, sf_dir):
    return _loss_rows(spark, sf_dir).select("origin", "regime").dropDuplicates()


@query(_LR + "select origin, target_index, method, regime, round(loss, 4) as loss from lr where origin = 2 and target_index = 3 and method = '1-URGENT' and regime = 'F'")
def fixed_row(spark, sf_dir):
    return _digits(reporting.exactly_one(_loss_rows(spark, sf_dir), origin=2, target_index=3, method="1-URGENT", regime="F").drop("repairs"), ["loss"], 4)


@query(_LR + "select 'differs: loss' as problem, count(*)::bigint as n from lr where origin = 1 having count(*) > 0 union all select 'only there', count(*) from lr where origin = 0 having count(*) > 0")
def table_differences(spark, sf_dir):
    """A package without the first origin and with another loss in the second, against its reference."""
    rows = _loss_rows(spark, sf_dir)
    own = rows.filter("origin > 0").withColumn("loss", F.when(F.col("origin") == 1, F.col("loss") * 1.5).otherwise(F.col("loss")))
    return reporting.table_differences(own, rows, ["origin", "target_index", "method", "regime"], ["loss", "repairs"])


@query(_LR + "select origin, target_index, method, regime, round(loss, 4) as computed, round(floor(loss), 4) as displayed, round(loss - floor(loss), 4) as gap from lr where loss - floor(loss) > 0.0011")
def displayed_differences(spark, sf_dir):
    rows = _loss_rows(spark, sf_dir)
    out = reporting.displayed_differences(rows, rows.withColumn("loss", F.floor("loss").cast("double")), ["origin", "target_index", "method", "regime"], "loss")
    return _digits(out, ["computed", "displayed", "gap"], 4)


@query("select 'block' as name, '3' as value union all select 'draws', '10000' union all select 'orders.rows', count(*)::varchar from orders union all select 'orders.columns', (select string_agg(column_name, ',' order by column_index) from duckdb_columns() where table_name = 'orders')")
def protocol(spark, sf_dir):
    return reporting.protocol({"block": 3, "draws": 10_000}, {"orders": v.read(spark, sf_dir, "orders")})


_METHOD_ROWS = "with lt as (select (year(o_orderdate) - 1995)::int as origin, month(o_orderdate)::int as target_index, o_orderpriority as method, avg(floor(o_totalprice)) as loss from orders group by all), "
_BLOCKS = """nb as (select *, least(n, 3) as size from (select method, origin, loss as v, row_number() over (partition by method, origin order by target_index) - 1 as i, count(*) over (partition by method, origin) as n from lt)),
 bs as (select method, origin, i - j as start, sum(v) as whole, sum(case when j < (n - 1) % size + 1 then v end) as cut from nb cross join (select unnest(range(3)) as j) where j < size and i - j >= 0 and i - j <= n - size group by all),
 dr as (select method, origin, n, r, b, ('0x' || substr(md5('20260714:' || method || ':' || origin || ':' || r || ':' || b), 1, 8))::bigint % (n - size + 1) as start, b = ceil(n / size) as final from (select distinct method, origin, n, size from nb) cross join (select unnest(range(1, 10001)) as r) cross join (select unnest(range(1, 5)) as b) where b <= ceil(n / size)),
 mm as (select method, r, sum(case when final then cut else whole end) as total from dr join bs using (method, origin, start) group by all),
 gm as (select method, avg(loss) as mean, count(*) as n from lt group by method),
 iv as (select method, stddev_samp(total / n) as se, quantile_cont(total / n, 0.025) as low, quantile_cont(total / n, 0.975) as high from mm join gm using (method) group by method) """


@query(_METHOD_ROWS + _BLOCKS + f"select method, {_sql_digits(_INTERVAL, 3)}, n::bigint as n from gm join iv using (method)")
def origin_block_intervals(spark, sf_dir):
    """Method-level means with the error and interval of the origin-preserving moving-block bootstrap, 10,000 replicates in parallel."""
    o = v.read(spark, sf_dir, "orders")
    rows = o.groupBy((F.year("o_orderdate") - 1995).alias("origin"), F.month("o_orderdate").alias("target_index"), F.col("o_orderpriority").alias("method")).agg(F.avg(F.floor("o_totalprice")).alias("loss"))
    return _digits(inference.block_intervals_at_scale(rows, ["method"], "loss"), _INTERVAL, 3)
