"""The driver's tables as inputs of the engine, and the same views as SQL.

E: hourly event counts by type (720 hours). E2: click and view only. S2: states of E2, 24 h windows, 4 h step (175).
O: daily order counts by priority (2,405 days). B: 7-day blocks of O (343). L: daily line counts by supplier, the first
600 days, as its SQL has it; L_all: from the first to the last ship day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gausstide.operators import grid, states
from gausstide.operators.splits import split_table

HOURS, DAYS, WINDOW, STEP, STATES = 720, 2405, 24, 4, 175
SPLITS = [(0, 61, 87, 111), (1, 85, 111, 135), (2, 109, 135, 159), (3, 133, 159, 175)]
RIDGE = 1e-5


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.counts(read(spark, sf_dir, "events"), "ts", "event_type")


def E(spark: SparkSession, sf_dir: str) -> DataFrame:  # noqa: N802
    return grid.filled_grid(events_hourly(spark, sf_dir), "2024-01-01 00:00:00", HOURS)


def E2(spark: SparkSession, sf_dir: str) -> DataFrame:  # noqa: N802
    return E(spark, sf_dir).filter(F.col("k").isin("click", "view"))


def S2(spark: SparkSession, sf_dir: str) -> DataFrame:  # noqa: N802
    return states.hopping_states(E2(spark, sf_dir), WINDOW, STEP, HOURS, RIDGE)


def state_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n): how many states the events give."""
    return S2(spark, sf_dir).agg(F.count("*").cast("int").alias("n"))


def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The splits that the states at hand can fill."""
    return split_table(spark, SPLITS).join(F.broadcast(state_count(spark, sf_dir)), F.col("test_end") <= F.col("n")).drop("n")


PANELS = {1: ("click", "view"), 2: ("purchase", "signup")}


def _panel_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E with the panel of each type."""
    panel = F.coalesce(*(F.when(F.col("k").isin(*keys), F.lit(p)) for p, keys in PANELS.items()))
    return E(spark, sf_dir).withColumn("panel", panel).filter("panel is not null")


def P(spark: SparkSession, sf_dir: str) -> DataFrame:  # noqa: N802
    """States of two panels of two types each, in one plan."""
    return states.hopping_states(_panel_grid(spark, sf_dir), WINDOW, STEP, HOURS, RIDGE, by=["panel"])


def PX(spark: SparkSession, sf_dir: str) -> DataFrame:  # noqa: N802
    """(panel, i, x): the raw vectors of the panels."""
    return states.vectors(_panel_grid(spark, sf_dir), ["panel"])


def S(spark: SparkSession, sf_dir: str) -> DataFrame:  # noqa: N802
    """All five types, standardised by the first fit block, so that d = 5 covariances are well conditioned."""
    e = E(spark, sf_dir)
    return states.hopping_states(grid.standardised(e, grid.fit_profile(e, 264)), WINDOW, STEP, HOURS, RIDGE)


def O(spark: SparkSession, sf_dir: str) -> DataFrame:  # noqa: E743, N802
    daily = grid.counts(read(spark, sf_dir, "orders"), "o_orderdate", "o_orderpriority", "day")
    return grid.filled_grid(daily, "1995-01-01 00:00:00", DAYS, "day")


def L(spark: SparkSession, sf_dir: str) -> DataFrame:  # noqa: N802
    daily = grid.counts(read(spark, sf_dir, "lineitem"), "l_shipdate", "l_suppkey", "day")
    return grid.filled_grid(daily, "1995-01-02 00:00:00", 600, "day")


def L_all(spark: SparkSession, sf_dir: str) -> DataFrame:  # noqa: N802
    daily = grid.counts(read(spark, sf_dir, "lineitem"), "l_shipdate", "l_suppkey", "day")
    first, days = daily.agg(F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss"), F.datediff(F.max("ts"), F.min("ts")) + 1).first()
    return grid.filled_grid(daily, first or "1995-01-02 00:00:00", days or 0, "day")


SQL = {
    "e": """hrs as (select (date_part('epoch', date_trunc('hour', ts::timestamp)) - date_part('epoch', timestamp '2024-01-01'))::bigint // 3600 as i, event_type as k, count(*) as n
      from events where ts is not null and event_type is not null group by all),
    e as (select g.i::int as i, ks.k, coalesce(n, 0)::double as c from (select unnest(range(720)) as i) g cross join (select distinct k from hrs) ks left join hrs using (i, k))""",
    "o": """dys as (select date_diff('day', date '1995-01-01', o_orderdate::date) as i, o_orderpriority as k, count(*) as n from orders group by all),
    o as (select g.i::int as i, ks.k, coalesce(n, 0)::double as c from (select unnest(range(2405)) as i) g cross join (select distinct k from dys) ks left join dys using (i, k))""",
    "l": """ldy as (select date_diff('day', date '1995-01-02', l_shipdate::date) as i, l_suppkey::varchar as k, count(*) as n from lineitem group by all),
    l as (select g.i::int as i, ks.k, coalesce(n, 0)::double as c from (select unnest(range(600)) as i) g cross join (select distinct k from ldy) ks left join ldy using (i, k))""",
    "l_all": """ldy as (select l_shipdate::date as day, l_suppkey::varchar as k, count(*) as n from lineitem where l_shipdate is not null and l_suppkey is not null group by all),
    lsp as (select min(day) as a, max(day) as b from ldy), ldi as (select date_diff('day', a, day) as i, k, n from ldy cross join lsp),
    l as (select g.i::int as i, ks.k, coalesce(n, 0)::double as c from (select unnest(range(date_diff('day', a, b) + 1)) as i from lsp) g cross join (select distinct k from ldi) ks left join ldi using (i, k))""",
    "s2": """v as (select i, max(case when k = 'click' then c end) as x, max(case when k = 'view' then c end) as y from e group by i),
    w as (select t::int as t, x, y from (select unnest(range(175)) as t) join v on i >= 4 * t and i < 4 * t + 24),
    s2 as (select t, avg(x) as mx, avg(y) as my, (sum(x*x) - sum(x)*sum(x)/24)/23 + 1e-5 as a, (sum(x*y) - sum(x)*sum(y)/24)/23 as b, (sum(y*y) - sum(y)*sum(y)/24)/23 + 1e-5 as d from w group by t)""",
    "ps": """pv as (select panel, i, max(case when k = k1 then c end) as x, max(case when k = k2 then c end) as y from e join (values (1, 'click', 'view'), (2, 'purchase', 'signup')) pk(panel, k1, k2) on k in (k1, k2) group by panel, i),
    pw as (select panel, t::int as t, x, y from (select unnest(range(175)) as t) join pv on i >= 4 * t and i < 4 * t + 24),
    ps as (select panel, t, avg(x) as mx, avg(y) as my, (sum(x*x) - sum(x)*sum(x)/24)/23 + 1e-5 as a, (sum(x*y) - sum(x)*sum(y)/24)/23 as b, (sum(y*y) - sum(y)*sum(y)/24)/23 + 1e-5 as d from pw group by panel, t)""",
    "sp": "sp as (select * from (values (0,61,87,111),(1,85,111,135),(2,109,135,159),(3,133,159,175)) x(origin, fit_end, val_end, test_end))",
    "src": """src as (select origin, horizon, unnest(range(val_end - horizon, test_end - horizon))::int as source from sp, (select unnest([3,4,5]) as horizon))""",
    "adj": """adj as (select q.t, p.mx as m1, p.my as m2, p.a as a1, p.b as b1, p.d as d1, q.mx as n1, q.my as n2, q.a as a2, q.b as b2, q.d as d2 from s2 p join s2 q on q.t = p.t + 1)""",
    "tr": """tr0 as (select *, sqrt(a1*d1 - b1*b1) as det1, sqrt(a2*d2 - b2*b2) as det2 from adj),
    tr1 as (select *, 1/det1 as al, d1/(det1*det1)/(1/det1) + a2/det2 as pa, -b1/(det1*det1)/(1/det1) + b2/det2 as pb, a1/(det1*det1)/(1/det1) + d2/det2 as pd from tr0),
    tr as (select *, sqrt(al*det2)/sqrt(pa*pd - pb*pb) as f from tr1)""",
    "eig": """eig0 as (select *, (a + d)/2 as h, sqrt(pow((a - d)/2, 2) + b*b) as g from s2), eig as (select *, h - g as l1, h + g as l2 from eig0)""",
}


def rounded(c, digits: int = 6):
    """Rounded, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def sql(body: str, *parts: str) -> str:
    return "with " + ",\n".join(SQL[p] for p in parts) + "\n" + body
