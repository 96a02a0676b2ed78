"""Operator 5: URL filters as of the time of the fetch.

Dated list entries (add or remove a host pattern) become validity intervals per list and pattern. Patterns are resolved
once per distinct host (the host itself and its parent domains) into one row with all its intervals; captures join that
row by host, and the as-of test is a filter inside the row. The join is one row to one, however many intervals a host
has, and a host with a third of all captures is an ordinary skewed join key that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gausstide.llm.common import broadcast_if_small, stage, table

DAY_ZERO = "2024-01-01"
CATEGORIES = ["adult", "gambling", "spam"]


def host_of(url: Column) -> Column:
    """The lower-cased host of an absolute URL without user, port and final dot; null for anything else."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    return F.when(found != "", F.regexp_replace(found, r"\.$", ""))


def parents(host: Column) -> Column:
    """A host and its parent domains, the host first: a.b.c, b.c, c."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """(category, pattern, valid_from, valid_to) from dated entries (category, pattern, action, since).

    An entry holds from its day to the day before the next entry of its list and pattern; valid_to is exclusive, null if
    open. Of several entries of a day "remove" counts. Entries with a null in any column are left out; repeated ones
    count once.
    """
    dated = entries.dropna(subset=["category", "pattern", "action", "since"]).groupBy("category", F.lower("pattern").alias("pattern"), "since").agg(F.max("action").alias("action"))
    following = F.lead("since").over(W.partitionBy("category", "pattern").orderBy("since"))
    return dated.withColumn("valid_to", following).filter("action = 'add'").select("category", "pattern", F.col("since").alias("valid_from"), "valid_to")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(page_id, host, fetched, blocked, pattern, category, n_active) of every capture (page_id, url, fetched).

    blocked: an entry for the host or a parent domain was valid on the day of the fetch; pattern and category are those
    of the most specific valid entry, ties by name. Captures without a host or day are not blocked; each repeated
    capture is evaluated; an empty list blocks nothing; extra columns are ignored.
    """
    captures = captures.select("page_id", host_of(F.col("url")).alias("host"), "fetched")
    hosts = captures.filter("host is not null").select("host").distinct().select("host", F.explode(parents(F.col("host"))).alias("pattern"))
    entry = F.struct(-F.length("pattern"), "pattern", "category", "valid_from", "valid_to")
    resolved = stage(hosts.join(intervals(entries), "pattern").groupBy("host").agg(F.array_sort(F.collect_list(entry)).alias("entries")), "host-entries")
    valid = F.filter("entries", lambda e: (e["valid_from"] <= F.col("fetched")) & (e["valid_to"].isNull() | (F.col("fetched") < e["valid_to"])))
    both = captures.join(broadcast_if_small(resolved), "host", "left").withColumn("active", F.coalesce(valid, F.array().cast(resolved.schema["entries"].dataType)))
    top = F.get("active", F.lit(0))
    return both.select("page_id", "host", "fetched", (F.size("active") > 0).alias("blocked"), top["pattern"].alias("pattern"), top["category"].alias("category"), F.size("active").cast("long").alias("n_active"))


def example_entries(pages: DataFrame) -> DataFrame:
    """A dated list for tables that have none, made by rule from the MD5 of each host: half of the hosts, or their parents, are added on a day of 2024 and removed 10 to 99 days later."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).filter("host is not null").distinct()
    byte = lambda i: F.conv(F.substring(F.md5(F.col("host").cast("binary")), i, 2), 16, 10).cast("int")
    rows = hosts.select("host", byte(1).alias("a"), byte(3).alias("b"), byte(5).alias("c"), byte(7).alias("d")).filter("a % 4 < 2")
    pattern = F.when(F.col("a") % 4 == 0, F.col("host")).otherwise(F.regexp_replace("host", r"^[^.]*\.", ""))
    category = F.element_at(F.array(*map(F.lit, CATEGORIES)), F.col("d") % 3 + 1)
    acts = F.array(F.struct(F.lit("add").alias("action"), F.col("b").alias("day")), F.struct(F.lit("remove").alias("action"), (F.col("b") + 10 + F.col("c") % 90).alias("day")))
    rows = rows.select(category.alias("category"), pattern.alias("pattern"), F.explode(acts).alias("x"))
    return rows.select("category", "pattern", "x.action", F.date_add(F.lit(DAY_ZERO).cast("date"), F.col("x.day")).alias("since"))


def query(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.date_add(F.lit(DAY_ZERO).cast("date"), (F.col("page_id") * 7919 % 366).cast("int")))
    return evaluate(captures, example_entries(pages)).withColumn("fetched", F.col("fetched").cast("string"))


SQL = r"""
with pages2 as (select page_id, date '2024-01-01' + (page_id * 7919 % 366)::int as fetched,
  nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1), '\.$', ''), '') as host from pages),
hosts as (select distinct host, md5(host) as m from pages2 where host is not null),
bytes as (select host, ('0x' || substr(m, 1, 2))::int as a, ('0x' || substr(m, 3, 2))::int as b, ('0x' || substr(m, 5, 2))::int as c, ('0x' || substr(m, 7, 2))::int as d from hosts),
rules as (select case when a % 4 = 0 then host else regexp_replace(host, '^[^.]*\.', '') end as pattern,
  ['adult', 'gambling', 'spam'][d % 3 + 1] as category, b, c from bytes where a % 4 < 2),
entries as (select category, pattern, 'add' as action, date '2024-01-01' + b as since from rules
  union all select category, pattern, 'remove', date '2024-01-01' + (b + 10 + c % 90) from rules),
dated as (select category, pattern, since, max(action) as action from entries group by all),
spans as (select * from (select *, lead(since) over (partition by category, pattern order by since) as until from dated) where action = 'add'),
active as (select page_id, pattern, category, row_number() over (partition by page_id order by length(pattern) desc, pattern, category) as k, count(*) over (partition by page_id) as n
  from pages2 join spans on (host = pattern or ends_with(host, '.' || pattern)) and since <= fetched and (until is null or fetched < until))
select p.page_id, host, fetched::varchar as fetched, k is not null as blocked, pattern, category, coalesce(n, 0)::bigint as n_active
from pages2 p left join active a on p.page_id = a.page_id and k = 1
"""
