"""Operator 9: mixing sources to target weights through a tree of domains, languages and sources.

Budgets run from the root down. At each node the budget is shared among its children by weight; a child cannot take more
than its tokens times the epochs allowed, and what it cannot take goes to its siblings with room, by weight. A node is
never given more than its whole subtree can take, so a shortage is met among siblings first and reaches an ancestor's
siblings only when all of them are full. A leaf takes whole epochs, and of the last epoch the token-prefix of its
documents in an order seeded by leaf epoch. Budgets are windows over the table of nodes; the prefix is a distributed
running sum: every leaf is cut into buckets of about 2,000 documents by the seeded hash, so a leaf that holds a third of
all rows is no single task. DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gausstide.llm.common import BLANKS, broadcast_if_small, free, stage, table, text_key

LEVELS = ["domain", "lang", "source"]
BUCKET_ROWS = 2_000
SEED = 20240101


def token_count(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.coalesce(F.size(F.filter(F.split(text, f"[{BLANKS}]+"), lambda w: w != "")), F.lit(0)).cast("long")


def with_domain(docs: DataFrame, domains: int = 4) -> DataFrame:
    """Adds a domain to tables that have none: sources are dealt to ``domains`` by the first byte of their MD5."""
    byte = F.conv(F.substring(F.md5(F.coalesce("source", F.lit("")).cast("binary")), 1, 2), 16, 10).cast("int")
    return docs.withColumn("domain", F.concat(F.lit("d"), (byte % domains).cast("string")))


def node_budgets(leaves: DataFrame, total: Column, max_epochs: float, temperature: float, weights: dict[tuple, float] | None = None, levels: list[str] | None = None) -> DataFrame:
    """``leaves`` (levels, tokens, rows) with ``budget``: tokens given to each leaf.

    A node's weight is that in ``weights`` under the tuple of its level values, else its tokens to the power of
    ``temperature``. Weights that are null or not above 0 are an error.
    """
    levels = levels or LEVELS
    if any(value is None or not value > 0 for value in (weights or {}).values()):
        raise ValueError("weights must be above 0")
    parent = leaves.agg(F.least(total.cast("double"), F.sum("tokens") * F.lit(float(max_epochs))).alias("parent_budget"))
    for d in range(1, len(levels) + 1):
        path = levels[:d]
        nodes = leaves.groupBy(*path).agg(F.sum("tokens").cast("double").alias("tokens")).filter("tokens > 0")
        weight = F.pow("tokens", F.lit(float(temperature)))
        for key, value in (weights or {}).items():
            if len(key) == d:
                match = F.lit(True)
                for c, v in zip(path, key, strict=True):
                    match = match & F.col(c).eqNullSafe(F.lit(v))
                weight = F.when(match, F.lit(float(value))).otherwise(weight)
        nodes = nodes.withColumn("weight", weight).withColumn("cap", F.col("tokens") * float(max_epochs))
        nodes = nodes.crossJoin(F.broadcast(parent)) if d == 1 else nodes.join(parent, path[:-1])
        inside = W.partitionBy(*path[:-1]) if d > 1 else W.partitionBy(F.lit(1))
        before = inside.orderBy(F.col("cap") / F.col("weight"), path[-1]).rowsBetween(W.unboundedPreceding, -1)
        full = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
        used = F.coalesce(F.sum("weight").over(before), F.lit(0.0))
        # what one unit of weight gets if exactly the children before this one are full; its maximum is the true level
        nodes = nodes.withColumn("level", (F.col("parent_budget") - full) / (F.sum("weight").over(inside) - used))
        nodes = nodes.withColumn("top", F.max("level").over(inside))
        share = F.least(F.col("cap"), F.greatest(F.col("weight") * F.col("top"), F.lit(0.0)))
        parent = nodes.select(*path, share.alias("parent_budget"))
    return leaves.join(parent, levels, "left").withColumn("budget", F.floor(F.coalesce("parent_budget", F.lit(0.0)) + 1e-6).cast("long")).drop("parent_budget")


def mix(docs: DataFrame, budget_share: float = 1.0, max_epochs: float = 2.0, temperature: float = 0.8, weights: dict[tuple, float] | None = None, seed: int = SEED, levels: list[str] | None = None) -> DataFrame:
    """(doc_id, text_key, levels, n_tokens, copies): how often each document is taken (0: not at all).

    The total budget is ``budget_share`` of all tokens. In the last, partial epoch a document is taken if the tokens
    before it in the seeded order are fewer than what is left of the budget, so the prefix is the shortest that reaches
    it. Null level values are values of their own, under the empty string; documents without tokens come along where
    they stand in the prefix; repeated rows are rows of their own; an empty table gives no rows.
    """
    levels = levels or LEVELS
    rows = docs.select("doc_id", text_key().alias("text_key"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in levels), token_count(F.col("text")).alias("n_tokens"))
    rows = stage(rows, "leaf-rows")
    leaves = stage(rows.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")), "leaves")
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    given = node_budgets(leaves, F.lit(float(total) * budget_share), max_epochs, temperature, weights, levels)
    given = given.withColumn("full", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.greatest("tokens", F.lit(1)))).otherwise(F.lit(0)).cast("long"))
    given = stage(given.withColumn("rest", F.col("budget") - F.col("full") * F.col("tokens")), "leaf-budgets")
    small = broadcast_if_small(given.select(*levels, "rows", "full", "rest"))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = rows.join(small, levels).withColumn("order", order)
    spread = F.conv(F.substring("order", 1, 8), 16, 10).cast("double") / 4294967296.0
    rows = rows.withColumn("bucket", F.floor(spread * F.ceil(F.col("rows") / BUCKET_ROWS)).cast("long"))
    sums = rows.groupBy(*levels, "bucket").agg(F.sum("n_tokens").alias("own"))
    earlier = W.partitionBy(*levels).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*levels, "bucket", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("offset"))
    prior = W.partitionBy(*levels, "bucket").orderBy("order", "doc_id", "text_key").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("n_tokens").over(prior), F.lit(0))).join(broadcast_if_small(stage(sums, "bucket-offsets")), [*levels, "bucket"])
    copies = F.col("full") + (F.col("offset") + F.col("before") < F.col("rest")).cast("long")
    return rows.select("doc_id", "text_key", *levels, "n_tokens", copies.alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents taken, a row for each copy, all columns kept, whatever their names. Rows that repeat a document each get the largest of its counts."""
    columns, levels = docs.columns, options.get("levels") or LEVELS
    tree = with_domain(docs) if "domain" in levels and "domain" not in columns else docs
    taken = mix(tree, **options).groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_taken")).agg(F.max("copies").cast("int").alias("_copies")).filter("_copies > 0")
    _key, _id, _taken, _copies, _copy = free(columns, "_key", "_id", "_taken", "_copies", "_copy")
    taken = taken.toDF(_id, _taken, _copies)
    keyed = docs.withColumn(_key, text_key())
    both = keyed.join(taken, keyed["doc_id"].eqNullSafe(taken[_id]) & (keyed[_key] == taken[_taken]))
    return both.withColumn(_copy, F.explode(F.sequence(F.lit(1), F.col(_copies)))).select(*columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = with_domain(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return mix(docs).select("doc_id", *LEVELS, "n_tokens", "copies")


SQL = r"""
with docs as (
  select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source,
         'd' || (('0x' || substr(md5(coalesce(source, '')), 1, 2))::int % 4) as domain,
         coalesce(len(list_filter(string_split_regex(text, '[ \t\n\x0b\x0c\r]+'), lambda w: w <> '')), 0)::bigint as n_tokens
  from documents),
leaves as (select domain, lang, source, sum(n_tokens)::bigint as tokens from docs group by all),
n1 as (select domain, sum(tokens)::double as tokens, sum(tokens) * 2.0 as cap, pow(sum(tokens)::double, 0.8) as weight,
       (select sum(tokens)::double from leaves) as b from leaves group by all),
l1 as (select *, (b - coalesce(sum(cap) over w, 0)) / (sum(weight) over () - coalesce(sum(weight) over w, 0)) as level from n1
       window w as (order by cap / weight, domain rows between unbounded preceding and 1 preceding)),
b1 as (select domain, least(cap, greatest(weight * max(level) over (), 0)) as b from l1),
n2 as (select domain, lang, sum(tokens)::double as tokens, sum(tokens) * 2.0 as cap, pow(sum(tokens)::double, 0.8) as weight from leaves group by all),
l2 as (select n2.*, b, (b - coalesce(sum(cap) over w, 0)) / (sum(weight) over (partition by domain) - coalesce(sum(weight) over w, 0)) as level
       from n2 join b1 using (domain) window w as (partition by domain order by cap / weight, lang rows between unbounded preceding and 1 preceding)),
b2 as (select domain, lang, least(cap, greatest(weight * max(level) over (partition by domain), 0)) as b from l2),
n3 as (select domain, lang, source, tokens, tokens * 2.0 as cap, pow(tokens::double, 0.8) as weight from leaves where tokens > 0),
l3 as (select n3.*, b, (b - coalesce(sum(cap) over w, 0)) / (sum(weight) over (partition by domain, lang) - coalesce(sum(weight) over w, 0)) as level
       from n3 join b2 using (domain, lang) window w as (partition by domain, lang order by cap / weight, source rows between unbounded preceding and 1 preceding)),
b3 as (select domain, lang, source, floor(least(cap, greatest(weight * max(level) over (partition by domain, lang), 0)) + 1e-6)::bigint as budget from l3),
given as (select domain, lang, source, coalesce(floor(budget / greatest(tokens, 1)), 0)::bigint as f,
          coalesce(budget, 0) - coalesce(floor(budget / greatest(tokens, 1)), 0)::bigint * tokens as rest from leaves left join b3 using (domain, lang, source)),
ordered as (select d.*, f, rest, coalesce(sum(n_tokens) over (partition by domain, lang, source order by md5('20240101:' || f || ':' || coalesce(doc_id::varchar, '')), doc_id
            rows between unbounded preceding and 1 preceding), 0) as before from docs d join given using (domain, lang, source))
select doc_id, domain, lang, source, n_tokens, f + (before < rest)::bigint as copies from ordered
"""
