"""Operator 4: reproducible shuffle and sharding by a Feistel permutation of global row numbers.

Rows are numbered by (hash bucket, doc_id, text key, hash of the row): bucket counts give each bucket its first number, a window inside the
bucket the rest, so no task sees more than a bucket. The numbers 0 to N - 1 are permuted by an alternating Feistel
network over a rectangle of A x B cells just larger than N; a number that lands outside is permuted again until it is
inside (cycle walking), which keeps the map a permutation of 0 to N - 1. Row p of the shuffled order is slot p div n of
shard p mod n: counts are at most one apart and slots have no gap. Shard and slot follow from a row number alone, and
``row_of`` goes back. DataFrame expressions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from gausstide.llm.common import broadcast_if_small, free, table, text_key

#: Rows of a bucket, about, and the least number of buckets.
BUCKET_ROWS, BUCKETS = 200_000, 1024
ROUNDS = 6
#: At most A - 1 cells lie outside, so up to 4,096 rows the walk ends within 64 steps; beyond, a step stays outside with a chance below 1 in 64.
WALKS = 64


def row_numbers(docs: DataFrame, name: str = "_row", buckets: int | None = None) -> tuple[DataFrame, int]:
    """``docs`` with the column ``name`` (0 to N - 1), and N.

    A bucket holds about BUCKET_ROWS rows: the document id is part of the hash, so groups of copies spread. Inside it
    rows stand by doc_id, text key and a hash of all columns, so rows that differ in any column have a fixed order.
    """
    buckets = buckets or max(BUCKETS, docs.count() // BUCKET_ROWS)
    _key, _all, _bucket, _rank, _first = free(docs.columns, "_key", "_all", "_bucket", "_rank", "_first")
    hashable = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    keyed = docs.withColumns({_key: text_key(), _all: F.xxhash64(*(F.col(f"`{c}`") for c in hashable))}).withColumn(_bucket, F.pmod(F.xxhash64("doc_id", _key), F.lit(buckets)).cast("int"))
    counts = dict(sorted(tuple(r) for r in keyed.groupBy(_bucket).count().collect()))  # at most ``buckets`` rows
    firsts, n = [], 0
    for b, c in counts.items():
        firsts.append((b, n))
        n += c
    offsets = docs.sparkSession.createDataFrame(firsts, T.StructType([T.StructField(_bucket, T.IntegerType()), T.StructField(_first, T.LongType())]))
    rank = F.row_number().over(W.partitionBy(_bucket).orderBy("doc_id", _key, _all))
    out = keyed.withColumn(_rank, rank).join(broadcast_if_small(offsets), _bucket)
    return out.withColumn(name, F.col(_first) + F.col(_rank) - 1).drop(_bucket, _rank, _first, _key, _all), n


def _network(x: Column, n: int, seed: int, backwards: bool = False) -> Column:
    """One pass of the Feistel network over the cells of the rectangle."""
    a = max(1, math.isqrt(n - 1) + 1)
    b = max(1, -(-n // a))
    rounds = list(range(ROUNDS))[:: -1 if backwards else 1]
    keys = F.array(*(F.struct(F.lit(r % 2 == 0).alias("left"), F.lit(seed * ROUNDS + r).cast("long").alias("key")) for r in rounds))
    start = F.struct(F.floor((x - F.pmod(x, F.lit(b))) / b).cast("long").alias("l"), F.pmod(x, F.lit(b)).cast("long").alias("r"))

    def step(s, k):
        turn = lambda value, other, size: F.pmod(value + (-1 if backwards else 1) * F.pmod(F.xxhash64(other, k["key"]), F.lit(size)), F.lit(size)).cast("long")
        return F.struct(F.when(k["left"], turn(s["l"], s["r"], a)).otherwise(s["l"]).alias("l"), F.when(k["left"], s["r"]).otherwise(turn(s["r"], s["l"], b)).alias("r"))

    return F.aggregate(keys, start, step, lambda s: s["l"] * b + s["r"])


def _walked(x: Column, n: int, seed: int, backwards: bool) -> Column:
    out = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), _network(x, n, seed, backwards), lambda y, _: F.when(y < n, y).otherwise(_network(y, n, seed, backwards)))
    return F.when(out < n, out).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def permuted(row: Column, n: int, seed: int = 0) -> Column:
    """The place of a row number in the shuffled order of ``n`` rows."""
    return _walked(row, n, seed, False)


def row_of(place: Column, n: int, seed: int = 0) -> Column:
    """The row number at a place of the shuffled order: the inverse of ``permuted``."""
    return _walked(place, n, seed, True)


def shards(docs: DataFrame, n_shards: int, seed: int = 0) -> DataFrame:
    """``docs`` with shard (0 to n_shards - 1) and slot (gapless from 0).

    Shard sizes are at most one apart. The result depends on the rows and the seed alone, not on partitions or file
    order. Null ids and texts are keys like others; repeated rows get a place each; an empty table stays empty. Input
    columns named shard or slot are replaced; others keep their names and values. Rows that differ in a map column alone
    may swap places.
    """
    _row, _place = free(docs.columns, "_row", "_place")
    numbered, n = row_numbers(docs.drop("shard", "slot"), _row)
    numbered = numbered.withColumn(_place, permuted(F.col(_row), max(n, 1), seed))
    return numbered.withColumns({"shard": F.pmod(_place, F.lit(n_shards)).cast("int"), "slot": ((F.col(_place) - F.pmod(_place, F.lit(n_shards))) / n_shards).cast("long")}).drop(_row, _place)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, text, size (UTF-8 bytes and one more; null text: none) and text_crc32."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    return docs.select("doc_id", "text", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = sized(table(spark, sf_dir, "documents"))
    # the text takes part through its key only, so that no text is shuffled
    out = shards(docs.withColumn("text", text_key().cast("string")), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
