"""Operator 6: line deduplication by sorted hash runs, with keep bitmaps as the result.

Lines are hashed to 128 bits, range-partitioned by (hash, document) and sorted by document and position within a
hash. One stream over each partition sees the runs of equal hashes: it gives the first occurrence of each run and the
number of its documents. A hash of a third of all rows spreads over many ranges, because the document is part of the
range key; the few partial runs of one hash are then summed. The result per document is a compressed bitmap of the
lines to keep, not text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gausstide.llm.common import BLANKS, broadcast_if_small, lower_ascii, same, stage, table, text_key

HASH = ["h1", "h2"]
RUNS = "h1 long, h2 long, n_docs long, first_doc long, first_key long, first_pos int"


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def lines_of(text: Column) -> Column:
    """The lines of a text; null or empty: one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """(h1, h2, doc_id, text_key, pos) of every line whose key has ``min_chars`` code points or more."""
    rows = docs.select("doc_id", text_key().alias("text_key"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    rows = rows.withColumn("line", line_key(F.col("line"))).filter(F.length("line") >= min_chars)
    return rows.select(F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit("second")).alias("h2"), "doc_id", "text_key", "pos")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per run of equal hashes in a sorted partition. Only the run that is open is held from batch to batch."""
    names = ["h1", "h2", "n_docs", "first_doc", "first_key", "first_pos"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
    held = None  # h1, h2, documents so far, first occurrence, last document
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, key, pos = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "text_key", "pos"))
        null = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
        doc = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
        new_hash = np.ones(len(h1), bool)
        new_hash[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new_doc = np.ones(len(h1), bool)
        new_doc[1:] = new_hash[1:] | (doc[1:] != doc[:-1]) | (null[1:] != null[:-1])
        if held and (h1[0], h2[0]) == held[:2]:
            new_doc[0] = (doc[0], null[0]) != held[6]
        starts = np.flatnonzero(new_hash)
        docs = np.add.reduceat(new_doc.astype(np.int64), starts)
        out = [(int(h1[s]), int(h2[s]), int(n), None if null[s] else int(doc[s]), int(key[s]), int(pos[s])) for s, n in zip(starts, docs, strict=True)]
        if held:
            if out[0][:2] == held[:2]:
                out[0] = (*held[:2], held[2] + out[0][2], *held[3:6])
            else:
                out.insert(0, held[:6])
        held = (*out.pop(), (doc[-1], null[-1]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(held[:6], kinds, strict=True)], names)


def hash_runs(hashes: DataFrame) -> DataFrame:
    """(h1, h2, n_docs, first_doc, first_key, first_pos) of every hash: its documents, and its first occurrence by doc_id (nulls first) and position."""
    spark = hashes.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [*HASH, "doc_id", "text_key", "pos"]
    dealt = hashes.repartitionByRange(n, *HASH, "doc_id").sortWithinPartitions(*order)
    runs = dealt.mapInArrow(_runs, RUNS)
    first = F.min(F.struct(F.col("first_doc"), F.col("first_key"), F.col("first_pos")))
    return runs.groupBy(*HASH).agg(F.sum("n_docs").alias("n_docs"), first.alias("first")).select(*HASH, "n_docs", "first.*")


@F.pandas_udf(T.BinaryType())
def _bitmap(n_lines: pd.Series, dropped: pd.Series) -> pd.Series:
    def one(n, gone):
        keep = np.ones(n, bool)
        keep[np.asarray(gone, int)] = False
        return zlib.compress(np.packbits(keep).tobytes())

    return pd.Series([one(n, g) for n, g in zip(n_lines, dropped, strict=True)])


@F.pandas_udf(T.StringType())
def _kept(text: pd.Series, bitmap: pd.Series) -> pd.Series:
    def one(t, bits):
        lines = t.split("\n")
        keep = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8), count=len(lines))
        return "\n".join(x for x, k in zip(lines, keep, strict=True) if k)

    return pd.Series([one(t, b) for t, b in zip(text, bitmap, strict=True)])


def keep_bitmaps(docs: DataFrame, mode: str = "frequent", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """(doc_id, text_key, n_lines, n_dropped, keep_bitmap) of the documents that lose lines.

    mode "frequent": a line whose key is found in ``min_docs`` documents or more loses all its occurrences.
    mode "first": of each key the first occurrence stays, by doc_id (nulls first), text key and position.
    ``keep_bitmap`` is zlib-compressed, a bit per line, most significant bit first, 1 to keep. Empty table: no rows.
    Null and empty texts have one empty line, whose key is too short to be dropped. Rows that repeat a doc_id count as
    one document; extra columns are ignored. Very long texts: a line is a row, so no task holds a text twice.
    """
    if mode not in ("frequent", "first"):
        raise ValueError("mode: frequent or first")
    hashes = stage(line_hashes(docs, min_chars), "line-hashes")
    runs = hash_runs(hashes)
    if mode == "frequent":
        frequent = broadcast_if_small(stage(runs.filter(F.col("n_docs") >= min_docs).select(*HASH), "frequent-lines"))
        gone = hashes.join(frequent, HASH, "left_semi")
    else:
        gone = hashes.join(runs, HASH).filter(~(F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("text_key") == F.col("first_key")) & (F.col("pos") == F.col("first_pos"))))
    gone = gone.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))
    sizes = docs.select("doc_id", text_key().alias("text_key"), F.size(lines_of(F.col("text"))).alias("n_lines")).distinct()
    out = gone.join(sizes.withColumnsRenamed({"doc_id": "d", "text_key": "k"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")))
    return out.select("doc_id", "text_key", F.col("n_lines").cast("long"), F.size("dropped").cast("long").alias("n_dropped"), _bitmap("n_lines", "dropped").alias("keep_bitmap"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with kept_text, n_lines and n_dropped; texts that lose nothing pass unchanged (null as empty)."""
    docs = docs.withColumn("text_key", text_key())
    marks = bitmaps.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"), F.col("n_dropped").alias("_n"), F.col("keep_bitmap").alias("_b"))
    both = docs.join(marks, docs["doc_id"].eqNullSafe(marks["_d"]) & (docs["text_key"] == marks["_k"]), "left")
    both = both.withColumns({"n_lines": F.size(lines_of(F.col("text"))).cast("long"), "n_dropped": F.coalesce("_n", F.lit(0)).cast("long")})
    left = both.filter("_b is null").withColumn("kept_text", F.coalesce("text", F.lit("")))
    cut = both.filter("_b is not null").withColumn("kept_text", _kept("text", "_b"))
    return left.unionByName(cut).drop("_d", "_k", "_n", "_b", "text_key")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = apply_bitmaps(docs, keep_bitmaps(docs, "frequent", min_docs=10, min_chars=1))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
with lines as (
  select doc_id, pos, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents)),
frequent as (select key from lines where length(key) >= 1 group by key having count(distinct doc_id) >= 10)
select doc_id, count(*)::bigint as n_lines, count(f.key)::bigint as n_dropped,
       sha256(coalesce(string_agg(case when f.key is null then line end, chr(10) order by pos), '')) as kept_sha256
from lines left join frequent f using (key) group by doc_id
"""
