"""Operator 7: Jaccard self-join of word n-gram sets, by rare-first prefixes.

1. A first scan gives every document's set size and a digest of its set, and counts shingles by documents, in chunks of
   CHUNK documents inside each task; a chunk reports those it meets more than once. A shingle of more documents than
   there are chunks is met twice in one, so none that is common escapes, and the sums give all documents one order, rare
   first. Frequent are those in a ten-thousandth of all documents or more: at most 10,000 times the mean number of
   shingles of a document, however large the input is (at 450 shingles a document 4.5 million, 72 MB); only these are
   broadcast.
2. Equal sets become one node. A node posts the prefix of its ordered set: two sets that link share a prefix shingle. The
   postings are shuffled once, by shingle. Inside a shingle they are ordered by set size, and one is kept only if a
   neighbour in that order can link with it: the smaller of two sets must hold the shingle early enough for the overlap
   that the link needs.
3. In every group of a prefix shingle, each node is first compared with one hub only, the one with fewest rare shingles.
   Links of these stars are joined into components. Then pairs inside a group are formed only across components, in
   buckets of set size, and only where the triangle inequality of the Jaccard distance over the hub leaves a link
   possible; so a group of thousands of near copies costs a row each, not all its pairs, and no link between components
   is missed.
4. Length and positional filters are part of the join across components, and so is a look back: a pair whose two postings
   share one of the last few shingles before this one was formed there, and is not formed again. The suffix filter, by
   bitmaps of the whole sets, comes before verification; each pair is verified once, on whole sets rebuilt from the two
   texts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gausstide.llm.common import broadcast_if_small, components, free, scratch, stage, table, text_key

#: A shingle is frequent from this share of all documents on.
FREQUENT_SHARE = 1e-4
#: Documents, and shingles, after which a chunk is counted.
CHUNK, CHUNK_SHINGLES = 4096, 2_500_000
#: Words that are hashed into shingles at a time.
GROUP_WORDS = 100_000
#: Bits of a suffix filter's bitmap for each member of the set, at least.
BITS = 4
#: How many earlier shingles of a set a posting carries in the join across components.
BACK = 4
#: Entries after which a task starts its word tables anew.
MEMO = 300_000

_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D, 0xBF58476D1CE4E5B9], np.uint64)


class _Words(dict):
    """word -> row of a growing array of hashes."""

    def __init__(self):
        super().__init__()
        self.hashes = np.zeros(1024, np.uint64)

    def __missing__(self, word: bytes) -> int:
        i = len(self)
        if i == len(self.hashes):
            self.hashes = np.resize(self.hashes, 2 * i)
        self.hashes[i] = xxhash.xxh3_64_intdigest(word)
        self[word] = i
        return i


def _hashed(h: np.ndarray, size: int) -> np.ndarray:
    """The hashes of all runs of ``size`` word hashes."""
    n = len(h) - size + 1
    h = h ^ (h >> np.uint64(29))
    out = np.full(n, size, np.uint64)
    for j in range(size):
        out = (out ^ (h[j : j + n] * _MULT[j % 8] + np.uint64(j))) * _MULT[(j + 3) % 8]
    return out ^ (out >> np.uint64(32))


def _sets_of(texts: Iterator[str | None], k: int) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles. Words are what bytes.split, which knows ASCII white space alone, leaves of the A-Z lower-cased text; many short texts are hashed at once."""
    table = _Words()

    def flush(group: list[list[bytes]]) -> Iterator[np.ndarray]:
        sizes = list(map(len, group))
        at = np.fromiter(map(table.__getitem__, chain.from_iterable(group)), np.int64, sum(sizes))
        h = table.hashes[at]  # after the look-up, which lets it grow
        whole = _hashed(h, k) if len(h) >= k else h
        at = 0
        for n in sizes:
            if n >= k:
                yield np.unique(whole[at : at + n - k + 1])
            else:
                yield _hashed(h[at : at + n], n) if n else np.zeros(0, np.uint64)
            at += n
        if len(table) > MEMO:
            table.clear()

    group, words = [], 0
    for text in texts:
        group.append(text.encode().lower().split() if text else [])
        words += len(group[-1])
        if words >= GROUP_WORDS:
            yield from flush(group)
            group, words = [], 0
    yield from flush(group)


def _texts(batch: pa.RecordBatch, name: str) -> Iterator[str | None]:
    return (x.as_py() for x in batch.column(name))


def _digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _first_scan(k: int):
    """Rows of two kinds: (doc_id, text_key, n, digest) of every document, and (s, df) of the shingles that a chunk of documents meets more than once; equal sets count once in a chunk."""

    def counted(chunk: list[np.ndarray], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        if chunk:
            s, n = np.unique(np.concatenate(chunk), return_counts=True)
            more = n > 1
            if more.any():
                columns = [pa.nulls(int(more.sum()), f.type) for f in list(schema)[:4]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(s[more].view(np.int64)), pa.array(n[more].astype(np.int64))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, seen, docs, size, schema = [], set(), 0, 0, None
        for batch in batches:
            schema = schema or pa.schema([("doc_id", batch.schema.field("doc_id").type), ("text_key", pa.int64()), ("n", pa.int32()), ("digest", pa.binary()), ("s", pa.int64()), ("df", pa.int64())])
            sizes, digests = [], []
            for own in _sets_of(_texts(batch, "text"), k):
                docs += 1
                sizes.append(len(own))
                digests.append(digest := _digest(own) if len(own) else None)
                if digest not in seen:
                    seen.add(digest)
                    chunk.append(own)
                    size += len(own)
                if docs >= CHUNK or size >= CHUNK_SHINGLES:
                    yield from counted(chunk, schema)
                    chunk, seen, docs, size = [], set(), 0, 0
            n = len(sizes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], schema=schema)
        if schema:
            yield from counted(chunk, schema)

    return run


def frequent_shingles(counts: DataFrame, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counted documents of the frequent shingles; see the module text for their bound."""
    found = counts.groupBy("s").agg(F.sum("df").alias("df")).filter(F.col("df") >= max(2, int(n_docs * FREQUENT_SHARE)))
    got = found.toArrow()
    shingles, df = got.column("s").to_numpy().view(np.uint64), got.column("df").to_numpy().astype(np.int64)
    order = np.argsort(shingles)
    return shingles[order], df[order]


def _bitmap(hashes: np.ndarray) -> bytes:
    """A bit for each hash, by its lowest bits; as many bits as the power of two that gives each member BITS of them."""
    size = max(64, 1 << (BITS * len(hashes) - 1).bit_length())
    marks = np.zeros(size, bool)
    marks[(hashes & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(marks).tobytes()


def _sets(frequent, k: int, percent: int):
    """Per document with words: size of its set, members that are not frequent, digest of the set, the prefix in rare-first order, and the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, df = frequent.value
        for batch in batches:
            rows, kept = [], []
            for i, hashes in enumerate(_sets_of(_texts(batch, "text"), k)):
                n = len(hashes)
                if not n:
                    continue
                at = np.searchsorted(known, hashes)
                at[at == len(known)] = 0
                ranks = np.where(known[at] == hashes, df[at], 0) if len(known) else np.zeros(n, np.int64)
                prefix = hashes[np.argsort(ranks, kind="stable")[: n - -(-percent * n // 100) + 1]]  # hashes are sorted: the order among equals
                rows.append((n, int((ranks == 0).sum()), _digest(hashes), prefix.view(np.int64), _bitmap(hashes)))
                kept.append(i)
            if rows:
                n, rare, digest, prefix, bits = zip(*rows, strict=True)
                ids = [batch.column(c).take(pa.array(kept)) for c in ("doc_id", "text_key")]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(n, pa.int32()), pa.array(rare, pa.int32()), pa.array(digest, pa.binary()), pa.array(prefix, pa.list_(pa.int64())), pa.array(bits, pa.binary())], ["doc_id", "text_key", "n", "rare", "digest", "prefix", "bits"])

    return run


def _may_link(percent: int):
    """The pairs (x, y) whose bitmaps leave the overlap that a link needs, 100 i >= percent (nx + ny - i): members whose bit the other set lacks are not shared. A larger bitmap is folded to the size of the smaller."""

    def folded(bits: np.ndarray, size: int) -> np.ndarray:
        while len(bits) > size:
            bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
        return bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for nx, bx, ny, by in zip(*(batch.column(c).to_pylist() for c in ("nx", "bx", "ny", "by")), strict=True):
                bx, by = np.frombuffer(bx, np.uint8), np.frombuffer(by, np.uint8)
                size = min(len(bx), len(by))
                bx, by = folded(bx, size), folded(by, size)
                most = min(nx - int(np.bitwise_count(bx & ~by).sum()), ny - int(np.bitwise_count(by & ~bx).sum()))
                keep.append(most * (100 + percent) >= percent * (nx + ny))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("x", "y")], ["x", "y"])

    return run


def _verify(k: int):
    """The overlap and union of each pair of texts; pairs come sorted by y, whose set is kept while it stays the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (None, None)
        for batch in batches:
            inter, union = [], []
            for i, own in enumerate(_sets_of(_texts(batch, "tx"), k)):
                y = batch.column("y")[i].as_py()
                if held[0] != y:
                    held = (y, next(_sets_of(iter([batch.column("ty")[i].as_py()]), k)))
                n = len(np.intersect1d(own, held[1], assume_unique=True))
                inter.append(n)
                union.append(len(own) + len(held[1]) - n)
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), pa.array(inter, pa.int64()), pa.array(union, pa.int64())], ["x", "y", "inter", "union"])

    return run


def _postings(nodes: DataFrame, percent: int) -> DataFrame:
    """(s, node, n, pos, hub, hub_n, hub_pos): the postings that can link with another of their shingle, and the group's hub.

    A set of n members needs an overlap of 2p/(100+p) n with one that is no smaller, so as the smaller one it must hold
    their first common shingle within that much of its end (``early``); the larger may hold it anywhere in its prefix.
    """
    posts = nodes.select("node", "n", "rare", F.posexplode("prefix").alias("pos", "s"))
    n = F.col("n").cast("long")
    early = (n - F.col("pos")) * (100 + percent) >= 2 * percent * n
    ordered = W.partitionBy("s").orderBy("n", "node")
    below = F.last(F.when(early, n), ignorenulls=True).over(ordered.rowsBetween(W.unboundedPreceding, -1))
    above = F.lead(n).over(ordered)
    partner = F.coalesce(100 * below >= percent * n, F.lit(False)) | F.coalesce(early & (100 * n >= percent * above), F.lit(False))
    posts = posts.withColumn("partner", partner).filter("partner")
    # the hub is the member with fewest rare shingles: of edited copies, the one they were made from
    posts = posts.withColumn("hub", F.min(F.struct("rare", "node", "n", "pos")).over(W.partitionBy("s")))
    return posts.select("s", "node", "n", "pos", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.pos").alias("hub_pos"))


def _fits(nx: str, px: str, ny: str, py: str, percent: int) -> Column:
    """The length filter, and the positional one: the first common shingle of a link stands where as many follow, on either side, as the link needs."""
    nx, ny = F.col(nx).cast("long"), F.col(ny).cast("long")
    length = 100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)
    return length & (F.least(nx - F.col(px), ny - F.col(py)) * (100 + percent) >= percent * (nx + ny))


def _across(posts: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (x, y) of postings with other labels. The smaller of two sets stands in the bucket of its size, the larger in its own bucket and the one below, which together hold all sizes that a link allows."""
    level = F.floor(F.log(F.col("n") + 0.5) / math.log(100 / min(percent, 99))).cast("int")  # the half keeps sizes off the bounds
    of_node = W.partitionBy("node").orderBy("pos")
    posts = posts.withColumn("back", F.array_compact(F.array(*(F.lag("s", i).over(of_node) for i in range(1, BACK + 1)))))
    fields = ("node", "n", "pos", "label", "far", "back")
    early = (F.col("n").cast("long") - F.col("pos")) * (100 + percent) >= 2 * percent * F.col("n").cast("long")
    a = posts.filter(early).select("s", level.alias("level"), *(F.col(c).alias(f"{c}_x") for c in fields))
    b = posts.select("s", F.explode(F.array(level, level - 1)).alias("level"), *(F.col(c).alias(f"{c}_y") for c in fields))
    near = F.coalesce(F.abs(F.col("far_x") - F.col("far_y")) <= 1 - percent / 100 + 1e-9, F.lit(True))
    smaller = (F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("node_x") < F.col("node_y")))
    on = (a["s"] == b["s"]) & (a["level"] == b["level"]) & smaller & (F.col("label_x") != F.col("label_y")) & near
    # every filter that holds here holds at an earlier common shingle too, or the pair cannot link
    rest = a.join(b, on & _fits("n_x", "pos_x", "n_y", "pos_y", percent) & ~F.arrays_overlap("back_x", "back_y"))
    return rest.select(F.least("node_x", "node_y").alias("x"), F.greatest("node_x", "node_y").alias("y")).distinct()


def similar_documents(docs: DataFrame, k: int = 4, percent: int = 85) -> tuple[DataFrame, DataFrame, DataFrame]:
    """members (doc_id, text_key, n_shingles, digest) of all rows, nodes (node, digest), and links (x, y, inter, union)
    between nodes that suffice for the components; each a staged table.

    Words are what stands between ASCII white space, A-Z lower-cased. A set holds the distinct runs of ``k`` words; with
    fewer words the whole sequence is the one member; without words (null and empty texts too) it is empty, its digest is
    null, and nothing links. Two sets link when 100 * intersection >= percent * union. Equal sets (128-bit digests) share
    a node, so copies and repeated rows are one node however many they are. Rows are told apart by (doc_id, text_key), so
    ids may repeat with other texts, or be null. Members of sets are 64-bit hashes: two different shingles of one pair
    of documents count as equal with a chance below n_x n_y / 2**64.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", text_key().alias("text_key"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    linked = F.col("inter") * 100 >= F.col("union") * percent
    with scratch(spark, "jaccard") as step:
        scanned = step(docs.mapInArrow(_first_scan(k), f"doc_id {kind}, text_key long, n int, digest binary, s long, df long"), "first-scan")
        members = stage(scanned.filter("s is null").select("doc_id", "text_key", F.col("n").cast("long").alias("n_shingles"), "digest"), "members")
        frequent = spark.sparkContext.broadcast(frequent_shingles(scanned.filter("s is not null").select("s", "df"), members.count()))
        sets = docs.mapInArrow(_sets(frequent, k, percent), f"doc_id {kind}, text_key long, n int, rare int, digest binary, prefix array<long>, bits binary")
        nodes = step(sets.dropDuplicates(["digest"]).withColumn("node", F.monotonically_increasing_id()), "nodes")
        frequent.unpersist()
        posts = step(_postings(nodes, percent), "postings")

        stars = posts.filter((F.col("node") != F.col("hub")) & _fits("n", "pos", "hub_n", "hub_pos", percent)).select(F.col("node").alias("x"), F.col("hub").alias("y")).distinct()
        checked = step(_checked(stars, nodes, docs, k, percent, step), "verified-stars")
        links = checked.filter(linked)
        parts = components(links.select(F.col("x").alias("u"), F.col("y").alias("v")), step)

        # what the stars left: pairs across components that share a prefix shingle
        posts = posts.select("s", "node", "n", "pos", "hub").join(broadcast_if_small(parts.select("node", "label")), "node", "left").withColumn("label", F.coalesce("label", "node"))
        group = W.partitionBy("s")
        mixed = posts.withColumns({"a": F.min("label").over(group), "b": F.max("label").over(group)}).filter("a <> b").drop("a", "b")
        mixed = step(mixed, "mixed-postings")
        far = checked.select(F.col("x").alias("node"), F.col("y").alias("hub"), (1 - F.col("inter") / F.col("union")).alias("far"))
        mixed = mixed.join(broadcast_if_small(step(far, "hub-distances")), ["node", "hub"], "left")
        mixed = mixed.withColumn("far", F.when(F.col("node") == F.col("hub"), F.lit(0.0)).otherwise(F.col("far")))
        rest = _across(mixed, percent).join(checked.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")), ["x", "y"], "left_anti")
        more = _checked(rest, nodes, docs, k, percent, step).filter(linked)
        links = stage(links.unionByName(more), "links")
        nodes = stage(nodes.select("node", "digest"), "set-nodes")
    return members, nodes, links


def _checked(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, percent: int, step) -> DataFrame:
    """Pairs (x, y) that pass the suffix filter, with their verified overlap and union."""

    def ends(pairs: DataFrame, columns: list) -> DataFrame:
        wanted = pairs.select(F.col("x").alias("node")).union(pairs.select(F.col("y").alias("node"))).distinct()
        return nodes.select("node", *columns).join(broadcast_if_small(step(wanted, "wanted")), "node", "left_semi")

    pairs = step(pairs, "pairs")
    own = ends(pairs, ["n", "bits"])
    x, y = own.select(F.col("node").alias("x"), F.col("n").alias("nx"), F.col("bits").alias("bx")), own.select(F.col("node").alias("y"), F.col("n").alias("ny"), F.col("bits").alias("by"))
    pairs = step(pairs.join(x, "x").join(y, "y").mapInArrow(_may_link(percent), "x long, y long"), "candidate-pairs")
    ids = broadcast_if_small(step(ends(pairs, [F.col("doc_id").alias("id"), F.col("text_key").alias("key")]), "candidate-nodes"))
    # dealt by node once: the exchange serves both joins
    texts = docs.join(ids, docs["doc_id"].eqNullSafe(ids["id"]) & (docs["text_key"] == ids["key"])).select("node", "text").dropDuplicates(["node"])
    both = pairs.join(texts.select(F.col("node").alias("x"), F.col("text").alias("tx")), "x").join(texts.select(F.col("node").alias("y"), F.col("text").alias("ty")), "y")
    return both.mapInArrow(_verify(k), "x long, y long, inter long, union long")


def _grouped(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """members, and per digest of a set the first row (no null id before any other, then the least doc_id and text key) of its component."""
    members, nodes, links = similar_documents(docs, k, percent)
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    sets = members.filter("digest is not null").groupBy("digest").agg(F.min(row).alias("first"))
    with scratch(docs.sparkSession, "components") as step:
        parts = components(links.select(F.col("x").alias("u"), F.col("y").alias("v")), step)
        labels = step(nodes.join(broadcast_if_small(parts), "node").select("digest", "label"), "labels")
        joined = sets.join(broadcast_if_small(labels), "digest")
        joined = step(joined, "linked-sets")
        of_label = broadcast_if_small(step(joined.groupBy("label").agg(F.min("first").alias("first")), "label-firsts"))
        linked = stage(joined.select("digest", "label").join(of_label, "label").select("digest", F.col("first").alias("linked")), "linked-firsts")
    firsts = sets.join(broadcast_if_small(linked), "digest", "left").select("digest", F.coalesce("linked", "first").alias("first"))
    return members, firsts


def component_ids(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (least doc_id that links reach, itself included).

    Rows that repeat a doc_id are each returned, with the component of their own text. Null ids link like others; a
    component's id is its least id that is not null, or null without one. A document without words is its own component.
    Other columns, whatever their names, play no part. Empty table: no rows.
    """
    members, firsts = _grouped(docs, k, percent)
    least = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    return members.join(firsts, "digest", "left").select("doc_id", "n_shingles", least.alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component, that of the least (doc_id, text key), null ids last; all columns kept.

    Only linked or equal sets are dropped: rows that share an id but not their text both stay, and so do all rows without
    words. Of rows that repeat both id and text one stays.
    """
    columns = docs.columns
    members, firsts = _grouped(docs, k, percent)
    first = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.text_key") == F.col("text_key"))
    rows = stage(members.filter("digest is not null").join(firsts, "digest").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), first.alias("first")), "chosen-rows")
    (key,) = free(columns, "text_key")
    keyed = docs.withColumn(key, text_key())
    at = lambda other: keyed["doc_id"].eqNullSafe(other["_id"]) & (keyed[key] == other["_key"])
    gone = broadcast_if_small(stage(rows.filter("not first").select("_id", "_key").distinct(), "later-rows"))
    again = stage(rows.filter("first").groupBy("_id", "_key").count().filter("count > 1").select("_id", "_key"), "repeated-rows")
    kept = keyed.join(gone, at(gone), "left_anti")
    if again.take(1):  # the rare case: rows repeated in full
        again = broadcast_if_small(again)
        once = kept.join(again, at(again), "left_semi").dropDuplicates(["doc_id", key])
        kept = kept.join(again, at(again), "left_anti").unionByName(once)
    return kept.select(*columns)


def query(spark, sf_dir: str) -> DataFrame:
    return component_ids(table(spark, sf_dir, "documents"), k=4, percent=85)


SQL = r"""
with recursive words as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
grams as (select distinct doc_id, array_to_string(w[s:s + 3], ' ') as g
          from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as s from words where len(w) > 0)),
sizes as (select doc_id, count(*) as n from grams group by doc_id),
shared as (select a.doc_id as x, b.doc_id as y, count(*) as i from grams a join grams b on a.g = b.g and a.doc_id <> b.doc_id group by all),
links as (select x, y from shared join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * i >= 85 * (p.n + q.n - i)),
reach as (select x as doc_id, y from links union select r.doc_id, l.y from reach r join links l on l.x = r.y)
select doc_id, coalesce(n, 0)::bigint as n_shingles, least(doc_id, coalesce(m, doc_id)) as component_id
from words left join sizes using (doc_id) left join (select doc_id, min(y) as m from reach group by doc_id) using (doc_id)
"""
