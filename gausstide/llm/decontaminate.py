"""Operator 2: benchmark decontamination over a positional inverted index.

Benchmark texts are cut into windows of consecutive words. One scan of all texts counts the benchmark's terms, which puts
the terms of every window in order, rarest first. A second one, however many windows there are, stores the index: a
posting (term, document, position) for each occurrence of a term that is among the LISTS rarest of some window; the lists
of words that are common in every window they stand in are never read, so they are not stored. The rarest term's list
gives the candidates (document, window, start); the lists of the next terms are intersected with them one after the other
at their adjusted offsets. Postings and candidates are flat rows that meet on (document, term, position), so a term in
every document is spread over the documents. What is left is held against the words of its document around the start.
With a slop the lists are met within so many positions, in cells of 2 slop + 1 of them, which gives phrase and proximity
matches in one pass. Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gausstide.llm.common import ascii_words, broadcast_if_small, free, same, scratch, stage, table, text_key

WINDOW_WORDS = 10
#: The words that may stand between those of a window in the query's proximity matches.
NEAR_SLOP = 3
#: Words from this length on are indexed by their SHA-256 in hex, so that no posting is long.
LONG_WORD = 64
#: The rarest terms of a window whose lists are intersected.
LISTS = 3
DOC = ["doc_id", "text_key"]


def windows_of(items: DataFrame, size: int | None = WINDOW_WORDS) -> DataFrame:
    """(window, item_id): each run of ``size`` words of an item, or all words of a shorter item or where ``size`` is None. Items without words or without an id have none."""
    words = items.filter("item_id is not null").select("item_id", ascii_words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    if size is None:
        return words.select("item_id", F.col("words").alias("window"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    return words.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("words", s, F.lit(size)))).alias("window"))


def _term(word: Column) -> Column:
    return F.when(F.length(word) >= LONG_WORD, F.sha2(word, 256)).otherwise(word)


def positional_index(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, doc_id, text_key, pos): the postings of the terms of ``vocabulary`` (term, a staged table), positions from 0."""
    words = docs.select("doc_id", text_key().alias("text_key"), F.posexplode(ascii_words(F.col("text"))).alias("pos", "word"))
    return words.select(_term(F.col("word")).alias("term"), *DOC, "pos").join(broadcast_if_small(vocabulary), "term")


def _list_lengths(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, postings): how often each term stands in the texts."""
    words = docs.select(F.explode(ascii_words(F.col("text"))).alias("word")).select(_term(F.col("word")).alias("term"))
    return words.join(broadcast_if_small(vocabulary), "term").groupBy("term").agg(F.count("*").alias("postings"))


def _ranked(windows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(w, length, offset, term, rank): the LISTS places of each window with the shortest lists. A window with a term that no document has is gone."""
    places = windows.select("w", F.size("window").alias("length"), F.posexplode("window").alias("offset", "word")).withColumn("term", _term(F.col("word"))).drop("word")
    sized = places.join(broadcast_if_small(sizes), "term", "left")
    of_window = W.partitionBy("w")
    rank = F.row_number().over(of_window.orderBy("postings", "term", "offset"))
    ranked = sized.withColumns({"rank": rank, "known": F.count("postings").over(of_window)})
    return ranked.filter((F.col("known") == F.col("length")) & (F.col("rank") <= LISTS)).select("w", "length", "offset", "term", "rank")


def _met(wanted: DataFrame, index: DataFrame, slop: int) -> DataFrame:
    """The rows of ``wanted`` (doc_id, text_key, term, at, ...) with a posting of their term in their document within ``slop`` positions of ``at``; with a slop a row may come twice."""
    width = 2 * slop + 1
    cell = lambda at: F.floor(at / width).cast("int")
    cells = F.explode(F.sequence(cell(F.col("at") - slop), cell(F.col("at") + slop)))
    left = wanted.withColumn("cell", cells if slop else F.col("at"))
    right = index.withColumn("cell", cell(F.col("pos")) if slop else F.col("pos"))
    on = same(left, right, DOC) & (left["term"] == right["term"]) & (left["cell"] == right["cell"]) & (F.abs(right["pos"] - left["at"]) <= slop)
    return left.join(right, on, "left_semi")


def _matches(docs: DataFrame, items: DataFrame, size: int | None, slop: int, step) -> DataFrame:
    """(doc_id, text_key, length, start, item_ids, exact, spans): per document and candidate place of a window whether it stands there word for word, and the spans (s, e) that hold its words in order with ``slop`` others at most. Positions from 0."""
    docs = docs.select("doc_id", "text")
    windows = windows_of(items, size).groupBy("window").agg(F.collect_set("item_id").alias("item_ids"))
    windows = step(windows.withColumn("w", F.monotonically_increasing_id()), "windows")
    vocabulary = step(windows.select(F.explode("window").alias("word")).select(_term(F.col("word")).alias("term")).distinct(), "vocabulary")
    ranked = step(_ranked(windows, step(_list_lengths(docs, vocabulary), "list-lengths")), "ranked-places")
    index = step(positional_index(docs, step(ranked.select("term").distinct(), "listed-terms")), "positional-index")

    of_rank = lambda r: broadcast_if_small(step(ranked.filter(F.col("rank") == r), f"rank-{r}"))
    key = [*DOC, "w", "length", "start"]
    found = index.join(of_rank(1), "term").withColumn("start", F.col("pos") - F.col("offset")).filter("start >= 0").select(*key).distinct()
    for r in range(2, LISTS + 1):
        found = step(found, "candidates")
        wanted = found.join(of_rank(r).select("w", "term", "offset"), "w").select(*key, "term", (F.col("start") + F.col("offset")).alias("at"))
        met = _met(wanted, index, slop).select(*key)
        found = found.filter(F.col("length") < r).unionByName(met.distinct() if slop else met)
    found = step(found, "candidates")

    ids = broadcast_if_small(step(found.select(*DOC).distinct(), "candidate-documents"))
    keyed = docs.withColumn("text_key", text_key())
    texts = keyed.join(ids, same(keyed, ids, DOC), "left_semi").dropDuplicates(DOC)
    texts = step(texts.select(*DOC, ascii_words(F.col("text")).alias("words")), "candidate-words")  # cut once, not per candidate
    places = found.groupBy(*DOC).agg(F.collect_list(F.struct("w", "length", "start")).alias("places"))
    both = texts.join(places, same(texts, places, DOC)).select(*(texts[c] for c in DOC), "words", "places")
    first = lambda p: F.greatest(p["start"] - slop, F.lit(0))
    around = lambda p: F.struct(p["w"].alias("w"), p["length"].alias("length"), p["start"].alias("start"), first(p).alias("first"), F.slice("words", first(p) + 1, p["start"] + p["length"] + slop - first(p)).alias("around"))
    both = both.select(*DOC, F.inline(F.transform("places", around))).join(windows, "w")
    exact = F.slice("around", F.col("start") - F.col("first") + 1, F.col("length")) == F.col("window")
    after = lambda e, word: F.array_position(F.slice("around", e + 1, F.size("around")), word).cast("int")
    end_from = lambda s: F.aggregate(F.slice("window", 2, F.size("window")), s, lambda e, word: F.when(after(e, word) > 0, e + after(e, word)))
    heads = F.filter(F.sequence(F.lit(1), F.size("around")), lambda i: F.element_at("around", i) == F.element_at("window", 1))
    spans = F.filter(F.transform(heads, lambda s: F.named_struct(F.lit("s"), s, F.lit("e"), end_from(s))), lambda x: F.coalesce(x["e"] - x["s"] < F.col("length") + slop, F.lit(False)))
    spans = F.transform(spans, lambda x: F.named_struct(F.lit("s"), x["s"] + F.col("first") - 1, F.lit("e"), x["e"] + F.col("first") - 1))
    out = both.select(*DOC, "length", "start", "item_ids", exact.alias("exact"), spans.alias("spans"))
    return step(out.filter(F.col("exact") | (F.size("spans") > 0)), "matches")


def phrase_hits(docs: DataFrame, items: DataFrame, size: int = WINDOW_WORDS, slop: int = 0) -> DataFrame:
    """(doc_id, text_key, hits, near_ids) of the documents with a match.

    hits: array of (start, length, item_ids), start from 1: every exact occurrence of a window. near_ids: the items (sorted
    strings) with a window whose words stand in order with ``slop`` others between them at most. Null texts and texts
    without words have no hits; rows that repeat a document have the same hits; an empty benchmark gives no hits. Items of
    any length. Further columns play no part.
    """
    with scratch(docs.sparkSession, "decontamination") as step:
        both = _matches(docs, items, size, slop, step)
        hit = F.when(F.col("exact"), F.struct((F.col("start") + 1).alias("start"), "length", "item_ids"))
        out = both.groupBy(*DOC).agg(F.collect_list(hit).alias("hits"), F.flatten(F.collect_set("item_ids")).alias("near_ids"))
        return stage(out.withColumn("near_ids", _strings(F.col("near_ids"))), "phrase-hits")


def _strings(ids: Column) -> Column:
    return F.array_sort(F.transform(F.array_distinct(ids), lambda i: i.cast("string")))


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW_WORDS, slop: int = 0) -> DataFrame:
    """Per document: doc_id, text_key, n_words, n_hit (words inside any occurrence), item_ids (sorted strings), near_ids (those with proximity matches within ``slop``, item_ids among them), contaminated. For odd cases see ``phrase_hits``."""
    hits = phrase_hits(docs, items, size, slop)
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["length"] - 1))))
    ids = _strings(F.flatten(F.transform("hits", lambda h: h["item_ids"])))
    hits = broadcast_if_small(stage(hits.select(*DOC, F.size(covered).cast("long").alias("n_hit"), ids.alias("item_ids"), "near_ids"), "hit-documents"))
    rows = docs.select("doc_id", text_key().alias("text_key"), F.size(ascii_words(F.col("text"))).cast("long").alias("n_words"))
    n_hit, none = F.coalesce("n_hit", F.lit(0).cast("long")), F.array().cast("array<string>")
    both = rows.join(hits, same(rows, hits, DOC), "left")
    return both.select(rows["doc_id"], rows["text_key"], "n_words", n_hit.alias("n_hit"), *(F.coalesce(c, none).alias(c) for c in ("item_ids", "near_ids")), (n_hit > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """``docs`` without the contaminated rows, all columns kept, whatever their names."""
    found = broadcast_if_small(stage(phrase_hits(docs.select("doc_id", "text"), items, size).filter(F.size("hits") > 0).select(*DOC), "contaminated"))
    (key,) = free(docs.columns, "text_key")
    keyed = docs.withColumn(key, text_key())
    return keyed.join(found, keyed["doc_id"].eqNullSafe(found["doc_id"]) & (keyed[key] == found["text_key"]), "left_anti").drop(key)


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int) -> DataFrame:
    """(doc_id, text_key, item_id, start, end): where all words of an item stand in order, with ``slop`` words at most between them in all.

    Of the spans that begin at one position the shortest is given. slop 0 is exact phrase search. Items are whole
    queries here (no windows); positions count from 1.
    """
    with scratch(docs.sparkSession, "proximity") as step:
        spans = _matches(docs, items, None, slop, step).select(*DOC, F.explode("item_ids").alias("item_id"), "spans").select(*DOC, "item_id", F.explode("spans").alias("x"))
        return stage(spans.groupBy(*DOC, "item_id", (F.col("x.s") + 1).alias("start")).agg((F.min("x.e") + 1).alias("end")), "proximity-matches")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = contamination(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"), slop=NEAR_SLOP)
    n = lambda c: F.size(c).cast("long")
    return out.select("doc_id", "n_words", "n_hit", n("item_ids").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated", n("near_ids").alias("n_near"))


SQL = r"""
with recursive cut as (
  select 'd' as t, doc_id as id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as x from documents
  union all select 'i', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') from benchmark),
words as (select t, id, list_filter(string_split_regex(x, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as w from cut),
win as (select distinct id as item_id, least(10, len(w)) as n, array_to_string(w[s:s + 9], ' ') as g
        from (select id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as s from words where t = 'i' and len(w) > 0)),
grams as (select id as doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') as g
          from (select id, w, n, unnest(range(1, len(w) - n + 2)) as s from words, (select distinct n from win) where t = 'd')),
hit as (select distinct doc_id, s, n, item_id from grams join win using (n, g)),
covered as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + n)) as p from hit) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids
          from (select distinct doc_id, item_id from hit) group by doc_id),
pat as (select distinct n, string_split(g, ' ') as p from win),
-- words of a window met in order, each the next one after the last, at most n + 3 words in all
walk as (select id as doc_id, p, n, s, s as e, 1 as k from (select id, unnest(range(1, len(w) + 1)) as s, w from words where t = 'd') join pat on p[1] = w[s]
         union all
         select doc_id, p, n, s, e + j, k + 1
         from (select walk.*, list_position(w[e + 1:least(s + n + 2, len(w))], p[k + 1]) as j from walk join words on t = 'd' and id = doc_id where k < n) where j > 0),
near as (select doc_id, count(distinct item_id) as n_near from (select distinct doc_id, p, n from walk where k = n) join win on g = array_to_string(p, ' ') group by doc_id)
select id as doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated,
       coalesce(n_near, 0)::bigint as n_near
from words left join covered on id = covered.doc_id left join items on id = items.doc_id left join near on id = near.doc_id where t = 'd'
"""
