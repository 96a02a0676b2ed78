"""Operator 13: collocations of 2 to 5 words per language.

The n-grams of the texts become DataFrame rows and are aggregated per language. A phrase can be frequent only if its
words and its word pairs are, so three scans do: words; pairs of frequent words; phrases of 3 and more words whose pairs
are all frequent. What a scan may skip it learns from a bitmap of fixed size (``BITMAP_BITS``) over hashes of what the
scan before found frequent: it can let too much pass, never too little, and does not grow with the data. Each task sums
up its own n-grams first. Counts of first parts and rests come by joins, scores are exact decimals, phrases inside an
equally frequent longer one go by an anti-join on one-word extensions, and a window ranks the rest.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gausstide.llm.common import LOWER, UPPER, free, scratch, stage, table

#: Bits of the bitmap that a scan gets from the scan before (8 MB), whatever the data.
BITMAP_BITS = 1 << 26
#: Words of a language, and distinct words, that a task sums up before it passes their n-grams on.
HELD = 1_000_000
#: N-grams that a task passes on at a time.
ROWS_OUT = 50_000
#: Partial ranks within which each language's first rows are found before they meet.
SALTS = 32
UNKNOWN = "und"

#: Ends of pieces become 0xFF, which no UTF-8 text has; tabs become blanks, letters lower case.
_FOLD = bytes.maketrans(UPPER.encode() + b"\t" + b".,;:!?\n\x0b\x0c\r", LOWER.encode() + b" " + b"\xff" * 10)
END = b"\xff"
ROWS = "lang string, phrase string, n_words int, c long"


def words_and_ends(text: bytes) -> list[bytes]:
    """The words of a text in order, with END where a piece ends. (No other white space is left for ``split``.)"""
    return text.translate(_FOLD).replace(END, b" \xff ").split()


class Codes(dict):
    """Numbers of the words of a task, from 1 on (0: the end of a piece), with the hash of each word."""

    def __init__(self):
        self[END] = 0
        self.words, self.hashes = [b""], array("Q", [0])

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self.words)
        self.words.append(word)
        self.hashes.append(xxhash.xxh64_intdigest(word, 42))
        return code


def _set(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the bitmap holds."""
    at = (hashes % np.uint64(8 * len(bits))).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _pair_hash(first, second):
    return (first >> np.uint64(13)) ^ second


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys and their counts. ``keys`` is sorted in place: no order beside it is needed, so little memory is."""
    keys.sort()
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.diff(first, append=len(keys))


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, count) of each distinct key, and the number of each key among the distinct ones."""
    _, first, number, count = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    return first, count, number


def _grams(level: int, codes: np.ndarray, hashes: np.ndarray, bits: list[np.ndarray], max_words: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """(codes of the first words, of the second ones and so on, counts) of the distinct n-grams of a scan in a row of codes."""
    if level == 1:
        counts = np.bincount(codes)
        found = 1 + np.flatnonzero(counts[1:])
        yield [found], counts[found]
        return
    ok = (codes > 0) & _set(bits[0], hashes)[codes]
    at = np.flatnonzero(ok[:-1] & ok[1:])
    if not len(at):
        return
    if level == 2:
        keys = codes[at].astype(np.uint64)
        keys <<= np.uint64(32)
        keys |= codes[at + 1]
        del ok, at
        keys, counts = _distinct(keys)
        yield [keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)], counts
        return
    places = at[_set(bits[1], _pair_hash(hashes[codes[at]], hashes[codes[at + 1]]))]
    pairs = np.zeros(len(codes), bool)  # where a pair that may be frequent begins
    pairs[places] = True
    # an n-gram's key: the number of its first n - 1 words, then the last word's code, so keys are exact at any length
    number = codes[places]
    for n in range(2, max_words + 1):
        if not len(places):
            return
        first, count, number = _counted((number.astype(np.uint64) << np.uint64(32)) | codes[places + n - 1])
        if n > 2:
            yield [codes[places[first] + j] for j in range(n)], count
        longer = pairs[places + n - 1]
        places, number = places[longer], number[longer]


def _counts(level: int, max_words: int, sent: tuple, most: int):
    """Counts of a scan: level 1 words, level 2 pairs of possibly frequent words, level 3 longer phrases of possibly frequent pairs. A task sums up ``most`` words of a language at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [np.frombuffer(b.value, np.uint8) for b in sent]
        known = Codes()
        held: dict[str, list] = {}
        sizes: dict[str, int] = {}

        def flush(lang: str):
            codes, hashes = np.concatenate(held.pop(lang)), np.array(known.hashes, np.uint64)
            sizes.pop(lang)
            words = pa.array(known.words, pa.binary()).cast(pa.string())
            for columns, counts in _grams(level, codes, hashes, bits, max_words):
                n = len(columns)
                for at in range(0, len(counts), ROWS_OUT):
                    part = slice(at, at + ROWS_OUT)
                    phrases = pc.binary_join_element_wise(*(words.take(pa.array(x[part])) for x in columns), " ")
                    yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(phrases)), phrases, pa.array(np.full(len(phrases), n, np.int32)), pa.array(counts[part].astype(np.int64))], ["lang", "phrase", "n_words", "c"])

        for batch in batches:
            texts, langs = batch.column("text").cast(pa.binary()), batch.column("lang")
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                if not text:
                    continue
                lang, words = langs[i].as_py(), words_and_ends(text)
                words.append(END)
                held.setdefault(lang, []).append(np.fromiter(map(known.__getitem__, words), np.uint32, len(words)))
                sizes[lang] = sizes.get(lang, 0) + len(words)
                if sizes[lang] > most:
                    yield from flush(lang)
                if len(known.words) > most:
                    for each in list(held):
                        yield from flush(each)
                    known = Codes()
        for each in list(held):
            yield from flush(each)

    return run


def _bitmap(spark: SparkSession, phrases: DataFrame, n_words: int):
    """A broadcast bitmap of BITMAP_BITS bits with the hash of each phrase of ``n_words`` (1 or 2) words set."""
    h = "xxhash64(phrase)" if n_words == 1 else "shiftrightunsigned(xxhash64(split_part(phrase, ' ', 1)), 13) ^ xxhash64(split_part(phrase, ' ', 2))"
    hashed = phrases.select(F.expr(f"({h}) & {BITMAP_BITS - 1}L").alias("h"))
    parts = hashed.select(F.expr("cast(shiftright(h, 3) as int)").alias("at"), F.expr("shiftleft(1, cast(h & 7 as int))").alias("bit"))
    rows = parts.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(BITMAP_BITS // 8, np.uint8)
    bits[rows["at"].to_numpy()] = rows["bits"].to_numpy().astype(np.uint8)
    return spark.sparkContext.broadcast(bits.tobytes())


def frequent_phrases(docs: DataFrame, min_count: int, max_words: int, step) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n_words, f) of the phrases of up to ``max_words`` words with f >= ``min_count``, and (lang, n), all word occurrences. ``step`` stages tables."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).cast("string").alias("lang"), "text")

    def scan(level: int, sent: tuple) -> DataFrame:
        return texts.mapInArrow(_counts(level, max_words, sent, HELD), ROWS).groupBy("lang", "phrase", "n_words").agg(F.sum("c").alias("f"))

    words = scan(1, ())
    tagged = words.withColumn("rare", F.col("f") < min_count)
    # rare words leave nothing but their sum
    kept = step(tagged.groupBy("lang", F.when(~F.col("rare"), F.col("phrase")).alias("phrase")).agg(F.sum("f").alias("f")), "words")
    totals = step(kept.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    levels = [kept.filter("phrase is not null").select("lang", "phrase", F.lit(1).alias("n_words"), "f")]
    sent: tuple = ()
    for level in (2, 3)[: max_words - 1]:
        sent = (*sent, _bitmap(spark, levels[-1], level - 1))
        levels.append(step(scan(level, sent).filter(F.col("f") >= min_count), f"phrases-{level}"))
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out, totals


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, n_words, a, l, r, n, score) of the phrases of two words and more, by their lowest-scoring cut."""
    words = F.split("phrase", " ")
    cuts = phrases.filter("n_words >= 2").select("lang", "phrase", "n_words", F.col("f").alias("a"), words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "n_words", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.col("n_words")), " ").alias("rest"))
    left = phrases.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    cuts = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(totals, "lang")
    exact = "(cast(1000 as decimal(4, 0)) * cast(a as decimal(19, 0)) * cast(n as decimal(15, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))"
    cuts = cuts.withColumn("score", F.expr(exact))
    best = cuts.groupBy("lang", "phrase", "n_words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    return best.select("lang", "phrase", "n_words", "a", "m.l", "m.r", "n", "m.score")


def collocations(docs: DataFrame, min_count: int = 100, max_words: int = 5, first: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``first`` collocations of each language.

    Null languages count as "und", null and empty texts have no words; repeated rows count each. An empty table gives no
    rows. Ties: score and a descending, then the phrase by its bytes, so ranks never tie. Extra columns are ignored,
    whatever their names. A language's share of the rows does not matter: n-grams are summed up in each task, and ranks
    are found within SALTS parts of a language before its first rows meet.
    """
    if max_words < 2 or min_count < 1:
        raise ValueError("max_words: 2 or more, min_count: 1 or more")
    with scratch(docs.sparkSession, "collocations") as step:
        phrases, totals = frequent_phrases(docs, min_count, max_words, step)
        rows = scored(phrases, totals)
        words = F.split("phrase", " ")
        part = lambda start: F.array_join(F.slice(words, F.lit(start), F.col("n_words") - 1), " ")
        inside = phrases.filter("n_words >= 3").select("lang", "f", F.explode(F.array(part(1), part(2))).alias("phrase"))
        inside = inside.groupBy("lang", "phrase").agg(F.max("f").alias("a"))
        rows = rows.join(inside, ["lang", "phrase", "a"], "left_anti")  # an extension is never more frequent than its part
        order = [F.desc("score"), F.desc("a"), "phrase"]
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
        near = salted.withColumn("near", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("near") <= first)
        ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= first)
        return stage(ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")


def query(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))


SQL = r"""
with recursive texts as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
pieces as (select lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') as w from texts),
placed as (select lang, w, unnest(range(1, len(w) + 1)) as i from pieces),
grams as (select lang, array_to_string(w[i:i + m - 1], ' ') as phrase, m from placed, range(1, 6) as sizes(m) where i + m - 1 <= len(w)),
totals as (select lang, count(*) as n from placed group by lang),
f as (select lang, phrase, m, count(*) as f from grams group by all having count(*) >= 100),
cuts as (
  select c.lang, c.phrase, c.m, c.f as a, k, array_to_string(string_split(c.phrase, ' ')[1:k], ' ') as x, array_to_string(string_split(c.phrase, ' ')[k + 1:c.m], ' ') as y
  from f c, range(1, 5) as ks(k) where c.m >= 2 and k < c.m),
scored as (
  select cuts.lang, cuts.phrase, cuts.m, cuts.a, k, l.f as l, r.f as r, n, ((1000::hugeint * cuts.a * n) // (l.f::hugeint * r.f))::bigint as score
  from cuts join f l on l.lang = cuts.lang and l.phrase = x join f r on r.lang = cuts.lang and r.phrase = y join totals on totals.lang = cuts.lang),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
kept as (
  select * from best b where not exists (select 1 from f g where g.lang = b.lang and g.m > b.m and g.f >= b.a and contains(' ' || g.phrase || ' ', ' ' || b.phrase || ' ')))
select lang, rank, phrase, a, l, r, n, score from (
  select lang, row_number() over (partition by lang order by score desc, a desc, phrase)::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score from kept)
where rank <= 2000
"""
