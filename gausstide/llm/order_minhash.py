"""Operator 3: document fingerprints by Order MinHash.

A k-mer begins at every code point and is K code points long, or as many as there are before the next bound; bounds are
a fixed set of letters and digits and every code point beyond ASCII. What is a k-mer follows from the code points there
and from nothing else: no length, place or neighbouring blank plays a part, so an edit changes the few k-mers it
touches, whatever stands before it and in any script. Each k-mer is numbered by its occurrence, so a repeated k-mer counts as often as it stands. Every
numbered k-mer is hashed once; the hashes are dealt into SKETCH parts, and in each part the TUPLE least hashes are kept
(one permutation instead of SKETCH of them). What is kept is put back into text order and hashed as a tuple. Two texts
share a tuple when they share its k-mers and their order, which makes the likeness follow edit distance rather than
bags of words. A text passes through one row expression: sort, runs, sort; no k-mer becomes a row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from gausstide.llm.common import BLANKS, free, table, text_key

#: Code points of a k-mer.
K = 4
#: No k-mer reaches over these ASCII characters, about one in five of European prose, nor over a code point beyond ASCII; they begin k-mers of their own.
BOUNDS = "aioAIO048"


def kmer_pattern(k: int) -> str:
    """At each code point that one and up to k - 1 more that are no bounds, as group 1; the matches are empty, so they begin everywhere (never between two surrogates)."""
    return f"(?=([^\\p{{Cs}}][\\x00-\\x7F&&[^{BOUNDS}]]{{0,{k - 1}}}))"


#: A k-mer is one long: 40 bits of hash above 24 bits of place.
PLACE_BITS = 24
PLACE = (1 << PLACE_BITS) - 1
SKETCH = 32
TUPLE = 2
#: Of a text's hashes about so many of the least are looked at first, those below a bound set by their number; if they do not fill every part, all are.
LEAST = 384
#: Documents of one bucket of the ascending order, about.
BUCKET_ROWS = 2_000
MAX_BUCKETS = 20_000


def _bound(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once; an expression that a lambda names directly may be computed anew for every element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _packed(h: Column, place: Column) -> Column:
    return h.bitwiseAND(F.lit(~PLACE)).bitwiseOR(place)


def _hashes(text: Column, k: int, origin: Column | None = None) -> Column:
    """The packed hashes of a text's k-mers in text order, places counted from ``origin`` (0 if none is given)."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(kmer_pattern(k)), F.lit(1))
    return F.transform(words, lambda w, i: _packed(F.xxhash64(w), (i if origin is None else i + origin).cast("long").bitwiseAND(F.lit(PLACE))))


def _bare(x: Column) -> Column:
    return F.shiftright(x, PLACE_BITS)


def _numbered(g: str) -> Column:
    """The hashes of (k-mer, occurrence) from the column ``g``, the sorted ones of k-mers. It names ``g`` more than once, so that Spark keeps it as a column, sorted as primitives.

    Passes that pair an array with another take fewer steps for an element than lookups at its place.
    """
    changes = lambda a: F.zip_with(a, F.concat(F.array(F.bitwise_not(F.get(a, F.lit(0)))), a), lambda x, y: x.bitwiseXOR(y).bitwiseAND(F.lit(~PLACE)) != 0)
    begins = lambda a: _bound(changes(a), lambda c: F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: F.get(c, i)))
    # a run of equal hashes lists its places in text order: the place in the run is the occurrence number
    ends = lambda a, r: F.concat(F.slice(r, F.lit(2), F.size(r) - 1), F.array(F.size(a)))
    occurrences = lambda a: _bound(begins(a), lambda r: F.flatten(F.zip_with(r, ends(a, r), lambda x, y: F.sequence(F.lit(0), y - x - 1))))
    marks = lambda a: F.zip_with(a, occurrences(a), lambda x, o: _packed(F.xxhash64(_bare(x), o), x.bitwiseAND(F.lit(PLACE))))
    return F.when(F.size(g) > 0, _bound(F.col(g), marks)).otherwise(F.col(g))


def _by_part(least: Column, bits: int) -> Column:
    """Hashes as (part, order, place). A part is the lowest bits of a hash, so the least hashes are of all parts."""
    order = lambda x: F.shiftrightunsigned(x.bitwiseXOR(F.lit(-(1 << 63))), PLACE_BITS + bits)
    return F.transform(least, lambda x: F.shiftleft(_bare(x), 64 - bits).bitwiseOR(F.shiftleft(order(x), PLACE_BITS)).bitwiseOR(x.bitwiseAND(F.lit(PLACE))))


def _picked(k: str, bits: int, size: int) -> Column:
    """The ``size`` least of each part, the part in the upper bits, from the column ``k``, which is sorted. It names ``k`` more than once, so that Spark keeps it as a column, sorted as primitives."""
    part = lambda x: F.shiftrightunsigned(x, 64 - bits)
    picked = _bound(F.col(k), lambda a: F.filter(a, lambda x, i: (i < size) | (part(F.get(a, i - size)) != part(x))))
    return F.when(F.size(k) <= size, F.col(k)).otherwise(picked)


def _signed(df: DataFrame, g: str, out: str, sketch: int, size: int) -> DataFrame:
    """Adds the signature ``out`` from the column ``g``, the sorted hashes of k-mers."""
    _n, _k, _m = free([*df.columns, out], "_n", "_k", "_m")
    bits = sketch.bit_length() - 1
    df = df.withColumn(_n, _numbered(g))
    # hashes are uniform; what a part keeps of those below any bound is right as soon as the part is filled
    bound = F.expr(f"{1 - (1 << 63)}L + ({(1 << 63) - 1}L div greatest(size({_n}), {2 * LEAST})) * {2 * LEAST}L")
    least = F.when(F.size(_n) <= 2 * LEAST, F.col(_n)).otherwise(_bound(bound, lambda t: F.filter(_n, lambda x: x <= t)))
    df = df.withColumn(_k, F.sort_array(_by_part(least, bits)))
    df = df.withColumn(_m, _picked(_k, bits, size))
    enough = (F.size(_n) <= 2 * LEAST) | (F.size(_m) == sketch * size)
    df = df.withColumn(_k, F.when(~enough, F.sort_array(_by_part(F.col(_n), bits))))
    df = df.withColumn(_m, F.when(F.col(_k).isNull(), F.col(_m)).otherwise(_picked(_k, bits, size)))
    part = lambda x: F.shiftrightunsigned(x, 64 - bits)

    def gathered(m, x, i):
        # hashes are sorted, so the members of a part stand together
        own = F.filter(F.slice(m, i + 1, F.lit(size)), lambda y: part(y) == part(x))
        ordered = F.transform(F.sort_array(F.transform(own, lambda y: F.struct(y.bitwiseAND(F.lit(PLACE)).alias("i"), _bare(y).alias("h")))), lambda y: y["h"])
        named = F.shiftleft(part(x), 64 - bits).bitwiseOR(F.shiftrightunsigned(F.xxhash64(ordered), bits))
        return F.when((i == 0) | (part(F.get(m, i - 1)) != part(x)), named)

    signature = _bound(F.col(_m), lambda m: F.filter(F.transform(m, lambda x, i: gathered(m, x, i)), lambda x: x.isNotNull()))
    return df.withColumn(out, signature).drop(_n, _k, _m)


def with_signature(df: DataFrame, text: str, out: str, k: int = K, sketch: int = SKETCH, size: int = TUPLE) -> DataFrame:
    """Adds ``out``: an array of longs, one for each of the ``sketch`` (a power of two) parts that k-mers fall into, the part in its upper bits.

    Null and empty texts have an empty array; every code point of another text begins a k-mer. Input columns keep their
    names and values, unless one is named ``out``. Places are counted up to 2**24 k-mers; beyond, k-mers of one tuple may
    change their order.
    """
    (_g,) = free([*df.columns, out], "_g")
    return _signed(df.withColumn(_g, F.sort_array(_hashes(F.col(text), k))), _g, out, sketch, size).drop(_g)


def with_signatures_of_edit(df: DataFrame, text: str, keep: str, added: str, out: str, edited_out: str, k: int = K, sketch: int = SKETCH, size: int = TUPLE) -> DataFrame:
    """Adds what ``with_signature`` gives for ``text`` and for the text edited at its end, its first ``keep`` code points followed by ``added``.

    Both have the k-mers that end before ``keep``, at the same places, so these are told and hashed once.
    """
    _h, _g, _e, _q = free([*df.columns, out, edited_out], "_h", "_g", "_e", "_q")
    whole = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn(_q, F.greatest(F.col(keep) - (k - 1), F.lit(0)))
    behind = F.concat(F.substring(whole, F.col(_q) + 1, F.col(keep) - F.col(_q)), F.coalesce(F.col(added), F.lit("")))
    df = df.withColumn(_h, _hashes(whole, k))
    df = df.withColumns({_g: F.sort_array(_h), _e: F.sort_array(F.concat(F.slice(_h, F.lit(1), F.col(_q)), _hashes(behind, k, F.col(_q))))}).drop(_h, _q)
    return _signed(_signed(df, _g, out, sketch, size).drop(_g), _e, edited_out, sketch, size).drop(_e)


def fingerprint(signature: str) -> Column:
    """A signature as text: 16 hex digits a tuple."""
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: str, b: str, sketch: int = SKETCH) -> Column:
    """The share of equal tuples among the parts that either text fills; 1 if neither fills any."""
    parts = lambda s: F.transform(s, lambda x: F.shiftrightunsigned(x, 64 - (sketch.bit_length() - 1)))
    used = F.size(F.array_union(parts(a), parts(b)))
    return F.when(used == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / used)


def with_next(docs: DataFrame, columns: list[str], key: str = "doc_id", derive: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``docs`` with next_<column>: the values of the next row in ascending ``key`` (nulls first, then by text key), after the last those of the first.

    ``derive`` adds columns, which ``columns`` may name, once the rows are in place, so that nothing before computes them
    too; it finds next_<column> of the input's own columns there.

    The order is cut into buckets at quantiles of the key, which is a number, found on the driver (BUCKET_ROWS rows each,
    MAX_BUCKETS at most; the window spills). Every bucket also gets the first row of the next filled one, so windows need
    no neighbour. Input columns keep their names and values; an empty table stays empty.
    """
    _bucket, _tie, _extra, _k, _t, _to = free(docs.columns, "_bucket", "_tie", "_extra", "_k", "_t", "_to")
    spark = docs.sparkSession
    n = docs.count()
    parts = max(1, min(MAX_BUCKETS, n // BUCKET_ROWS))
    cuts = sorted(set(docs.approxQuantile(key, [i / parts for i in range(1, parts)], 1 / (4 * parts)))) if parts > 1 else []
    cuts = [int(c) for c in cuts]
    bucket = _bucket_of(key, cuts)
    keyed = docs.withColumns({_bucket: bucket, _tie: text_key(), _extra: F.lit(0)})
    firsts = keyed.groupBy(_bucket).agg(F.min(F.struct(F.col(key).isNotNull().alias("n"), F.col(key).alias("k"), F.col(_tie).alias("t"))).alias("f")).select(_bucket, "f.*").collect()
    firsts.sort(key=lambda r: r[0])
    given = [c for c in columns if c in docs.columns]
    late = [c for c in columns if c not in given]
    if not firsts:
        docs = derive(docs.withColumns({f"next_{c}": F.col(c) for c in given}))
        return docs.withColumns({f"next_{c}": F.col(c) for c in late})
    before = [firsts[i - 1][0] for i in range(len(firsts))]  # the first bucket's head goes behind the last
    heads = spark.createDataFrame([(r[2], r[3], b) for r, b in zip(firsts, before, strict=True)], T.StructType([T.StructField(_k, docs.schema[key].dataType), T.StructField(_t, T.LongType()), T.StructField(_to, T.IntegerType())]))
    own = keyed.drop(_bucket)
    extra = own.join(F.broadcast(heads), own[key].eqNullSafe(heads[_k]) & (own[_tie] == heads[_t])).dropDuplicates([_to])
    extra = extra.withColumns({_bucket: F.col(_to), _extra: F.lit(1)}).select(*keyed.columns)
    inside = W.partitionBy(_bucket).orderBy(_extra, key, _tie)
    both = derive(keyed.unionByName(extra).withColumns({f"next_{c}": F.lead(c).over(inside) for c in given}))
    both = both.withColumns({f"next_{c}": F.lead(c).over(inside) for c in late})
    return both.filter(F.col(_extra) == 0).drop(_bucket, _tie, _extra)


def _bucket_of(key: str, cuts: list[int]) -> Column:
    """The number of cuts at or below the key, as a balanced tree of comparisons."""

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col(key) < cuts[middle], among(low, middle)).otherwise(among(middle + 1, high))

    return F.when(F.col(key).isNull(), F.lit(0)).otherwise(among(0, len(cuts)))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def signed(df):
        n = F.char_length("text")
        df = df.withColumns({"n_chars": n.cast("long"), "keep": n - F.floor(n / 4).cast("int")})
        df = df.withColumn("end", F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), F.col("n_chars").cast("int") - F.col("keep")))
        edited = F.concat(F.substring("text", F.lit(1), F.col("keep")), F.col("end"))
        df = with_signatures_of_edit(df.withColumn("edited_sha256", F.sha2(edited, 256)), "text", "keep", "end", "sig", "edited_sig")
        return df.drop("text", "next_text", "keep", "end")

    both = with_next(docs, ["text", "sig"], derive=signed)
    return both.select("doc_id", "n_chars", "edited_sha256", fingerprint("sig").alias("fingerprint"), fingerprint("edited_sig").alias("edited_fingerprint"), likeness("sig", "edited_sig").alias("near_edited"), likeness("sig", "next_sig").alias("near_next"))
