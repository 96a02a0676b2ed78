"""Findings of round 3."""

import hashlib
import random
import struct
import tracemalloc
from collections import Counter, defaultdict
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as contract
from gausstide.llm import collocations, order_minhash, suffix_dedup
from gausstide.llm.common import text_key

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("copies", [60, 400])
def test_matrix_exponential_at_large_counts(spark, tmp_path, copies):
    """matexp_d2 follows its SQL where exponents pass 40 and where they overflow."""
    duckdb.sql(f"copy (select e.* from '{SMALL}/events.parquet' e, range({copies})) to '{tmp_path}/events.parquet'")
    db = duckdb.connect()
    db.sql("set timezone = 'UTC'")
    db.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    want = db.sql(contract.oracle_sql()["matexp_d2"]).df().sort_values("t").to_numpy(float)
    got = contract.queries()["matexp_d2"](spark, str(tmp_path)).toPandas().sort_values("t").to_numpy(float)
    assert np.nanmax(want[np.isfinite(want)]) > np.exp(40) and np.isfinite(want).all() == (copies == 60)
    assert np.allclose(got, want, rtol=1e-9, atol=1e-6, equal_nan=True)


# ---- operator 3


def kmers(text):
    """A k-mer from every code point on, up to K long, before the next bound."""
    free = lambda c: ord(c) < 128 and c not in "aioAIO048"
    ends = [next((j for j in range(i + 1, i + order_minhash.K) if j >= len(text) or not free(text[j])), i + order_minhash.K) for i in range(len(text))]
    return [text[i:j] for i, j in enumerate(ends)]


def signature(text, size=2):
    """Order MinHash in plain Python, the hashes too: {part: tuple of hashes in text order}."""
    signed = lambda x, bits=64: (x + 2 ** (bits - 1)) % 2**bits - 2 ** (bits - 1)
    hashed = lambda data, seed=42: signed(xxhash.xxh64_intdigest(data, seed % 2**64))
    seen, parts = Counter(), defaultdict(list)
    for i, word in enumerate(kmers(text)):
        h = hashed(word.encode()) >> 24
        m = hashed(struct.pack("<i", seen[h]), hashed(struct.pack("<q", h))) >> 24
        seen[h] += 1
        parts[m % 32].append((m, i))
    out = set()
    for p, members in parts.items():
        h = 42
        for m, _ in sorted(sorted(members)[:size], key=lambda x: x[1]):
            h = hashed(struct.pack("<q", signed(p << 35 | (m % 2**40 ^ 2**39) >> 5, 40)), h)
        out.add((p, (p << 59 | h % 2**64 >> 5)))
    return out


def alike(a, b):
    used = {p for p, _ in a | b}
    return len(a & b) / len(used) if used else 1.0


def likeness_of(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i long, a string, b string")
    for c in "ab":
        df = order_minhash.with_signature(df, c, f"s{c}")
    return [r.l for r in df.select("i", order_minhash.likeness("sa", "sb").alias("l")).orderBy("i").collect()]


def test_every_code_point_counts(spark):
    """Texts that differ only far from any of the nine letters and digits."""
    rng = random.Random(8)
    bare = lambda n: "".join(rng.choice("bcdefghjklmnpqrstuvwxyz") for _ in range(n))
    head = bare(4)
    t = bare(400)
    got = likeness_of(spark, [(head + bare(500), head + bare(500)), ("a" + head + bare(60), "a" + head + bare(60)), (t, "x" + t), (t, t[:200] + "y" + t[200:])])
    assert got[0] < 0.1 and got[1] < 0.3 and got[2] > 0.8 and got[3] > 0.8, got


@pytest.mark.parametrize("least", [order_minhash.LEAST, 64])
def test_signatures_of_every_position(spark, monkeypatch, least):
    """Against plain Python; with few of the least hashes looked at first, all are looked at where those do not do."""
    monkeypatch.setattr(order_minhash, "LEAST", least)
    rng = random.Random(5)
    prose = lambda n: " ".join(rng.choice(["one", "two", "three", "x" * 17, "y" * 16, "0a8"]) for _ in range(n))
    texts = ["", "a", "b", "bcd", "bcdfg", "aaaa bbbb aaaa", "𝔞😀a😀bcdf", "naïve été 中文\n\r\u2028x", "z" * 3000, prose(120), prose(2000), "".join(chr(rng.randrange(32, 126)) for _ in range(4000))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(len(texts), None)], "i long, t string")
    got = {r.i: r.s for r in order_minhash.with_signature(df, "t", "s").collect()}
    for i, t in enumerate([*texts, ""]):
        assert sorted(x % 2**64 for x in got[i]) == sorted(x for _, x in signature(t)), i


def test_fingerprint_query_of_every_position(spark):
    """near_edited and near_next of every document against plain Python."""
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in order_minhash.query(spark, SMALL).collect()}
    assert len(got) == len(docs)
    signed = {d: signature(t) for d, t in docs}
    for (d, t), (after, other) in zip(docs, docs[1:] + docs[:1], strict=True):
        r, cut = got[d], len(t) // 4
        edited = t[: len(t) - cut] + other[:cut]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - alike(signed[d], signature(edited))) < 1e-9 and abs(r.near_next - alike(signed[d], signed[after])) < 1e-9


def test_numbered_hashes_are_not_sorted(spark):
    """Sorting all numbered hashes of a text costs a seventh of the signature; a bound picks the least ones. Only the k-mers are sorted whole."""
    plan = order_minhash.with_signature(spark.createDataFrame([("a",)], "t string"), "t", "s")._jdf.queryExecution().analyzed().toString()
    sorted_whole = [name for name in ("_g", "_n") if f", true) AS {name}#" in plan]
    assert sorted_whole == ["_g"], sorted_whole


@pytest.mark.parametrize("least", [order_minhash.LEAST, 64])
def test_signatures_of_an_edit_share_hashes(spark, monkeypatch, least):
    """A text and its edited text are signed together, the k-mers of what stays told once; each has its own signature all the same."""
    monkeypatch.setattr(order_minhash, "LEAST", least)
    rng = random.Random(12)
    prose = lambda n: " ".join(rng.choice(["one", "two", "three", "x" * 17, "𝔞é", "0a8"]) for _ in range(n))
    texts = ["", "a", "bcd", "bcdf", "bcdfg", None, "z" * 3000, "😀" * 9, prose(40), prose(900)]
    rows = [(i, t, keep, end) for i, (t, keep, end) in enumerate((t, keep, end) for t in texts for end in ("", "xb", None, prose(30)) for keep in {0, 2, len(t or "") * 3 // 4, len(t or "")} if keep <= len(t or ""))]
    df = spark.createDataFrame(rows, "i long, t string, keep int, end string")
    both = order_minhash.with_signatures_of_edit(df, "t", "keep", "end", "a", "b")
    assert both.columns == ["i", "t", "keep", "end", "a", "b"]
    for i, t, keep, end in rows:
        rows[i] = (signature(t or ""), signature((t or "")[:keep] + (end or "")))
    for r in both.collect():
        assert [sorted(x % 2**64 for x in got) for got in (r.a, r.b)] == [sorted(x for _, x in want) for want in rows[r.i]], r.i
    plan = both._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all") == 2  # the text, and what follows it in the edited one


def test_next_text_is_there_to_derive_from(spark):
    """Signatures are made behind the shuffle, from a text and the next one."""
    df = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "doc_id long, text string")
    got = order_minhash.with_next(df, ["text", "n"], derive=lambda d: d.withColumn("n", F.concat_ws("-", "text", "next_text"))).collect()
    assert sorted((r.doc_id, r.n) for r in got) == [(1, "x"), (2, "z"), (3, "z-x")]


def test_next_rows_derive_once(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "doc_id long, text string")
    got = order_minhash.with_next(df, ["text", "n"], derive=lambda d: d.withColumn("n", F.length("text"))).collect()
    assert sorted((r.doc_id, r.next_text, r.next_n) for r in got) == [(1, None, None), (2, "z", 1), (3, "x", 1)]
    empty = order_minhash.with_next(df.limit(0), ["n"], derive=lambda d: d.withColumn("n", F.length("text")))
    assert empty.collect() == [] and "next_n" in empty.columns


# ---- operator 13


def test_counting_stays_small_in_memory():
    """A task's memory for 2.4 million words of a language, all words and pairs possibly frequent; no occurrence is lost."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 3000, 4000)) for _ in range(600)]
    batches = pa.table({"lang": ["en"] * 600, "text": texts}).to_batches(max_chunksize=50)
    every = SimpleNamespace(value=b"\xff" * 1024)
    for level in (1, 2):
        seen, rows = 0, 0
        tracemalloc.start()
        for b in collocations._counts(level, 5, (every,) * (level - 1), collocations.HELD)(iter(batches)):
            seen, rows = seen + sum(b.column("c").to_pylist()), rows + b.num_rows
        peak = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        assert seen == 600 * (4001 - level) and rows < seen
        assert peak < 100, (level, peak)


# ---- operator 12


def test_only_texts_with_spans_are_shuffled(spark):
    """Of 2,000 texts 20 have spans; the others pass without meeting the list, and the result is the plain one."""
    docs = spark.range(2000).selectExpr("id as doc_id", "case when id % 100 = 7 then null else repeat(cast(id as string), 90) end as text", "id as text_key")
    spans = docs.filter("doc_id % 100 = 5").select("doc_id", text_key().alias("text_key"), F.lit(10).alias("start"), F.lit(40).alias("stop"))
    got = suffix_dedup.remove_spans(docs, spans).collect()
    want = {i: b"" if i % 100 == 7 else str(i).encode() * 90 for i in range(2000)}
    assert len(got) == 2000 and all(r.text_key == r.doc_id and bytes(r.kept) == (w[:10] + w[40:] if r.doc_id % 100 == 5 else w) for r in got for w in [want[r.doc_id]])
    keyed = docs.withColumn("text_key", text_key())
    listed = suffix_dedup.with_listed(keyed, "text_key", spans.select("text_key"), "listed").filter("listed")
    assert {r.doc_id for r in listed.collect()} >= set(range(5, 2000, 100)) and listed.count() < 40


def test_bitmap_has_every_key(spark, monkeypatch):
    """One row of the bitmap and many; the least and greatest keys."""
    edge = [0, 1, 7, 8, 2**15 - 1, 2**15, 2**26 - 1, 2**26, -1, -(2**63), 2**63 - 1]
    for bits in (1 << 15, 1 << 26):
        monkeypatch.setattr(suffix_dedup, "BITMAP_BITS", bits)
        for k in edge:
            rows = suffix_dedup.with_listed(spark.createDataFrame([(x,) for x in edge], "x long"), "x", spark.createDataFrame([(k,)], "k long"), "in").collect()
            assert len(rows) == len(edge) and {r.x for r in rows if r["in"]} == {x for x in edge if (x - k) % bits == 0}, (bits, k)
