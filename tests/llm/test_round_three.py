"""Operators 11 to 13 against brute force: fill-in-the-middle, repeated substrings, collocations."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gausstide.llm import collocations, fill_in_middle, suffix_dedup
from gausstide.llm.common import text_key


# ---- repeated substrings


def brute_spans(rows, length):
    """Per row: the bytes that a repeated string of ``length`` bytes covers."""
    seen = Counter(d[x : x + length] for d in rows for x in range(len(d) - length + 1))
    out = []
    for d in rows:
        gone = bytearray(len(d))
        for x in range(len(d) - length + 1):
            if seen[d[x : x + length]] > 1:
                gone[x : x + length] = b"\1" * length
        kept = bytes(c for c, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), len(re.findall(b"\1+", bytes(gone))), kept))
    return out


def passages(seed, length):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé ") for _ in range(rnd.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))[: 6 * n]
    shared = [prose(length // 3)[: length + d] for d in (-20, -1, 0, 1, 40, length)]
    texts = [prose(rnd.randint(1, 200)) for _ in range(20)]
    texts += [prose(rnd.randint(0, 40)) + rnd.choice(shared) + prose(rnd.randint(0, 40)) + rnd.choice(shared) for _ in range(40)]
    near = prose(3 * length // 4)
    for _ in range(8):  # near copies: one byte differs
        at = rnd.randrange(len(near))
        texts.append(near[:at] + "#" + near[at + 1 :])
    return [*texts, texts[0], texts[25], "x" * (3 * length), "xy" * length, "", None, shared[0] * 3, shared[4][5:], "é" * length]


@pytest.mark.parametrize(("length", "hot", "seed"), [(64, 1000, 1), (64, 3, 2), (100, 4, 3), (400, 1000, 4)])
def test_repeated_substrings(spark, monkeypatch, length, hot, seed):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    texts = passages(seed, length)
    rows = [(i % 57 if i % 11 else None, t, "x") for i, t in enumerate(texts)]  # ids repeat, some are null
    rows += rows[30:33]  # repeated in full
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(5)
    got = suffix_dedup.without_repeats(docs, length).collect()
    want = brute_spans([(t or "").encode() for _, t, _ in rows], length)
    named = sorted((str(i), t or "", *w) for (i, t, _), w in zip(rows, want, strict=True))
    assert sorted((str(r.doc_id), r.text or "", r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == named
    assert sum(w[1] for w in want) > 0


def test_runs_are_split_and_chunks_overlap(spark, monkeypatch):
    """Many small runs, ranges and chunks give what one of each gives."""
    texts = passages(7, 64)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").repartition(4)
    whole = suffix_dedup.repeated_spans(docs, 64)
    digest = lambda spans: sorted(map(tuple, suffix_dedup.remove_spans(docs, spans, digest=True).collect()))
    want = digest(whole)
    run = suffix_dedup.Run("0", 64, [b"b", b"d"], 3)
    data = b"abcde" * 40
    for p, lo, n in suffix_dedup.anchors_of(data, 64):
        for a in zip(p.tolist(), lo.tolist(), n.tolist(), strict=True):
            run.add(data, (1, 2, *a), False)
    assert {r[0] for r in run.emit()} >= {0, 1}
    monkeypatch.setattr(suffix_dedup, "RUN_BYTES", 2000)
    monkeypatch.setattr(suffix_dedup, "SAMPLE", 1)
    monkeypatch.setattr(suffix_dedup, "RANGE_ROWS", 5)
    assert digest(suffix_dedup.repeated_spans(docs, 64)) == want


def test_anchors_cover_every_window_once():
    rnd = random.Random(0)
    data = bytes(rnd.choice(b"ab") for _ in range(5000))
    for size in (1 << 20, 700):
        suffix_dedup.CHUNK, kept = size, suffix_dedup.CHUNK
        try:
            spans = [(p, lo, n) for part in suffix_dedup.anchors_of(data, 100) for p, lo, n in zip(*(x.tolist() for x in part), strict=True)]
        finally:
            suffix_dedup.CHUNK = kept
        starts = [x for _, lo, n in spans for x in range(lo, lo + n)]
        assert starts == list(range(len(data) - 99))
        assert all(lo + n - 1 <= p <= lo + 49 for p, lo, n in spans)
        offset = {}
        for p, lo, n in spans:
            for x in range(lo, lo + n):
                assert offset.setdefault(data[x : x + 100], p - x) == p - x


def test_loser_tree_compares_no_known_byte():
    rnd = random.Random(3)
    words = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(1, 30))) for _ in range(400)]
    runs = []
    for r in range(7):
        own, before, coded = sorted(words[r::7]), b"", []
        for w in own:
            coded.append((suffix_dedup.common_prefix(before, w), suffix_dedup.Entry(w, b"", False, (0,))))
            before = w
        runs.append(coded)
    out = list(suffix_dedup.LoserTree([iter(r) for r in runs]))
    assert [e.suffix for _, e in out] == sorted(words)
    before = b""
    for common, e in out:
        assert common == suffix_dedup.common_prefix(before, e.suffix)
        before = e.suffix
    assert list(suffix_dedup.LoserTree([])) == []


def test_no_repeats_in_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.without_repeats(docs).collect() == []
    with pytest.raises(ValueError, match="64 bytes"):
        suffix_dedup.repeated_spans(docs, 10)


# ---- fill in the middle


def brute_fim(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd_texts():
    rnd = random.Random(5)
    alphabet = ["a", "Z", "b", " ", "\n", "é", "中", "😀", "1", "_", "{"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 3000))) for _ in range(60)]
    return [*texts, None, "", "x" * 200_000, "é" * 70_000, "ab <P> cd", "a<M>", "<S", "\x00퟿", "word " * 30_000, texts[0], texts[0]]


@pytest.mark.parametrize(("stride", "block"), [(512, 1 << 16), (3, 7), (1, 1), (1000, 64)])
def test_checkpoints_find_every_unit(stride, block):
    text = "".join(random.Random(1).choice("aZ é中\n") for _ in range(700))
    ends = [0]
    for u in re.findall("[A-Za-z]+|[^A-Za-z]", text):
        ends.append(ends[-1] + len(u))
    index = fill_in_middle.Checkpoints(text.encode(), stride, block)
    assert (index.n, index.n_chars) == (len(ends) - 1, len(text))
    for u, e in enumerate(ends):
        assert index.end_of(u) == (len(text[:e].encode()), e)


def test_fill_in_middle(spark):
    rows = [(i if i % 13 else None, t, 5) for i, t in enumerate(odd_texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h1 int")
    got = fill_in_middle.infilled(docs).collect()
    want = sorted(map(str, ((i, t, 5, *brute_fim(i, t)) for i, t, _ in rows)))
    assert sorted(map(str, (tuple(r) for r in got))) == want
    forms = {r.form for r in got}
    assert forms == {"plain", "psm", "spm"}
    assert all(fill_in_middle.restore(r.output.encode(), r.form).decode() == (r.text or "") for r in got)
    digests = fill_in_middle.infilled(docs, digest=True)
    assert digests.columns == ["doc_id", "h1", "units", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert sorted((r.output_sha256, r.restored_sha256) for r in digests.collect()) == sorted((sha(brute_fim(i, t)[-1]), sha(t or "")) for i, t, _ in rows)
    assert fill_in_middle.infilled(docs.limit(0)).collect() == []


# ---- collocations


def brute_collocations(rows, least, most, first):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = [w for w in re.split("[ \t]", piece) if w]
            n[lang] += len(words)
            for m in range(1, most + 1):
                f[lang].update(" ".join(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, counts in f.items():
        found = []
        frequent = {p: c for p, c in counts.items() if c >= least}
        for p, a in frequent.items():
            w = p.split(" ")
            if len(w) < 2:
                continue
            if any(c >= a and len(q) > len(p) and f" {p} " in f" {q} " for q, c in frequent.items() if q.count(" ") > p.count(" ")):
                continue
            cuts = [(1000 * a * n[lang] // (counts[" ".join(w[:k])] * counts[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            found.append((-score, -a, p.encode(), counts[" ".join(w[:k])], counts[" ".join(w[k:])]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:first], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize(("least", "most", "first", "bits"), [(3, 5, 2000, 1 << 26), (2, 4, 7, 1 << 26), (3, 5, 50, 64), (4, 2, 10, 1 << 26)])
def test_collocations(spark, monkeypatch, least, most, first, bits):
    monkeypatch.setattr(collocations, "BITMAP_BITS", bits)
    monkeypatch.setattr(collocations, "HELD", 40)
    rnd = random.Random(2)
    words = ["New", "york", "city", "é", "of", "the", "中", "a", "\x1c", "x\x00"]
    ends = [" ", " ", " ", "  ", "\t", ". ", "\n", "\x0b", ",", "!"]
    rows = [("".join(rnd.choice(words) + rnd.choice(ends) for _ in range(rnd.randint(0, 60))), rnd.choice(["en", "en", "en", "fr", None])) for _ in range(60)]
    rows += [("new york city hall " * 5, "en")] * 3 + [(None, "en"), ("", None), ("a a a a a a a. a a", "xx"), ("\xff \xfe", "xx")]
    docs = spark.createDataFrame([(t, lang, 1, "n") for t, lang in rows], "text string, lang string, rank int, phrase string")
    got = sorted(map(tuple, collocations.collocations(docs, least, most, first).collect()))
    assert got == brute_collocations(rows, least, most, first)


def test_collocations_of_nothing(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(docs).collect() == []
    with pytest.raises(ValueError, match="max_words"):
        collocations.collocations(docs, max_words=1)


def test_hashes_agree_with_spark(spark):
    import xxhash

    row = spark.sql("select 'größe 中' as p").select(F.xxhash64("p").alias("h")).first()
    assert row.h % (1 << 26) == xxhash.xxh64_intdigest("größe 中".encode(), 42) % (1 << 26)
    assert spark.createDataFrame([(None,)], "text string").select(text_key().alias("k")).first().k is not None
