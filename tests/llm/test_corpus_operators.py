import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gausstide.llm import licences, mixture, queries, token_counts, toxicity, url_filter
from test_text_operators import brute_components, brute_score

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in "documents pages benchmark".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    a, b = queries.queries()[name](spark, SF).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns) and len(a) == len(b)
    # whole numbers with nulls come as floats from one side and as nullable integers from the other
    a, b = (x[cols].sort_values(cols).reset_index(drop=True).convert_dtypes().astype(str) for x in (a, b))
    assert a.equals(b)


# ---- operator 5


def test_url_filter_cases(spark):
    entries = spark.createDataFrame([("ads", "Bad.org", "add", "2024-02-01"), ("ads", "bad.org", "remove", "2024-03-01"), ("ads", "bad.org", "add", "2024-03-01"), ("spam", "x.bad.org", "add", "2024-01-05"), ("spam", None, "add", "2024-01-01"), ("ads", "bad.org", "add", "2024-02-01")], "category string, pattern string, action string, since string").withColumn("since", F.to_date("since"))
    rows = [(1, "http://bad.org/", "2024-01-31"), (2, "HTTPS://u:p@BAD.org.:8080/a?b", "2024-02-01"), (3, "http://a.bad.org", "2024-02-29"), (4, "http://bad.org", "2024-03-01"), (5, "http://x.bad.org#f", "2024-06-01"), (6, "http://notbad.org", "2024-02-02"), (7, None, "2024-02-02"), (8, "nonsense", "2024-02-02"), (9, "http://bad.org", None), (9, "http://bad.org", None), (10, "", "2024-02-02")]
    captures = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, fetched string, host string, pattern int").withColumn("fetched", F.to_date("fetched"))
    out = url_filter.evaluate(captures, entries).collect()
    assert len(out) == len(rows) and {r.page_id for r in out if r.blocked} == {2, 3, 5}
    assert {r.page_id: (r.pattern, r.category, r.n_active) for r in out}[5] == ("x.bad.org", "spam", 1)
    assert not url_filter.evaluate(captures, entries.limit(0)).filter("blocked").count()
    assert url_filter.evaluate(captures.limit(0), entries).count() == 0


# ---- operator 8


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_allocation_against_brute_force(rule):
    rng = random.Random(1)
    for _ in range(300):
        lengths = np.array([rng.randrange(1, 6) for _ in range(rng.randrange(0, 9))], np.int64)
        edges = sorted(rng.randrange(0, 30) for _ in range(2 * rng.randrange(1, 4)))
        s, e = np.array(edges[::2]), np.array(edges[1::2])
        want, a = [0.0] * len(s), 0
        for n in lengths:
            share = [max(0, min(a + n, y) - max(a, x)) for x, y in zip(s, e)]
            if any(share):
                if rule == "split":
                    want = [w + x / n for w, x in zip(want, share)]
                else:
                    want[share.index(max(share)) if rule == "majority" else next(i for i, x in enumerate(share) if x)] += 1
            a += n
        got, _ = token_counts.allocate(lengths, s, e, rule)
        assert np.allclose(got, want)


def test_token_counts(spark):
    rows = [(1, "Héllo world\nmiddle line ñ\nlast"), (2, None), (3, ""), (4, "one line"), (4, "one line"), (None, "a\nb"), (5, "word " * 30_000)]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, section string, start int")
    out = token_counts.attribute_tokens(docs.withColumn("sections", token_counts.line_sections(F.col("text")))).collect()
    assert len(out) == 3 * len(rows)
    encoding, size = token_counts._encoding(token_counts.VOCABULARY, token_counts.PATTERN)
    for (d, t), n in Counter(rows).items():
        mine = [r for r in out if r.doc_id == d]
        assert sum(r.n_tokens for r in mine) == n * len(encoding.encode_ordinary(t or "")) and sum(r.n_chars for r in mine) == n * len(t or "")
        assert bytes(size[encoding.encode_ordinary(t or "")].sum().item()) == bytes(len((t or "").encode()))
    own = spark.createDataFrame([(1, "a", 0, 5), (1, "b", 5, 12)], "doc_id long, section string, start int, end int")
    some = token_counts.attribute_tokens(token_counts.attach_sections(docs.select("doc_id", "text"), own), rule="split").collect()
    assert {(r.doc_id, r.section) for r in some} == {(1, "a"), (1, "b")}
    assert token_counts.attribute_tokens(docs.limit(0).withColumn("sections", token_counts.line_sections(F.col("text")))).count() == 0


def test_overlapping_and_negative_sections(spark):
    text = "one two three four five six"
    given = [("b", 4, 13), ("a", -3, 7), ("n", None, 3), ("back", 20, 15)]
    docs = spark.createDataFrame([(1, text, given)], "doc_id long, text string, sections array<struct<section:string,start:int,end:int>>")
    out = {r.section: (r.n_chars, r.n_tokens) for r in token_counts.attribute_tokens(docs, rule="split").collect()}
    encoding, _ = token_counts._encoding(token_counts.VOCABULARY, token_counts.PATTERN)
    assert {k: v[0] for k, v in out.items()} == {"a": 7, "b": 6, "back": 0}
    assert abs(out["a"][1] + out["b"][1] - len(encoding.encode_ordinary(text[:13]))) < 1e-9 and out["back"][1] == 0


# ---- operator 9


def water(budget, weight, cap):
    """Shares by weight with caps, by repeated redistribution."""
    given, left, open_ = dict.fromkeys(weight, 0.0), budget, set(weight)
    while open_ and left > 1e-9:
        unit = left / sum(weight[k] for k in open_)
        full = {k for k in open_ if given[k] + unit * weight[k] >= cap[k]}
        if not full:
            for k in open_:
                given[k] += unit * weight[k]
            break
        for k in full:
            left -= cap[k] - given[k]
            given[k] = cap[k]
        open_ -= full
    return given


def test_budgets_against_brute_force(spark):
    rng = random.Random(4)
    leaves = [(f"d{a}", f"l{b}", f"s{c}", rng.choice([0, 5, 40, 900, 7000]), 1) for a in range(3) for b in range(3) for c in range(rng.randrange(1, 4))]
    frame = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long, rows long")
    explicit = {("d0",): 9000.0, ("d1", "l1"): 1.0}
    for total in (100.0, 9000.0, 10**6):
        got = {(r.domain, r.lang, r.source): r.budget for r in mixture.node_budgets(frame, F.lit(total), 2.0, 0.7, explicit).collect()}
        size = Counter()
        for *p, n, _ in leaves:
            for k in range(4):
                size[tuple(p[:k])] += n
        want = {(): min(total, 2.0 * size[()])}
        for d in range(3):
            for parent in [p for p in list(want) if len(p) == d]:
                kids = {k for k in size if len(k) == d + 1 and k[:d] == parent and size[k]}
                want |= water(want[parent], {k: explicit.get(k, size[k] ** 0.7) for k in kids}, {k: 2.0 * size[k] for k in kids})
        assert all(abs(got[k] - want.get(k, 0)) <= 1 for k in got)


def test_mixture_rows(spark, monkeypatch):
    monkeypatch.setattr(mixture, "BUCKET_ROWS", 7)
    rng = random.Random(6)
    rows = [(i, "w " * rng.randrange(0, 30), rng.choice(["en", None]), rng.choice(["a", "b", None]), 1) for i in range(120)] + [(None, "x y", "en", "a", 1), (7, None, None, None, 1), (500, "z " * 30_000, "fr", "c", 1)] + [(900, "same text", "en", "a", 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, copies int")
    tree = mixture.with_domain(docs)
    out = mixture.mix(tree, temperature=0.6).toPandas()
    assert len(out) == len(rows) and out["copies"].between(0, 2).all()
    leaf = out.assign(taken=out["copies"] * out["n_tokens"]).groupby(["domain", "lang", "source"])[["taken", "n_tokens"]].sum()
    assert (leaf["taken"] <= 2 * leaf["n_tokens"]).all() and abs(leaf["taken"].sum() - leaf["n_tokens"].sum()) <= out.groupby(["domain", "lang", "source"])["n_tokens"].max().sum()
    kept = mixture.mixed(docs, temperature=0.6)
    assert kept.columns == docs.columns and kept.count() >= out["copies"].sum()
    assert mixture.mix(tree.limit(0)).count() == 0


# ---- operator 10


def brute_licences(rows, threshold=licences.THRESHOLD, margin=licences.MARGIN):
    terms = lambda t: [w for w in re.split("[^a-z0-9]+", t.lower()) if w]
    vocabulary = {w for _, t in licences.TEMPLATES for w in terms(t)}
    parts = lambda x: re.split(licences.MARKS, x) if re.search(licences.MARKS, x) else []
    cut = lambda t: t.split("\n") + [y for x in t.split("\n") for y in parts(x)] + [p for p in re.split("\n[ \t\r]*\n", t) if "\n" in p]
    units = [(d, terms(x)) for d, t in rows if t is not None for x in cut(t)]
    df = Counter(w for _, x in units for w in set(x) if w in vocabulary)
    n = len(units)
    idf = lambda w: math.log((n + 1) / (df[w] + 1)) + 1 if w in vocabulary else math.log(n + 1) + 1
    norm = lambda c: math.sqrt(sum((k * idf(w)) ** 2 for w, k in c.items()))
    models = [(name, Counter(terms(t))) for name, t in licences.TEMPLATES]
    models = [(name, m, norm(m), [w for w in licences.NAMES[name] if w in m]) for name, m in models]
    best = defaultdict(list)
    for d, x in units:
        c, of = Counter(x), {}
        for name, m, size, must in models if x else []:
            if any(w not in c for w in must):
                continue
            cos = round(min(1.0, sum(c[w] * m[w] * idf(w) ** 2 for w in m) / norm(c) / size), 9)
            of[name] = max(of.get(name, 0), cos)
        order = sorted((-cos, name) for name, cos in of.items())
        if order and -order[0][0] >= threshold and (len(order) == 1 or order[1][0] - order[0][0] >= margin - 1e-9):
            best[d].append(order[0])
    return {d: min(v) for d, v in best.items()}


def test_licences_against_brute_force(spark):
    rng = random.Random(8)
    notices = [t for _, t in licences.TEMPLATES] + ["released under some license", "licensed to nobody"]
    rows = [(i, "\n".join(rng.choice(notices) if rng.random() < 0.05 else " ".join(rng.choice("the of to in under you is a b c d e f".split()) for _ in range(8)) for _ in range(6))) for i in range(80)] + [(100, None), (101, "")]
    files = spark.createDataFrame([(*r, "s/en/f", False, 1.0) for r in rows], "doc_id long, text string, path string, is_licence_file boolean, cosine double")
    got = {r.doc_id: (-r.cosine, r.own_licence) for r in licences.own_licences(files).collect()}
    want = brute_licences(rows)
    assert set(got) == set(want) and all(got[d][1] == want[d][1] and abs(got[d][0] - want[d][0]) < 1e-6 for d in got)


def test_common_notices_count(spark):
    """A notice in a third of the documents, and one that two tiny files share."""
    mit, gpl = "Released under the MIT License", "This work is licensed under the GNU General Public License, version 3"
    many = [(i, f"{mit}\nx{i} y" if i % 3 == 0 else f"the work of q{i}\nx{i} y") for i in range(300)]
    for rows, want in ((many, {i: "MIT" for i in range(0, 300, 3)}), ([(1, gpl), (2, gpl), (3, "other words")], {1: "GPL-3.0", 2: "GPL-3.0"})):
        got = {r.doc_id: r.own_licence for r in licences.own_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == want


def test_no_unit_within_reach_is_set_aside(spark):
    """Against the cosine of every unit with every template, without any filter."""
    rng = random.Random(12)
    words = [w for _, t in licences.TEMPLATES for w in t.split()] + ["zeta", "eta"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9)))) for i in range(150)] + [(200 + i, t + " zeta" * (i % 4) + " the" * (i % 3)) for i, (_, t) in enumerate(licences.TEMPLATES * 3)]
    rows += [(5000 + i, f"intro {i}\n\n" + "\n".join(" ".join(w) for w in (t.split()[:9], t.split()[9:]))) for i, (_, t) in enumerate(licences.TEMPLATES)]
    got = {r.doc_id: (round(-r.cosine, 6), r.own_licence) for r in licences.own_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: (round(c, 6), name) for d, (c, name) in brute_licences(rows).items()}


def test_confusable_licences(spark):
    gnu = "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU {0}General Public License\nas published by the Free Software Foundation; either version {1}\nof the License, or (at your option) any later version."
    whole = {t[0]: t[1] for t in licences.TEMPLATES}  # the last template of each, the whole text where there is one
    wrapped = lambda t: "Copyright (c) 2020 Somebody\n\n" + "\n".join(" ".join(t.split()[i : i + 11]) for i in range(0, len(t.split()), 11))
    cases = {
        "GPL-2.0": gnu.format("", 2), "GPL-3.0": gnu.format("", 3), "LGPL-2.1": gnu.format("Lesser ", 2.1), "AGPL-3.0": gnu.format("Affero ", 3),
        "BSD-2-Clause": wrapped(whole["BSD-2-Clause"]), "BSD-3-Clause": wrapped(whole["BSD-3-Clause"]), "ISC": wrapped(whole["ISC"]), "MIT": wrapped(whole["MIT"]),
        "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-4.0": "Licensed under CC BY 4.0", "Apache-1.1": "Licensed under the Apache Software License, Version 1.1",
    }
    undecided = ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", gnu.format("", 3).split("; either")[0]]
    for filler in (3, 1000):
        rows = [(i, t) for i, t in enumerate([*cases.values(), *undecided])] + [(100 + i, f"plain line {i} of some words") for i in range(filler)]
        got = {r.doc_id: r.own_licence for r in licences.own_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == dict(enumerate(cases))


def test_sentences_that_point_to_a_licence(spark):
    """Tags, pointers, grants behind code, and licences that no template knows."""
    cases = {
        "Distributed under the Boost Software License, Version 1.0.": "BSL-1.0", "SPDX-License-Identifier: MIT": "MIT", "// SPDX-License-Identifier: Apache-2.0": "Apache-2.0", "/* SPDX-License-Identifier: GPL-2.0-or-later */": "GPL-2.0",
        "This project is licensed under the MIT License - see the LICENSE file for details": "MIT", "This is free and unencumbered software released into the public domain.": "Unlicense",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.": "Zlib",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0": "EPL-2.0", "Licensed under the CC0 1.0 Universal": "CC0-1.0",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.": "BSD-3-Clause", "GNU AFFERO GENERAL PUBLIC LICENSE\n   Version 3, 19 November 2007": "AGPL-3.0",
        "int main() { return run(argc, argv); } // Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files": "MIT",
        "Distributed under the Frobnicate Software License, Version 1.0.": None, "SPDX-License-Identifier: WTFPL": None, "Licensed under the Quux License, Version 2.0": None, "See http://example.org/license for our terms": None,
    }
    for filler in (5, 200):
        rows = [(i, t) for i, t in enumerate(cases)] + [(100 + i, f"plain line {i} of some words\nand another # one") for i in range(filler)]
        got = {r.doc_id: r.own_licence for r in licences.own_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert {t: got.get(i) for i, t in enumerate(cases)} == cases and set(got) < set(range(100))


def test_licences_of_an_empty_table(spark):
    files = spark.createDataFrame([], "doc_id long, path string, text string, is_licence_file boolean, text_key int, dir string, unit string")
    assert licences.scan(files).count() == 0


def test_inheritance(spark):
    plain, mit, gpl = "nothing here", "Released under the MIT License", "This work is licensed under the GNU General Public License, version 3"
    rows = [(1, "repo/LICENSE", mit, True), (2, "repo/a/LICENSE", gpl, True), (3, "repo/a/b/c.py", plain, False), (4, "repo/x/y.py", plain, False), (5, "repo/a/own.py", mit, False), (6, "other/z.py", plain, False), (7, None, plain, False), (8, "top.py", None, None)] + [(100 + i, "big/f", "\n".join(["filler words only"] * 60), False) for i in range(5)]
    out = {r.doc_id: (r.licence, r.inherited_from) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, path string, text string, is_licence_file boolean")).collect()}
    assert [out[i] for i in range(1, 9)] == [("MIT", None), ("GPL-3.0", None), ("GPL-3.0", "repo/a"), ("MIT", "repo"), ("MIT", None), (None, None), (None, None), (None, None)]


# ---- pipeline


def brute_hits(docs, items, size=10):
    """Ids of documents with a run of ``size`` words of an item, or with all words of a shorter one."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower().decode())
    runs = {tuple(w[i : i + size]) for t in items for w in [cut(t)] if w for i in range(max(1, len(w) - size + 1))}
    lengths = {len(r) for r in runs}
    return {d for d, t in docs for w in [cut(t)] if any(tuple(w[i : i + n]) in runs for n in lengths for i in range(len(w) - n + 1))}


def test_pipeline_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, step in corpus_pipeline.STAGES:
        before = docs.select("doc_id", "text", "lang", "source").toPandas()
        rows = list(zip(before.doc_id, before.text, strict=True))
        docs = corpus_pipeline.stage(step(spark, docs, SF), f"test-{name}")
        after = Counter(r.doc_id for r in docs.select("doc_id").collect())
        if name != "sharding":
            assert docs.columns == columns
        if name == "toxicity":
            frame = spark.createDataFrame(rows, "doc_id long, text string")
            model = toxicity.fit(frame, spark.read.parquet(f"{SF}/labels.parquet"))
            assert after == Counter(d for d, t in rows if brute_score(t, model) < 0.5)
        if name == "near_copies":
            assert after == Counter(d for d, n, c in brute_components(rows, 5, 80) if d == c)
        if name == "decontamination":
            gone = brute_hits(rows, pd.read_parquet(f"{SF}/benchmark.parquet").text)
            assert gone and after == Counter(d for d, _ in rows if d not in gone)
        if name == "mixture":
            con = duckdb.connect()
            con.register("documents", before)
            copies = con.execute(mixture.SQL).df()
            assert after == Counter({int(d): int(c) for d, c in zip(copies.doc_id, copies.copies, strict=True) if c})
    assert after == Counter(before.doc_id)
    placed = docs.select("shard", "slot").toPandas()
    counts = placed.groupby("shard").slot.agg(["count", "nunique", "max"])
    assert len(counts) == 8 and counts["count"].max() - counts["count"].min() <= 1 and (counts["count"] == counts["nunique"]).all() and (counts["max"] == counts["count"] - 1).all()


@pytest.mark.parametrize(("k", "step"), list(enumerate(corpus_pipeline.STAGES)))
def test_pipeline_stage_on_empty_input(spark, k, step):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert step[1](spark, docs, SF).count() == 0


def test_the_pipeline_runs_as_its_stages_do(spark):
    """``run`` over the whole table gives what its stages give one after the other."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, SF).persist()
        sizes.append(docs.count())
    got = corpus_pipeline.run(spark, SF)
    assert sorted(got.columns) == sorted(docs.columns) and sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] > 0 and sizes[0] > sizes[3]
    key = ["doc_id", "shard", "slot"]
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, docs.select(*key).collect()))
