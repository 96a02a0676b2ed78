"""Operator 10: licence scan by sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Units are every line of every whole text, every paragraph of more than one line, and the whole text of licence files.
Document frequencies of the templates' terms are counted over all units. A unit is set aside only when an upper bound of
its cosine, found in its row, stays below the threshold; the others are reduced to their distinct word sequences, and each
of these is compared with the templates once, as sparse vectors joined by term. A unit that two licences claim within a
margin says nothing. A file without a licence of its own takes that of the licence file in its nearest ancestor
directory: directories, not files, are joined with their ancestors. DataFrame expressions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gausstide.llm.common import broadcast_if_small, lower_ascii, scratch, stage, table, text_key

#: Notices as licences ask for them, and the whole text of the short licences.
_SOFTWARE_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1_2 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_GNU_HEAD = "is free software: you can redistribute it and/or modify it under the terms of the GNU"
_GNU_FSF = "as published by the Free Software Foundation"
_GNU_LATER = "either version {} of the License, or (at your option) any later version."
_CC = "This work is licensed under a Creative Commons Attribution{} 4.0 International License"
_NOTICES = [
    ("Apache-1.1", "Licensed under the Apache Software License, Version 1.1"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MIT", "Released under the MIT License"),
    ("MIT", _MIT_GRANT),
    ("MIT", f"{_MIT_GRANT} (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_SOFTWARE_AS_IS}"),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_AS_IS}"),
    ("0BSD", f"{_ISC_GRANT}."),
    ("0BSD", f"{_ISC_GRANT}. {_ISC_AS_IS}"),
    ("BSD-2-Clause", _BSD_HEAD),
    ("BSD-2-Clause", f"{_BSD_HEAD} {_BSD_1_2} {_BSD_AS_IS}"),
    ("BSD-3-Clause", _BSD_HEAD),
    ("BSD-3-Clause", _BSD_3),
    ("BSD-3-Clause", f"{_BSD_HEAD} {_BSD_1_2} {_BSD_3} {_BSD_AS_IS}"),
    *((f"GPL-{v}.0", f"This work is licensed under the GNU General Public License, version {v}") for v in (2, 3)),
    *((f"GPL-{v}.0", f"This program {_GNU_HEAD} General Public License {_GNU_FSF}") for v in (2, 3)),
    *((f"GPL-{v}.0", f"This program {_GNU_HEAD} General Public License {_GNU_FSF}, {_GNU_LATER.format(v)}") for v in (2, 3)),
    *((f"LGPL-{v}", f"This work is licensed under the GNU Lesser General Public License, version {v}") for v in ("2.1", "3.0")),
    *((f"LGPL-{v}", f"This {what} {_GNU_HEAD} Lesser General Public License {_GNU_FSF}, {_GNU_LATER.format(v)}") for v in ("2.1", "3.0") for what in ("library", "program")),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("AGPL-3.0", f"This program {_GNU_HEAD} Affero General Public License {_GNU_FSF}, {_GNU_LATER.format(3)}"),
    *((f"CC-BY{short}-4.0", f"Licensed under CC BY{short} 4.0") for short in ("", "-SA", "-ND", "-NC", "-NC-SA", "-NC-ND")),
    ("CC-BY-4.0", _CC.format("")),
    ("CC-BY-SA-4.0", _CC.format("-ShareAlike")),
    ("CC-BY-ND-4.0", _CC.format("-NoDerivatives")),
    ("CC-BY-NC-4.0", _CC.format("-NonCommercial")),
    ("CC-BY-NC-SA-4.0", _CC.format("-NonCommercial-ShareAlike")),
    ("CC-BY-NC-ND-4.0", _CC.format("-NonCommercial-NoDerivatives")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
_MORE = [
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0"),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
]
#: What licences are called in sentences that point to them.
CALLED = [
    ("MIT", "MIT License"), ("Apache-2.0", "Apache License 2.0"), ("Apache-2.0", "Apache License, Version 2.0"), ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("ISC", "ISC License"),
    ("Zlib", "zlib License"), ("BSL-1.0", "Boost Software License, Version 1.0"), ("Unlicense", "Unlicense"), ("MPL-2.0", "Mozilla Public License 2.0"), ("EPL-2.0", "Eclipse Public License 2.0"), ("CC0-1.0", "CC0 1.0 Universal"),
    ("GPL-2.0", "GNU General Public License v2.0"), ("GPL-3.0", "GNU General Public License v3.0"), ("LGPL-3.0", "GNU Lesser General Public License v3.0"), ("AGPL-3.0", "GNU Affero General Public License v3.0"),
]
POINTERS = ["Licensed under the {}", "Distributed under the {}", "This project is licensed under the {}", "This project is licensed under the {} - see the LICENSE file for details"]
_VERSIONED = {"GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0"}
TEMPLATES = [
    *((licence, pointer.format(name)) for pointer in POINTERS for licence, name in CALLED),
    *((x, f"SPDX-License-Identifier: {x}{end}") for x in dict.fromkeys(name for name, _ in _NOTICES + _MORE) for end in (["", "-only", "-or-later"] if x in _VERSIONED else [""])),
    *_MORE,
    *_NOTICES,
]
#: The words that name a licence. A template with such words of its own licence matches only units that have them too.
NAMES = {
    "Apache-1.1": ["apache"], "Apache-2.0": ["apache"], "MIT": ["mit"], "ISC": ["isc"], "0BSD": ["0bsd"], "BSD-2-Clause": ["bsd"], "BSD-3-Clause": ["bsd"], "MPL-2.0": ["mozilla", "mpl"], "BSL-1.0": ["boost", "bsl"], "Zlib": ["zlib"],
    "Unlicense": ["unlicense", "unencumbered"], "EPL-2.0": ["eclipse", "epl"], "CC0-1.0": ["cc0"], "GPL-2.0": ["gnu", "gpl"], "GPL-3.0": ["gnu", "gpl"], "LGPL-2.1": ["gnu", "lesser", "lgpl"], "LGPL-3.0": ["gnu", "lesser", "lgpl"], "AGPL-3.0": ["gnu", "affero", "agpl"],
    **{f"CC-BY{short}-4.0": ["cc", "creative"] for short in ("", "-SA", "-ND", "-NC", "-NC-SA", "-NC-ND")},
}
#: Where comments begin and end.
MARKS = "//+|/[*]+|[*]+/|#+|<!--|-->"
THRESHOLD = 0.6
#: By so much a unit's best licence must be nearer than its second.
MARGIN = 0.01


def terms_of(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(text), "[^a-z0-9]+"), lambda w: w != "")


def units_of(text: Column, whole: Column) -> Column:
    """The lines of a text, the parts of lines that comment marks divide, its paragraphs (between blank lines) of more than one line, and, if ``whole``, all of it where it has several paragraphs. Null has none."""
    paragraphs = F.split(text, "\n[ \t\r]*\n")
    several = F.filter(paragraphs, lambda p: F.contains(p, F.lit("\n")))
    lines = F.split(text, "\n")
    parts = F.flatten(F.transform(F.filter(lines, lambda x: x.rlike(MARKS)), lambda x: F.split(x, MARKS)))
    return F.concat(lines, parts, several, F.when(whole & (F.size(paragraphs) > 1), F.array(text)).otherwise(F.array().cast("array<string>")))


def template_table(spark, templates: list[tuple[str, str]]) -> DataFrame:
    """(template, licence, term, tf, must): ``must`` marks the words that name the template's licence."""
    rows = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], T.StructType([T.StructField("template", T.IntegerType()), T.StructField("licence", T.StringType()), T.StructField("text", T.StringType())]))
    named = F.lit(False)
    for name, words in NAMES.items():
        named = named | ((F.col("licence") == name) & F.col("term").isin(words))
    out = rows.select("template", "licence", F.explode(terms_of(F.col("text"))).alias("term")).groupBy("template", "licence", "term").agg(F.count("*").alias("tf"))
    return out.withColumn("must", named.cast("int"))


def own_licences(files: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """(doc_id, text_key, own_licence, cosine) of the files with a unit that reaches ``threshold``: the best unit, ties by licence name.

    Weights are term counts times ln((units + 1) / (df + 1)) + 1. Words outside the templates enter a unit's length as
    if no other unit had them, so a notice buried in other words scores lower, never higher. A template that names its
    licence matches only units with that name, so a sentence about a licence that no template knows is not taken for one
    that it resembles. A notice counts however many units carry it. A unit whose second licence is less than ``margin`` behind the first is left out: a sentence that
    two licences share decides nothing. Units without a term of the templates match nothing. Null and empty texts have no
    licence. Files without is_licence_file are no licence files; further columns play no part.
    """
    spark = files.sparkSession
    whole = F.coalesce("is_licence_file", F.lit(False)) if "is_licence_file" in files.columns else F.lit(False)
    with scratch(spark, "licences") as step:
        vectors = step(template_table(spark, templates or TEMPLATES), "templates")
        vocabulary = [r[0] for r in vectors.select("term").distinct().collect()]  # bounded by the templates
        units = files.select("doc_id", text_key().alias("text_key"), F.explode(units_of(F.col("text"), whole)).alias("unit")).withColumn("terms", terms_of(F.col("unit")))
        known = F.array_distinct(F.filter("terms", lambda w: w.isin(vocabulary)))
        seen = units.select(F.explode(F.concat(F.array(F.lit("")), known)).alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()
        df = {r[0]: r[1] for r in seen}
        n = df.pop("", 0)
        weight = [(t, _idf(n, df.get(t, 0))) for t in vocabulary]
        idf = spark.createDataFrame(weight, T.StructType([T.StructField("term", T.StringType()), T.StructField("idf", T.DoubleType())]))
        vectors = vectors.join(F.broadcast(idf), "term").withColumn("w", F.col("tf") * F.col("idf"))
        sizes = vectors.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"), F.sum("must").alias("needs"))
        vectors = F.broadcast(vectors.join(F.broadcast(sizes), "template").select("template", "licence", "needs", "must", "term", (F.col("w") / F.col("size") * F.col("idf")).alias("w")))

        cells = vectors.select("template", "term", "w").collect()  # bounded by the templates
        most: dict[str, float] = {}
        for r in cells:
            most[r["term"]] = max(most.get(r["term"], 0.0), r["w"])
        telling = sorted(set(most) - _common({(r["template"], r["term"]): r["w"] for r in cells}, dict(weight), threshold))
        reach = F.exists("terms", lambda w: w.isin(telling)) & _may_reach(F.col("terms"), most, dict(weight), _idf(n, 0), threshold)
        found = step(units.filter(reach).select("doc_id", "text_key", F.array_join("terms", " ").alias("unit")), "notices")
        each = found.select("unit").distinct().select("unit", F.explode(F.split("unit", " ")).alias("term")).groupBy("unit", "term").agg(F.count("*").alias("tf"))
        each = each.join(F.broadcast(idf), "term", "left").withColumn("weight", F.col("tf") * F.coalesce("idf", F.lit(_idf(n, 0))))
        length = each.groupBy("unit").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"))
        dots = each.join(vectors, "term").groupBy("unit", "template", "licence", "needs").agg(F.sum(F.col("tf") * F.col("w")).alias("dot"), F.sum("must").alias("has")).filter("has = needs")
        cosine = F.round(F.least(F.lit(1.0), F.col("dot") / F.col("length")), 9)
        scored = dots.join(length, "unit").groupBy("unit", "licence").agg(F.max(cosine).alias("cosine"))
        ranked = F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("less"), F.col("licence"))))
        best = scored.groupBy("unit").agg(ranked.alias("r")).filter((-F.col("r")[0]["less"] >= threshold) & F.coalesce(F.get("r", F.lit(1))["less"] - F.col("r")[0]["less"] >= margin - 1e-9, F.lit(True)))
        best = broadcast_if_small(step(best.select("unit", F.col("r")[0]["licence"].alias("licence"), (-F.col("r")[0]["less"]).alias("cosine")), "scored"))
        of_file = found.join(best, "unit").groupBy("doc_id", "text_key").agg(F.min(F.struct((-F.col("cosine")).alias("less"), F.col("licence"))).alias("b"))
        return stage(of_file.select("doc_id", "text_key", F.col("b.licence").alias("own_licence"), (-F.col("b.less")).alias("cosine")), "own-licences")


def _idf(n: int, df: int) -> float:
    return math.log((n + 1) / (df + 1)) + 1


def _common(weights: dict[tuple[int, str], float], idf: dict[str, float], threshold: float) -> set[str]:
    """Terms, the most common first, that carry so little of each template that a unit with no other terms of the templates stays below the threshold: within those terms the dot product is at most the template's length there (Cauchy and Schwarz), times the unit's whole length."""
    of: dict[str, list[tuple[int, float]]] = {}
    for (template, term), w in weights.items():
        of.setdefault(term, []).append((template, (w / idf[term]) ** 2))
    held: dict[int, float] = {}
    out = set()
    for term in sorted(of, key=lambda t: (idf[t], t)):
        if all(held.get(template, 0.0) + x < (threshold - 1e-6) ** 2 for template, x in of[term]):
            out.add(term)
            for template, x in of[term]:
                held[template] = held.get(template, 0.0) + x
    return out


def _may_reach(terms: Column, most: dict[str, float], idf: dict[str, float], other: float, threshold: float) -> Column:
    """False only for units whose cosine to every template is below ``threshold``.

    A unit's squared length is at least k + u: k, exact, of its terms that templates have, and u of its other words as if
    none repeated (tf * tf >= tf). Its dot product with a template is at most the sum of each occurrence's largest share
    ``most``, and, as templates have length 1 in these terms, at most the root of k. Known terms are sorted once, so that
    repeats stand together: the step from tf to tf + 1 adds 2 tf + 1 squared weights to k.
    """
    entry = lambda t: (F.lit(t), F.struct(F.lit(most[t]).alias("w"), F.lit(idf[t] ** 2).alias("s")))
    first: dict[int, list[str]] = {}
    for t in most:  # a map is searched from its start, so there is one for each first character
        first.setdefault(ord(t[0]), []).append(t)
    pairs = F.array(*(F.create_map(*(x for t in first.get(c, [next(iter(most))]) for x in entry(t))) for c in range(ord("0"), ord("z") + 1)))
    known = F.transform(F.sort_array(F.filter(terms, lambda w: w.isin(list(most)))), lambda t: F.struct(t.alias("t"), F.element_at(F.get(pairs, F.ascii(t) - ord("0")), t).alias("p")))
    zero = F.struct(F.lit("").alias("t"), F.lit(0).alias("tf"), F.lit(0.0).alias("w"), F.lit(0.0).alias("k"), F.lit(0).alias("n"))

    def add(a, x):
        tf = F.when(a["t"] == x["t"], a["tf"]).otherwise(F.lit(0))
        return F.struct(x["t"].alias("t"), (tf + 1).alias("tf"), (a["w"] + x["p"]["w"]).alias("w"), (a["k"] + x["p"]["s"] * (2 * tf + 1)).alias("k"), (a["n"] + 1).alias("n"))

    total = F.aggregate(known, zero, add, lambda a: F.struct(a["n"].alias("n"), a["w"].alias("w"), a["k"].alias("k"), (a["k"] + (F.size(terms) - a["n"]) * other**2).alias("s")))
    least = threshold - 1e-9
    return F.exists(F.array(total), lambda a: (a["n"] > 0) & (a["w"] >= least * F.sqrt(a["s"])) & (a["k"] >= least**2 * a["s"]))


def directory(path: Column) -> Column:
    """The path without its last part; the empty string at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def ancestors(path: Column) -> Column:
    """A directory and those above it, the nearest first, the top (the empty string) last."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda i: F.struct((F.size(parts) - i).alias("up"), F.array_join(F.slice(parts, 1, i), "/").alias("above")))


def scan(files: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, path, own_licence, cosine, licence, inherited_from) of files (doc_id, path, text, is_licence_file).

    A licence file with a licence of its own gives it to its directory; of several the best cosine counts, then the
    licence's name. Other files take their own licence, else that of the nearest ancestor directory (their own first),
    else null. Null paths inherit nothing; repeated rows are returned each; an empty table gives no rows. Cosines are
    rounded to 6 digits. Further columns, whatever their names, are ignored.
    """
    keyed = files.select("doc_id", "path", "text", F.coalesce("is_licence_file", F.lit(False)).alias("is_licence_file"), text_key().alias("text_key"))
    own = own_licences(files, templates, threshold).withColumn("cosine", F.round("cosine", 6)).withColumnsRenamed({"doc_id": "_d", "text_key": "_k"})
    rows = keyed.select("doc_id", "path", "is_licence_file", "text_key")
    rows = rows.join(own, rows["doc_id"].eqNullSafe(own["_d"]) & (rows["text_key"] == own["_k"]), "left").drop("_d", "_k")
    rows = stage(rows.withColumn("dir", directory(F.col("path"))), "licence-files")
    given = rows.filter("is_licence_file and own_licence is not null and dir is not null").groupBy(F.col("dir").alias("above")).agg(F.min(F.struct(-F.col("cosine"), F.col("own_licence"))).alias("b")).select("above", F.col("b.own_licence").alias("given"))
    levels = rows.filter("dir is not null").select("dir").distinct().select("dir", F.inline(ancestors(F.col("dir"))))
    nearest = levels.join(given, "above").groupBy("dir").agg(F.min(F.struct("up", "above", "given")).alias("b")).select("dir", "b.above", "b.given")
    out = rows.join(broadcast_if_small(stage(nearest, "directory-licences")), "dir", "left")
    inherits = F.col("own_licence").isNull()
    return out.select("doc_id", "path", "own_licence", "cosine", F.coalesce("own_licence", "given").alias("licence"), F.when(inherits, F.col("above")).alias("inherited_from"))


def with_paths(docs: DataFrame) -> DataFrame:
    """Paths for a table that has none: source/language/one of ten directories/id. Texts of five lines or fewer are licence files, of one of these three directories by id."""
    source, lang = F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none"))
    shelf = F.concat(F.lit("d"), F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(10)).cast("string"))
    small = F.coalesce(F.size(F.split("text", "\n")) <= 5, F.lit(False))
    turn = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(3))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    where = F.when(small & (turn == 0), F.concat_ws("/", source, name)).when(small & (turn == 1), F.concat_ws("/", source, lang, name)).otherwise(F.concat_ws("/", source, lang, shelf, name))
    return docs.select("doc_id", "text", where.alias("path"), small.alias("is_licence_file"))


def query(spark, sf_dir: str) -> DataFrame:
    return scan(with_paths(table(spark, sf_dir, "documents")))


def _sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    templates = ", ".join(f"({i}, {quoted(name)}, {quoted(text)})" for i, (name, text) in enumerate(TEMPLATES))
    names = ", ".join(f"({quoted(name)}, {quoted(w)})" for name, words in NAMES.items() for w in words)
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
with files as (
  select doc_id, text, coalesce(len(string_split(text, chr(10))) <= 5, false) as small, coalesce(source, 'none') as s, coalesce(lang, 'none') as l from documents),
placed as (
  select doc_id, text, small, case when small and doc_id % 3 = 0 then s when small and doc_id % 3 = 1 then s || '/' || l
         else s || '/' || l || '/d' || (doc_id % 10) end as dir from files),
units as (
  select doc_id, row_number() over () as u, list_filter(string_split_regex({lower.format("unit")}, '[^a-z0-9]+'), lambda w: w <> '') as terms from (
    select doc_id, unnest(string_split(text, chr(10))) as unit from placed
    union all select doc_id, unnest(string_split_regex(unit, '{MARKS}')) as unit from (select doc_id, unnest(string_split(text, chr(10))) as unit from placed) where regexp_matches(unit, '{MARKS}')
    union all select doc_id, unit from (select doc_id, unnest(string_split_regex(text, '\n[ \t\r]*\n')) as unit from placed) where contains(unit, chr(10))
    union all select doc_id, text from placed where small and len(string_split_regex(text, '\n[ \t\r]*\n')) > 1)),
tf as (select doc_id, u, term, count(*) as tf from (select doc_id, u, unnest(terms) as term from units) group by all),
tt as (select t, licence, term, count(*) as tf from (select t, licence, unnest(list_filter(string_split_regex({lower.format("txt")}, '[^a-z0-9]+'), lambda w: w <> '')) as term
       from (values {templates}) v(t, licence, txt)) group by all),
n as (select count(*) as n from units),
idf as (select term, ln((n + 1.0) / (coalesce(df, 0) + 1)) + 1 as idf from (select distinct term from tt) left join (select term, count(*) as df from tf group by term) using (term), n),
vec as (select t, tt.licence, term, tf * idf / sqrt(sum(tf * idf * tf * idf) over (partition by t)) * idf as w, count(nw.word) over (partition by t) as needs, nw.word is not null as must
        from tt join idf using (term) left join (values {names}) nw(name, word) on nw.name = tt.licence and nw.word = term),
size as (select u, sqrt(sum(pow(tf * coalesce(idf, ln(n + 1.0) + 1), 2))) as len from tf left join idf using (term), n group by u),
scored as (select doc_id, u, licence, max(round(least(1.0, dot / len), 9)) as cosine from (select doc_id, u, t, licence, needs, sum(tf * w) as dot from tf join vec using (term) group by all having count(*) filter (must) = needs) join size using (u) group by all),
ranked as (select *, row_number() over (partition by u order by cosine desc, licence) as r, lead(cosine) over (partition by u order by cosine desc, licence) as second from scored),
own as (select doc_id, first(licence order by cosine desc, licence) as own_licence, max(cosine) as cosine from ranked
        where r = 1 and cosine >= {THRESHOLD} and cosine - coalesce(second, -1) >= {MARGIN} - 1e-9 group by doc_id),
rows_ as (select doc_id, dir, small, own_licence, round(cosine, 6) as cosine, dir || '/' || doc_id as path from placed left join own using (doc_id)),
given as (select dir as above, first(own_licence order by cosine desc, own_licence) as given from rows_ where small and own_licence is not null group by dir),
nearest as (select dir, first(above order by length(above) desc) as above, first(given order by length(above) desc) as given
            from (select distinct dir from rows_) join given on above = '' or dir = above or starts_with(dir, above || '/') group by dir)
select doc_id, path, own_licence, cosine, coalesce(own_licence, given) as licence, case when own_licence is null then above end as inherited_from
from rows_ left join nearest using (dir)
"""


SQL = _sql()
