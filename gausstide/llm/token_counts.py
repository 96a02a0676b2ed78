"""Operator 8: token counts by section, from one encoding of each whole document.

A document is encoded once, as a whole, since tokens may cross section borders. The byte lengths of its tokens give every
token its span; spans are joined to the sections' intervals by binary search. A token that crosses a border is allocated
by an explicit rule. Tokenization needs a library, so this runs in Arrow batches inside tasks; sections are columns of
the row, so nothing is shuffled.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gausstide.llm.common import table

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pre-split pattern of the vocabulary above.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("start", "majority", "split")
SECTIONS = "array<struct<section:string,start:int,end:int>>"


@cache
def _encoding(path: str, pattern: str):
    """The encoder, and the byte length of each token; loaded once per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def _byte_edges(text: str, edges: list[int]) -> np.ndarray:
    """Byte positions of ascending code point positions."""
    out, at, last = [], 0, 0
    for e in edges:
        at += len(text[last:e].encode())
        last = e
        out.append(at)
    return np.array(out, np.int64)


def allocate(lengths: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each section. Sections are disjoint and ascending, empty ones allowed; token and section spans are half-open byte ranges.

    start: a token belongs to the section of its first byte, or, if that is in none, to the first one it touches.
    majority: to the section with most of its bytes, ties to the first. split: to each section by its share of bytes.
    """
    n = len(starts)
    tokens, crossing = np.zeros(n), np.zeros(n, np.int64)
    if not n:
        return tokens, crossing
    b = np.cumsum(lengths)
    a = b - lengths
    first, last = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
    one = (last - first == 1) & (a >= starts[np.minimum(first, n - 1)]) & (b <= ends[np.minimum(first, n - 1)])
    np.add.at(tokens, first[one], 1)
    for i in np.flatnonzero(~one & (first < last)):
        inside = np.arange(first[i], last[i])
        inside = inside[ends[inside] > starts[inside]]
        if not len(inside):
            continue
        share = np.minimum(ends[inside], b[i]) - np.maximum(starts[inside], a[i])
        crossing[inside[share > 0]] += 1
        if rule == "split":
            tokens[inside] += share / (b[i] - a[i])
        elif rule == "majority":
            tokens[inside[share.argmax()]] += 1
        else:
            tokens[inside[share > 0][0]] += 1
    return tokens, crossing


def _disjoint(sections: list[dict | None]) -> list[dict]:
    """Sections in ascending order, cut so that none begins before 0 or before the end of an earlier one. Null sections and bounds are left out; one that ends before its start is empty."""
    out, last = [], 0
    for s in sorted((s for s in sections if s and s["start"] is not None and s["end"] is not None), key=lambda s: (s["start"], s["end"])):
        start = max(s["start"], last)
        out.append({"section": s["section"], "start": start, "end": max(s["end"], start)})
        last = out[-1]["end"]
    return out


def _attribute(path: str, pattern: str, rule: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, size = _encoding(path, pattern)
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                text = batch.column("text")[i].as_py() or ""
                sections = _disjoint(batch.column("sections")[i].as_py() or [])
                edges = _byte_edges(text, [e for s in sections for e in (s["start"], s["end"])])
                ids = np.array(encoding.encode_ordinary(text), np.int64)
                tokens, crossing = allocate(size[ids], edges[::2], edges[1::2], rule)
                rows += [(i, s["section"], float(t), int(c), s["end"] - s["start"], len(ids)) for s, t, c in zip(sections, tokens, crossing, strict=True)]
            if rows:
                at, *rest = zip(*rows, strict=True)
                columns = [batch.column(c).take(pa.array(at)) for c in names]
                kinds = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, k) for c, k in zip(rest, kinds, strict=True))], [*names, "section", "n_tokens", "n_crossing", "n_chars", "document_tokens"])

    return run


def attribute_tokens(docs: DataFrame, rule: str = "start", path: str = VOCABULARY, pattern: str = PATTERN, key: str = "doc_id") -> DataFrame:
    """(key, section, n_tokens, n_crossing, n_chars, document_tokens): a row per section of ``docs`` (key, text, sections).

    ``sections``: array of (section, start, end), code point positions from 0, end exclusive. Where sections overlap, the
    one that starts first keeps the overlap. Bytes outside all sections count for none. ``path`` must be readable on every
    executor. Null and empty texts have 0 tokens; a document with null or no sections gives no rows;
    repeated rows are counted each; other columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule: one of {RULES}")
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text", F.col("sections").cast(SECTIONS).alias("sections")).mapInArrow(_attribute(path, pattern, rule, [key]), f"`{key}` {kind}, section string, n_tokens double, n_crossing long, n_chars long, document_tokens long")


def attach_sections(docs: DataFrame, sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` with a sections column, from a table (key, section, start, end); the sections of one document meet in one row."""
    own = sections.groupBy(F.col(key).alias("_key")).agg(F.collect_list(F.struct("section", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))).alias("sections"))
    return docs.join(own, docs[key].eqNullSafe(own["_key"]), "left").drop("_key")


def line_sections(text: Column) -> Column:
    """head (first line with its line break), body, tail (last line); a text of one line is all head."""
    text = F.coalesce(text, F.lit(""))
    n, broken = F.char_length(text), F.instr(text, "\n") > 0
    head = F.when(broken, F.instr(text, "\n")).otherwise(n)
    body = F.greatest(head, n - F.when(broken, F.char_length(F.substring_index(text, "\n", -1))).otherwise(0))
    part = lambda name, a, b: F.struct(F.lit(name).alias("section"), a.cast("int").alias("start"), b.cast("int").alias("end"))
    return F.array(part("head", F.lit(0), head), part("body", head, body), part("tail", body, n))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", line_sections(F.col("text")).alias("sections"))
    return attribute_tokens(docs, rule="start")
