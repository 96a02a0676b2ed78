"""Operator 11: fill-in-the-middle transformation over a sparse checkpoint index.

A text is cut into units (`[A-Za-z]+` or one other code point). Units are counted block by block over the UTF-8 bytes;
on the way the index keeps, for every ``STRIDE``-th unit, its byte and its code-point offset. A cut after u units finds
the last checkpoint at or before u by binary search and rescans at most ``STRIDE`` units from there. Besides the text
itself, memory holds one block's masks and a checkpoint per ``STRIDE`` units, whatever the length of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gausstide.llm.common import free, table

#: Units between checkpoints, and bytes counted at a time.
STRIDE, BLOCK = 512, 1 << 16
#: Sentinels of the contract.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def _marks(raw: np.ndarray, letter_before: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """(a unit starts here, a code point starts here) for each byte, and whether the last byte is a letter."""
    folded = raw | 0x20
    letter = (folded >= 97) & (folded <= 122)
    head = (raw & 0xC0) != 0x80
    before = np.empty(len(raw), bool)
    before[0], before[1:] = letter_before, letter[:-1]
    return head & ~(letter & before), head, bool(letter[-1])


class Checkpoints:
    """Counts the units of a UTF-8 text and finds the byte and code-point offset at which any unit ends."""

    def __init__(self, data: bytes, stride: int = STRIDE, block: int = BLOCK):
        self.data, self.raw, self.block = data, np.frombuffer(data, np.uint8), block
        units, chars, letter = 0, 0, False
        found = []  # per block: unit numbers, byte offsets, code-point offsets of its checkpoints
        for at in range(0, len(data), block):
            starts, heads, letter = _marks(self.raw[at : at + block], letter)
            where = np.flatnonzero(starts)
            first = -units % stride
            if first < len(where):
                kept = where[first::stride]
                points = np.cumsum(heads) - 1
                found.append((units + np.arange(first, len(where), stride), at + kept, chars + points[kept]))
            units += len(where)
            chars += int(heads.sum())
        self.n, self.n_chars = units, chars
        self.unit, self.byte, self.char = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3

    def end_of(self, units: int) -> tuple[int, int]:
        """(byte offset, code-point offset) after the first ``units`` units."""
        if units >= self.n:
            return len(self.data), self.n_chars
        c = int(np.searchsorted(self.unit, units, side="right")) - 1
        missing, at, chars, letter = units - int(self.unit[c]), int(self.byte[c]), int(self.char[c]), False
        while True:  # the rescan: a unit may be a run of letters of any length
            starts, heads, letter = _marks(self.raw[at : at + self.block], letter)
            where = np.flatnonzero(starts)
            if missing < len(where):
                stop = int(where[missing])
                return at + stop, chars + int(heads[:stop].sum())
            missing, at, chars = missing - len(where), at + len(heads), chars + int(heads.sum())


def arrange(prefix: bytes, middle: bytes, suffix: bytes, form: str) -> bytes:
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    return b"".join((p, prefix, s, suffix, m, middle) if form == "psm" else (s, suffix, p, prefix, m, middle))


def restore(output: bytes, form: str) -> bytes:
    """The text that an output of ``arrange`` was made of; the texts themselves hold no sentinel."""
    if form == "plain":
        return output
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    head, middle = output.split(m)
    first, second = (p, s) if form == "psm" else (s, p)
    one, two = head.removeprefix(first).split(second)
    return one + middle + two if form == "psm" else two + middle + one


def _transform(draws: list[str], infill_percent: int, spm_percent: int, digest: bool):
    """Over Arrow batches: adds the columns of ``infilled`` to each row and drops the draws. With ``digest`` the output and the restored text are given as hashes only."""
    names = ["units", "form", "prefix_chars", "middle_chars"] + (["output_sha256", "restored_sha256"] if digest else ["output"])
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64()] + ([pa.string()] * 2 if digest else [pa.string()])

    def one(data: bytes, h1: int, h2: int, h3: int, h4: int):
        index = Checkpoints(data)
        sentinel = any(x.encode() in data for x in (PREFIX, SUFFIX, MIDDLE))
        if not data or sentinel or h3 % 100 >= infill_percent:
            form, output, sizes = "plain", data, (None, None)
        else:
            form = "spm" if h4 % 100 < spm_percent else "psm"
            a, b = sorted((h1 % (index.n + 1), h2 % (index.n + 1)))
            (byte_a, char_a), (byte_b, char_b) = index.end_of(a), index.end_of(b)
            output, sizes = arrange(data[:byte_a], data[byte_a:byte_b], data[byte_b:], form), (char_a, char_b - char_a)
        if not digest:
            return index.n, form, *sizes, output.decode()
        return index.n, form, *sizes, hashlib.sha256(output).hexdigest(), hashlib.sha256(restore(output, form)).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):  # outputs leave in small batches: texts may be long
                batch = whole.slice(at, 64)
                texts = batch.column("text").cast(pa.binary())
                numbers = [batch.column(c) for c in draws]
                rows = [one(texts[i].as_py() or b"", *(c[i].as_py() for c in numbers)) for i in range(batch.num_rows)]
                keep = [c for c in batch.schema.names if c not in draws and not (digest and c == "text")]
                made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + made, keep + names)

    return run


def draws_of(doc_id: Column) -> list[Column]:
    """h1 to h4: the first four groups of eight hexadecimal digits of sha256("1:" and the decimal id) as numbers."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def infilled(docs: DataFrame, infill_percent: int = 90, spm_percent: int = 20, digest: bool = False) -> DataFrame:
    """``docs`` with units, form, prefix_chars, middle_chars and output.

    Of 100 documents ``infill_percent`` are rearranged, of these ``spm_percent`` come suffix first. Which, and
    where the cuts are, follows from the doc_id alone (a null id draws as the empty one). Null and empty texts and texts
    that hold a sentinel stay plain (null as empty); prefix_chars and middle_chars are null there. Rows that repeat an
    id have the same draws, so equal rows give equal results; other columns pass unchanged, but a column of a result's
    name is replaced. Texts of any length: see the module. ``digest``: output_sha256 and restored_sha256 in place of
    text and output, restored from output and form alone.
    """
    made = {"units", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored_sha256"}
    docs = docs.drop(*(c for c in docs.columns if c.lower() in made))
    draws = free(docs.columns, "h1", "h2", "h3", "h4")
    kept = [f for f in docs.schema.fields if not (digest and f.name == "text")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    out = "units long, form string, prefix_chars long, middle_chars long, " + ("output_sha256 string, restored_sha256 string" if digest else "output string")
    rows = docs.withColumns(dict(zip(draws, draws_of(F.col("doc_id")), strict=True)))
    return rows.mapInArrow(_transform(draws, infill_percent, spm_percent, digest), f"{kinds}, {out}")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return infilled(docs, digest=True).withColumnRenamed("units", "n")


SQL = r"""
with units as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u,
         sha256('1:' || doc_id) as s from documents),
drawn as (
  select doc_id, text, u, len(u) as n, ('0x' || substr(s, 1, 8))::bigint as h1, ('0x' || substr(s, 9, 8))::bigint as h2,
         ('0x' || substr(s, 17, 8))::bigint as h3, ('0x' || substr(s, 25, 8))::bigint as h4 from units),
cut as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
         case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain'
              when h4 % 100 < 20 then 'spm' else 'psm' end as form from drawn),
parts as (
  select *, coalesce(array_to_string(u[1:a], ''), '') as p, coalesce(array_to_string(u[a + 1:b], ''), '') as m,
         coalesce(array_to_string(u[b + 1:n], ''), '') as x from cut)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(p) end::bigint as prefix_chars,
       case when form <> 'plain' then length(m) end::bigint as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || x || '<M>' || m
              else '<S>' || x || '<P>' || p || '<M>' || m end) as output_sha256, sha256(text) as restored_sha256
from parts
"""
