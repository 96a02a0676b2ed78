"""Operator 12: removal of repeated substrings by a distributed, common-prefix-aware merge sort of suffixes.

A window is a string of ``length`` bytes. All windows of a corpus are too many to sort, so suffixes start at anchors:
the anchor of a window is the least-hashed k-gram of its first ``length // 2`` bytes, so equal windows have their
anchors at equal offsets, and neighbouring windows mostly share one (about 90 windows to an anchor). What follows the
anchor inside every window, its core, is more than half a window long.

1. Cores are hashed and counted; an anchor whose core occurs once has no repeated window and goes.
2. Each task cuts the suffixes of its anchors (the text from the anchor to the end of its last window, and what its
   windows have before it), sorts them, joins equal ones and writes a front-coded run: of each suffix the number of
   bytes shared with the one before, and the rest. Splitters from a sample divide runs into ranges, which are exchanged.
3. A loser tree merges the runs of a range. It carries each head's common prefix with the last output, so two heads are
   compared by these numbers alone unless they tie, and never on bytes known to be equal. The common prefixes of the
   merged list separate the groups that share a core, and bound what windows of a suffix can repeat; within a group
   windows are compared across both sides of the anchor.
4. A core found more than ``HOT`` times makes no group: fingerprints (128 bits) of its windows, distinct in each run,
   are dealt out by their hash instead, so that no key gathers in one task.

The outermost repeated windows of an anchor all hold the anchor, so they give one span of bytes to remove.

Texts are shuffled only where they must meet a list of anchors or spans: a broadcast bitmap of fixed size over the text
keys of those lists sorts out the other texts first. It can let a text too many pass, never one too few.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gausstide.llm.common import free, scratch, stage, table, text_key

#: Bytes of the k-grams that anchors are chosen by, bytes of text handled at a time, bytes of suffixes in a run.
GRAM, CHUNK, RUN_BYTES = 16, 1 << 20, 48 << 20
#: Occurrences above which a core is settled by fingerprints.
HOT = 1000
#: Bytes of a suffix that decide its range, a share of the cores that splitters are chosen from, and their most.
HEAD, SAMPLE, SPLITTERS = 64, 64, 20_000
#: Suffixes for which a range is made.
RANGE_ROWS = 4000
#: Bits of the bitmap of text keys (8 MB), whatever the data, and of one of its rows (what ``bitmap_construct_agg`` makes).
BITMAP_BITS, ROW_BITS = 1 << 26, 1 << 15

ANCHORS = "doc_id {id}, text_key long, core long, p int, lo int, n int, head binary"
EXCHANGED = "part int, run long, i int, common int, rest binary, before binary, h1 long, h2 long, many boolean, doc_id {id}, text_key long, p int, lo int, n int"
SPANS = "doc_id {id}, text_key long, start int, stop int"


# ---- anchors


def _hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes (8 to 16) from each position on, in the high half; the position in the low half."""
    n = len(data) - k + 1
    word = lambda at: np.ndarray((n,), "<u8", data.data, at, (1,))  # noqa: E731  eight bytes from each position
    with np.errstate(over="ignore"):
        h = (word(0) * np.uint64(0x9E3779B97F4A7C15)) ^ ((word(k - 8) + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xC2B2AE3D27D4EB4F))
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
    h &= np.uint64(0xFFFFFFFF00000000)
    h |= np.arange(n, dtype=np.uint64)
    return h


def _sliding_least(h: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` neighbours, by doubling."""
    done, out = 1, h
    while done * 2 <= w:
        out = np.minimum(out[: len(out) - done], out[done:])
        done *= 2
    rest = w - done
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchors_of(data: bytes | memoryview, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(p, lo, n): anchors of a text, with the first start and the number of the windows each stands for. A chunk of the text at a time; an anchor may come once from each of two chunks, for different windows."""
    raw = np.frombuffer(data, np.uint8)
    reach = length // 2
    k = min(GRAM, reach // 2)
    for at in range(0, len(raw) - length + 1, CHUNK):
        starts = min(CHUNK, len(raw) - length + 1 - at)
        part = np.ascontiguousarray(raw[at : at + starts + reach - 1])
        least = (_sliding_least(_hashes(part, k), reach - k + 1)[:starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        yield least[first] + at, first + at, np.diff(np.r_[first, starts])


def core_bytes(length: int) -> int:
    """Bytes from an anchor on that all its windows share."""
    reach = length // 2
    return length - (reach - min(GRAM, reach // 2))


def _anchor_rows(length: int, sample: int, kind: pa.DataType):
    size = core_bytes(length)
    fields = pa.schema([("doc_id", kind), ("text_key", pa.int64()), ("core", pa.int64()), ("p", pa.int32()), ("lo", pa.int32()), ("n", pa.int32()), ("head", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for i in range(batch.num_rows):
                data = texts[i].as_py()
                if data is None or len(data) < length:
                    continue
                view = memoryview(data)
                for p, lo, n in anchors_of(view, length):
                    where = p.tolist()
                    core = [xxhash.xxh3_64_intdigest(view[x : x + size]) for x in where]
                    heads = [data[x : x + min(HEAD, size)] if c % sample == 0 else None for x, c in zip(where, core, strict=True)]
                    core = np.array(core, np.uint64).view(np.int64)
                    at = pa.array(np.full(len(where), i))
                    held.append(pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("text_key").take(at), pa.array(core), *(pa.array(x.astype(np.int32)) for x in (p, lo, n)), pa.array(heads, pa.binary())], schema=fields))
                    rows += len(where)
                if rows > 20_000:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return run


# ---- runs


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of two strings, of which ``known`` bytes need not be read again."""
    most = min(len(a), len(b))
    if a[known:most] == b[known:most]:
        return most
    step = 8
    while a[known : known + step] == b[known : known + step]:
        known += step
        step *= 2
    while step > 1:  # the first difference lies in the next ``step`` bytes
        step //= 2
        if a[known : known + step] == b[known : known + step]:
            known += step
    return known


class Entry(NamedTuple):
    """A suffix of a run: the text from an anchor to the end of its last window, and what its windows have before it; ``many`` if the run holds it repeatedly. Positions tell where it stands, of the first one that has it."""

    suffix: bytes
    before: bytes
    many: bool
    ref: tuple  # doc_id, text_key, p, lo, n


class Run:
    """Suffixes that a task has gathered; ``emit`` sorts them and gives the rows to exchange."""

    def __init__(self, number: int, length: int, splitters: list[bytes], parts: int):
        self.number, self.length, self.splitters, self.parts = number, length, splitters, parts
        self.head = min(HEAD, core_bytes(length))  # no group of one core lies in two ranges
        self.plain: dict[tuple[bytes, bytes], list] = {}
        self.hot: dict[tuple[bytes, bytes], list] = {}
        self.size = 0

    def add(self, data: bytes, ref: tuple, hot: bool) -> None:
        _, _, p, lo, n = ref
        key = data[p : lo + n - 1 + self.length], data[lo:p]
        group = self.hot if hot else self.plain
        if key in group:
            group[key].append(ref)
        else:
            group[key] = [ref]
            self.size += len(key[0]) + len(key[1]) + (250 * n if hot else 0)
        self.size += 100

    def _whole(self, refs: list) -> Iterator[tuple]:
        """Windows that repeat within the run: the span is known already."""
        for ref in refs:
            yield (ref[4] + ref[3] + ref[2]) % self.parts, None, 0, None, None, None, None, None, True, *ref

    def emit(self) -> Iterator[tuple]:
        before, last = b"", None
        for i, (suffix, left) in enumerate(sorted(self.plain)):
            refs = self.plain[suffix, left]
            part = bisect_right(self.splitters, suffix[: self.head])
            common = common_prefix(before, suffix) if part == last else 0
            many = len(refs) > 1
            yield part, self.number, i, common, suffix[common:], left, None, None, many, *(refs[0] if not many else (None,) * 5)
            if many:
                yield from self._whole(refs)
            before, last = suffix, part
        yield from self._fingerprints()

    def _fingerprints(self) -> Iterator[tuple]:
        """The windows of hot cores, each distinct one once; those that the run repeats are settled here."""
        first: dict[bytes, list] = {}
        for (suffix, left), refs in self.hot.items():
            whole, (doc, key, p, lo, n) = left + suffix, refs[0]
            if len(refs) > 1:
                yield from self._whole(refs)
            for x in range(n):
                h = xxhash.xxh3_128_digest(whole[x : x + self.length])
                seen = first.get(h)
                if seen is None:
                    first[h] = [len(refs) > 1, (doc, key, p, lo + x, 1)]
                else:
                    if not seen[0]:
                        seen[0] = True
                        yield from self._whole([seen[1]])
                    if len(refs) == 1:
                        yield from self._whole([(doc, key, p, lo + x, 1)])
        for h, (many, ref) in first.items():
            h1, h2 = int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)
            yield len(self.splitters) + 1 + h1 % self.parts, None, 0, None, None, None, h1, h2, many, *(ref if not many else (None,) * 5)


def _exchange_rows(length: int, splitters: list[bytes], parts: int, most: int, kind: pa.DataType):
    fields = pa.schema([("part", pa.int32()), ("run", pa.int64()), ("i", pa.int32()), ("common", pa.int32()), ("rest", pa.binary()), ("before", pa.binary()), ("h1", pa.int64()), ("h2", pa.int64()), ("many", pa.bool_()), ("doc_id", kind), ("text_key", pa.int64()), ("p", pa.int32()), ("lo", pa.int32()), ("n", pa.int32())])

    def batches_of(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        held = []
        for row in rows:
            held.append(row)
            if len(held) == 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), fields, strict=True)], schema=fields)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), fields, strict=True)], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 20
        own = Run(number, length, splitters, parts)
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for i in range(batch.num_rows):
                data, doc, key = texts[i].as_py(), batch.column("doc_id")[i].as_py(), batch.column("text_key")[i].as_py()
                for a in batch.column("anchors")[i].as_py():
                    own.add(data, (doc, key, a["p"], a["lo"], a["n"]), a["hot"])
                    if own.size > most:
                        yield from batches_of(own.emit())
                        number += 1
                        own = Run(number, length, splitters, parts)
        yield from batches_of(own.emit())

    return run


# ---- merge


class Head(NamedTuple):
    """A run's next suffix: bytes shared with the last output of the merge, the suffix, and the entry."""

    common: int
    suffix: bytes
    entry: Entry | None


SPENT = Head(-1, b"", None)


class LoserTree:
    """Merges front-coded sorted runs into (common prefix with the output before, entry).

    Every inner node holds the loser of its match. Heads in play carry their common prefix with the last output: the
    longer one is smaller, and only equal ones are compared, from there on; the loser then keeps what it shares with the
    winner. So no byte that is known to be equal is read again.
    """

    def __init__(self, runs: list[Iterator[tuple[int, Entry]]]):
        self.runs = runs
        self.leaves = 1
        while self.leaves < len(runs):
            self.leaves *= 2
        self.losers: list[tuple[Head, int]] = [(SPENT, 0)] * self.leaves

    def _first(self, node: int) -> tuple[Head, int]:
        if node >= self.leaves:
            at = node - self.leaves
            return (self._next(at, 0) if at < len(self.runs) else SPENT), at
        won, self.losers[node] = self._match(self._first(2 * node), self._first(2 * node + 1))
        return won

    def _next(self, at: int, _: int) -> Head:
        found = next(self.runs[at], None)
        return SPENT if found is None else Head(found[0], found[1].suffix, found[1])

    @staticmethod
    def _match(x: tuple[Head, int], y: tuple[Head, int]) -> tuple[tuple[Head, int], tuple[Head, int]]:
        """(winner, loser)."""
        a, b = x[0], y[0]
        if a.common != b.common or a.entry is None:
            return (x, y) if a.common > b.common else (y, x)
        both = common_prefix(a.suffix, b.suffix, a.common)
        if a.suffix[both : both + 1] <= b.suffix[both : both + 1]:
            return x, (Head(both, b.suffix, b.entry), y[1])
        return y, (Head(both, a.suffix, a.entry), x[1])

    def __iter__(self) -> Iterator[tuple[int, Entry]]:
        head, at = self._first(1)
        while head.entry is not None:
            yield head.common, head.entry
            won = self._next(at, 0), at  # its front code tells what it shares with the output just made
            node = (at + self.leaves) // 2
            while node:
                won, self.losers[node] = self._match(won, self.losers[node])
                node //= 2
            head, at = won


def repeated_windows(group: list[tuple[int, Entry]], length: int) -> Iterator[tuple[tuple, int, int]]:
    """(ref, first, last): the outermost repeated windows of the suffixes of a group, numbered from the first of each. ``group``: (common prefix with the one before, entry), sorted."""
    if len(group) == 1:
        return
    distinct: dict[tuple[bytes, bytes], list[Entry]] = {}
    bound: dict[tuple[bytes, bytes], int] = {}  # the longest prefix shared with a neighbour, over the equal ones
    for i, (common, e) in enumerate(group):
        key = e.suffix, e.before
        distinct.setdefault(key, []).append(e)
        bound[key] = max(bound.get(key, 0), common if i else 0, group[i + 1][0] if i + 1 < len(group) else 0)
    found: dict[bytes, int] = {}  # window: its distinct suffix, or -1 if it repeats
    settled = {k for k, es in distinct.items() if len(es) > 1 or es[0].many}
    hashes = []
    for j, (suffix, before) in enumerate(distinct):
        whole = before + suffix
        # a window ends within the prefix that some other suffix shares
        last = min(len(whole) - length, len(before) + bound[suffix, before] - length)
        own = [xxhash.xxh3_128_digest(whole[x : x + length]) for x in range(last + 1)] if len(distinct) > 1 else []
        mark = -1 if (suffix, before) in settled else j
        for h in own:
            found[h] = mark if h not in found else -1
        hashes.append(own)
    for own, (key, entries) in zip(hashes, distinct.items(), strict=True):
        refs = [e.ref for e in entries if not e.many]
        if key in settled:
            yield from ((ref, 0, len(key[0]) + len(key[1]) - length) for ref in refs)
        elif refs and (hits := [x for x, h in enumerate(own) if found[h] == -1]):
            yield refs[0], hits[0], hits[-1]


def merged_groups(runs: list[Iterator[tuple[int, Entry]]], core: int) -> Iterator[list[tuple[int, Entry]]]:
    """The merged suffixes, cut where neighbours share less than a core."""
    group: list[tuple[int, Entry]] = []
    for common, entry in LoserTree(runs):
        if group and common < core:
            yield group
            group = []
        group.append((common, entry))
    if group:
        yield group


def _merge(length: int, kind: pa.DataType):
    fields = pa.schema([("doc_id", kind), ("text_key", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])
    core = core_bytes(length)

    def decoded(t: pa.Table) -> Iterator[tuple[int, Entry]]:
        suffix = b""
        columns = [t.column(c).to_pylist() for c in ("common", "rest", "before", "many", "doc_id", "text_key", "p", "lo", "n")]
        for common, rest, before, many, *ref in zip(*columns, strict=True):
            suffix = suffix[:common] + rest
            yield common, Entry(suffix, before, many, tuple(ref))

    def run(t: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        out = []
        sorted_rows = t.filter(pc.is_valid(t["run"])).sort_by([("run", "ascending"), ("i", "ascending")])
        numbers = sorted_rows["run"].to_numpy()
        edges = np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1], True]) if len(numbers) else np.zeros(1, int)
        runs = [decoded(sorted_rows.slice(a, b - a)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        for group in merged_groups(runs, core):
            for (doc, key, _, lo, _), first, last in repeated_windows(group, length):
                out.append((doc, key, lo + first, lo + last + length))
        rest = t.filter(pc.is_null(t["run"]))
        known = rest.filter(pc.is_null(rest["h1"])).select(["doc_id", "text_key", "lo", "n"]).to_pylist()
        out += [(r["doc_id"], r["text_key"], r["lo"], r["lo"] + r["n"] - 1 + length) for r in known]
        prints = rest.filter(pc.is_valid(rest["h1"])).select(["h1", "h2", "many", "doc_id", "text_key", "lo"])
        weight: dict[tuple, int] = {}
        rows = list(zip(*(prints.column(c).to_pylist() for c in prints.column_names), strict=True))
        for h1, h2, many, *_ in rows:
            weight[h1, h2] = weight.get((h1, h2), 0) + 1 + many
        out += [(doc, key, lo, lo + length) for h1, h2, many, doc, key, lo in rows if not many and weight[h1, h2] > 1]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], schema=fields) if out else fields.empty_table()

    return run


# ---- the operator


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def with_listed(df: DataFrame, key: str, keys: DataFrame, out: str) -> DataFrame:
    """Adds ``out``: false where ``keys``, one column of longs, surely lacks the row's ``key``, else true. No nulls. ``keys`` is read once more by this."""
    _row, _bits = free([*df.columns, out], "_row", "_bits")
    row = lambda k: F.shiftright(k.bitwiseAND(F.lit(BITMAP_BITS - 1)), ROW_BITS.bit_length() - 1)
    at = lambda k: k.bitwiseAND(F.lit(ROW_BITS - 1)).cast("int")
    own, listed = F.col(key), F.col(keys.columns[0])
    bits = keys.groupBy(row(listed).alias(_row)).agg(F.bitmap_construct_agg(at(listed).cast("long")).alias(_bits))
    byte = F.conv(F.hex(F.substring(_bits, F.shiftright(at(own), 3) + 1, F.lit(1))), 16, 10).cast("int")
    found = df.withColumn(_row, row(own)).join(F.broadcast(bits), _row, "left")
    weight = F.element_at(F.array(*(F.lit(1 << i) for i in range(8))), at(own).bitwiseAND(F.lit(7)) + 1)
    return found.withColumn(out, F.coalesce(byte.bitwiseAND(weight) != 0, F.lit(False))).drop(_row, _bits)


def repeated_spans(docs: DataFrame, length: int = 400) -> DataFrame:
    """(doc_id, text_key, start, stop): byte spans of each text that repeated windows cover; spans may overlap. A staged table.

    See the module for the method. Texts of fewer bytes, null and empty ones have no window. Rows that repeat an id with
    other texts are told apart by text_key; rows repeated in full repeat each other's windows, as do windows of one
    document, overlaps included. Null ids are allowed. Extra columns are ignored. Very long texts are read in chunks.
    """
    if length < 64:
        raise ValueError("length: 64 bytes or more")
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    sql, arrow = kind.simpleString(), _arrow(kind)
    rows = docs.select("doc_id", "text", text_key().alias("text_key"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with scratch(spark, "suffixes") as step:
        anchors = step(rows.mapInArrow(_anchor_rows(length, SAMPLE, arrow), ANCHORS.format(id=sql)), "anchors")
        cores = step(anchors.groupBy("core").agg(F.count("*").alias("c")).filter("c > 1"), "cores")
        heads = anchors.filter("head is not null").groupBy("core").agg(F.first("head").alias("head")).join(cores, "core", "left_semi")
        sample = [bytes(r.head) for r in heads.orderBy("core").limit(SPLITTERS).select("head").collect()]
        ranges = 1 + min(len(sample), max(4 * partitions, cores.agg(F.sum("c")).first()[0] // RANGE_ROWS) if sample else 0)
        sample = sorted(set(sample))
        splitters = sorted({sample[len(sample) * j // ranges] for j in range(1, ranges)}) if sample else []
        shared = anchors.join(cores.select("core", (F.col("c") > HOT).alias("hot")), "core")
        by_doc = shared.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("p", "lo", "n", "hot")).alias("anchors"))
        by_doc = step(by_doc, "candidates").withColumnsRenamed({"doc_id": "d", "text_key": "k"})
        texts = with_listed(rows.filter(F.octet_length("text") >= length), "text_key", by_doc.select("k"), "listed").filter("listed")
        texts = texts.join(by_doc, texts["doc_id"].eqNullSafe(by_doc["d"]) & (texts["text_key"] == by_doc["k"])).select("doc_id", "text_key", "text", "anchors")
        runs = texts.mapInArrow(_exchange_rows(length, splitters, 4 * partitions, RUN_BYTES, arrow), EXCHANGED.format(id=sql))
        return stage(runs.groupBy("part").applyInArrow(_merge(length, arrow), SPANS.format(id=sql)), "spans")


def _cut(data: bytes, spans) -> tuple[int, int, bytes]:
    """(removed bytes, maximal removed runs, the rest) for spans that may overlap."""
    kept, at, n_spans, open_to = [], 0, 0, -1
    for start, stop in sorted((s["start"], s["stop"]) for s in spans):
        if start > open_to:
            n_spans += 1
            kept.append(data[at:start])
        open_to = max(open_to, stop)
        at = open_to
    kept.append(data[at:])
    rest = b"".join(kept)
    return len(data) - len(rest), n_spans, rest


def _apply(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                texts, spans = batch.column("text").cast(pa.binary()), batch.column("spans")
                made = []
                for i in range(batch.num_rows):
                    data = texts[i].as_py() or b""
                    removed, n, rest = _cut(data, spans[i].as_py() or ())
                    made.append((len(data), removed, n, hashlib.sha256(rest).hexdigest() if digest else rest))
                keep = [c for c in batch.schema.names if c != "spans" and not (digest and c == "text")]
                kinds = [pa.int64()] * 3 + [pa.string() if digest else pa.binary()]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], keep + ["n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept"])

    return run


def remove_spans(docs: DataFrame, spans: DataFrame, digest: bool = False) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans (maximal runs of removed bytes) and kept, the remaining bytes (which need not be UTF-8: a span may begin inside a character). With ``digest`` kept_sha256 in place of text and kept. Null text: no bytes. A column of a result's name is replaced. ``docs`` and ``spans`` are read twice: texts without spans go no further than their task."""
    docs = docs.drop(*(c for c in docs.columns if c.lower() in {"n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "spans"}))
    lists = spans.groupBy(F.col("doc_id").alias("_span_doc"), F.col("text_key").alias("_span_key")).agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    _key, _listed = free(docs.columns, "_key", "_listed")
    marked = with_listed(docs.withColumn(_key, text_key()), _key, spans.select("text_key"), _listed)
    some = marked.filter(_listed)
    some = some.join(lists, some["doc_id"].eqNullSafe(F.col("_span_doc")) & (some[_key] == F.col("_span_key")), "left").select(*docs.columns, "spans")
    both = some.unionByName(marked.filter(~F.col(_listed)).select(*docs.columns, F.lit(None).cast(some.schema["spans"].dataType).alias("spans")))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if not (digest and f.name == "text"))
    return both.mapInArrow(_apply(digest), f"{kinds}, n_bytes long, n_removed long, n_spans long, " + ("kept_sha256 string" if digest else "kept binary"))


def without_repeats(docs: DataFrame, length: int = 400, digest: bool = False) -> DataFrame:
    """``docs`` without the bytes covered by a string of ``length`` bytes that also starts anywhere else; see ``repeated_spans`` and ``remove_spans``. An empty table gives no rows."""
    return remove_spans(docs, repeated_spans(docs, length), digest)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeats(docs, 400, digest=True)
