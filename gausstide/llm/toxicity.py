"""Operator 1: toxicity scores from a learned lexicon, misspellings included.

The lexicon (whole words, and stems that stand for all words beginning with them) is learned from labelled documents of
the training folds: distributed counts of words and prefixes by label. It is kept as a trie. A word is matched by
intersecting the terms' Levenshtein automata with the trie, as one automaton built as words need it. Each (term, distance) has a weight measured
on the training documents, so an edit distance at which a term also meets ordinary words weighs nothing. Matches are
summed over context windows; matches between quotation marks or after words of attribution count at a discount. A
logistic model turns a document's window sums into its score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gausstide.llm.common import free, table

#: Labelled documents that the model is fitted on at most, those with the least hashes of their ids.
FIT_DOCUMENTS = 20_000
#: A term's share of toxic documents over its share of others, and the least evidence for it (natural logarithm of the
#: odds against chance) beyond the logarithm of the number of terms tried.
MIN_RATIO = 25.0
MIN_SURPRISE = 2.0
WINDOW = 40
QUOTE_DISCOUNT = 0.35
#: Words that announce someone else's speech.
ATTRIBUTION = frozenset(["said", "says", "quote", "quoted", "wrote", "called", "sagte", "schrieb", "dit", "écrit", "dijo", "escribió"])
#: A stem has 3 letters or more (2 in scripts without blanks). All stems of up to so many letters are counted at once,
#: longer ones only where stems of half their length are frequent: see ``_frequent_terms``.
FIRST_STEMS = 10
#: Lengths above this are tried at its doubles only.
EVERY_STEM = 64
QUOTES = frozenset('"“”«»„')
#: Thai, Lao, Burmese, Khmer, Kana and Han letters: words do not end at blanks there, so one may begin at any letter.
_RUN_ON = "\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\U00020000-\U0003FFFF"
RUN_ON = re.compile(f"[{_RUN_ON}]")
TOKEN = re.compile(rf"[{_RUN_ON}]+|(?:(?![{_RUN_ON}])[^\W_])+|[\"“”«»„]")
PLAIN = re.compile(r"[^\W_]+|[\"“”«»„]")
#: Letters from its first on that a term of such a script may have.
RUN_ON_REACH = 8
MEMO = 300_000
#: States of the automaton after which a worker starts it anew.
MAX_STATES = 100_000
FEATURES = 4


def held_out_fold():
    """0 to 4: crc32 of the id as text, modulo 5. A null id is in fold 1: it has no label to learn from, and is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)), F.lit(1))


def allowed_edits(term: str) -> int:
    return 0 if len(term) < 4 else 1 if len(term) < 8 else 2


class Trie:
    """Terms ("word" whole, "stem*" for all words that begin so), matched within their allowed edits.

    The product of the terms' Levenshtein automata with the trie is run as one deterministic automaton that is built as
    words need it. A state holds, for each live node of the trie, the edits between what was read and the node's prefix;
    nodes beyond the edits that any term below them allows are dead, so most words end in the empty state early.
    """

    def __init__(self, terms: list[str]):
        self.terms, self.next, self.ends, self.most = terms, [{}], [[]], [0]
        for i, t in enumerate(terms):
            bare = t.rstrip("*")
            at, k = 0, allowed_edits(bare)
            self.most[0] = max(self.most[0], k)
            for c in bare:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.ends.append([])
                    self.most.append(0)
                at = self.next[at][c]
                self.most[at] = max(self.most[at], k)
            self.ends[at].append((i, t.endswith("*"), k, -len(bare)))
        self.letters = {c for children in self.next for c in children}
        self._restart()

    def _restart(self) -> None:
        self.known, self.nodes, self.steps, self.on_stem, self.on_word = {}, [], [], [], []
        self._state({})
        self._state(self._deletions({0: 0}))

    def _deletions(self, live: dict[int, int]) -> dict[int, int]:
        """``live`` with the nodes reached by leaving out letters of the term. Children are numbered above their parents."""
        todo = list(live)
        while todo:
            node = todo.pop()
            d = live[node] + 1
            for child in self.next[node].values():
                if d <= self.most[child] and d < live.get(child, 99):
                    live[child] = d
                    todo.append(child)
        return live

    def _state(self, live: dict[int, int]) -> int:
        key = tuple(sorted(live.items()))
        if key not in self.known:
            self.known[key] = len(self.nodes)
            self.nodes.append(live)
            self.steps.append({})
            reached = [(d, length, i, stem) for node, d in live.items() for i, stem, k, length in self.ends[node] if d <= k]
            self.on_stem.append(min((r[:3] for r in reached if r[3]), default=None))
            self.on_word.append(min((r[:3] for r in reached), default=None))
        return self.known[key]

    def _step(self, state: int, c: str) -> int:
        live: dict[int, int] = {}
        for node, d in self.nodes[state].items():
            if d < self.most[node] and d + 1 < live.get(node, 99):
                live[node] = d + 1
            for letter, child in self.next[node].items():
                e = d + (letter != c)
                if e <= self.most[child] and e < live.get(child, 99):
                    live[child] = e
        return self._state(self._deletions(live))

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, distance) of the nearest term, of equally near ones the longest, then the first; None without one."""
        if len(self.nodes) > MAX_STATES:
            self._restart()
        state, best, letters, steps, on_stem = 1, None, self.letters, self.steps, self.on_stem
        for c in word:
            if c not in letters:
                c = ""
            to = steps[state].get(c)
            if to is None:
                to = steps[state][c] = self._step(state, c)
            state = to
            if not state:
                break
            found = on_stem[state]
            if found is not None and (best is None or found < best):
                best = found
        found = self.on_word[state]
        if found is not None and (best is None or found < best):
            best = found
        return (best[2], best[0]) if best else None


@lru_cache(maxsize=2)
def _trie(terms: tuple[str, ...]) -> Trie:
    """The trie and its automaton, kept by each Python worker from task to task."""
    return Trie(list(terms))


class Matcher(dict):
    """word -> match, remembered per task up to MEMO words."""

    def __init__(self, trie: Trie):
        super().__init__()
        self.trie = trie

    def __missing__(self, word: str):
        if len(self) > MEMO:
            self.clear()
        self[word] = found = self.trie.match(word)
        return found


def tokens_of(text: str | None) -> list[str]:
    """Lower-case words (underscores part them) and quotation marks; of scripts without blanks, what follows each letter."""
    if not text:
        return []
    text = text.lower()
    if text.isascii() or not RUN_ON.search(text):
        return PLAIN.findall(text)
    out: list[str] = []
    for t in TOKEN.findall(text):
        if RUN_ON.match(t):
            out.extend(t[i : i + RUN_ON_REACH] for i in range(len(t)))
        else:
            out.append(t)
    return out


def document_matches(matcher: Matcher, text: str | None) -> tuple[list[str], list[tuple[int, tuple[int, int]]]]:
    tokens = tokens_of(text)
    return tokens, [(i, m) for i, m in enumerate(map(matcher.__getitem__, tokens)) if m]


def document_features(tokens: list[str], found: list, weights: np.ndarray) -> tuple[float, float, float, float]:
    """The largest window sum, the logarithm of the whole sum, matches per 100 words, and the number of terms."""
    if not found:
        return (0.0,) * FEATURES
    marks = np.cumsum([t in QUOTES for t in tokens])
    at, w, terms = [], [], set()
    for i, (term, d) in found:
        x = weights[term, d]
        if x <= 0:
            continue
        inside = marks[i] % 2 == 1 and marks[-1] > marks[i]
        told = any(t in ATTRIBUTION for t in tokens[max(0, i - 4) : i])
        at.append(i)
        w.append(x * (QUOTE_DISCOUNT if inside or told else 1.0))
        terms.add(term)
    if not at:
        return (0.0,) * FEATURES
    at, total = np.array(at), np.concatenate([[0.0], np.cumsum(w)])
    window = (total[np.searchsorted(at, at + WINDOW)] - total[:-1]).max()
    return float(window), math.log1p(total[-1]), min(20.0, 100.0 * len(at) / len(tokens)), float(min(len(terms), 10))


def _stem_lengths(word: str, low: int, high: int) -> Iterator[int]:
    """Lengths of the stems of a word from ``low`` to ``high``."""
    most = min(len(word) - 1, high)
    least = 2 if RUN_ON.match(word) else 3
    yield from range(max(low, least), min(most, EVERY_STEM) + 1)
    double = 2 * EVERY_STEM
    while double <= most:
        if double >= low:
            yield double
        double *= 2


def _counted(keep: frozenset | None, low: int, high: int, roots: frozenset | None):
    """(term, n): documents of a task that hold each word (where ``low`` is 1) and each stem of ``low`` to ``high`` letters. ``keep`` limits the terms, ``roots`` the words whose stems are counted: to those with one of these stems."""
    sizes = sorted({len(r) - 1 for r in roots or ()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column("text"):
                terms = set()
                for w in set(tokens_of(text.as_py())):
                    if low == 1:
                        terms.add(w)
                    if roots is None or any(w[:k] + "*" in roots for k in sizes if k < len(w)):
                        terms.update(w[:k] + "*" for k in _stem_lengths(w, low, high))
                counts.update(terms & keep if keep is not None else terms)
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

    return run


def _frequent_terms(count, least: int) -> dict[str, int]:
    """Words and stems found in ``least`` toxic documents or more, of any length: a stem is no more frequent than its own beginnings, so longer ones are sought behind frequent ones alone, twice as far each time. ``count(keep, low, high, roots)`` counts documents."""
    found = {r[0]: r[1] for r in count(None, 1, FIRST_STEMS, None).filter(F.col("n") >= least).collect()}
    high = FIRST_STEMS
    while True:
        tried = [k for k in range(high, 0, -1) if k <= EVERY_STEM or k & (k - 1) == 0]  # the longest length counted so far
        roots = frozenset(t for t in found if t.endswith("*") and len(t) - 1 == tried[0])
        if not roots:
            return found
        found |= {r[0]: r[1] for r in count(None, high + 1, 2 * high, roots).filter(F.col("n") >= least).collect()}
        high *= 2


def choose_terms(pos: dict[str, int], neg: dict[str, int], n_pos: int, n_neg: int) -> list[str]:
    """Terms far likelier in toxic documents, those with most evidence first; of equal evidence whole words, then the longest.

    Every term with enough evidence is taken, however many there are. A term that a chosen stem covers is skipped, and so is a stem whose evidence is that of chosen longer terms.
    """
    prior = max(n_pos, 1) / max(n_pos + n_neg, 1)

    def surprise(k: int, miss: int) -> float:
        """How far the share of toxic documents among those with a term is from chance: documents times relative entropy."""
        n = k + miss
        if k <= n * prior:
            return 0.0
        return k * math.log(k / n / prior) + (miss * math.log(miss / n / (1 - prior)) if miss else 0.0)

    def good(k: int, miss: int) -> bool:
        return k > 3 * miss and (k + 0.5) / (n_pos + 1) >= MIN_RATIO * (miss + 0.5) / (n_neg + 1) and surprise(k, miss) >= MIN_SURPRISE + math.log(max(len(pos), 1))

    order = sorted((t for t in pos if good(pos[t], neg.get(t, 0))), key=lambda t: (-round(surprise(pos[t], neg.get(t, 0)), 3), t.endswith("*"), -len(t), t))
    chosen: list[str] = []
    for t in order:
        bare = t.rstrip("*")
        if any(c == bare or c.endswith("*") and bare.startswith(c[:-1]) for c in chosen):
            continue
        inside = [c for c in chosen if t.endswith("*") and c.startswith(bare)]
        if inside and not good(pos[t] - sum(pos[c] for c in inside), neg.get(t, 0)):
            continue
        chosen.append(t)
    return chosen


def _sample_rows(trie_terms: list[str]):
    """Per training document: its matches (term, distance) with weight 1, for the weights; kept small by the fit bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(_trie(tuple(trie_terms)))
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                _, found = document_matches(matcher, text.as_py())
                rows.append(sorted({t * 3 + d for _, (t, d) in found}))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(rows, pa.list_(pa.int32()))], ["toxic", "found"])

    return run


def _feature_rows(terms: list[str], weights: np.ndarray, model: np.ndarray | None, carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(_trie(tuple(terms)))
        for batch in batches:
            rows, hits = [], []
            for text in batch.column("text"):
                tokens, found = document_matches(matcher, text.as_py())
                found = [f for f in found if weights[f[1]] > 0]
                rows.append(document_features(tokens, found, weights))
                hits.append(len(found))
            x = np.array(rows, float).reshape(-1, FEATURES)
            if model is None:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(list(x), pa.list_(pa.float64()))], [*carry, "x"])
            else:
                score = 1 / (1 + np.exp(-np.clip(model[0] + x @ model[1:], -30, 30)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(score), pa.array(hits, pa.int64())], [*carry, "score", "n_matches"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the intercept is not penalised."""
    a = np.hstack([np.ones((len(x), 1)), x])
    b, ridge = np.zeros(a.shape[1]), np.r_[0.01, np.full(x.shape[1], 0.5)]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge), a.T @ (y - p) - ridge * b)
        b = b + np.clip(step, -5, 5)
        if abs(step).max() < 1e-8:
            break
    return b


def fit(docs: DataFrame, labels: DataFrame, max_documents: int = FIT_DOCUMENTS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(terms, weights by term and distance, logistic model) from labelled documents whose fold is not 0.

    At most ``max_documents`` documents are used, those with the least hashes of their ids; equal texts count once. A
    document with several labels is toxic if any is; null labels are left out. Without toxic documents there are no
    terms, and every score is the smoothed share of label 1.
    """
    marked = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(held_out_fold() != 0)
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_documents)
    sample = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id").groupBy("text").agg(F.max("toxic").cast("int").alias("toxic")).persist()
    sizes = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    least = max(3, n_pos // 100)

    def count(label: int):
        rows = sample.filter(F.col("toxic") == label).select("text")
        return lambda *how: rows.mapInArrow(_counted(*how), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))

    pos = _frequent_terms(count(1), least)
    longest = max((len(t) - 1 for t in pos if t.endswith("*")), default=0)
    neg = {r[0]: r[1] for r in count(0)(frozenset(pos), 1, longest, None).collect()} if pos else {}
    terms = choose_terms(pos, neg, n_pos, n_neg)
    weights = np.zeros((max(1, len(terms)), 3))
    if terms:
        seen = np.zeros((2, len(terms), 3))
        found = sample.mapInArrow(_sample_rows(terms), "toxic int, found array<int>").select("toxic", F.explode("found").alias("f")).groupBy("toxic", "f").count()
        for toxic, f, n in found.collect():
            seen[toxic, f // 3, f % 3] = n
        weights = np.log((seen[1] + 0.5) / (n_pos + 1)) - np.log((seen[0] + 0.5) / (n_neg + 1))
        for d in (1, 2):  # too rare to measure: half the weight of one edit less
            rare = seen[:, :, d].sum(0) < 3
            weights[rare, d] = weights[rare, d - 1] / 2
        weights[weights < 1.5] = 0
    rows = sample.mapInArrow(_feature_rows(terms, weights, None, ["toxic"]), "toxic int, x array<double>").toArrow()
    sample.unpersist()
    y = rows.column("toxic").to_numpy().astype(float)
    if not n_pos or not n_neg or not terms:
        share = (y.sum() + 0.5) / (len(y) + 1)
        return terms, weights, np.r_[math.log(share / (1 - share)), np.zeros(FEATURES)]
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, FEATURES)
    return terms, weights, _logistic(x, y)


def score(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], carry: str = "doc_id") -> DataFrame:
    """(carry, score, n_matches) of every row. Null and empty texts have no match and get the score of such texts."""
    kind = docs.schema[carry].dataType.simpleString()
    return docs.select(carry, "text").mapInArrow(_feature_rows(*model, [carry]), f"`{carry}` {kind}, score double, n_matches long")


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose score reaches ``threshold``; all columns kept, whatever their names."""
    columns = docs.columns
    _score, _matches = free(columns, "_score", "_matches")
    model = fit(docs, labels)
    terms, weights, coef = model
    run = _feature_rows(terms, weights, coef, columns)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kinds}, `{_score}` double, `{_matches}` long").filter(F.col(_score) < threshold).select(*columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (held_out_fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_matches")
