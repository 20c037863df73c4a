"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

Words are maximal runs of digits, letters a-z (A-Z count as lower case) and bytes from 0x80.  The automaton of
all items follows the words of a document and keeps the longest matching length.  A span is hit where that
length reaches LENGTH words (the length limit), or where a whole item of fewer words ends (the coverage limit:
all of the item).  No span is hit without as many words in a row as the shortest limit that also stand in an item, so
the automaton walks only through runs of such words; these are found with array operations, by hash.

Items are read to the driver in portions of at most PORTION_WORDS words, counted first; each portion is an
automaton of its own, built once in each worker, and a narrow pass over the documents, so a benchmark of any size
needs bounded memory and no document moves.  Hits of portions are united.

Defined results: null texts and items have no words; items of the same id unite; an item without words never
occurs; an item without an id hits words but is neither counted nor listed; documents are handled row by row, so repeated rows, ties and extra columns don't matter; an empty
benchmark leaves every document without a hit; a very long text is a step of its own and handled whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternfish import session
from lanternfish.llm import rolling

_OWN = ("n_words", "hit_spans", "hit_items")
LENGTH = 10
PORTION_WORDS = 500_000
_INSIDE = np.array([48 <= b < 58 or 97 <= b < 123 or b >= 128 for b in range(256)])


class Automaton:
    """A suffix automaton over several sequences of word numbers."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.items: dict[int, set[str]] = {}  # by state: items with a window of `length` words that ends there
        self.short: dict[int, list[tuple[int, str]]] = {}  # by state: whole short items, with their lengths
        self.up: list[int] = []

    def _clone(self, p: int, c: int) -> int:
        q = self.next[p][c]
        if self.len[p] + 1 == self.len[q]:
            return q
        new = self._state(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.len.append(length)
        self.link.append(link)
        return len(self.len) - 1

    def add(self, sequence: list[int]) -> None:
        last = 0
        for c in sequence:
            if c in self.next[last]:
                last = self._clone(last, c)
                continue
            new, p = self._state(self.len[last] + 1, 0, {}), last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            self.link[new] = self._clone(p, c) if p >= 0 else 0
            last = new

    def step(self, state: int, length: int, c: int) -> tuple[int, int]:
        while c not in self.next[state]:
            state = self.link[state]
            if state < 0:
                return 0, 0
            length = self.len[state]
        return self.next[state][c], length + 1

    def shortened(self, state: int, length: int) -> int:
        """The state of the suffix of `length` words of what ends at `state`."""
        while self.len[self.link[state]] >= length:
            state = self.link[state]
        return state

    def mark(self, item: str, sequence: list[int], window: int) -> None:
        state = length = 0
        for c in sequence:
            state, length = self.step(state, length, c)
            if length >= window:
                self.items.setdefault(self.shortened(state, window), set()).add(item)
        if sequence and len(sequence) < window:
            self.short.setdefault(self.shortened(state, len(sequence)), []).append((len(sequence), item))

    def close(self) -> None:
        """For each state, the nearest one on its suffix links, itself included, where a short item ends."""
        self.up = [-1] * len(self.len)
        for s in sorted(range(len(self.len)), key=self.len.__getitem__):
            self.up[s] = s if s in self.short else self.up[self.link[s]] if s else -1

    def hits(self, sequence: list[int], window: int) -> Iterator[tuple[int, int, set[str]]]:
        """(first word, end word, items) of each span that is hit."""
        state = length = 0
        for i, c in enumerate(sequence):
            state, length = self.step(state, length, c)
            if length >= window:
                at = self.shortened(state, window)
                yield i + 1 - window, i + 1, self.items.get(at, set())
            s = self.up[state]
            while s >= 0:
                for size, item in self.short[s]:
                    if size <= length:
                        yield i + 1 - size, i + 1, {item}
                s = self.up[self.link[s]] if s else -1


def _words(raw: np.ndarray, offsets: np.ndarray):
    small = rolling.lower(raw)
    return small, *rolling.words(small, offsets, ~_INSIDE[small])


class Matcher:
    """Finds the spans of texts that occur in a portion of items."""

    def __init__(self, items: list[tuple[str, str | None]], length: int) -> None:
        self.length = length
        raw, offsets = rolling.text_bytes(pa.array([t for _, t in items], pa.string()))
        small, starts, stops, first = _words(raw, offsets)
        self.known, ids = np.unique(rolling.word_hashes(small, starts, stops), return_inverse=True)
        sequences = [ids[a:b].tolist() for a, b in zip(first, first[1:], strict=False)]
        self.least = min([length, *(len(s) for s in sequences if s)])
        self.runs = np.unique(self._runs(rolling.word_hashes(small, starts, stops), first)[1])
        self.automaton = Automaton()
        for s in sequences:
            self.automaton.add(s)
        for (item, _), s in zip(items, sequences, strict=True):
            self.automaton.mark(item, s, length)
        self.automaton.close()

    def _runs(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first words, hashes) of the runs of `least` words within a text."""
        h = rolling.mix(rolling.all_spans(rolling.prefix(words), self.least))
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        at = np.flatnonzero(text[: len(h)] == text[self.least - 1 :]) if len(h) else np.zeros(0, np.int64)
        return at, h[at]

    def spans(self, raw: np.ndarray, offsets: np.ndarray):
        """(word starts, word stops, first word of each text, {text: [(first word, end word, items)]})."""
        small, starts, stops, first = _words(raw, offsets)
        found: dict[int, list] = {}
        if len(starts) and len(self.known):
            h = rolling.word_hashes(small, starts, stops)
            begin, run = self._runs(h, first)
            begin = begin[self.runs[np.minimum(np.searchsorted(self.runs, run), len(self.runs) - 1)] == run]
            edge = np.zeros(len(h) + 1, np.int64)
            edge[begin] += 1
            edge[begin + self.least] -= 1  # begins differ, so do ends
            inside = np.cumsum(edge[:-1]) > 0
            cut = np.zeros(len(h) + 1, bool)
            cut[first] = True
            begins = np.flatnonzero(inside & (cut[:-1] | np.append(True, ~inside[:-1])))
            ends = np.flatnonzero(inside & (cut[1:] | np.append(~inside[1:], True))) + 1
            at = np.zeros(len(h), np.int64)
            at[inside] = np.searchsorted(self.known, h[inside])
            for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
                text = int(np.searchsorted(first, a, "right")) - 1
                base = a - int(first[text])
                for i, j, items in self.automaton.hits(at[a:b].tolist(), self.length):
                    found.setdefault(text, []).append((base + i, base + j, items))
        return starts, stops, first, found


def find(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", length: int = LENGTH, portion_words: int = PORTION_WORDS, cut: bool = False) -> DataFrame:
    """docs with n_words long, hit_spans array<struct<first:int, stop:int>> (merged word ranges) and hit_items
    array<string> (sorted as strings); with cut, docs with texts without these ranges instead."""
    spark = docs.sparkSession
    session.ship_package(spark)
    items = items.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text")).where("text is not null")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    portions = max(1, -(-size // (2 * portion_words)))  # a word has a character and a separator at least
    own = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("stop", T.IntegerType())]))), T.StructField("hit_items", T.ArrayType(T.StringType()))])
    kept = [f for f in docs.schema.fields if f.name not in own.names]
    out = docs.select(*[F.col(f"`{f.name}`") for f in kept])
    for k in range(portions):
        some = [(r.id, r.text) for r in items.where(F.pmod(F.xxhash64("id", "text"), F.lit(portions)) == k).collect()]
        shared = spark.sparkContext.broadcast(some)
        last = cut and k == portions - 1
        schema = T.StructType(kept if last else kept + own.fields)
        out = out.mapInArrow(_finder(shared, schema, text, length, first=k == 0, cut=last), schema)
    return out


_MATCHERS: dict[tuple[str, int], Matcher] = {}


def _matcher(shared, length: int) -> Matcher:
    """The matcher of a portion, kept for later tasks of this worker; a few portions at a time."""
    items = shared.value
    key = (hashlib.sha256(repr(items).encode()).hexdigest(), length)
    if key not in _MATCHERS:
        while len(_MATCHERS) > 2:
            _MATCHERS.pop(next(iter(_MATCHERS)))
        _MATCHERS[key] = Matcher(items, length)
    return _MATCHERS[key]


def _finder(shared, schema, text, length, first, cut):
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(shared, length)
        for batch in batches:
            for a, b in rolling.steps(batch.column(text)):
                part = batch.slice(a, b - a)
                raw, offsets = rolling.text_bytes(part.column(text))
                starts, stops, begin, found = matcher.spans(raw, offsets)
                n = len(part)
                spans, items = [[]] * n, [[]] * n
                if not first:
                    spans = [[(s["first"], s["stop"]) for s in x] for x in part.column("hit_spans").to_pylist()]
                    items = part.column("hit_items").to_pylist()
                for t, hits in found.items():
                    spans[t] = merged([*spans[t], *((i, j) for i, j, _ in hits)])
                    items[t] = sorted({*items[t]}.union(*(x - {None} for _, _, x in hits)))
                kind = pa.list_(pa.struct([("first", pa.int32()), ("stop", pa.int32())]))
                own = {
                    "n_words": pa.array(np.diff(begin), pa.int64()),
                    "hit_spans": pa.array([[{"first": i, "stop": j} for i, j in s] for s in spans], kind),
                    "hit_items": pa.array(items, pa.list_(pa.string())),
                }
                if cut and any(spans):
                    texts = part.column(text).to_pylist()
                    for t in (t for t in range(n) if spans[t]):
                        i, j = begin[t], begin[t + 1]
                        texts[t] = _without(texts[t], spans[t], starts[i:j], stops[i:j], int(offsets[t]))
                    own[text] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([own[x] if x in own else part.column(x) for x in names], names=names)

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for i, j in sorted(spans):
        if out and i <= out[-1][1]:
            out[-1] = (out[-1][0], max(j, out[-1][1]))
        else:
            out.append((i, j))
    return out


def report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256 and contaminated instead of spans."""
    found = find(docs, items, **options)
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + (s["stop"] - s["first"]))
    return found.select("*", hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated")).drop("hit_spans", "hit_items")


def removed(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs whose texts have lost the hit spans, each from its first word's to its last word's end, with one
    space in place of it; other texts stay as they are, byte for byte.  All rows and columns are kept, those with the names
    of what find() gives too.  The last portion's pass cuts the texts."""
    renamed = {c: f"__{c}" for c in docs.columns if c in _OWN}
    found = find(docs.withColumnsRenamed(renamed), items, text=text, cut=True, **options)
    return found.select([F.col(f"`{renamed.get(c, c)}`").alias(c) for c in docs.columns])


def _without(text: str, spans: list[tuple[int, int]], starts: np.ndarray, stops: np.ndarray, base: int) -> str:
    """text without spans of words; starts and stops are those of its own words, base the place of its first byte."""
    data, out, at = text.encode(), [], 0
    for i, j in spans:
        out.append(data[at : int(starts[i]) - base])
        at = int(stops[j - 1]) - base
    out.append(data[at:])
    return b" ".join(x.strip(b" ") for x in out if x.strip(b" ")).decode()


def sha256_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
