"""What exact substring deduplication by words and by bytes have in common.

Every window of `window` units (words or bytes) of a document picks, by its own content alone, one of its grams
of `gram` units: the one of the least hash.  Consecutive windows with the same pick form a *path*, a run of text
that travels as one row: equal windows lie in paths with equal grams, so a window can only repeat where its gram
stands in two documents.  This goes in three steps, none of which gathers all rows of a gram in one task:

1. Documents are dealt into blocks of a bounded size by a hash of doc_id.  Each block sends the different grams
   that it has, once each, as 32-bit prints to buckets whose number grows with the input.
2. A bucket answers each block with those of its prints that stand in two documents or more.
3. Blocks find their paths again and keep those with such a gram: `paths`.

`spans` are then joined to blocks, and a function of the caller makes the result of each document.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternfish import session
from lanternfish.llm import rolling

BLOCK_BYTES = 2 << 20
BUCKET_PRINTS = 1 << 20


@dataclasses.dataclass(frozen=True)
class Units:
    """How a text is cut: by_word or by byte; window and gram in units; bytes of text for each path, about."""

    by_word: bool
    window: int = 50
    gram: int = 25
    path_bytes: int = 70

    def cut(self, raw: np.ndarray, offsets: np.ndarray):
        """(values to hash, the same by independent letters, first unit of each text)."""
        if not self.by_word:
            return rolling.letters(raw), rolling.letters(raw, 1), offsets
        starts, stops, first = rolling.words(raw, offsets)
        return *(rolling.word_hashes(raw, starts, stops, which) for which in (0, 1)), first


WORDS = Units(True)
BYTES = Units(False, gram=18, path_bytes=16)


@dataclasses.dataclass
class Paths:
    """Arrays by path: text, first unit within the text, windows, gram hash, an independent hash of all its units, and the
    gram's place behind the first unit."""

    text: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    gram: np.ndarray
    content: np.ndarray
    pick: np.ndarray


def paths_of(raw: np.ndarray, offsets: np.ndarray, units: Units) -> Paths:
    values, others, first = units.cut(raw, offsets)
    sums = rolling.prefix(values)
    grams = rolling.all_spans(sums, units.gram)
    picks = rolling.minimisers(grams, units.window - units.gram + 1)
    size = np.diff(first)
    room = np.maximum(size - units.window + 1, 0)
    ends = np.cumsum(room)
    total = int(ends[-1]) if len(ends) else 0
    place = np.arange(total) + np.repeat(first[:-1] - (ends - room), room)
    text = np.repeat(np.arange(len(size)), room)
    pick = picks[place]
    new = np.ones(total, bool)
    new[1:] = (pick[1:] != pick[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, total))
    begin, text, pick = place[at], text[at], pick[at]
    gram = rolling.mix(grams[pick])
    content = rolling.span_hash(rolling.prefix(others, 1), begin, begin + n - 1 + units.window, 1)
    return Paths(text, begin - first[text], n, gram, content, pick - begin)


def each(table: pa.Table, units: Units) -> Iterator[tuple[int, Paths]]:
    column = column_of(table)
    for a, b in rolling.steps(column):
        yield a, paths_of(*rolling.text_bytes(column.slice(a, b - a)), units)


def _names(gram: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and print of a gram as one number."""
    return (((gram >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32)) | (gram & np.uint64(0xFFFFFFFF))


class Rows:
    """Finds a block's rows by doc_id and version; a version numbers the different texts of one doc_id, which all
    lie in one block, so numbers stay the same from step to step."""

    def __init__(self, table: pa.Table) -> None:
        ids, key = pc.fill_null(table["doc_id"], 0).to_numpy(), table["key"].to_numpy()
        self.ids, at = np.unique(ids, return_inverse=True)
        by = np.lexsort((key, at))
        new = np.zeros(len(by), np.int64)
        new[1:] = (key[by[1:]] != key[by[:-1]]) & (at[by[1:]] == at[by[:-1]])
        count = np.cumsum(new)
        begin = np.searchsorted(at[by], np.arange(len(self.ids)))
        self.version = np.empty(len(by), np.int64)
        self.version[by] = count - count[begin[at[by]]] if len(by) else count
        self.name = at.astype(np.int64) << 32 | self.version

    def names(self, ids: np.ndarray, version: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ids, ids).astype(np.int64) << 32 | version

    def rows(self, ids: np.ndarray, version: np.ndarray) -> np.ndarray:
        """A row of each; all rows of one name have one text."""
        names, where = np.unique(self.name, return_index=True)
        return where[np.searchsorted(names, self.names(ids, version))]


def blocks(docs: DataFrame, text: str = "text") -> tuple[DataFrame, int]:
    """((block, doc_id, key, text) of every row, bytes of text); key tells rows of one doc_id apart by text.  Rows
    without a doc_id are dealt by their text, so that many of them don't share a block."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = block_count(size)
    key = F.xxhash64("doc_id", "text")
    dealt = F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text")), F.lit("block")), F.lit(count))
    return rows.select(dealt.cast("int").alias("block"), "doc_id", key.alias("key"), "text"), size


def _growth(size: int) -> int:
    """Blocks and buckets meet in pairs.  Above 256 GB of text both grow with its root, so that a pair's row still
    holds many prints and rows grow no faster than the text."""
    return max(1, math.isqrt(size >> 38))


def buckets_of(size: int, units: Units) -> int:
    return max(1, size // (units.path_bytes * BUCKET_PRINTS * _growth(size)))


def shared_prints(dealt: DataFrame, size: int, units: Units) -> DataFrame:
    """(block, bucket, prints): to each block, by bucket, the prints of its grams that stand in two documents."""
    buckets = buckets_of(size, units)

    def prints(table: pa.Table) -> pa.Table:
        rolling.release()
        has = pc.is_valid(table["doc_id"]).to_numpy()
        number = np.unique(pc.fill_null(table["doc_id"], 0).to_numpy(), return_inverse=True)[1]
        grams, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for a, p in each(table, units):
            use = has[p.text + a]
            grams.append(p.gram[use])
            docs.append(number[p.text[use] + a])
        name, doc = _names(np.concatenate(grams), buckets), np.concatenate(docs)
        by = np.lexsort((doc, name))
        name, doc = name[by], doc[by]
        begin = np.flatnonzero(np.append(True, name[1:] != name[:-1])[: len(name)])
        twice = np.zeros(len(name), bool)
        twice[1:] = (name[1:] == name[:-1]) & (doc[1:] != doc[:-1])
        several = np.logical_or.reduceat(twice, begin) if len(begin) else np.zeros(0, bool)
        name = name[begin]
        bucket = (name >> np.uint64(32)).astype(np.int64)
        edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)])
        one, two = [], []
        for i, j in zip(edge, np.append(edge, len(name))[1:], strict=True):
            low, flag = name[i:j].astype(np.uint32), several[i:j]
            one.append(low[~flag].tobytes())
            two.append(low[flag].tobytes())
        block = table["block"][0].as_py()
        return pa.table({"bucket": pa.array(bucket[edge], pa.int32()), "block": pa.array([block] * len(edge), pa.int32()), "one": pa.array(one, pa.binary()), "two": pa.array(two, pa.binary())})

    def shared(table: pa.Table) -> pa.Table:
        rolling.release()
        one = [np.frombuffer(x, np.uint32) for x in table["one"].to_pylist()]
        two = [np.frombuffer(x, np.uint32) for x in table["two"].to_pylist()]
        every = np.sort(np.concatenate([*one, *two]))
        again = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *two]))
        answers = []
        for x, y in zip(one, two, strict=True):
            at = np.minimum(np.searchsorted(again, x), max(len(again) - 1, 0))
            answers.append(np.concatenate([x[again[at] == x] if len(again) else x[:0], y]).tobytes())
        return pa.table({"block": table["block"], "bucket": table["bucket"], "prints": pa.array(answers, pa.binary())})

    sent = dealt.groupBy("block").applyInArrow(prints, "bucket int, block int, one binary, two binary")
    return sent.groupBy("bucket").applyInArrow(shared, "block int, bucket int, prints binary")


class Known:
    """A block's answers: which of its grams stand in two documents."""

    def __init__(self, answer: pa.Table, buckets: int) -> None:
        parts = [np.zeros(0, np.uint64)]
        for bucket, found in zip(answer["bucket"].to_pylist(), answer["prints"].to_pylist(), strict=True):
            parts.append(np.frombuffer(found, np.uint32).astype(np.uint64) | np.uint64(bucket << 32))
        self.names, self.buckets = np.sort(np.concatenate(parts)), buckets

    def has(self, gram: np.ndarray) -> np.ndarray:
        name = _names(gram, self.buckets)
        return self.names[np.minimum(np.searchsorted(self.names, name), len(self.names) - 1)] == name if len(self.names) else np.zeros(len(name), bool)


def paths(dealt: DataFrame, size: int, units: Units) -> DataFrame:
    """(gram, content, doc_id, version, start, windows, pick) of paths whose gram stands in two documents or more.
    Rows without a doc_id have none."""
    buckets = buckets_of(size, units)

    def keep(table: pa.Table, answer: pa.Table) -> pa.Table:
        rolling.release()
        known = Known(answer, buckets)
        out: dict[str, list] = {n: [] for n in ("gram", "content", "row", "start", "windows", "pick")}
        if len(known.names) and table.num_rows:
            for a, p in each(table, units):
                use = known.has(p.gram)
                for n, x in (("gram", p.gram.view(np.int64)), ("content", p.content.view(np.int64)), ("row", p.text + a), ("start", p.start), ("windows", p.windows), ("pick", p.pick)):
                    out[n].append(x[use])
        c = {n: np.concatenate(x) if x else np.zeros(0, np.int64) for n, x in out.items()}
        version = Rows(table).version[c["row"]] if table.num_rows else c["row"]
        made = pa.table({"gram": c["gram"], "content": c["content"], "doc_id": table["doc_id"].take(pa.array(c["row"])), "version": pa.array(version, pa.int32()), **{n: pa.array(c[n], pa.int32()) for n in ("start", "windows", "pick")}})
        return made.filter(made["doc_id"].is_valid())

    back = shared_prints(dealt, size, units)
    return dealt.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(keep, "gram long, content long, doc_id long, version int, start int, windows int, pick int")


def sources(found: DataFrame) -> DataFrame:
    """(gram, content, first, version, start, windows, pick): each different path with the coordinates of its source,
    its first place in the document of the smallest doc_id."""
    place = F.min(F.struct("doc_id", "version", "start", "windows", "pick")).alias("s")
    return found.groupBy("gram", "content").agg(place).select("gram", "content", F.col("s.doc_id").alias("first"), "s.version", "s.start", "s.windows", "s.pick")


def block_of(doc_id: str, count: int) -> Column:
    return F.pmod(F.xxhash64(F.col(doc_id), F.lit("block")), F.lit(count)).cast("int")


def column_of(table: pa.Table, name: str = "text") -> pa.Array:
    column = table[name].combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], table.schema.field(name).type)
    return column


def finish(dealt: DataFrame, spans: DataFrame, count: int, result: Callable[..., dict[str, pa.Array]], units: Units, schema: str, holds: Callable[..., np.ndarray] | None = None) -> DataFrame:
    """Joins spans to blocks.  result(raw, offsets, first unit of each text, (unit starts, stops), mask of removed
    units) gives columns; doc_id comes first in the schema.  holds(raw, places, first units, end units, digests) tells which spans
    hold, where spans have digests."""
    names = ("doc_id", "version", "start", "stop", *(["digest"] if holds else []))
    right = spans.select(block_of("doc_id", count).alias("block"), *names)

    def run(table: pa.Table, marks: pa.Table) -> pa.Table:
        lines = Rows(table)
        keys = lines.names(marks["doc_id"].to_numpy(), marks["version"].to_numpy())
        by = np.argsort(keys, kind="stable")
        keys, start, stop = keys[by], marks["start"].to_numpy()[by], marks["stop"].to_numpy()[by]
        column = column_of(table)
        own = lines.name
        out: dict[str, list] = {}
        for a, b in rolling.steps(column, 1 << 20):
            raw, offsets = rolling.text_bytes(column.slice(a, b - a))
            starts, stops, first = rolling.words(raw, offsets) if units.by_word else (None, None, offsets)
            low, high = np.searchsorted(keys, own[a:b], "left"), np.searchsorted(keys, own[a:b], "right")
            n = high - low
            which = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)
            base = np.repeat(first[:-1], n)
            if holds and len(which):
                good = holds(raw, (starts, stops), base + start[which], base + stop[which], marks["digest"].take(pa.array(by[which])).to_pylist())
                which, base = which[good], base[good]
            edge = np.zeros(int(first[-1]) + 1, np.int64)
            np.add.at(edge, base + start[which], 1)
            np.add.at(edge, base + stop[which], -1)
            removed = np.cumsum(edge[:-1]) > 0
            for name, x in result(raw, offsets, first, (starts, stops), removed).items():
                out.setdefault(name, []).append(x)
        made = {n: pa.concat_arrays(x) for n, x in out.items()}
        return pa.table({"doc_id": table["doc_id"], **made})

    empty = schema_of(schema)

    def safe(table: pa.Table, marks: pa.Table) -> pa.Table:
        rolling.release()
        return run(table, marks) if table.num_rows else empty.empty_table()

    return dealt.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(safe, schema)


def schema_of(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in schema.split(","))])


def block_count(size: int) -> int:
    return max(1, -(-size // (BLOCK_BYTES * _growth(size))))
