"""Substring deduplication by bytes: a sparse suffix array, range-partitioned and sorted locally.

The suffixes in question are those that begin at the least gram of some window whose gram stands in two documents
(see `repeats`).  Each block of documents sends its different ones once, as bytes, with all places in the block where
they stand and with the bytes that may stand before them in a window: copies within a block are combined before the
shuffle.  Sampled splitters over the leading GRAM bytes deal them into ranges, and each range is sorted by leading
bytes, then by the rest.  A run of equal leading bytes lies in one range and is carried over the boundaries of
batches; within it, equal neighbours are equal suffixes, and where suffixes of a run differ, their windows are
ordered by multikey quicksort on 8-byte keys: only what ties on one key is sorted by the next.  Equal neighbours then
are equal windows, and the smallest doc_id among them decides, place by place.  A run of more than RUN rows is not
held: its windows are spelled out as rows as they come, and grouped by their bytes with partial aggregates.

All decisions are by bytes.  Hashes only tell which suffixes can be left out, as their gram stands in one document,
and which suffixes of one block are equal (gram and content by independent hashes, 128 bits).

Defined results: null and empty texts have no bytes; a document never removes bytes of itself, nor of rows with the
same doc_id; repeated rows get equal results; rows without a doc_id keep all bytes and remove none; texts of fewer
than WINDOW bytes stay whole; a very long text is a step of its own and handled whole; characters may be cut, for
the unit is the byte; empty tables give empty ones; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfish import session
from lanternfish.llm import repeats, rolling

#: Rows of one run of equal leading bytes that a task holds.
RUN = 1 << 17
#: Rows compared at a time.
_ROWS = 8192
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_MARKS = "doc_id long, version int, start int, stop int, window binary"
_PLACE = np.dtype([("doc", "<i8"), ("version", "<i4"), ("start", "<i4")])


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values laid end to end."""
    offsets = np.append(0, ends).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _runs(n: np.ndarray) -> np.ndarray:
    """0, 1, ... n[0] - 1, 0, 1, ..."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _suffixes(dealt: DataFrame, size: int, units: repeats.Units) -> DataFrame:
    """(body, pick, places): each block's different paths whose gram stands in two documents, as bytes, the place of
    the gram in them, and where they stand in the block, the smallest doc_id first."""
    buckets = repeats.buckets_of(size, units)

    def cut(table: pa.Table, answer: pa.Table) -> pa.Table:
        rolling.release()
        known = repeats.Known(answer, buckets)
        found: dict[str, list] = {n: [np.zeros(0, np.int64)] for n in ("row", "start", "windows", "pick")}
        names = [np.zeros((0, 2), np.uint64)]
        has = pc.is_valid(table["doc_id"]).to_numpy()
        if len(known.names) and table.num_rows:
            for a, p in repeats.each(table, units):
                use = np.flatnonzero(known.has(p.gram) & has[p.text + a])
                names.append(np.stack([p.gram[use], p.content[use]], 1))
                for n, x in (("row", p.text + a), ("start", p.start), ("windows", p.windows), ("pick", p.pick)):
                    found[n].append(x[use])
        row, start, windows, pick = (np.concatenate(x) for x in found.values())
        name = np.concatenate(names)
        place = np.empty(len(row), _PLACE)
        place["doc"] = pc.fill_null(table["doc_id"], 0).to_numpy()[row]
        place["version"] = repeats.Rows(table).version[row] if table.num_rows else 0
        place["start"] = start
        by = np.lexsort((start, place["version"], place["doc"], name[:, 1], name[:, 0]))
        name, place = name[by], place[by]
        first = np.flatnonzero(np.append(True, (name[1:] != name[:-1]).any(axis=1))[: len(by)])
        one = by[first]
        raw, offsets = rolling.text_bytes(table["text"])
        n = windows[one] + units.window - 1
        at = np.repeat(offsets[:-1][row[one]] + start[one], n) + _runs(n)
        ends = np.append(first[1:], len(by)) * _PLACE.itemsize
        return pa.table({"body": _binary(raw[at], np.cumsum(n)), "pick": pa.array(pick[one].astype(np.int32)), "places": _binary(place.view(np.uint8), ends[: len(first)])})

    back = repeats.shared_prints(dealt, size, units)
    return dealt.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(cut, "body binary, pick int, places binary")


def multikey_classes(keys: np.ndarray) -> np.ndarray:
    """For rows of keys, most significant first: a number for each row, equal for equal rows, in sorted order of
    rows.  Sorts by the first key, then each run of ties by the next."""
    n = len(keys)
    order = np.argsort(keys[:, 0], kind="stable")
    new = np.ones(n, bool)
    new[1:] = keys[order[1:], 0] != keys[order[:-1], 0]
    for k in range(1, keys.shape[1]):
        run = np.cumsum(new)
        tied = np.flatnonzero(~new | np.append(~new[1:], False))
        if not len(tied):
            break
        rows = order[tied]
        by = np.lexsort((keys[rows, k], run[tied]))
        rows = rows[by]
        order[tied] = rows
        differs = np.zeros(len(tied), bool)
        differs[1:] = keys[rows[1:], k] != keys[rows[:-1], k]
        new[tied] |= differs
    out = np.empty(n, np.int64)
    out[order] = np.cumsum(new) - 1
    return out


class _Batch:
    """Rows of suffixes as arrays."""

    def __init__(self, rows: pa.Table, gram: int) -> None:
        self.rows, self.n = rows, rows.num_rows
        self.raw, self.edge = _bytes(rows["body"])
        self.pick = rows["pick"].to_numpy()
        places, edge = _bytes(rows["places"])
        self.places, self.place_edge = np.ascontiguousarray(places).view(_PLACE), edge // _PLACE.itemsize
        self.lead = np.lib.stride_tricks.sliding_window_view(self.raw, gram)[self.edge[:-1] + self.pick]
        self.new = np.ones(self.n, bool)
        self.new[1:] = (self.lead[1:] != self.lead[:-1]).any(axis=1)


def _bytes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    data = column.combine_chunks()
    data = pa.concat_arrays(data.chunks) if isinstance(data, pa.ChunkedArray) else data
    data = data.cast(pa.large_binary())
    edge = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    return np.frombuffer(data.buffers()[2], np.uint8)[edge[0] : edge[-1]], edge - edge[0]


def _compared(b: _Batch, window: int) -> pa.RecordBatch:
    """Spans of places whose windows also stand in a document with a smaller doc_id.  b: whole runs, sorted."""
    body = b.rows["body"].combine_chunks()
    same = np.zeros(b.n, bool)
    same[1:] = pc.equal(body[1:], body[:-1]).to_numpy(zero_copy_only=False)
    head = np.flatnonzero(~same)  # rows of different suffixes
    kind = np.cumsum(~same) - 1
    least = np.minimum.reduceat(b.places["doc"][b.place_edge[:-1]], head)
    run = np.cumsum(b.new)[head]
    differs = np.bincount(run)[run] > 1  # other suffixes in its run
    windows = np.diff(b.edge)[head] - window + 1
    base = np.append(0, np.cumsum(windows))
    smallest = np.repeat(least, windows)  # by window of the different suffixes
    some = np.flatnonzero(np.repeat(differs, windows))
    if len(some):
        at = np.repeat(b.edge[:-1][head], windows)[some] + _runs(windows)[some]
        matrix = np.zeros((len(some), -(-window // 8) * 8), np.uint8)
        matrix[:, :window] = np.lib.stride_tricks.sliding_window_view(b.raw, window)[at]
        equal = multikey_classes(matrix.view(">u8").astype(np.uint64))
        low = np.full(int(equal.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(low, equal, smallest[some])
        smallest[some] = low[equal]
    held = np.diff(b.place_edge)
    of = np.repeat(kind, held)  # by place: its suffix
    place = b.places
    whole = ~differs[of]
    later = np.flatnonzero(whole & (least[of] < place["doc"]))
    out = [(place["doc"][later], place["version"][later], place["start"][later], place["start"][later] + windows[of[later]] - 1 + window)]
    rest = np.flatnonzero(~whole)
    if len(rest):
        n = windows[of[rest]]
        offset = _runs(n)
        p = np.repeat(rest, n)
        gone = smallest[base[of[p]] + offset] < place["doc"][p]
        begin = gone & ~(np.append(False, gone[:-1]) & (offset > 0))
        end = gone & ~(np.append(gone[1:], False) & np.append(offset[1:] > 0, False))
        p, begin, end = p[begin], offset[begin], offset[end]
        out.append((place["doc"][p], place["version"][p], place["start"][p] + begin, place["start"][p] + end + window))
    return _marks(*(np.concatenate(x) for x in zip(*out, strict=True)))


def _marks(doc: np.ndarray, version: np.ndarray, start: np.ndarray, stop: np.ndarray, window: pa.Array | None = None) -> pa.RecordBatch:
    arrays = [pa.array(doc, pa.int64()), *(pa.array(x.astype(np.int32)) for x in (version, start, stop))]
    return pa.RecordBatch.from_arrays([*arrays, pa.nulls(len(doc), pa.binary()) if window is None else window], names=["doc_id", "version", "start", "stop", "window"])


def _spelled(b: _Batch, window: int) -> Iterator[pa.RecordBatch]:
    """All windows at all places, a few rows at a time."""
    held = np.diff(b.place_edge)
    windows = np.diff(b.edge) - window + 1
    for i in range(0, len(b.places), _ROWS):
        place = np.arange(i, min(i + _ROWS, len(b.places)))
        row = np.searchsorted(b.place_edge, place, "right") - 1
        n = windows[row]
        offset, p, row = _runs(n), np.repeat(place, n), np.repeat(row, n)
        data = np.lib.stride_tricks.sliding_window_view(b.raw, window)[b.edge[row] + offset]
        start = b.places["start"][p] + offset
        yield _marks(b.places["doc"][p], b.places["version"][p], start, start + window, _binary(data.ravel(), np.arange(1, len(p) + 1) * window))


def _compare(units: repeats.Units, most: int):
    """Over rows sorted by leading bytes and body: marks (doc_id, version, start, stop), and with window for runs of more than
    `most` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: pa.Table | None = None
        crowded: bytes | None = None  # the leading bytes of a run that is being spelled out
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            b = _Batch(pa.concat_tables([carried, rows]) if carried is not None else rows, units.gram)
            carried = None
            if crowded is not None and b.lead[0].tobytes() == crowded:
                end = int(np.append(np.flatnonzero(b.new[1:]) + 1, b.n)[0])
                yield from _spelled(_Batch(b.rows.slice(0, end), units.gram), units.window)
                if end == b.n:
                    continue
                b = _Batch(b.rows.slice(end), units.gram)
            crowded = None
            last = int(np.flatnonzero(b.new)[-1])
            yield from _whole(b, last)
            if b.n - last > most:
                crowded = b.lead[last].tobytes()
                yield from _spelled(_Batch(b.rows.slice(last), units.gram), units.window)
            else:
                carried = b.rows.slice(last)
        if carried is not None:
            b = _Batch(carried, units.gram)
            yield from _whole(b, b.n)

    def _whole(b: _Batch, end: int) -> Iterator[pa.RecordBatch]:
        """The first `end` rows, whole runs, in slices of about _ROWS rows; a run of more than `most` is spelled out."""
        edges = np.append(np.flatnonzero(b.new[:end]), end)
        i = 0
        while i < len(edges) - 1:
            j = max(i + 1, int(np.searchsorted(edges, edges[i] + _ROWS, "right")) - 1)
            part = _Batch(b.rows.slice(int(edges[i]), int(edges[j] - edges[i])), units.gram)
            if j == i + 1 and part.n > most:
                yield from _spelled(part, units.window)
            else:
                yield _compared(part, units.window)
            i = j

    return run


def _digest(raw, offsets, first, places, removed) -> dict[str, pa.Array]:
    size = np.diff(offsets)
    begins = removed.copy()
    begins[1:] &= ~removed[:-1]
    cut = offsets[:-1][size > 0]
    begins[cut] = removed[cut]
    gone, runs = (np.diff(np.append(0, np.cumsum(x))[offsets]) for x in (removed, begins))
    data = raw[~removed].tobytes()
    ends = np.cumsum(size - gone).tolist()
    digests = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip([0, *ends], ends, strict=False)]
    return {"n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(runs, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}


def spans(docs: DataFrame, text: str = "text", units: repeats.Units = repeats.BYTES, run: int = RUN) -> tuple[DataFrame, DataFrame, int]:
    """(blocks, (doc_id, version, start, stop) of byte ranges that repeat, number of blocks)."""
    session.ship_package(docs.sparkSession)
    dealt, size = repeats.blocks(docs, text)
    suffixes = session.written(_suffixes(dealt, size, units), "suffixes")
    lead = F.substring("body", F.col("pick") + 1, F.lit(units.gram))
    ranges = suffixes.repartitionByRange(lead).sortWithinPartitions(lead, "body")
    marks = session.written(ranges.mapInArrow(_compare(units, run), _MARKS), "marks")
    session.discard(suffixes)
    places = ("doc_id", "version", "start", "stop")
    spelled = marks.where("window is not null")
    # written, so that both sides of the join are shuffled for it and the copies of a hot window can be split
    least = session.written(spelled.groupBy("window").agg(F.min("doc_id").alias("least")), "least")
    rest = spelled.join(least, "window").where("least < doc_id").select(*places)
    return dealt, marks.where("window is null").select(*places).unionByName(rest), repeats.block_count(size)


def deduplicate(docs: DataFrame, text: str = "text", units: repeats.Units = repeats.BYTES, run: int = RUN) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    dealt, marks, count = spans(docs, text, units, run)
    return repeats.finish(dealt, marks, count, _digest, units, SCHEMA)
