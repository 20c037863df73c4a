"""Substring deduplication by words: De Bruijn compaction.

The graph's edges are the runs of WINDOW words of all documents.  Edges that follow each other in a document and
share their least gram are taken as one path from the start, so that a stretch that every document continues alike is
a row for all its edges; a join on gram and content gives equal paths one source, the place in the document of the
smallest doc_id.  Paths of one gram that differ are where the graph branches: the sources' paths are spelled out into
edges again, from their coordinates in the source texts, and edges are joined.  Then non-branching stretches are
contracted: paths of a document that follow each other, and whose sources follow each other in one document too, meet
at their ends and become one long span with one source.  Long spans are verified by coordinates: the source's block
digests the source's words, and the span goes only if the document's own words there have the same digest.  A word
goes if an edge over it also starts in a document of a smaller doc_id.

Candidates are found by hashes of gram and content from independent letters; what goes is decided by 128 bits of
BLAKE2 over the words themselves.

Defined results: null and empty texts have no words; a document never removes words of itself, nor of rows with the
same doc_id; repeated rows get equal results; rows without a doc_id keep all words and remove none; texts of fewer
than WINDOW words stay whole; a very long text is a step of its own and handled whole; empty tables give empty ones;
other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfish import session
from lanternfish.llm import repeats, rolling

WINDOW = 50
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _edges(dealt: DataFrame, branches: DataFrame, count: int, units: repeats.Units) -> DataFrame:
    """(gram, edge, content, offset, first, version, place) of the sources' paths, from their texts."""

    def spell(table: pa.Table, wanted: pa.Table) -> pa.Table:
        rolling.release()
        out: dict[str, list] = {n: [np.zeros(0, np.int64)] for n in ("gram", "edge", "content", "offset", "first", "version", "place")}
        column = repeats.column_of(table)
        row = repeats.Rows(table).rows(wanted["first"].to_numpy(), wanted["version"].to_numpy()) if table.num_rows else np.zeros(0, np.int64)
        by = np.argsort(row, kind="stable")
        row = row[by]
        got = {n: wanted[n].to_numpy()[by] for n in ("gram", "content", "first", "version", "start", "windows")}
        for a, b in rolling.steps(column) if len(row) else ():
            i, j = np.searchsorted(row, a), np.searchsorted(row, b)
            if i == j:
                continue
            _, values, first = units.cut(*rolling.text_bytes(column.slice(a, b - a)))
            edges = rolling.all_spans(rolling.prefix(values, 1), units.window, 1)
            n = got["windows"][i:j]
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            place = np.repeat(first[row[i:j] - a] + got["start"][i:j], n) + offset
            out["edge"].append(rolling.mix(edges[place]).view(np.int64))
            out["offset"].append(offset)
            out["place"].append(np.repeat(got["start"][i:j], n) + offset)
            for name in ("gram", "content", "first", "version"):
                out[name].append(np.repeat(got[name][i:j], n))
        c = {n: np.concatenate(x) for n, x in out.items()}
        return pa.table({n: pa.array(x, pa.int32() if n in ("offset", "version", "place") else pa.int64()) for n, x in c.items()})

    asked = branches.select(repeats.block_of("first", count).alias("block"), "gram", "content", "first", "version", "start", "windows")
    return dealt.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(spell, "gram long, edge long, content long, offset int, first long, version int, place int")


def _digest(raw, offsets, first, places, removed) -> dict[str, pa.Array]:
    starts, stops = places
    n_words = np.diff(first)
    text = np.repeat(np.arange(len(n_words)), n_words)
    gone = np.bincount(text[removed], minlength=len(n_words))
    keep = np.flatnonzero(~removed)
    edge = np.zeros(len(raw) + 1, np.int8)
    edge[starts[keep]] += 1
    np.subtract.at(edge, stops[keep], 1)
    inside = np.cumsum(edge[:-1], dtype=np.int8) > 0
    joint = keep[:-1][text[keep[1:]] == text[keep[:-1]]]
    out = raw.copy()
    out[stops[joint]] = 32
    inside[stops[joint]] = True
    size = np.append(0, np.cumsum(inside))[offsets]
    data = out[inside].tobytes()
    digests = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(size.tolist(), size[1:].tolist(), strict=False)]
    return {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}


_SPAN = "doc_id long, version int, start int, stop int, first long, first_version int, first_start int"


def _stretches(found: DataFrame, origins: DataFrame, partial: DataFrame) -> DataFrame:
    """(doc_id, version, start, windows, first, first_version, first_start): paths, and single edges of paths, that stand in
    an earlier document, with their sources.  found: all paths; origins: their sources; partial: (gram, content, offset, s) of
    edges in a source that stand at s in an earlier document.  Paths of later documents than their source's repeat
    whole; those of the source's own document repeat where `partial` says so."""
    offsets = partial.groupBy("gram", "content").agg(F.collect_list(F.struct("offset", "s")).alias("offsets"))  # one path's edges at most
    # written, so that both sides of the join are shuffled for it and the copies of a hot path can be split
    known = session.written(origins.select("gram", "content", "first", F.col("version").alias("first_version"), F.col("start").alias("first_start")).join(offsets, ["gram", "content"], "left"), "known")
    rows = found.join(known, ["gram", "content"]).where((F.col("doc_id") > F.col("first")) | F.col("offsets").isNotNull())
    whole = F.array(F.struct(F.col("start"), F.col("windows"), F.col("first"), F.col("first_version"), F.col("first_start")))
    some = F.transform("offsets", lambda o: F.struct((F.col("start") + o["offset"]).alias("start"), F.lit(1).alias("windows"), o["s"]["first"].alias("first"), o["s"]["version"].alias("first_version"), o["s"]["place"].alias("first_start")))
    run = F.explode(F.when(F.col("doc_id") > F.col("first"), whole).otherwise(some)).alias("r")
    return rows.select("doc_id", "version", run).select("doc_id", "version", "r.*")


def _contracted(stretches: DataFrame, count: int, units: repeats.Units) -> DataFrame:
    """Long spans: a document's stretches joined where one's end is the next one's start, in it and in the source."""

    def run(table: pa.Table) -> pa.Table:
        names = ("doc_id", "version", "first", "first_version", "start", "first_start", "windows")
        c = {n: table[n].to_numpy().astype(np.int64) for n in names}
        slant = c["first_start"] - c["start"]
        by = np.lexsort((c["start"], slant, c["first_version"], c["first"], c["version"], c["doc_id"]))
        c, slant = {n: x[by] for n, x in c.items()}, slant[by]
        new = np.ones(len(by), bool)
        new[1:] = slant[1:] != slant[:-1]
        for n in ("doc_id", "version", "first", "first_version"):
            new[1:] |= c[n][1:] != c[n][:-1]
        new[1:] |= c["start"][1:] > (c["start"] + c["windows"])[:-1]  # edges that don't follow each other
        at = np.flatnonzero(new)
        end = np.append(at[1:], len(by)) - 1
        stop = (c["start"] + c["windows"])[end] - 1 + units.window
        out = {n: c[n][at] for n in names[:6]} | {"stop": stop}
        return pa.table({n: pa.array(out[n], pa.int64() if k == "long" else pa.int32()) for n, k in (x.split() for x in _SPAN.split(", "))})

    return stretches.withColumn("block", repeats.block_of("doc_id", count)).groupBy("block").applyInArrow(run, _SPAN)


def _digests(raw: np.ndarray, places: tuple[np.ndarray, np.ndarray], first: np.ndarray, stop: np.ndarray) -> list[bytes]:
    """Of words first to stop, joined by one space, for each span."""
    starts, stops = places
    data = raw.tobytes()
    words = lambda i, j: b" ".join(data[x:y] for x, y in zip(starts[i:j].tolist(), stops[i:j].tolist(), strict=True))
    return [hashlib.blake2b(words(i, j), digest_size=16).digest() for i, j in zip(first.tolist(), stop.tolist(), strict=True)]


def _holds(raw, places, first, stop, digests) -> np.ndarray:
    return np.array([x == y for x, y in zip(_digests(raw, places, first, stop), digests, strict=True)], bool)


_SOURCE = ("first", "first_version", "first_start", "size")


def _witnessed(dealt: DataFrame, long: DataFrame, count: int) -> DataFrame:
    """(doc_id, version, start, stop, digest): long spans with the digest of their sources' words.  A source that many
    documents copy is asked once; its digest goes back by a join that can be split."""

    def run(table: pa.Table, wanted: pa.Table) -> pa.Table:
        rolling.release()
        row = repeats.Rows(table).rows(wanted["first"].to_numpy(), wanted["first_version"].to_numpy()) if table.num_rows else np.zeros(0, np.int64)
        by = np.argsort(row, kind="stable")
        row, wanted = row[by], wanted.take(pa.array(by))
        begin, size = wanted["first_start"].to_numpy(), wanted["size"].to_numpy()
        column, digests = repeats.column_of(table), []
        for a, b in rolling.steps(column) if len(row) else ():
            i, j = np.searchsorted(row, a), np.searchsorted(row, b)
            if i < j:
                raw, offsets = rolling.text_bytes(column.slice(a, b - a))
                starts, stops, first = rolling.words(raw, offsets)
                at = first[row[i:j] - a] + begin[i:j]
                digests += _digests(raw, (starts, stops), at, at + size[i:j])
        return pa.table({**{n: wanted[n] for n in _SOURCE}, "digest": pa.array(digests, pa.binary())})

    sized = long.withColumn("size", F.col("stop") - F.col("start"))
    asked = sized.select(*_SOURCE).distinct().withColumn("block", repeats.block_of("first", count))
    found = dealt.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(run, "first long, first_version int, first_start int, size int, digest binary")
    return sized.join(session.written(found, "digests"), list(_SOURCE)).select("doc_id", "version", "start", "stop", "digest")


def spans(docs: DataFrame, text: str = "text", units: repeats.Units = repeats.WORDS) -> tuple[DataFrame, DataFrame, int]:
    """(blocks, (doc_id, version, start, stop, digest) of word ranges that repeat, number of blocks)."""
    session.ship_package(docs.sparkSession)
    dealt, size = repeats.blocks(docs, text)
    count = repeats.block_count(size)
    found = session.written(repeats.paths(dealt, size, units), "paths")
    origins = session.written(repeats.sources(found), "sources")
    # written, so that both sides of the join are shuffled for it and the paths of a hot gram can be split
    branching = session.written(origins.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "branching")
    edges = session.written(_edges(dealt, origins.join(branching, "gram"), count, units), "edges")
    least = session.written(edges.groupBy("gram", "edge").agg(F.min(F.struct("first", "version", "place")).alias("s")), "least")
    partial = edges.join(least, ["gram", "edge"]).where("s.first < first").select("gram", "content", "offset", "s")
    stretches = session.written(_stretches(found, origins, partial), "stretches")
    session.discard(found, origins, branching, edges, least)
    long = session.written(_contracted(stretches, count, units), "spans")
    session.discard(stretches)
    return dealt, _witnessed(dealt, long, count), count


def deduplicate(docs: DataFrame, text: str = "text", units: repeats.Units = repeats.WORDS) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed, kept_sha256."""
    dealt, marks, count = spans(docs, text, units)
    return repeats.finish(dealt, marks, count, _digest, units, SCHEMA, _holds)
