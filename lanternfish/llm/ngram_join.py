"""N-gram Jaccard self-join: rare-first prefix filtering, and the components of its links.

A document's set holds its different shingles of SHINGLE words.  Documents of equal sets are one class, whose
representative is the smallest doc_id.  Shingles are ordered by the number of documents that hold them (classes of
its logarithm, from counts over all documents), then by hash: the rarest first.  Two sets with a Jaccard
similarity of PERCENT or more share a shingle among the first n - ceil(PERCENT n / 100) + 1 of each.  A document whose
prefix holds only shingles of its own links with nothing, and most go that way.

Counts travel as in `repeats`: blocks of documents send each different shingle once, as a 32-bit print with a count,
and get back the prints that stand in several documents.  Prints that collide only make a shingle look less rare.

Prefix shingles of representatives are then joined.  In each of STARS rounds the holders of a shingle meet one of
them, unless they are linked already: in the first round the same one for all shingles of a group, then another for
each shingle and round.  Shingles all of whose holders are linked are settled.  What is not settled after that meets
pair by pair, at the first shingle that two share, only where they aren't linked.  No pair is verified in two
rounds.  Every pair that shares a prefix shingle is thus verified or its ends are connected by verified links, so
the components are exact.  Pairs pass the length and the positional filter when made; the suffix filter (numbers of
shingles by ranges of the hash bound the difference) follows, in the last step before a pair is made at all.

Links between different sets lie within components.  Their number, for each document, is counted there: the sets of
a component meet in chunks of CHUNK bytes, each pair of chunks in one task, where each pair of sets is counted
once from an index of their shingles.  Only numbers by document leave the task, so rows grow with documents, though
links may grow with the square of a group.  links() returns the pairs themselves.

Defined results: null, empty and wordless texts have an empty set and link with nothing; fewer than SHINGLE words are
one shingle; rows of one doc_id are one document, so they share its component; rows without a doc_id get no
component and link with nothing; repeated rows get equal results; empty tables give empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfish import session
from lanternfish.llm import repeats, rolling
from lanternfish.llm.components import components

SHINGLE = 5
PERCENT = 80
STARS = 3
#: Text of a component that one side of a task holds when its links are counted.
CHUNK = 2 << 20
_SHINGLE_BYTES = 6
_PARTS = 64
_SHIFT = np.uint64(64 - 6)
_SETS = "doc_id long, n int, s1 long, s2 long, tokens array<long>, places array<int>, parts array<int>, text string"


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the different shingles of each text, by text and hash."""
    raw = rolling.lower(raw)
    starts, stops, first = rolling.words(raw, offsets)
    sums = rolling.prefix(rolling.word_hashes(raw, starts, stops))
    n = np.diff(first)
    room = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
    text = np.repeat(np.arange(len(n)), room)
    begin = np.arange(len(text)) + np.repeat(first[:-1] - (np.cumsum(room) - room), room)
    h = rolling.span_hash(sums, begin, np.minimum(begin + shingle, first[1:][text]))
    by = np.lexsort((h, text))
    text, h = text[by], h[by]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return text[new], h[new]


def _column(table: pa.Table, name: str = "text") -> pa.Array:
    column = table[name].combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    return column


def _sets(dealt: DataFrame, size: int, shingle: int, percent: int) -> DataFrame:
    """A row for each document; tokens, places and text only where its prefix isn't all its own."""
    buckets = max(1, size // (_SHINGLE_BYTES * repeats.BUCKET_PRINTS))
    cut = np.uint64(32)

    def prints(table: pa.Table) -> pa.Table:
        rolling.release()
        column = _column(table)
        parts = [np.zeros(0, np.uint64)]
        for a, b in rolling.steps(column):
            parts.append(repeats._names(shingle_sets(*rolling.text_bytes(column.slice(a, b - a)), shingle)[1], buckets))
        name, n = np.unique(np.concatenate(parts), return_counts=True)
        bucket = (name >> cut).astype(np.int64)
        edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)])
        one, many, counts = [], [], []
        for i, j in zip(edge, np.append(edge, len(name))[1:], strict=True):
            low, more = name[i:j].astype(np.uint32), n[i:j] > 1
            one.append(low[~more].tobytes())
            many.append(low[more].tobytes())
            counts.append(n[i:j][more].astype(np.uint32).tobytes())
        block = table["block"][0].as_py()
        return pa.table({"bucket": pa.array(bucket[edge], pa.int32()), "block": pa.array([block] * len(edge), pa.int32()), "one": pa.array(one, pa.binary()), "many": pa.array(many, pa.binary()), "counts": pa.array(counts, pa.binary())})

    def count(table: pa.Table) -> pa.Table:
        one, many, counts = ([np.frombuffer(x, np.uint32) for x in table[n].to_pylist()] for n in ("one", "many", "counts"))
        prints = np.concatenate([*one, *many])
        weight = np.concatenate([np.ones(sum(map(len, one)), np.int64), *(c.astype(np.int64) for c in counts)])
        by = np.argsort(prints, kind="stable")
        prints, weight = prints[by], weight[by]
        edge = np.flatnonzero(np.append(True, prints[1:] != prints[:-1])[: len(prints)])
        prints, total = prints[edge], np.add.reduceat(weight, edge) if len(edge) else weight
        several = total > 1
        prints, rank = prints[several], np.minimum(np.ceil(4 * np.log2(np.maximum(total[several], 2))), 255).astype(np.uint8)
        answers, ranks = [], []
        for x, y in zip(one, many, strict=True):
            own = np.sort(np.concatenate([x, y]))
            at = np.minimum(np.searchsorted(prints, own), max(len(prints) - 1, 0))
            at = at[prints[at] == own] if len(prints) else at[:0]
            answers.append(prints[at].tobytes())
            ranks.append(rank[at].tobytes())
        return pa.table({"block": table["block"], "bucket": table["bucket"], "prints": pa.array(answers, pa.binary()), "ranks": pa.array(ranks, pa.binary())})

    def order(table: pa.Table, answer: pa.Table) -> pa.Table:
        rolling.release()
        known, rank = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)]
        for bucket, found, r in zip(*(answer[n].to_pylist() for n in ("bucket", "prints", "ranks")), strict=True):
            known.append(np.frombuffer(found, np.uint32).astype(np.uint64) | np.uint64(bucket << 32))
            rank.append(np.frombuffer(r, np.uint8))
        known, rank = np.concatenate(known), np.concatenate(rank)
        by = np.argsort(known)
        known, rank = known[by], rank[by]
        column = _column(table)
        out = []
        for a, b in rolling.steps(column):
            part = column.slice(a, b - a)
            text, h = shingle_sets(*rolling.text_bytes(part), shingle)
            name = repeats._names(h, buckets)
            at = np.minimum(np.searchsorted(known, name), max(len(known) - 1, 0))
            rare = np.where(known[at] == name, rank[at], 0) if len(known) else np.zeros(len(h), np.uint8)
            n = np.bincount(text, minlength=len(part))
            edge = np.append(0, np.cumsum(n))
            sums = [np.append(np.uint64(0), np.cumsum(rolling.mix(h ^ np.uint64(salt)), dtype=np.uint64)) for salt in (0x1234567, 0x7654321F0F0F0F0F)]
            s1, s2 = ((s[edge[1:]] - s[edge[:-1]]).view(np.int64) for s in sums)
            parts = np.bincount(text * _PARTS + (h >> _SHIFT).astype(np.int64), minlength=len(part) * _PARTS).astype(np.int32)
            parts = pa.ListArray.from_arrays(np.arange(0, len(parts) + 1, _PARTS, dtype=np.int32), pa.array(parts))
            by = np.lexsort((h, rare, text))
            h, rare = h[by], rare[by]
            place = np.arange(len(h)) - np.repeat(edge[:-1], n)
            use = (place < np.repeat(n - -(-percent * n // 100) + 1, n)) & (rare > 0)
            held = np.bincount(text[use], minlength=len(part))
            ends = np.append(0, np.cumsum(held)).astype(np.int32)
            own = pa.array(np.arange(len(part)), mask=held == 0)
            tokens = pa.ListArray.from_arrays(ends, pa.array(h[use].view(np.int64)))
            places = pa.ListArray.from_arrays(ends, pa.array(place[use].astype(np.int32)))
            out.append(pa.table({"doc_id": table["doc_id"].slice(a, b - a), "n": pa.array(n.astype(np.int32)), "s1": pa.array(s1), "s2": pa.array(s2), "tokens": tokens.take(own), "places": places.take(own), "parts": parts.take(own), "text": part.take(own)}))
        return pa.concat_tables(out) if out else _EMPTY.empty_table()

    sent = dealt.groupBy("block").applyInArrow(prints, "bucket int, block int, one binary, many binary, counts binary")
    back = sent.groupBy("bucket").applyInArrow(count, "block int, bucket int, prints binary, ranks binary")
    return dealt.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(order, _SETS)


_EMPTY = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("s1", pa.int64()), ("s2", pa.int64()), ("tokens", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())), ("parts", pa.list_(pa.int32())), ("text", pa.string())])


def similar(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sets of sorted hashes link."""
    n = len(x) + len(y)
    need = -(-percent * n // (100 + percent))  # of the intersection
    if need > min(len(x), len(y)):
        return False
    apart = np.abs(np.bincount((x >> _SHIFT).astype(np.int64), minlength=_PARTS) - np.bincount((y >> _SHIFT).astype(np.int64), minlength=_PARTS)).sum()
    if n - apart < 2 * need:  # suffix filter: each range differs by the difference of its sizes at least
        return False
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    return int((x[at] == y).sum()) >= need


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) and whether they link.  The join on a comes last, so that a's set is mostly at hand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            a, mine, column = batch.column("a").to_pylist(), batch.column("mine"), batch.column("text")
            found = []
            for i, j in rolling.steps(column):
                text, h = shingle_sets(*rolling.text_bytes(column.slice(i, j - i)), shingle)
                edge = np.searchsorted(text, np.arange(j - i + 1))
                for k in range(i, j):
                    source = mine[k].as_py()
                    key = hash((a[k], source))
                    if key not in held:
                        if len(held) >= 64:
                            held.clear()
                        held[key] = shingle_sets(*rolling.text_bytes(pa.array([source])), shingle)[1]
                    found.append(similar(held[key], h[edge[k - i] : edge[k - i + 1]], percent))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found, pa.bool_())], names=["a", "b", "linked"])

    own = texts.select(F.col("rep").alias("a"), F.col("text").alias("mine"))
    with_b = pairs.join(texts.select(F.col("rep").alias("b"), "text"), "b")
    return with_b.join(own, "a").select("a", "b", "mine", "text").mapInArrow(run, "a long, b long, linked boolean")


def _need(percent: int) -> str:
    """The least intersection of sets of na and nb shingles that link."""
    return f"({percent} * (na + nb) + {99 + percent}) div {100 + percent}"


def _passes(percent: int) -> str:
    """The length and positional filters."""
    return f"{_need(percent)} <= least(pa, pb) + least(na - pa, nb - pb) and 100 * least(na, nb) >= {percent} * greatest(na, nb)"


def _filtered(pairs: DataFrame, percent: int) -> DataFrame:
    """Different pairs of (a, na, pa), (b, nb, pb) that pass the length and positional filters."""
    return pairs.where(f"a != b and {_passes(percent)}").select("a", "b").distinct()


def _prepared(docs: DataFrame, text: str, shingle: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their representatives, the representatives' sets, and those of their prefix shingles that two hold."""
    session.ship_package(docs.sparkSession)
    dealt, size = repeats.blocks(docs, text)
    sets = session.written(_sets(dealt, size, shingle, percent), "sets")
    some = sets.where("n > 0 and doc_id is not null")
    # written, so that both sides of the joins are shuffled for them and the copies of one set can be split
    reps = session.written(some.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep")), "reps")
    rows = session.written(sets.select("doc_id", "n", "s1", "s2").join(reps, ["s1", "s2"], "left").select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("rep")).alias("rep")), "rows")
    chosen = some.where("tokens is not null").join(reps, ["s1", "s2"]).where("doc_id = rep").dropDuplicates(["s1", "s2"])
    texts = session.written(chosen.select("rep", "n", "tokens", "places", "parts", "text"), "representatives")
    tokens = texts.select("rep", "n", F.explode(F.arrays_zip("tokens", "places")).alias("t")).select(F.col("t.tokens").alias("token"), F.col("t.places").alias("place"), "rep", "n")
    return rows, texts, _unsettled(tokens.withColumn("label", F.col("rep")))


def _unsettled(tokens: DataFrame, most: int | None = None) -> DataFrame:
    """The rows of shingles whose holders have different labels.  These shingles are written first, so that both sides of
    the join are shuffled for it and the holders of a hot shingle can be split.  most: a bound of the rows."""
    several = tokens.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("token")
    return session.written(tokens.join(session.written(several, "several", most and most // 2), "token"), "tokens", most)


def _pair_by_pair(open_: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs of different labels, each at the first shingle that the two share."""
    prefix = texts.select("rep", "tokens", "parts")
    before = F.slice("tokens", 1, F.greatest(F.array_position("tokens", F.col("token")).cast("int") - 1, F.lit(0)))
    rest = open_.join(prefix, "rep").select("token", "rep", "n", "place", "label", "parts", before.alias("before"))
    left = rest.select("token", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"), F.col("label").alias("la"), F.col("parts").alias("ha"), F.col("before").alias("xa"))
    right = rest.select("token", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"), F.col("label").alias("lb"), F.col("parts").alias("hb"), F.col("before").alias("xb"))
    first = ~F.arrays_overlap("xa", "xb")  # a pair is made at its first common shingle only
    apart = F.aggregate(F.zip_with("ha", "hb", lambda x, y: F.abs(x - y)), F.lit(0), lambda c, x: c + x)
    near = apart <= F.expr(f"na + nb - 2 * ({_need(percent)})")  # the suffix filter, before a row is made
    return left.join(right, (left["token"] == right["token"]) & F.expr("a < b and la != lb") & F.expr(_passes(percent)) & near & first)


def links(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """All links between different sets as pairs (a, b) of class representatives, a < b, and one row for each row of
    docs: doc_id, n_shingles, class_id, n_links (of its class with other classes).  Every candidate pair is verified
    once, so pairs grow with the links there are."""
    rows, texts, open_ = _prepared(docs, text, shingle, percent)
    pairs = session.written(_verified(_filtered(_pair_by_pair(open_, texts, percent), percent), texts, shingle, percent).where("linked").select("a", "b"), "links")
    ends = pairs.select(F.col("a").alias("end")).unionByName(pairs.select(F.col("b").alias("end")))
    held = ends.groupBy("end").agg(F.count("*").alias("k"))
    members = rows.join(held, rows["rep"] == held["end"], "left")
    return pairs, members.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("rep").alias("class_id"), F.coalesce("k", F.lit(0)).cast("long").alias("n_links"))


def linked(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of what links() gives."""
    some = members.where("class_id is not null")
    one = some.groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("b")).where("a < b").select("a", "b")
    labels = components(pairs.unionByName(one))
    out = members.join(labels, members["class_id"] == labels["node"], "left")
    component = F.when(F.col("class_id").isNull(), F.col("doc_id")).otherwise(F.coalesce("root", "class_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"))


def _merged(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, root) of what labels and pairs connect; only the roots that pairs connect are walked again."""
    end = lambda name: labels.select(F.col("node").alias(name), F.col("root").alias(f"root_{name}"))
    edges = pairs.join(end("a"), "a", "left").join(end("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    new = components(edges, most=pairs.count() + labels.count())  # of what the step reads, too
    moved = labels.join(new.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
    return session.written(moved.select("node", F.coalesce("to", "root").alias("root")).unionByName(new), "labels", labels.count() + new.count())


def _link_counts(texts: DataFrame, labels: DataFrame, shingle: int, percent: int, chunk: int) -> DataFrame:
    """(rep, k): to how many other sets that of each representative links, for those that link at all."""
    nodes = labels.select(F.col("node").alias("rep"), "root").unionByName(labels.select(F.col("root").alias("rep"), "root").distinct())
    held = session.written(texts.select("rep", "n", "text").join(nodes, "rep"), "linked")
    sizes = held.groupBy("root").agg(F.sum(F.octet_length("text") + 64).alias("bytes"))
    sizes = session.written(sizes.select("root", F.ceil(F.col("bytes") / chunk).cast("int").alias("parts"), "bytes"), "sizes")
    shared = max(1, -(-(sizes.where("parts = 1").agg(F.sum("bytes")).first()[0] or 0) // chunk))
    part = F.pmod(F.xxhash64("rep", F.lit("part")), F.col("parts")).cast("int")
    placed = held.join(sizes, "root").select("rep", "n", "text", "root", "parts", part.alias("part"))
    small = placed.where("parts = 1").select("rep", "n", "text", "root", F.lit(0).alias("part"), F.pmod(F.xxhash64("root", F.lit("part")), F.lit(shared)).alias("key"), F.lit(-1).alias("i"), F.lit(-1).alias("j"))
    other = placed.where("parts > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    large = other.select("rep", "n", "text", "root", "part", F.col("root").alias("key"), F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))

    def run(table: pa.Table) -> pa.Table:
        across = table["i"][0].as_py() != table["j"][0].as_py()
        root, part = table["root"].to_numpy(), table["part"].to_numpy()
        by = np.lexsort((part, root))
        table, root, part = table.take(pa.array(by)), root[by], part[by]
        column, n = _column(table), table["n"].to_numpy().astype(np.int64)
        rows, names = [], []
        for a, b in rolling.steps(column):
            text, h = shingle_sets(*rolling.text_bytes(column.slice(a, b - a)), shingle)
            rows.append(text + a)
            names.append(h)
        row, name = np.concatenate(rows), np.concatenate(names)
        name = np.unique(rolling.mix(name) ^ rolling.mix(root.astype(np.uint64))[row], return_inverse=True)[1]  # shingles of one component each
        own = np.append(0, np.cumsum(np.bincount(row, minlength=len(n))))
        order = np.argsort(name, kind="stable")
        posted, at = row[order], np.append(0, np.cumsum(np.bincount(name)))
        begin, end = np.searchsorted(root, root, "left"), np.searchsorted(root, root, "right")
        if across:
            middle = int(np.searchsorted(part, part[-1]))
        k = np.zeros(len(n), np.int64)
        for x in range(middle if across else len(n)):
            first = middle if across else x + 1
            if first >= end[x]:
                continue
            mine = name[own[x] : own[x + 1]]
            size = at[mine + 1] - at[mine]
            met = posted[np.arange(size.sum()) + np.repeat(at[mine] - (np.cumsum(size) - size), size)]
            common = np.bincount(met - begin[x], minlength=end[x] - begin[x])[first - begin[x] :]
            link = 100 * common >= percent * (n[x] + n[first : end[x]] - common)
            k[x] += link.sum()
            k[first : end[x]] += link
        return pa.table({"rep": table["rep"], "k": k}).filter(pa.array(k > 0))

    counted = small.unionByName(large).groupBy("key", "i", "j").applyInArrow(run, "rep long, k long")
    return counted.groupBy("rep").agg(F.sum("k").alias("k"))


def join(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, stars: int = STARS, counts: bool = False, chunk: int = CHUNK) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id; with counts also class_id (the smallest doc_id of
    an equal set) and n_links (other sets that the row's set links with)."""
    rows, texts, open_ = _prepared(docs, text, shingle, percent)
    labels = components(rows.where("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("a", "b"))
    tried: DataFrame | None = None
    for r in range(stars + 1):
        most = open_.count()
        if not most:
            break
        if r < stars:
            rank = F.xxhash64("rep", F.lit(r)) if r == 0 else F.xxhash64("rep", "token", F.lit(r))
            middle = session.written(open_.groupBy("token").agg(F.min_by(F.struct("rep", "n", "place", "label"), rank).alias("m")), "middle", most // 2)
            met = open_.join(middle, "token").where("label != m.label").select(F.col("m.rep").alias("a"), F.col("m.n").alias("na"), F.col("m.place").alias("pa"), F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"))
        else:
            met = _pair_by_pair(open_, texts, percent)
        met = _filtered(met, percent)
        if tried is not None:
            new = (F.least(met["a"], met["b"]) == tried["x"]) & (F.greatest(met["a"], met["b"]) == tried["y"])
            met = met.join(tried, new, "left_anti")
        pairs = session.written(_verified(met, texts, shingle, percent), "pairs")
        labels = _merged(labels, pairs.where("linked").select("a", "b"))
        if r == stars:
            break
        known = pairs.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
        tried = known if tried is None else tried.unionByName(known)
        named = open_.drop("label").join(labels, open_["rep"] == labels["node"], "left").select("token", "place", "rep", "n", F.coalesce("root", "rep").alias("label"))
        last, open_ = open_, _unsettled(named, most + labels.count())
        session.discard(last)
    out = rows.join(labels, rows["rep"] == labels["node"], "left")
    component = F.when(F.col("rep").isNull(), F.col("doc_id")).otherwise(F.coalesce("root", "rep"))
    out = out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), F.col("rep").alias("class_id"))
    if not counts:
        return out.drop("class_id")
    held = _link_counts(texts, labels, shingle, percent, chunk).withColumnRenamed("rep", "class_id")
    return out.join(held, "class_id", "left").select("doc_id", "n_shingles", "component_id", "class_id", F.coalesce("k", F.lit(0)).cast("long").alias("n_links"))
