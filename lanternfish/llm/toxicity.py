"""Toxicity scores from class-conditional Kneser-Ney models of how words are spelled.

A word is its bytes behind a boundary.  Toxic and ordinary text have a model each: every byte is counted, at each of
its occurrences, with the longest history it has (up to ORDER - 1 bytes, from the boundary on at the start of a word),
discounted absolutely and interpolated with a model that both share: Kneser-Ney over the continuation counts of every
lower order, that is, how many different bytes (the boundary is one) stand before an n-gram in the words of *all*
documents.  As the first byte is judged too, the ratio of a word's likelihoods up to some byte is the ratio of the
rates at which words begin that way: an expression that either class uses more often shows at its stem, in any
language, whatever follows.

A text's features are the difference of its two log-likelihoods by length, the same for the best stem of each word
(the greatest ratio of a beginning, 0 at least), the five best stems, the number and share of clearly toxic ones, and
the length; a logistic curve over them gives the score.

What is fitted on a sample: n-grams by class and the curve, on at most CLASS_ROWS labelled rows of each class
(chosen by a hash of doc_id, the same at every run).  They lie in FOLDS parts, and the features of one part come from
counts of the others, else a text would be judged by its own words.  Shared counts come from every document, in a
table that grows with them; only those that the sample's n-grams back off to are read from it, so what the driver
collects and sends out is bounded by the sample.  An n-gram's name is its bytes, in a number of 64 bits, so no two
share a place.

Defined results: null and empty texts have no words and get the score of all-zero features; documents are scored
each by itself (repeated rows get equal scores); labels, language, source and id take no part in a score; where a
class has no training row, every score is 0; a row without a doc_id isn't held out and teaches nothing; texts of any
length are scored whole, a text of more than a step's bytes in a step of its own.  Extra columns are kept; columns
named held_out, score or predicted are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternfish import session
from lanternfish.llm import rolling

#: Bytes of an n-gram at most, the boundary included: as many as fit its name.
ORDER = 8
#: Taken off each count and left to the order below.
DISCOUNT = 0.75
CLASS_ROWS = 20000
#: An n-gram, or a history, seen fewer times in both classes together says nothing by itself: it counts in the totals,
#: but has no entry in the tables that are sent out; the history, or no preference, stands for it.
LEAST = 2
FOLDS = 8
THRESHOLD = 0.7
BOUNDARY = 32
_INSIDE = np.array([97 <= b < 123 or b >= 128 for b in range(256)])
_BEST = 5
_FEATURES = _BEST + 9
#: A stem begins to count as clearly toxic at this log ratio, and counts in full from _CLEAR + 2.
_CLEAR = 3.0
#: Different n-grams that a task holds before it merges them.
_HELD = 1 << 20
#: Bytes scored at a time; each different word among them is looked up once.
_STEP = 1 << 18
_U = np.uint64


def training_row(doc_id: str = "doc_id") -> Column:
    """True for rows whose labels may be learned."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) != 1


def _words(raw: np.ndarray, offsets: np.ndarray):
    """(small letters, word starts, word stops, first word of each text)."""
    small = rolling.lower(raw)
    return small, *rolling.words(small, offsets, ~_INSIDE[small])


def grams(letters: np.ndarray, within: np.ndarray) -> np.ndarray:
    """The longest n-gram that ends at each byte of words laid end to end; within: a byte's place in its word.  An
    n-gram's bytes, the last one lowest, are its name; what precedes the last byte, its history, is name >> 8."""
    out = letters.astype(_U)
    for back in range(1, ORDER):
        byte = np.zeros(len(letters), _U)
        byte[back:] = letters[: max(len(letters) - back, 0)]
        byte[within == back - 1] = BOUNDARY
        byte[within < back - 1] = 0
        out |= byte << _U(8 * back)
    return out


def _different(raw: np.ndarray, offsets: np.ndarray):
    """(letters of each different word end to end, within, end of each, which of them each word is, word sizes,
    first word of each text)."""
    small, starts, stops, first = _words(raw, offsets)
    size = stops - starts
    _, pick, same = np.unique(rolling.word_hashes(small, starts, stops), return_index=True, return_inverse=True)
    ends = np.cumsum(size[pick])
    within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size[pick], size[pick])
    return small[np.repeat(starts[pick], size[pick]) + within], within, ends, same, size, first


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts (names, n) of several parts, added up by name."""
    names, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    by = np.argsort(names, kind="stable")
    names = names[by]
    edge = np.flatnonzero(np.append(True, names[1:] != names[:-1])[: len(names)])
    return names[edge], np.add.reduceat(n[by], edge) if len(edge) else n


_PACKED = "bucket int, kind int, g binary, n binary"


def _packed(bucket: np.ndarray, kind: int, g: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket, with its n-grams and their counts laid end to end: millions of them are few rows."""
    by = np.argsort(bucket, kind="stable")
    bucket, g, n = bucket[by], g[by], n[by].astype(np.int32)
    edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)])
    cut = list(zip(edge.tolist(), [*edge[1:].tolist(), len(bucket)], strict=True)) if len(edge) else []
    return pa.RecordBatch.from_arrays([pa.array(bucket[edge].astype(np.int32)), pa.array(np.full(len(edge), kind, np.int32)), pa.array([g[i:j].tobytes() for i, j in cut], pa.binary()), pa.array([n[i:j].tobytes() for i, j in cut], pa.binary())], names=["bucket", "kind", "g", "n"])


def _unpacked(g: pa.ChunkedArray, n: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(g.to_pylist()), _U), np.frombuffer(b"".join(n.to_pylist()), np.int32)


def _bucket(g: np.ndarray, buckets: int, order: int = ORDER) -> np.ndarray:
    """n-grams of the same last `order` bytes have the same bucket."""
    return (rolling.mix(g & _U((1 << 8 * order) - 1)) % _U(buckets)).astype(np.int32)


def _buckets(size: int) -> int:
    """About 4 MB of n-grams each, if every byte of text had one of its own."""
    return max(8, size >> 22)


def _count(texts: DataFrame, buckets: int = 8) -> DataFrame:
    """(bucket, kind, g, n): how often each n-gram stands at the longest in the texts of a kind, 2 * fold + class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0
        for batch in batches:
            for a, b in rolling.steps(batch.column("text"), _STEP):
                part = batch.slice(a, b - a)
                small, starts, stops, first = _words(*rolling.text_bytes(part.column("text")))
                long = stops - starts
                ends = np.cumsum(long)
                within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - long, long)
                g = grams(small[np.repeat(starts, long) + within], within)
                kind = np.repeat(np.repeat(part.column("kind").to_numpy(), np.diff(first)), long)
                for k in np.unique(kind).tolist():
                    held.setdefault(k, []).append(np.unique(g[kind == k], return_counts=True))
                    size += len(held[k][-1][0])
                if size > _HELD:
                    held = {k: [_summed(x)] for k, x in held.items()}
                    if (size := sum(len(x[0][0]) for x in held.values())) > _HELD // 2:
                        yield from (_packed(_bucket(x[0][0], buckets), k, *x[0]) for k, x in held.items())
                        held, size = {}, 0
        for k, x in held.items():
            g, n = _summed(x)
            yield _packed(_bucket(g, buckets), k, g, n)

    def merge(rows: pa.Table) -> pa.Table:
        kinds, out = rows["kind"].to_numpy(), []
        for k in np.unique(kinds).tolist():
            some = rows.filter(pa.array(kinds == k))
            g, n = _summed([_unpacked(some["g"], some["n"])])
            out.append(_packed(np.zeros(len(g), np.int32), k, g, n))
        return pa.Table.from_batches(out)

    return texts.mapInArrow(run, _PACKED).groupBy("bucket").applyInArrow(merge, _PACKED)


def _longest(docs: DataFrame, text: str, buckets: int) -> DataFrame:
    """The n-grams, at the longest, of all words of all documents, those that end in the same three bytes in one bucket;
    some of them several times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda g: _packed(_bucket(g, buckets, 3), 0, g, np.zeros(len(g)))
        held, size = [np.zeros(0, _U)], 0
        for batch in batches:
            for a, b in rolling.steps(batch.column(0), _STEP):
                letters, within, *_ = _different(*rolling.text_bytes(batch.column(0).slice(a, b - a)))
                held.append(np.unique(grams(letters, within)))
                size += len(held[-1])
                if size > _HELD:
                    held = [np.unique(np.concatenate(held))]
                    if (size := len(held[0])) > _HELD // 2:
                        yield made(held.pop())
                        held, size = [np.zeros(0, _U)], 0
        yield made(np.unique(np.concatenate(held)))

    return docs.select(F.col(text)).mapInArrow(run, _PACKED).select("bucket", "g")


def _continuations(longest: DataFrame, wanted) -> DataFrame:
    """(g, n): in how many different bytes the n-grams of orders 2 to ORDER - 1 are continued to the left, for those whose
    history is wanted.  All n-grams that end in the same three bytes are in one bucket, so each is counted there for
    good, but for those of two bytes, which have a part of their count in several."""

    def run(rows: pa.Table) -> pa.Table:
        found, out = np.unique(np.frombuffer(b"".join(rows["g"].to_pylist()), _U)), []
        for order in range(2, ORDER):
            left = found[found >> _U(8 * order) != 0] & _U((1 << 8 * (order + 1)) - 1)
            g, n = np.unique(np.unique(left) & _U((1 << 8 * order) - 1), return_counts=True)
            at = np.minimum(np.searchsorted(wanted.value, g >> _U(8)), max(len(wanted.value) - 1, 0))
            use = wanted.value[at] == g >> _U(8) if len(wanted.value) else np.zeros(len(g), bool)
            out.append(_packed(np.zeros(int(use.sum()), np.int32), 0, g[use], n[use]))
        return pa.Table.from_batches(out)

    return longest.groupBy("bucket").applyInArrow(run, _PACKED)


def _histories(g: np.ndarray) -> np.ndarray:
    """The histories of lower orders that n-grams back off to."""
    return np.unique(np.concatenate([np.unique((g[g >> _U(8 * o) != 0] & _U((1 << 8 * o) - 1)) >> _U(8)) for o in range(2, ORDER)]))


class _Table:
    """Rows of numbers by 64-bit names, found by the leading bits of a mixed name and a few steps on from there.
    order: how rows, one more than names and the last one of zeros, follow from the names given."""

    def __init__(self, names: np.ndarray, columns: int, kind: type) -> None:
        names = rolling.mix(names)
        self.order = np.argsort(names).astype(np.int32)
        bits = max(int(len(names)).bit_length(), 4)
        self.shift = _U(64 - bits)
        self.names, self.rows = names[self.order], np.zeros((len(names) + 1, columns), kind)
        self.first = np.searchsorted(self.names >> self.shift, np.arange(1 << bits, dtype=_U)).astype(np.int32)

    def put(self, column: int, values: np.ndarray) -> None:
        self.rows[:-1, column] = values[self.order]

    def find(self, names: np.ndarray) -> np.ndarray:
        """The place of each name in rows; the last one, of zeros, for those not there."""
        names, n = rolling.mix(names), len(self.names)
        at = self.first[(names >> self.shift).astype(np.int64)]
        left = np.flatnonzero(at < n)
        while len(left):
            left = left[self.names[at[left]] < names[left]]
            at[left] += 1
            left = left[at[left] < n]
        found = at < n
        found[found] = self.names[at[found]] == names[found]
        return np.where(found, at, n)


def _below(g: np.ndarray, shared: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """P(last byte) of the shared model for n-grams at the longest, their histories a byte shorter.  shared: sorted
    names of lower orders with their counts; every n-gram of a history in question is among them."""
    history = shared >> _U(8)
    begin = np.flatnonzero(np.append(True, history[1:] != history[:-1])[: len(history)])
    history = history[begin]
    total, kinds = (np.add.reduceat(x, begin) if len(begin) else x for x in (counts, np.ones(len(shared))))
    p = np.full(len(g), 1 / 256)
    for order in range(2, ORDER):
        use = np.flatnonzero(g >> _U(8 * order))
        x = g[use] & _U((1 << 8 * order) - 1)
        i = np.minimum(np.searchsorted(shared, x), max(len(shared) - 1, 0))
        j = np.searchsorted(history, x >> _U(8))
        n = np.where(shared[i] == x, counts[i], 0)
        p[use] = np.maximum(n - DISCOUNT, 0) / total[j] + DISCOUNT * kinds[j] / total[j] * p[use]
    return p


class Model:
    """log P(byte | toxic) - log P(byte | ordinary) by n-gram, and by history for n-grams that neither class has; a
    column for each fold that counts(fold), (ordinary, toxic) by n-gram, leaves out."""

    def __init__(self, g: np.ndarray, below: np.ndarray, folds, counts, kind: type = np.float32) -> None:
        histories, at = np.unique(g >> _U(8), return_inverse=True)
        at = at.astype(np.int32)
        every = sum(counts(None))
        often = every >= LEAST, np.bincount(at, every, len(histories)) >= LEAST
        self.grams, self.histories = (_Table(x[y], len(folds), kind) for x, y in zip((g, histories), often, strict=True))
        for k, fold in enumerate(folds):
            by_gram, by_history = np.zeros(len(g)), np.zeros(len(histories))
            for sign, n in zip((-1, 1), counts(fold), strict=True):
                total, kinds = np.bincount(at, n, len(histories)), np.bincount(at, n > 0, len(histories))
                rest = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1)
                by_gram += sign * np.log(np.maximum(n - DISCOUNT, 0) / np.maximum(total, 1)[at] + rest[at] * below)
                by_history += sign * np.log(rest)
            self.grams.put(k, by_gram[often[0]])
            self.histories.put(k, by_history[often[1]])
        del self.grams.order, self.histories.order

    def ratios(self, g: np.ndarray, which: int = 0) -> np.ndarray:
        """For each n-gram at the longest; 0 where no class knows its history."""
        row = self.grams.find(g)
        out = self.grams.rows[row, which].astype(np.float64)
        rest = np.flatnonzero(row == len(self.grams.names))
        out[rest] = self.histories.rows[self.histories.find(g[rest] >> _U(8)), which]
        return out

    def features(self, raw: np.ndarray, offsets: np.ndarray, which: int = 0) -> np.ndarray:
        """A row for each text: see the head of this module."""
        letters, within, ends, same, size, first = _different(raw, offsets)
        out = np.zeros((len(offsets) - 1, _FEATURES))
        if not len(size):
            return out
        begins = np.append(0, ends[:-1])
        ratio = self.ratios(grams(letters, within), which)
        sums = np.cumsum(ratio) - np.repeat((np.cumsum(ratio) - ratio)[begins], ends - begins)
        words, stems = sums[ends - 1][same], np.maximum.reduceat(sums, begins)[same]
        n = np.diff(first)
        some = np.flatnonzero(n)
        at, n = first[:-1][some], n[some]
        total = lambda x: np.add.reduceat(x, at)
        clear = total(np.clip(stems - _CLEAR, 0, 2) / 2)
        number = total(stems > _CLEAR + 0.5)
        text = np.repeat(np.arange(len(some)), n)
        by = np.lexsort((-stems, text))
        best = np.zeros((len(some), _BEST))
        rank = np.arange(len(text)) - np.repeat(at, n)
        use = rank < _BEST
        best[text[use], rank[use]] = np.clip(stems[by][use], 0, 10) / 5
        rest = [total(words) / total(size), total(np.maximum(stems, 0)) / n, np.minimum(clear, 8) / 4, np.sqrt(clear / n), clear / n * 10, np.log1p(n) / 5, np.log((number + 0.5) / (n + 20)) + 4, np.log1p(number), np.ones(len(some))]
        out[some] = np.hstack([best, np.stack(rest, 1)])
        return out


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic curve, by Newton steps with a small ridge."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + 1e-2 * np.eye(len(w)), x.T @ (y - p) - 1e-2 * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _trimmed(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Batches, with what reading a broadcast table and scoring a batch leave behind handed back in between."""
    assert shared.value is not False
    for batch in batches:
        rolling.release()
        yield batch
    rolling.release()


def train(docs: DataFrame, labels: DataFrame, text: str = "text", class_rows: int = CLASS_ROWS) -> tuple[Model, np.ndarray] | None:
    """The model and the curve's weights; None where a class has no training row."""
    spark = docs.sparkSession
    session.ship_package(spark)
    known = labels.where(F.col("toxic").isin(0, 1) & training_row()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    if set(sizes) != {0, 1}:
        return None
    part = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) / float(1 << 20)
    share = F.when(F.col("toxic") == 1, class_rows / sizes[1]).otherwise(class_rows / sizes[0])
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS))
    chosen = known.where(part < share).select("doc_id", (2 * fold + F.col("toxic")).cast("int").alias("kind"))
    # class_rows bounds this side: two classes of so many rows of two numbers
    texts = session.written(docs.select("doc_id", F.col(text).alias("text")).where("text is not null").join(F.broadcast(chosen), "doc_id"), "toxicity-sample")
    size = lambda df, name: df.agg(F.sum(F.octet_length(name))).first()[0] or 0
    # all that is collected is bounded by the sample: its own n-grams, and what they back off to
    found = session.written(_count(texts, _buckets(size(texts, "text"))), "toxicity-counts")
    rows = found.toArrow()
    lengths = pc.divide(pc.binary_length(rows["n"]), 4).to_numpy()
    kind = np.repeat(rows["kind"].to_numpy().astype(np.int8), lengths)
    g, n = _unpacked(rows["g"], rows["n"])
    own, at = np.unique(g, return_inverse=True)
    at = at.astype(np.int32)
    del rows, g
    wanted = spark.sparkContext.broadcast(_histories(own))
    shared = session.written(_continuations(_longest(docs, text, _buckets(size(docs, text))), wanted).select("g", "n"), "toxicity-shared")
    rows = shared.toArrow()
    below = _below(own, *_summed([_unpacked(rows["g"], rows["n"])]))
    del rows
    rolling.release()
    session.discard(found, shared)
    wanted.destroy()

    def counts(fold: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ordinary, toxic) counts by n-gram, without those of a fold."""
        uses = [(kind & 1 == toxic) & (kind >> 1 != (-1 if fold is None else fold)) for toxic in (0, 1)]
        return tuple(np.bincount(at[use], n[use], len(own)) for use in uses)

    crossed = spark.sparkContext.broadcast(Model(own, below, range(FOLDS), counts, np.float16))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _trimmed(batches, crossed):
            for a, b in rolling.steps(batch.column("text"), _STEP):
                part = batch.slice(a, b - a)
                kind = part.column("kind").to_numpy()
                x = np.zeros((len(part), _FEATURES))
                for f in np.unique(kind // 2):
                    use = np.flatnonzero(kind // 2 == f)
                    x[use] = crossed.value.features(*rolling.text_bytes(part.column("text").take(pa.array(use))), f)
                yield pa.RecordBatch.from_arrays([pa.array(kind % 2), *(pa.array(x[:, i]) for i in range(_FEATURES))], names=["toxic", *(f"x{i}" for i in range(_FEATURES))])

    rolling.release()
    x = texts.mapInArrow(features, "toxic int, " + ", ".join(f"x{i} double" for i in range(_FEATURES))).toArrow()
    crossed.destroy()  # all that needs it is here
    table = np.stack([x[f"x{i}"].to_numpy() for i in range(_FEATURES)], 1)
    by = np.lexsort(table.T)  # rows come in any order; sums of floats must not depend on it
    session.discard(texts)
    return Model(own, below, [None], counts), _fit(table[by], x["toxic"].to_numpy()[by].astype(float))


def score(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = THRESHOLD, class_rows: int = CLASS_ROWS) -> DataFrame:
    """docs with held_out, score and predicted (1 where score reaches the threshold)."""
    own = T.StructType([T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    kept = [f for f in docs.schema.fields if f.name not in own.names]
    fitted = docs.sparkSession.sparkContext.broadcast(train(docs, labels, text, class_rows))
    schema = T.StructType(kept + [own["score"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _trimmed(batches, fitted):
            for a, b in rolling.steps(batch.column(text), _STEP):
                part = batch.slice(a, b - a)
                if fitted.value is None:
                    found = np.zeros(len(part))
                else:
                    model, weights = fitted.value
                    x = model.features(*rolling.text_bytes(part.column(text)))
                    found = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(found)], names=schema.names)

    out = docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, schema)
    return out.select("*", F.coalesce(~training_row(), F.lit(False)).alias("held_out"), (F.col("score") >= threshold).cast("int").alias("predicted"))
