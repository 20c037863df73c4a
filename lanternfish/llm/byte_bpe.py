"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is split in halves down to leaves of LEAF characters.  A leaf is encoded by itself; two neighbours
join by encoding a window around their boundary again.  The window grows until it begins and ends at a
*stable cut*: a letter or digit followed by a space or line feed.  No alternative of the splitting pattern
matches a character that is no white space and then white space, so every match ends at such a cut, whatever
stands before or after it: the tokens outside the window are those of the whole text.  Joining is associative,
and the result is the same for every shape of the tree.  Decoding concatenates up the same kind of tree.

Defined results: a null text counts as empty and has no tokens; text of one unbroken word longer than a leaf
makes the window grow over both neighbours whole; rows are handled each by itself, so repeated rows, extra
columns and clashing names don't matter (columns are taken by name from `docs` and only those).
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternfish import session

LEAF = 4096
WINDOW = 32
_CUT = re.compile(r"[^\W_](?=[ \n])")


@functools.lru_cache(maxsize=4)
def encoding_of(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    """The encoder for a rank file's content; made once in each Python process."""
    found = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=found, special_tokens={})


def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        return encoding_of(f.read(), pattern)


def _leaf(enc: tiktoken.Encoding, text: str) -> np.ndarray:
    return enc.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


def _cut_before(text: str, low: int, mid: int) -> int:
    """The last stable cut in text[low:mid], growing a window down from mid; low if there is none."""
    width = WINDOW
    while True:
        start = max(low, mid - width)
        found = [m.end() for m in _CUT.finditer(text, start, mid)]
        if found:
            return found[-1]
        if start == low:
            return low
        width *= 4


def _cut_after(text: str, mid: int, high: int) -> int:
    """The first stable cut in text[mid:high], growing a window up from mid; high if there is none."""
    width = WINDOW
    while True:
        stop = min(high, mid + width)
        if found := _CUT.search(text, mid, stop):
            return found.end()
        if stop == high:
            return high
        width *= 4


def encode(enc: tiktoken.Encoding, text: str, low: int = 0, high: int | None = None, leaf: int = LEAF) -> np.ndarray:
    """Token ids of text[low:high]."""
    high = len(text) if high is None else high
    if high - low <= leaf:
        return _leaf(enc, text[low:high])
    mid = (low + high) // 2
    left, right = encode(enc, text, low, mid, leaf), encode(enc, text, mid, high, leaf)
    start, stop = _cut_before(text, low, mid), _cut_after(text, mid, high)
    keep = len(left) - len(_leaf(enc, text[start:mid])) if start > low else 0
    skip = len(_leaf(enc, text[mid:stop])) if stop < high else len(right)
    return np.concatenate([left[:keep], _leaf(enc, text[start:stop]), right[skip:]])


def decode(enc: tiktoken.Encoding, ids: np.ndarray, leaf: int = LEAF) -> bytes:
    if len(ids) <= leaf:
        return enc.decode_bytes(ids.tolist())
    mid = len(ids) // 2
    return decode(enc, ids[:mid], leaf) + decode(enc, ids[mid:], leaf)


def tokenise(docs: DataFrame, path: str, pattern: str, text: str = "text", keep_ids: bool = True) -> DataFrame:
    """docs with n_tokens, ids_sha256, decoded_sha256 (of the ids decoded again) and, with keep_ids,
    token_ids (little-endian unsigned 32-bit integers as binary).  One narrow pass, no shuffle.  Only the driver
    reads the file of ranks; its content, which is bounded by the vocabulary, is broadcast."""
    session.ship_package(docs.sparkSession)
    with open(path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    own = ["token_ids"] * keep_ids + ["n_tokens", "ids_sha256", "decoded_sha256"]
    kept = [f for f in docs.schema.fields if f.name not in own]
    kinds = {"token_ids": T.BinaryType(), "n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    schema = T.StructType(kept + [T.StructField(n, kinds[n]) for n in own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding_of(ranks.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found: dict[str, list] = {n: [] for n in own}
                for value in part.column(text):
                    ids = encode(enc, value.as_py() or "")
                    raw = ids.tobytes()
                    if keep_ids:
                        found["token_ids"].append(raw)
                    found["n_tokens"].append(len(ids))
                    found["ids_sha256"].append(hashlib.sha256(raw).hexdigest())
                    found["decoded_sha256"].append(hashlib.sha256(decode(enc, ids)).hexdigest())
                columns = [part.column(f.name) for f in kept]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(found[n], pa.binary() if n == "token_ids" else pa.int64() if n == "n_tokens" else pa.string()) for n in own], names=schema.names)

    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, schema)
