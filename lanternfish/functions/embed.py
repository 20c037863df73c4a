"""Text to tokens to vectors: the steps around a model, and a deterministic stand-in for it."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BOS, EOS, PAD = 2, 1, 0


def prepare_tokens(prefix: Column, tokens: Column, length: int) -> Column:
    """BOS, prefix, tokens, EOS; cut or padded to a length (a cut may lose the end mark)."""
    whole = F.concat(F.array(F.lit(BOS)), prefix, tokens, F.array(F.lit(EOS)))
    return F.slice(F.concat(whole, F.array_repeat(F.lit(PAD), length)), 1, length)


def embedder(make: Callable[[], Callable[[list[str]], list[list[float]]]]):
    """An Arrow UDF around a model: make() loads it once for each worker's batches; empty texts are an error."""

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            if any(not t for t in texts):
                raise ValueError("text is empty")
            yield pd.Series(model(texts.tolist()))

    return embed


def hashed(text: str, dimension: int = 64) -> list[float]:
    """Hashed words and letter trigrams at unit length.  Shows the plumbing; its scores mean little."""
    out = [0.0] * dimension
    for w in re.findall(r"\w+", text.lower()):
        for part in (w, *(w[i : i + 3] for i in range(len(w) - 2))):
            h = zlib.crc32(part.encode())
            out[h % dimension] += 1.0 if h >> 31 else -1.0
    norm = math.sqrt(sum(x * x for x in out))
    return [x / norm for x in out] if norm else out


def hashed_model() -> Callable[[list[str]], list[list[float]]]:
    return lambda texts: [hashed(t) for t in texts]


def dimension(model: Callable[[list[str]], list[list[float]]]) -> int:
    return len(model(["test"])[0])


def token_counter(count: Callable[[str], int]):
    """An Arrow UDF around a function that counts tokens."""

    @F.pandas_udf("int")
    def counted(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: 0 if t is None else count(t))

    return counted


def split(key: Column, share: int = 10) -> Column:
    """train or test; one of `share` keys is test, the same at every run."""
    number = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")
    return F.when(number % share == 0, "test").otherwise("train")
