import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from lanternfish.llm import byte_bpe, queries

PATH, PATTERN = public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def enc():
    return byte_bpe.encoding(PATH, PATTERN)


@pytest.mark.parametrize("leaf", [1, 2, 7, 50])
def test_every_tree_gives_the_plain_encoding(enc, leaf):
    rng = random.Random(leaf)
    parts = ["abc", " ", "  ", "\n", "\t", "été", "日本語", "'s", "'", "12", "!?", "\x1c", " ", "x" * 40, "_", "I'm", "🙂"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(60)))
        ids = byte_bpe.encode(enc, text, leaf=leaf)
        assert ids.tolist() == enc.encode_ordinary(text)
        assert byte_bpe.decode(enc, ids, leaf=leaf) == text.encode()


def test_long_texts(enc):
    for text in ("a" * 50_000, "word " * 30_000, " " * 20_000, "é\n" * 9_000):
        assert byte_bpe.encode(enc, text).tolist() == enc.encode_ordinary(text)


def test_query_columns_nulls_and_extra_columns(spark, enc):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 6), (2, "the same row", 7), (2, "the same row", 7)], "doc_id long, text string, n_tokens int")
    rows = byte_bpe.tokenise(docs, PATH, PATTERN).collect()
    assert len(rows) == 4
    for r in rows:
        ids = enc.encode_ordinary(r.text or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert byte_bpe.tokenise(docs.limit(0), PATH, PATTERN).count() == 0
