import hashlib
import random

import numpy as np
import pytest

from lanternfish.llm import queries, repeats, suffix_dedup


def brute(docs, window=50):
    seen = {}
    split = [(d, (t or "").encode()) for d, t in docs]
    for d, w in split:
        for i in range(len(w) - window + 1):
            k = w[i : i + window]
            seen[k] = min(seen.get(k, d), d)
    for d, w in split:
        gone = bytearray(len(w))
        for i in range(len(w) - window + 1):
            if seen[w[i : i + window]] < d:
                gone[i : i + window] = b"\1" * window
        kept = bytes(b for b, g in zip(w, gone, strict=True) if not g)
        yield d, len(w), sum(gone), sum(len(x) > 0 for x in bytes(gone).split(b"\0")), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("run", [1 << 17, 3])
def test_against_brute_force(spark, monkeypatch, run):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(repeats, "BUCKET_PRINTS", 50)
    rng = random.Random(run)
    for letters in ("ab", "abcdefgh éü日 \n"):
        passages = ["".join(rng.choice(letters) for _ in range(rng.choice([30, 48, 50, 51, 80, 200]))) for _ in range(12)]
        docs = []
        for i in range(150):
            parts = []
            for _ in range(rng.randrange(4)):
                p = list(rng.choice(passages))
                if rng.random() < 0.3:
                    p[rng.randrange(len(p))] = rng.choice(letters)
                parts += [rng.choice(letters) for _ in range(rng.randrange(9))] + p
            docs.append((i if rng.random() < 0.9 else max(0, i - 3), "".join(parts)))
        docs += [(3, None), (4, ""), (5, "x" * 130), (9, "x" * 130), (9, "x" * 130), (9, "x" * 49)]
        df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as block", "'k' as first").repartition(5)
        assert sorted(map(tuple, suffix_dedup.deduplicate(df, run=run).collect())) == sorted(brute(docs))


def test_the_tables_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.QUERIES["op10_suffix_dedup"](spark, sf).collect())) == sorted(brute(docs))


def test_multikey_order():
    keys = np.random.default_rng(1).integers(0, 3, (500, 4)).astype(np.uint64)
    assert suffix_dedup.multikey_classes(keys).tolist() == np.unique(keys, axis=0, return_inverse=True)[1].ravel().tolist()


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a" * 60), (1, "a" * 60), (2, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in suffix_dedup.deduplicate(docs).collect()) == [(0, 0), (1, 0), (2, 0)]
    assert suffix_dedup.deduplicate(docs.limit(0)).count() == 0


def test_very_long_text(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefghij é") for _ in range(400_000))
    docs = [(1, long[200_000:200_090]), (2, long), (3, long[:390_000] + "x" + long[390_000:]), (4, "ab" * 200_000), (5, "ab" * 150_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, suffix_dedup.deduplicate(df).collect())) == sorted(brute(docs))
