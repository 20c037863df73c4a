import hashlib
import re

import numpy as np
import public_tokenizers

import corpus_pipeline
from lanternfish.llm import byte_bpe, queries
from tests.llm import test_decontaminate, test_line_dedup, test_ngram_join

SF = "/root/testdata/sf0.001"
WORD = re.compile(b"[0-9a-z\x80-\xff]+")


def without_passages(text, items):
    """Spans of ten words that an item has, by brute force over the bytes of words."""
    if text is None:
        return None
    raw = text.encode()
    small = bytes(b + 32 if 65 <= b < 91 else b for b in raw)
    found = list(WORD.finditer(small))
    words = [m[0].decode() for m in found]
    hit = set()
    for item in items:
        w = test_decontaminate.norm(item)
        n = min(10, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
    if not hit:
        return text
    out, at = [], 0
    for i in sorted(hit):
        if i - 1 not in hit:
            out.append(raw[at : found[i].start()])
        at = found[i].end()
    out.append(raw[at:])
    return b" ".join(x.strip(b" ") for x in out if x.strip(b" ")).decode()


def test_against_brute_force(spark):
    toxic = {r.doc_id for r in queries.QUERIES["op8_toxicity"](spark, SF).where("predicted = 1").collect()}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.doc_id not in toxic]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [(d, t) for d, _, _, t in test_line_dedup.brute(docs)]
    keep = {d for d, _, c in test_ngram_join.brute(docs) if d == c}
    docs = {d: without_passages(t, items) for d, t in docs if d in keep}
    enc = byte_bpe.encoding(public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN)
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.text for r in rows} == docs
    for r in rows:
        ids = np.frombuffer(r.token_ids, "<u4")
        assert ids.tolist() == enc.encode_ordinary(r.text)
        assert r.n_tokens == len(ids) and r.n_chars == len(r.text)
        assert r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).dtypes == docs.dtypes
