import hashlib
import random
import re

from lanternfish.llm import queries, repeats, substring_dedup


def brute(docs, window=50):
    seen = {}
    split = [(d, [] if t is None else re.findall(r"[^\x20\x09-\x0D]+", t)) for d, t in docs]
    for d, w in split:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            seen[k] = min(seen.get(k, d), d)
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        yield d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()


def corpus(rng, n, letters, sizes, join):
    passages = [[rng.choice(letters) for _ in range(rng.choice(sizes))] for _ in range(12)]
    docs = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(5)):
            p = list(rng.choice(passages))
            if rng.random() < 0.3:
                p[rng.randrange(len(p))] = rng.choice(letters)
            parts += p[rng.randrange(3) :] if rng.random() < 0.5 else [rng.choice(letters) for _ in range(rng.randrange(9))] + p
        docs.append((i if rng.random() < 0.9 else max(0, i - 3), join(rng, parts)))
    return docs


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(repeats, "BUCKET_PRINTS", 50)
    rng = random.Random(11)
    join = lambda rng, w: "".join(x + rng.choice([" ", "\n", "\t ", "\x0b"]) for x in w)
    for letters, sizes in ((["a", "b"], [5, 40, 60, 80]), ([f"w{i}é" for i in range(300)], [49, 50, 51, 75, 120, 260])):
        docs = corpus(rng, 120, letters, sizes, join) + [(3, None), (4, ""), (5, "x " * 130), (9, "x " * 130), (9, "x " * 130)]
        df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as block", "'k' as key").repartition(5)
        assert sorted(map(tuple, substring_dedup.deduplicate(df).collect())) == sorted(brute(docs))


def test_the_tables_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.QUERIES["op3_substring_dedup"](spark, sf).collect())) == sorted(brute(docs))


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a " * 60), (1, "a " * 60), (2, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in substring_dedup.deduplicate(docs).collect()) == [(0, 0), (1, 0), (2, 0)]
    assert substring_dedup.deduplicate(docs.limit(0)).count() == 0


def test_stretches_become_one_span_that_the_source_must_confirm(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = " ".join(word() for _ in range(400))
    docs = [(i, f"{word()} {passage} {word()}") for i in range(1, 5)]
    dealt, marks, count = substring_dedup.spans(spark.createDataFrame(docs, "doc_id long, text string"))
    rows = marks.collect()
    assert sorted((r.doc_id, r.start, r.stop) for r in rows) == [(i, 1, 401) for i in (2, 3, 4)]
    wrong = marks.selectExpr("doc_id", "version", "start", "stop", "if(doc_id = 3, unhex('00'), digest) as digest")
    found = repeats.finish(dealt, wrong, count, substring_dedup._digest, repeats.WORDS, substring_dedup.SCHEMA, substring_dedup._holds)
    assert {r.doc_id: r.n_removed for r in found.collect()} == {1: 0, 2: 400, 3: 0, 4: 400}


def test_very_long_text(spark):
    rng = random.Random(4)
    long = [f"w{rng.randrange(10**6)}" for _ in range(60_000)]
    docs = [(1, " ".join(long[30_000:30_080])), (2, " ".join(long)), (3, " ".join(long[:59_000] + ["x"] + long[59_000:]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, substring_dedup.deduplicate(df).collect())) == sorted(brute(docs))
