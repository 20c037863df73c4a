import random
import re

import pytest

from lanternfish.llm import components, ngram_join, queries, repeats


def sets_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1 if w else 0))}


def brute(docs):
    s = [sets_of(t) for _, t in docs]
    root = {d: d for d, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                a, b = sorted((find(docs[i][0]), find(docs[j][0])))
                root[b] = a
    for (d, _), x in zip(docs, s, strict=True):
        yield d, len(x), find(d)


@pytest.mark.parametrize("stars", [0, 1, 4])
def test_against_brute_force(spark, monkeypatch, stars):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 5000)
    monkeypatch.setattr(repeats, "BUCKET_PRINTS", 100)
    rng = random.Random(stars)
    letters = [f"w{i}É" for i in range(40)] + ["A", "b"]
    base = [[rng.choice(letters) for _ in range(rng.choice([1, 3, 4, 5, 6, 20, 60, 200]))] for _ in range(25)]
    docs = []
    for i in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2, 3, 8])):
            w[rng.randrange(len(w))] = rng.choice(letters)
        docs.append((1000 - i, rng.choice([" ", "\n", " \t"]).join(w)))
    docs += [(2, None), (3, ""), (4, " \n"), (5, docs[0][1].lower()), (5, docs[0][1].lower())]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as rep", "'k' as n").repartition(4)
    assert sorted(map(tuple, ngram_join.join(df, stars=stars).collect())) == sorted(brute(docs))


def test_the_tables_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.QUERIES["op4_ngram_join"](spark, sf).drop("n_links").collect())) == sorted(brute(docs))


def test_one_doc_id_is_one_document(spark):
    docs = [(5, "a b c"), (3, "a b c"), (5, "d e f"), (9, "d e f"), (None, "d e f"), (1, "x")]
    rows = ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id or 0, r.component_id or 0) for r in rows)) == [(0, 0), (1, 1), (3, 3), (5, 3), (5, 3), (9, 3)]
    assert ngram_join.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(0, 70)] + [(500, 500 + i) for i in range(1, 30)] + [(7, 7)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 71)}, **{500 + i: 500 for i in range(1, 30)}}
