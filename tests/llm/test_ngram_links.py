import random
from collections import Counter

from lanternfish.llm import ngram_join, repeats
from tests.llm.test_ngram_join import brute, sets_of


def test_links_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 5000)
    monkeypatch.setattr(repeats, "BUCKET_PRINTS", 100)
    rng = random.Random(5)
    letters = [f"w{i}É" for i in range(40)]
    base = [[rng.choice(letters) for _ in range(120)] for _ in range(4)]
    docs = []
    for i in range(120):  # large groups of near copies
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(letters)
        docs.append((500 - i, " ".join(w)))
    docs += [(1, None), (2, ""), (3, docs[0][1].lower()), (None, docs[0][1])]
    sets = {d: frozenset(sets_of(t)) for d, t in docs if d is not None}
    rep = {}
    for d in sorted(sets):
        rep.setdefault(sets[d], d)
    reps = sorted(r for s, r in rep.items() if s)
    want = {(a, b) for a in reps for b in reps if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert len(want) > 3 * len(reps)  # far more links than a forest has
    pairs, members = ngram_join.links(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    rows = pairs.collect()
    assert len(rows) == len(want) and {(r.a, r.b) for r in rows} == want
    n = Counter(x for p in want for x in p)
    got = sorted(((r.doc_id, r.n_shingles, r.class_id, r.n_links) for r in members.collect()), key=str)
    all_rows = [(d, len(sets_of(t)), rep[sets[d]] if d is not None and sets[d] else None, n[rep[sets[d]]] if d is not None and sets[d] else 0) for d, t in docs]
    assert got == sorted(all_rows, key=str)
    for chunk in (1 << 20, 5000):
        counted = ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string"), counts=True, chunk=chunk)
        assert sorted(((r.doc_id, r.n_shingles, r.class_id, r.n_links) for r in counted.collect()), key=str) == got
    named = [x for x in docs if x[0] is not None]
    found = ngram_join.linked(pairs, members).where("doc_id is not null").collect()
    assert sorted(map(tuple, found)) == sorted(brute(named))


def test_empty(spark):
    pairs, members = ngram_join.links(spark.createDataFrame([], "doc_id long, text string"))
    assert pairs.count() == members.count() == 0
