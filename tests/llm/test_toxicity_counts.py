import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from lanternfish.llm import toxicity


def spelled(word):
    """(history, letter) of each place, at the longest history."""
    w = " " + word
    return [(w[max(i - 7, 0) : i], w[i]) for i in range(1, len(w))]


def brute(texts, classes):
    """log P(word | toxic) - log P(word | ordinary) by place, from counts in dictionaries."""
    before = defaultdict(set)
    for word in {w for t in texts for w in t.split()}:
        w = " " + word
        for o in range(2, 8):
            for i in range(o, len(w)):
                before[w[i - o + 1 : i], w[i]].add(w[i - o])
    below = {x: len(s) for x, s in before.items()}
    own = [Counter(x for t in c for w in t.split() for x in spelled(w)) for c in classes]

    def by_history(counts):
        out = defaultdict(lambda: [0, 0])
        for (h, _), n in counts.items():
            out[h] = [out[h][0] + n, out[h][1] + 1]
        return out

    totals, shared = [by_history(c) for c in own], by_history(below)
    seen = own[0] + own[1]
    often = by_history(seen)

    def interpolated(counts, totals, h, b, rest):
        n, kinds = totals.get(h, (0, 0))
        return rest if not n else (max(counts.get((h, b), 0) - 0.75, 0) + 0.75 * kinds * rest) / n

    def ratio(word):
        out = []
        for h, b in spelled(word):
            p = 1 / 256
            for o in range(1, len(h)):
                p = interpolated(below, shared, h[-o:], b, p)
            if seen[h, b] < 2:  # the history alone tells
                p, b = 1, None
            out.append(0 if seen[h, b] < 2 and often[h][0] < 2 else math.log(interpolated(own[1], totals[1], h, b, p) / interpolated(own[0], totals[0], h, b, p)))
        return out

    return ratio


def test_words_against_brute_force(spark):
    rng = random.Random(3)
    made = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 12))) for _ in range(400)]
    docs = [(i, " ".join(rng.choice(made[:300] if i % 3 else made[100:]) for _ in range(30))) for i in range(300)]
    labels = [(i, int(i % 3 == 0)) for i in range(300)]
    d, l = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    learned = {r.doc_id: r.toxic for r in l.where(toxicity.training_row()).collect()}
    model, _ = toxicity.train(d, l)
    ratio = brute([t for _, t in docs], [[t for i, t in docs if learned.get(i) == k] for k in (0, 1)])
    for word in [*made, "abcdabcdabcd", "dddddddddd", "xyz"]:
        letters = np.frombuffer(word.encode(), np.uint8)
        got = model.ratios(toxicity.grams(letters, np.arange(len(letters))))
        assert got.tolist() == pytest.approx(ratio(word), abs=1e-4)


def test_names_are_the_bytes(spark):
    """No two n-grams share a name."""
    words = ["".join(chr(97 + (i // 26**k) % 26) for k in range(4)) + chr(97 + i % 7) for i in range(150000)]
    rows = [(" ".join(words[i : i + 1000]), i // 1000 % 4) for i in range(0, len(words), 1000)]
    texts = spark.createDataFrame(rows, "text string, kind int")
    want = {(k, h, b) for t, k in rows for w in t.split() for h, b in spelled(w)}
    found = toxicity._count(texts).toArrow()
    assert sum(len(x) for x in found["g"].to_pylist()) == 8 * len(want)


def test_very_long_text(spark):
    """A text beyond a step is scored whole: its only abuse stands at the end."""
    docs = [(i, "you scum you scum" if i % 2 else "good day to you") for i in range(400)]
    long = "good day to you " * 120_000
    d = spark.createDataFrame([*docs, (1000, long), (1001, "scum " * 300_000)], "doc_id long, text string")
    l = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    found = {r.doc_id: r.score for r in toxicity.score(d, l).where("doc_id >= 1000").collect()}
    assert found[1000] < 0.5 < 0.7 <= found[1001]
