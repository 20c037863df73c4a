import random
import re

from lanternfish.llm import decontaminate, queries

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def norm(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, length=10):
    windows = {}
    for item, text in items:
        w = norm(text)
        for i in range(max(len(w) - length + 1, 1 if w else 0)):
            windows.setdefault(tuple(w[i : i + length]), set()).add(str(item))
    sizes = {len(k) for k in windows}
    for doc, text in docs:
        w, hit, found = norm(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if k := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= k
        yield doc, len(w), len(hit), len(found), decontaminate.sha256_of(list(found)), bool(hit)


def test_against_brute_force(spark):
    rng = random.Random(3)
    letters = ["a", "B", "c", "É", "7", "dd"]
    text = lambda n: "".join(rng.choice(letters) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 2, 5, 9, 10, 11, 25]))) for i in range(3, 12)] + [(12, None), (5, text(12))]
    items = [(i, t) for i, t in items if t is None or len(norm(t)) not in (1, 2) or i == 4]
    docs = [(i, text(rng.randrange(60)) + (rng.choice(items)[1] or "") + text(rng.randrange(9))) for i in range(200)] + [(7, None), (8, ""), (9, items[0][1])] * 2
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n_words", "'x' as hit_items")
    b = spark.createDataFrame(items, "item_id long, text string")
    for words in (500_000, 20):
        rows = decontaminate.report(d, b, portion_words=words).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
        assert sorted(map(tuple, rows)) == sorted(brute(docs, items))


def test_query_and_brute_force_on_the_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted(map(tuple, queries.QUERIES["op7_decontaminate"](spark, sf).collect())) == sorted(brute(docs, items))


def test_empty_tables_and_removal(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "one two three. four", 9), (2, None, 9)], "doc_id long, text string, n int")
    assert {r.contaminated for r in decontaminate.report(docs, none).collect()} == {False}
    assert decontaminate.report(docs.limit(0), none).count() == 0
    item = spark.createDataFrame([("a", "TWO three")], "item_id string, text string")
    assert [tuple(r) for r in decontaminate.removed(docs, item).orderBy("doc_id").collect()] == [(1, "one . four", 9), (2, None, 9)]


def test_an_item_without_an_id_hits_words_only(spark):
    docs = spark.createDataFrame([(1, "one two three four"), (2, "three")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "two three"), ("a", "two three four"), (None, None)], "item_id string, text string")
    rows = sorted(tuple(r)[2:] for r in decontaminate.report(docs, items).collect())
    assert rows == [(1, 0, 0, decontaminate.sha256_of([]), False), (4, 3, 1, decontaminate.sha256_of(["a"]), True)]


def test_very_long_text(spark):
    """A text beyond a step; the item stands across what would be a cut, and at the end."""
    item = " ".join(f"w{i}" for i in range(12))
    text = "filler word " * 40_000 + item + " filler" * 60_000 + " " + item
    docs = [(1, text), (2, "short")]
    df, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("x", item)], "item_id string, text string")
    rows = decontaminate.report(df, items).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted(map(tuple, rows)) == sorted(brute(docs, [("x", item)]))
