import re
from collections import Counter, defaultdict

import pytest

from lanternfish.llm import line_dedup, queries


def masked(line):
    tokens = [t for t in re.split(r"[\x09-\x0D\x20]+", line) if t]
    return tuple("<*>" if re.search("[0-9@]|://", t) else t for t in tokens)


def brute(docs, depth=2, share=5, similarity=70):
    """(doc_id, lines, dropped lines, kept text), by walking the tree of all lines in dictionaries."""
    holders = defaultdict(set)
    for doc, text in docs:
        for line in (text or "").split("\n") if doc is not None else ():
            holders[masked(line)].add(doc)
    leaves = defaultdict(list)
    for w in holders:
        leaves[len(w), w[:depth]].append(w)
    template = {}
    for (n, lead), members in leaves.items():
        at = [Counter() for _ in range(n)]
        for w in members:
            for i, t in enumerate(w):
                at[i][t] += len(holders[w])
        total = sum(len(holders[w]) for w in members)
        for w in members:
            made = lead + tuple(t if at[i][t] * share >= total else "<*>" for i, t in enumerate(w) if i >= depth)
            template[w] = made if 100 * sum(t != "<*>" for t in made) >= similarity * n else w
    where = defaultdict(set)
    for w, found in holders.items():
        where[template[w]] |= found

    def gone(doc, w):
        if not w or doc is None:
            return False
        t = template[w]
        lacking = max(0, 4 - sum(x != "<*>" for x in t))
        return len(where[t]) >= 3 * 4**lacking and doc > min(where[t])

    for doc, text in docs:
        lines = [] if text is None else text.split("\n")
        drop = [gone(doc, masked(x)) for x in lines]
        yield doc, len(lines), sum(drop), None if text is None else "\n".join(x for x, d in zip(lines, drop, strict=True) if not d)


def check(spark, docs, **options):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'k' as line", "1 as a", "2L as n_dropped", "'v' as version", "0 as leaf", "'w' as words")
    rows = line_dedup.deduplicate(df, counts=True, **options)
    got = sorted(map(tuple, rows.select("doc_id", "n_lines", "n_dropped", "text").collect()), key=str)
    assert got == sorted(brute(docs, **options), key=str)
    return {r[0]: r for r in got}


def test_against_brute_force(spark):
    lines = ["Page 3 of 12", "Page  4 of\t99 ", "write to me@x.org now please", "write to you@y.org now please", "one two three", "a b c d", "a b c d é", "", "x y z http://q w", "é é é é", "the <*> of <*>"]
    docs = [(i % 37, "\n".join(lines[(i * j) % 11] + (f" {i}x word" if j == 2 else "") for j in range(i % 9))) for i in range(80)]
    names = ["Anna", "Bob", "Cleo", "Dan", "Eve", "Fay", "Gil", "Hal", "Ida"]
    docs += [(100 + i, f"Read more stories by {names[i % 9]} on our site\nThe {names[i % 9]} of {names[i % 4]} and {names[i % 7]}\nShare this\nText of {names[i % 9]}") for i in range(60)]
    docs += [(5, None), (6, ""), (7, "a b c d\na b c d"), (7, "a b c d\na b c d"), (0, "a b c d\r\nq"), (None, "a b c d\nShare this"), (None, None)]
    check(spark, docs)
    check(spark, docs, depth=4, share=3, similarity=50)
    df = spark.createDataFrame(docs[:9], "doc_id long, text string").selectExpr("*", "'k' as line", "1 as a")
    assert line_dedup.deduplicate(df).columns == df.columns
    assert line_dedup.deduplicate(df.limit(0)).count() == 0


def test_plain_words_are_fields_too(spark):
    """Lines without any digit that differ in one token in the middle share a template; the first document keeps its own."""
    names = ["Anna", "Bob", "Cleo", "Dan", "Eve", "Fay", "Gil"]
    docs = [(i, f"Read more stories by {names[i]} on our site\nown line {names[i]} {names[-i]} {names[i - 3]} {names[i - 2]}") for i in range(7)]
    found = check(spark, docs)
    assert [found[i][2] for i in range(7)] == [0, 1, 1, 1, 1, 1, 1]


def test_depth_decides(spark):
    """With five leading tokens the name is part of the path, so every line has a leaf of its own."""
    names = ["Anna", "Bob", "Cleo", "Dan", "Eve", "Fay", "Gil"]
    docs = [(i, f"Read more stories by {names[i]} on our site") for i in range(7)]
    assert sum(r[2] for r in check(spark, docs, depth=5).values()) == 0
    assert sum(r[2] for r in check(spark, docs, depth=4).values()) == 6


@pytest.mark.parametrize("less", [0, 1])
def test_short_lines_need_more_documents(spark, less):
    needs = {"a b c d": 3, "a b c": 12, "Share this": 48, "a 1 b 2 c": 12, "x": 192}
    docs = [(i, "\n".join(line for line, need in needs.items() if i < need - less)) for i in range(192)]
    assert sum(r[2] for r in check(spark, docs).values()) == (0 if less else sum(needs.values()) - len(needs))


def test_very_long(spark):
    """A text of many lines and a line of many tokens."""
    many = "\n".join(["the same line here"] + [f"w{chr(97 + i % 26)}{'x' * (i % 50)} {i}" for i in range(70000)])
    wide = " ".join(["lead of"] + ["tok" + "y" * (i % 30) for i in range(60000)])
    docs = [(1, "the same line here"), (2, many), (3, many), (4, wide), (5, wide + " end\nthe same line here"), (6, wide), (7, wide), (8, wide[:-1] + "z")]
    check(spark, docs)


def test_the_plan_has_no_python(spark):
    found = queries.QUERIES["op1_line_dedup"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
