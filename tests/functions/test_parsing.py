import json

import pytest
from pyspark.sql import functions as F

from lanternfish.functions import parsing
from lanternfish.streaming import classifier

CALL = '{"name": "get", "parameters": {"city": "NYC"}}'
CASES = [
    ("<start_function_call>call:get_weather{location:<escape>San Francisco<escape>}<end_function_call>", "function", ("get_weather", {"location": "San Francisco"})),
    ("<start_function_call>call:w{a:<escape>Tokyo<escape>,b:<escape>c<escape>}", "function", ("w", {"a": "Tokyo", "b": "c"})),
    ("<start_function_call>call:w{a:<escape>1<escape>,a:<escape>2<escape>,b:<escape>x\ny<escape>}<end_function_call>", "function", ("w", {"a": "2"})),
    ("just words", "function", None),
    (f"<tool_code>\n{CALL}\n</tool_code>", "instruct", ("get", {"city": "NYC"})),
    (f"<tool_code>no</tool_code>```json\n{CALL}\n```", None, ("get", {"city": "NYC"})),
    (f"```json\nbad\n```\n```\n{CALL}\n```", None, None),
    (f"x ```\n{CALL}\n```", None, ("get", {"city": "NYC"})),
    (CALL, None, ("get", {"city": "NYC"})),
    ('{"name": "t", "args": {"k": 1}}', None, ("t", {"k": 1})),
    ('{"name": "t", "parameters": "x", "args": {"k": 1}}', None, None),
    ('{"name": 1, "parameters": {}}', None, None),
    ('{"name": "a", "name": "b", "parameters": {}}', None, ("b", {})),
    (f"<start_of_turn>model\n{CALL}<end_of_turn>", None, ("get", {"city": "NYC"})),
    (f" {CALL}<end_of_turn>\n", None, ("get", {"city": "NYC"})),
    ("", None, None),
]


@pytest.fixture(scope="module")
def cases(spark):
    return spark.createDataFrame([(i, t, f) for i, (t, f, _) in enumerate(CASES)], "i int, t string, f string")


def test_parse_call(cases):
    rows = cases.select("i", parsing.parse_call(F.col("t"), F.col("f")).alias("c")).orderBy("i").collect()
    got = [(r.c.name, json.loads(r.c.args)) if r.c and r.c.name is not None else None for r in rows]
    assert got == [want for _, _, want in CASES]
    assert [(c[0], json.loads(c[1])) if (c := classifier.parse(t, f)) else None for t, f, _ in CASES] == got


TEXTS = ["{", "}", "{}", '{"a": "}"}', '{"a": "\\"}"}', "}{", "{{}", "\\{}", '{"a": {"b": 1}}', '"{}"', "", "{\\", "ab{c}d", '{"x": "y}']


def test_balanced(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    assert [r[0] for r in df.select(parsing.is_balanced(F.col("t"))).collect()] == [classifier.balanced(t) for t in TEXTS]


def test_start_complete_text(spark):
    rows = [
        ("<start_function_call>call:test", "function", True, False),
        ("{x}", "function", False, False),
        ("<start_function_call>call:t{}<end_function_call>", "function", True, True),
        ("<start_function_call>call:t{a:<escape>b", "function", True, False),
        (' {"name": "x", "parameters": {}} ', "instruct", True, True),
        ("```json\n{", None, True, False),
        ("```json\n{```", None, True, True),
        ("words", None, False, False),
        ("", None, False, False),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "t string, f string")
    got = df.select(parsing.is_call_start(F.col("t"), F.col("f")), parsing.is_call_complete(F.col("t"), F.col("f"))).collect()
    assert [tuple(g) for g in got] == [r[2:] for r in rows]
    assert all(classifier.complete(t, f) == c for t, f, _, c in rows)
    texts = spark.createDataFrame([("hello there",), ("abcd",), ("some Json here",), ("{abcdef",), ("a <tool b",)], "t string")
    assert [r[0] for r in texts.select(parsing.is_definitely_text(F.col("t"))).collect()] == [True, False, False, False, False]
