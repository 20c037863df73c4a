"""Function calls in model text: detection, completeness, extraction.

`family` is a column with the model family; only 'function' has a grammar of its own, all others and null are JSON.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternfish.functions.text import SPACE, first, trim, units

#: Marks of the call syntaxes.
CALL, END_CALL, ESCAPE = "<start_function_call>", "<end_function_call>", "<escape>"
TURN, END_TURN = "<start_of_turn>", "<end_of_turn>"
CODE, END_CODE, FENCE = "<tool_code>", "</tool_code>", "```"
S = SPACE


def _function(family: Column) -> Column:
    return F.coalesce(family == "function", F.lit(False))


def is_call_start(buffer: Column, family: Column) -> Column:
    t = trim(buffer)
    return F.when(_function(family), t.startswith(CALL)).otherwise(t.startswith("{") | t.startswith(FENCE) | t.startswith(CODE))


def is_definitely_text(buffer: Column) -> Column:
    t = trim(buffer)
    early = t.substr(1, 30)
    marks = early.contains("{") | F.lower(early).contains("json") | early.contains("<tool")
    return (units(t) >= 5) & ~is_call_start(buffer, F.lit(None).cast("string")) & ~marks


def is_balanced(s: Column) -> Column:
    """Braces outside strings balance and there is one at least.  A backslash skips the next character anywhere;
    it and strings are cut out by one pattern, then a fold counts what is left."""
    bare = F.regexp_replace(F.regexp_replace(s, r"(?s)\\.", ""), r'"[^"]*("|\z)', "")
    braces = F.regexp_extract_all(bare, F.lit(r"[{}]"), F.lit(0))
    step = lambda a, x: F.struct((a["n"] + F.when(x == "{", 1).otherwise(-1)).alias("n"), (a["bad"] | ((a["n"] == 0) & (x == "}"))).alias("bad"))
    fold = F.aggregate(braces, F.struct(F.lit(0).alias("n"), F.lit(False).alias("bad")), step)
    return (F.size(braces) > 0) & (fold["n"] == 0) & ~fold["bad"]


def is_call_complete(buffer: Column, family: Column) -> Column:
    t = trim(buffer)
    own = t.contains(CALL) & (t.contains(END_CALL) | t.endswith("}"))
    blocks = (t.contains(FENCE + "json") & t.endswith(FENCE)) | (t.contains(CODE) & t.contains(END_CODE))
    plain = F.when(t.startswith("{") & t.endswith("}"), is_balanced(t)).otherwise(blocks)
    return F.when(_function(family), own).otherwise(plain) & (t != "")


def clean_response(s: Column) -> Column:
    wrapped = first(s, rf"<start_of_turn>model{S}*([\s\S]*?)<end_of_turn>")
    return trim(F.coalesce(wrapped, F.regexp_replace(s, rf"<end_of_turn>{S}*\z", "")))


def code_block(s: Column) -> Column:
    """JSON text of the first tool_code block, null without one."""
    return trim(first(s, rf"<tool_code>{S}*([\s\S]*?){S}*</tool_code>"))


def json_fence(s: Column) -> Column:
    return trim(first(s, rf"```json{S}*([\s\S]*?){S}*```"))


def any_fence(s: Column) -> Column:
    inner = trim(first(s, rf"```{S}*([\s\S]*?){S}*```"))
    return F.when(inner.startswith("{") & inner.contains('"name"'), inner)


def _call_of(text: str | None) -> tuple[str, str] | None:
    """(name, arguments as JSON text) of a JSON call.  A name that is no string, or parameters that are no object,
    make it none; absent or null parameters let args speak."""
    try:
        value = json.loads(text) if text else None
    except ValueError:
        return None
    if not isinstance(value, dict) or not isinstance(value.get("name"), str):
        return None
    for key in ("parameters", "args"):
        if (args := value.get(key)) is not None:
            return (value["name"], json.dumps(args, ensure_ascii=False, separators=(",", ":"))) if isinstance(args, dict) else None
    return None


@F.pandas_udf(T.StructType([T.StructField("name", T.StringType()), T.StructField("args", T.StringType())]))
def json_call(texts: pd.Series) -> pd.DataFrame:
    """JSON decoded in Arrow batches: later duplicates of a key win and types are checked, as built-in parsing of
    variants does neither."""
    found = [_call_of(t) for t in texts]
    return pd.DataFrame({"name": [f and f[0] for f in found], "args": [f and f[1] for f in found]})


def function_name(s: Column) -> Column:
    return F.coalesce(first(s, r"(?s)<start_function_call>call:(\w+)\{(.*?)\}<end_function_call>"), first(s, r"(?s)<start_function_call>call:(\w+)\{(.*?)\}"))


def function_params(s: Column) -> Column:
    """map of all parameters; values don't span lines, later ones win."""
    body = F.coalesce(first(s, r"(?s)<start_function_call>call:(\w+)\{(.*?)\}<end_function_call>", 2), first(s, r"(?s)<start_function_call>call:(\w+)\{(.*?)\}", 2))
    pattern = F.lit(r"(\w+):<escape>(.*?)<escape>")
    keys, values = F.regexp_extract_all(body, pattern, F.lit(1)), F.regexp_extract_all(body, pattern, F.lit(2))
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    names = F.array_distinct(keys)
    last = F.transform(names, lambda n: F.element_at(F.filter(pairs, lambda p: p["k"] == n), -1)["v"])
    return F.map_from_arrays(names, last)


def json_source(s: Column) -> Column:
    """The JSON text that the cascade comes to: tool code, else fence (a json fence ends the search), else itself.
    A tool_code block that is no call lets the next speak, so it is tried apart in parse_call."""
    t = clean_response(s)
    return F.coalesce(json_fence(t), any_fence(t), F.when(t.startswith("{") & t.contains('"name"'), t))


def parse_call(s: Column, family: Column) -> Column:
    """struct(name, args as JSON text); null name where there is no call."""
    t = clean_response(s)
    code = json_call(F.when(_function(family), F.lit(None)).otherwise(code_block(t)))
    rest = json_call(F.when(_function(family), F.lit(None)).otherwise(json_source(s)))
    own = F.struct(function_name(t).alias("name"), F.to_json(function_params(t)).alias("args"))
    return F.when(_function(family), own).when(code["name"].isNotNull(), code).otherwise(rest)


@F.pandas_udf(T.StringType())
def json_message(texts: pd.Series) -> pd.Series:
    """The text under `message` of a JSON object, null where there is none."""

    def one(t):
        try:
            value = json.loads(t) if t else None
        except ValueError:
            return None
        return value["message"] if isinstance(value, dict) and isinstance(value.get("message"), str) else None

    return texts.map(one)
