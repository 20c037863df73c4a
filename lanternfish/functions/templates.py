"""Chat templates of seven model families, response cleaning and prompts.

Families: general, instruct, deepseek, qwen, llama, hammer, function.  Message types: text, tool_response,
tool_call, system_info, thinking.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternfish.functions.parsing import CALL, END_CALL, END_TURN, ESCAPE, TURN
from lanternfish.functions.text import SPACE, trim

FAMILIES = ("general", "instruct", "deepseek", "qwen", "llama", "hammer", "function")
#: Control marks of the families.
DEEPSEEK = ("<｜begin▁of▁sentence｜>", "<｜User｜>", "<｜Assistant｜>")
QWEN = ("<|im_start|>", "<|im_end|>")
LLAMA = ("[INST]", "[/INST]")
HAMMER = ("User:", "Assistant:")
DECLARATION = ("<start_function_declaration>", "<end_function_declaration>")
RESPONSE = ("<start_function_response>", "<end_function_response>")
#: Sentences of the prompts.
JSON_PROMPT = (
    'You have access to functions. ONLY call a function when the user explicitly requests an action or command (like "change color", "show alert", "set title"). For regular conversation, greetings, and questions, respond normally without calling any functions.',
    'When you do need to call a function, respond with ONLY the JSON in this format: {"name": function_name, "parameters": {argument: value}}',
    "After the function is executed, you will get a response. Then provide a helpful message to the user about what was accomplished.",
)
FUNCTION_PROMPT = "You are a model that can do function calling with the following functions"


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def tool_response(text: Column, kind: Column, tool: Column) -> Column:
    block = _text("<tool_response>\nTool Name: ", F.coalesce(tool, F.lit("null")), "\nTool Response:\n", text, "\n</tool_response>")
    return F.when(kind == "tool_response", block).otherwise(text)


def general(text: Column, user: Column, content: Column) -> Column:
    return F.when(user, _text(TURN + "user\n", content, END_TURN)).otherwise(_text(TURN + "model\n", text, END_TURN))


def instruct(text: Column, user: Column, content: Column) -> Column:
    return F.when(user, _text(TURN + "user\n", content, f"{END_TURN}\n{TURN}model\n")).otherwise(_text(text, END_TURN + "\n"))


def deepseek(text: Column, user: Column, content: Column) -> Column:
    return F.when(user, _text(DEEPSEEK[0] + DEEPSEEK[1], content, DEEPSEEK[2])).otherwise(text)


def qwen(text: Column, user: Column, content: Column) -> Column:
    return F.when(user, _text(QWEN[0] + "user\n", content, f"{QWEN[1]}\n{QWEN[0]}model\n")).otherwise(_text(text, QWEN[1] + "\n"))


def llama(text: Column, user: Column, content: Column) -> Column:
    return F.when(user, _text(LLAMA[0] + " ", content, " " + LLAMA[1])).otherwise(text)


def hammer(text: Column, user: Column, content: Column) -> Column:
    return F.when(user, _text(HAMMER[0] + " ", content, f"\n{HAMMER[1]} ")).otherwise(text)


def function(text: Column, user: Column, kind: Column, tool: Column) -> Column:
    reply = (kind == "tool_response") & tool.isNotNull()
    content = F.when(reply, _text(RESPONSE[0] + "response:", tool, "{result:" + ESCAPE, text, ESCAPE + "}" + RESPONSE[1])).otherwise(text)
    opened = f"\n{TURN}model\n"
    return (
        F.when(text.startswith(TURN), text)
        .when(kind == "tool_response", _text(content, opened))
        .when(user, _text(TURN + "user\n", content, END_TURN + opened))
        .otherwise(_text(text, END_TURN + "\n"))
    )


def to_prompt(text: Column, user: Column, kind: Column, tool: Column, family: str, file_type: str = "binary") -> Column:
    """One message in a family's template; system information is empty, task files are formatted elsewhere."""
    content = tool_response(text, kind, tool)
    if family == "function":
        body = function(text, user, kind, tool)
    elif file_type == "task":
        body = content
    else:
        body = {"general": general, "instruct": instruct, "deepseek": deepseek, "qwen": qwen, "llama": llama, "hammer": hammer}[family](text, user, content)
    return F.when(kind == "system_info", F.lit("")).otherwise(body)


def remove_thinking(text: Column, family: str) -> Column:
    return trim(F.regexp_replace(text, r"(?s)<think>.*?</think>", "")) if family == "deepseek" else text


def clean(text: Column, family: str, thinking: bool = False, strip_end_tag: bool = False) -> Column:
    """Trimmed; a closing mark at the end survives unless strip_end_tag is asked for."""
    out = remove_thinking(text, family) if thinking else text
    if strip_end_tag and family in ("instruct", "qwen"):
        mark = END_TURN if family == "instruct" else r"<\|im_end\|>"
        out = F.regexp_replace(out, rf"{mark}{SPACE}*\z", "")
    return trim(out)


def json_tools_prompt(tools: Column) -> Column:
    """tools: array<struct<name, description, parameters>>, parameters as JSON text kept as it is."""
    lines = F.transform(tools, lambda t: F.concat(t["name"], F.lit(": "), t["description"], F.lit(" Parameters: "), t["parameters"], F.lit("\n")))
    return _text("\n".join(JSON_PROMPT) + "\n<tool_code>\n", F.array_join(lines, ""), "</tool_code>\n")


def _declaration(tool: dict) -> str:
    quoted = lambda v: f"{ESCAPE}{v}{ESCAPE}"
    schema = json.loads(tool["parameters"] or "{}")
    out = f"{DECLARATION[0]}declaration:{tool['name']}{{description:{quoted(tool['description'])}"
    if fields := schema.get("properties"):
        entries = []
        for name, field in fields.items():
            if not isinstance(field, dict):
                continue
            parts = [f"description:{quoted(field['description'])}"] if field.get("description") is not None else []
            if values := field.get("enum"):
                if bad := [v for v in map(str, values) if any(m in v for m in (ESCAPE, "<start_", "<end_"))]:
                    raise ValueError(f"enum value {bad[0]!r} holds a control mark")
                parts.append("enum:[" + ",".join(map(quoted, values)) + "]")
            parts.append("type:" + quoted((field.get("type") or "STRING").upper()))
            entries.append(f"{name}:{{{','.join(parts)}}}")
        needed = schema.get("required")
        out += ",parameters:{properties:{" + ",".join(entries) + "}" + (",required:[" + ",".join(map(quoted, needed)) + "]" if needed else "") + f",type:{quoted('OBJECT')}}}"
    return out + "}" + DECLARATION[1] + "\n"


@F.pandas_udf(T.StringType())
def function_tools_prompt(tools: pd.Series) -> pd.Series:
    """The declaration turn for an array of tools; enum values with control marks are an error."""
    return tools.map(lambda ts: f"{TURN}developer\n{FUNCTION_PROMPT}\n{''.join(map(_declaration, ts))}{END_TURN}\n")


def message_of(text: Column, user: Column, kind: str, tool: Column | None = None) -> Column:
    """A message struct as the factories make it: tool calls are the model's, tool responses the user's JSON."""
    body = F.to_json(text) if kind == "tool_response" else text
    who = {"tool_response": F.lit(True), "tool_call": F.lit(False)}.get(kind, user)
    return F.struct(body.alias("text"), who.alias("is_user"), F.lit(None).cast("binary").alias("image_bytes"), F.lit(kind).alias("type"), (tool if tool is not None else F.lit(None).cast("string")).alias("tool_name"))


def same_message(a: Column, b: Column) -> Column:
    """All five fields, bytes by value, null equal to null."""
    return a.eqNullSafe(b)


def web_prompt(parts: Column) -> Column:
    """parts: ordered array<struct<text, image>>; images as text between control marks once there is any."""
    joined = F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], p["image"], F.lit(""))), "")
    images = F.exists(parts, lambda p: p["image"].isNotNull())
    return F.when(images, _text("<ctrl99>user\n", joined, "<ctrl100>\n<ctrl99>model\n")).otherwise(joined)


def rag_prompt(contents: Column, question: Column) -> Column:
    """Context lines, then the question."""
    return _text("Context:\n", F.array_join(contents, "\n"), "\n\nQuestion: ", question)


def sft_text(system: str, user: Column, tool: Column, arguments: Column) -> Column:
    """A training example; arguments is JSON text of flat parameters."""
    pairs = F.map_entries(F.from_json(arguments, "map<string,string>"))
    joined = F.array_join(F.transform(pairs, lambda p: F.concat(p["key"], F.lit(":" + ESCAPE), p["value"], F.lit(ESCAPE))), ",")
    prompt = _text(f"{system}{TURN}user\n", user, f"\n{END_TURN}\n{TURN}model\n")
    return _text(prompt, CALL + "call:", tool, "{", joined, "}" + END_CALL)


def sft_output_valid(output: Column) -> Column:
    return output.contains(CALL) & ~output.substr(1, 50).contains("<pad>")


def task_prefix(text: Column, kind: str = "search result") -> Column:
    """kind: search result, clustering, classification or retrieval."""
    return _text(f"task: {kind} | query: ", text)
