"""Token streams into text, thinking and calls: one state machine, run over a table or a stream.

Input rows: (stream_id, seq, token, done).  One rule for both forms: tokens count in order of seq, of several rows of one
seq the first to come (in a table the least), and the first row with done ends its stream; what comes after it,
and a seq that has passed, is left out.  Output rows: (stream_id, out_seq, kind, text, fn_name, fn_args, in_history).
Kinds: text, thinking, call, and reset where a single-turn family forgets its history.

A stream's state is the machine and the tokens ahead of their turn; it expires KEPT_MS after its last change, so a
stream that never ends, and the mark of one that has, don't stay for ever.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lanternfish.functions import parsing

MOST_BUFFERED = 150
SCHEMA = "stream_id string, out_seq long, kind string, text string, fn_name string, fn_args string, in_history boolean"
_STATE = "state string"
#: A day.
KEPT_MS = 86_400_000


def _utf16(s: str) -> int:
    return len(s.encode("utf-16-le")) // 2


def balanced(s: str) -> bool:
    depth, seen, quoted, skip = 0, False, False, False
    for c in s:
        if skip:
            skip = False
        elif c == "\\":
            skip = True
        elif c == '"':
            quoted = not quoted
        elif not quoted and c in "{}":
            depth += 1 if c == "{" else -1
            seen |= c == "{"
            if depth < 0:
                return False
    return seen and depth == 0


def complete(buffer: str, family: str | None) -> bool:
    t = buffer.strip()
    if family == "function":
        return parsing.CALL in t and (parsing.END_CALL in t or t.endswith("}"))
    if t.startswith("{") and t.endswith("}"):
        return balanced(t)
    return ("```json" in t and t.endswith("```")) or (parsing.CODE in t and parsing.END_CODE in t)


def parse(text: str, family: str | None) -> tuple[str, str] | None:
    if wrapped := re.search(r"<start_of_turn>model\s*([\s\S]*?)<end_of_turn>", text):
        t = wrapped[1].strip()
    else:
        t = re.sub(r"<end_of_turn>\s*\Z", "", text).strip()
    if family == "function":
        m = re.search(r"<start_function_call>call:(\w+)\{(.*?)\}<end_function_call>", t, re.S | re.A) or re.search(r"<start_function_call>call:(\w+)\{(.*?)\}", t, re.S | re.A)
        if not m:
            return None
        args = dict(re.findall(r"(\w+):<escape>(.*?)<escape>", m[2], re.A))
        return m[1], json.dumps(args, ensure_ascii=False, separators=(",", ":"))
    if (m := re.search(r"<tool_code>\s*([\s\S]*?)\s*</tool_code>", t)) and (found := parsing._call_of(m[1].strip())):
        return found
    if m := re.search(r"```json\s*([\s\S]*?)\s*```", t):
        inner = m[1].strip()
    elif (m := re.search(r"```\s*([\s\S]*?)\s*```", t)) and m[1].strip().startswith("{") and '"name"' in m[1]:
        inner = m[1].strip()
    else:
        inner = t if t.startswith("{") and '"name"' in t else None
    return parsing._call_of(inner)


class Machine:
    """The state of one stream.  `tools` turns call detection on; `thinking` the filter of the deepseek family."""

    def __init__(self, family: str | None = None, thinking: bool = False, tools: bool = True, state: dict | None = None) -> None:
        self.family, self.filter, self.tools = family, thinking and family == "deepseek", tools
        self.inside, self.thought, self.buffer, self.history, self.out = self.filter, "", "", "", 0
        if state:
            self.__dict__.update(state)

    def state(self) -> dict:
        return {n: getattr(self, n) for n in ("inside", "thought", "buffer", "history", "out")}

    def _row(self, kind: str, text: str | None = None, call: tuple[str, str] | None = None, kept: bool = False) -> tuple:
        self.out += 1
        return (self.out - 1, kind, text, call and call[0], call and call[1], kept)

    def push(self, token: str) -> Iterator[tuple]:
        if self.inside:
            before, mark, after = token.partition("</think>")
            if not mark:
                self.thought += token
                yield self._row("thinking", token)
                return
            self.thought += before
            if self.thought:
                yield self._row("thinking", self.thought)
            self.inside = False
            if not after:
                return
            token = after
        if not self.tools or (not self.buffer and "{" not in token and "```" not in token):
            if self.family == "function":  # no other family looks back
                self.history += token
            yield self._row("text", token, kept=True)
        elif not self.buffer:
            self.buffer = token
        else:
            self.buffer += token
            if complete(self.buffer, self.family):
                yield self._resolved(self.buffer, message=True)
                self.buffer = ""
            elif _utf16(self.buffer) > MOST_BUFFERED:
                yield self._row("text", self.buffer)
                self.buffer = ""

    def _resolved(self, content: str, message: bool) -> tuple:
        if message:
            try:
                value = json.loads(self.buffer)
            except ValueError:
                value = None
            if isinstance(value, dict) and isinstance(value.get("message"), str):
                return self._row("text", value["message"])
        found = parse(content, self.family)
        return self._row("call", None, found) if found else self._row("text", self.buffer)

    def finish(self) -> Iterator[tuple]:
        called = messaged = False
        if self.buffer:
            own = self.family == "function"
            content = self.history + self.buffer if own else self.buffer
            if complete(content, self.family):
                row = self._resolved(content, message=not own)
                called, messaged = row[1] == "call", row[1] == "text" and row[2] != self.buffer
                yield row
            else:
                yield self._row("text", self.buffer)
            self.buffer = ""
        if self.family == "function" and not called and not messaged:
            yield self._row("reset")


def _frame(stream_id: str, rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(stream_id, *r) for r in rows], columns=["stream_id", "out_seq", "kind", "text", "fn_name", "fn_args", "in_history"])


def classify(tokens: DataFrame, family: str | None = None, thinking: bool = False, tools: bool = True) -> DataFrame:
    """The batch form: a stream's tokens in order of seq."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        machine, rows = Machine(family, thinking, tools), []
        for token, done in pdf.sort_values(["seq", "token", "done"]).drop_duplicates("seq")[["token", "done"]].itertuples(index=False):
            rows += machine.push(token or "")
            if done is True or done == 1:
                break
        return _frame(key[0], rows + list(machine.finish()))

    return tokens.groupBy("stream_id").applyInPandas(one, SCHEMA)


class _Processor(StatefulProcessor):
    """Keeps the machine and the tokens that came ahead of their turn."""

    def __init__(self, family: str | None, thinking: bool, tools: bool, kept_ms: int | None) -> None:
        self.options, self.kept_ms = (family, thinking, tools), kept_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.saved = handle.getValueState("machine", _STATE, self.kept_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = json.loads(self.saved.get()[0]) if self.saved.exists() else {"machine": None, "next": 0, "ahead": {}}
        if kept is None:  # ended
            for _ in rows:
                pass
            yield _frame(key[0], [])
            return
        machine, out = Machine(*self.options, state=kept["machine"]), []
        for pdf in rows:
            for seq, token, done in zip(pdf.seq, pdf.token, pdf.done, strict=True):
                if seq >= kept["next"]:
                    kept["ahead"].setdefault(str(seq), [token or "", bool(done)])
        ended = False
        while not ended and str(kept["next"]) in kept["ahead"]:
            token, ended = kept["ahead"].pop(str(kept["next"]))
            kept["next"] += 1
            out += machine.push(token)
        if ended:
            out += machine.finish()
        kept["machine"] = machine.state()
        self.saved.update((json.dumps(None if ended else kept),))
        yield _frame(key[0], out)

    def close(self) -> None:
        pass


def classify_stream(tokens: DataFrame, family: str | None = None, thinking: bool = False, tools: bool = True, kept_ms: int | None = KEPT_MS) -> DataFrame:
    """The streaming form; seq counts from 0 without gaps.  Needs the RocksDB state store.  kept_ms: how long a stream's
    state outlives its last change; None keeps it, for a run that ends by itself when all input is read, which the
    clock that expiry needs would keep going."""
    return tokens.groupBy("stream_id").transformWithStateInPandas(statefulProcessor=_Processor(family, thinking, tools, kept_ms), outputStructType=SCHEMA, outputMode="Append", timeMode="None" if kept_ms is None else "ProcessingTime")
