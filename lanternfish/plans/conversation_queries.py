"""Queries of chat templates, history and token streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanternfish import session
from lanternfish.functions import embed, templates
from lanternfish.operators import conversation
from lanternfish.plans.registry import QUERIES, query
from lanternfish.streaming import classifier


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as messages: every fifth user turn is a tool's response."""
    rows = session.table(spark, sf_dir, "conversations")
    kind = F.when((F.col("turn") % 5 == 4) & (F.col("role") == "user"), "tool_response").when(F.col("role") == "system", "system_info").otherwise("text")
    return rows.select("conv_id", "turn", (F.col("role") == "user").alias("is_user"), kind.alias("type"), "text", F.lit("tool").alias("tool_name"), F.when(F.col("turn") % 7 == 3, F.col("text").cast("binary")).alias("image_bytes"))


_M = """m AS (SELECT conv_id, turn, role = 'user' AS u, CASE WHEN turn % 5 = 4 AND role = 'user' THEN 'tool_response' WHEN role = 'system' THEN 'system_info' ELSE 'text' END AS k, text AS t FROM conversations),
c AS (SELECT *, CASE WHEN k = 'tool_response' THEN '<tool_response>' || chr(10) || 'Tool Name: tool' || chr(10) || 'Tool Response:' || chr(10) || t || chr(10) || '</tool_response>' ELSE t END AS c FROM m)"""
_N = "chr(10)"
_FORMS = {
    "general": (f"'<start_of_turn>user' || {_N} || c || '<end_of_turn>'", f"'<start_of_turn>model' || {_N} || t || '<end_of_turn>'"),
    "instruct": (f"'<start_of_turn>user' || {_N} || c || '<end_of_turn>' || {_N} || '<start_of_turn>model' || {_N}", f"t || '<end_of_turn>' || {_N}"),
    "deepseek": ("'<｜begin▁of▁sentence｜><｜User｜>' || c || '<｜Assistant｜>'", "t"),
    "qwen": (f"'<|im_start|>user' || {_N} || c || '<|im_end|>' || {_N} || '<|im_start|>model' || {_N}", f"t || '<|im_end|>' || {_N}"),
    "llama": ("'[INST] ' || c || ' [/INST]'", "t"),
    "hammer": (f"'User: ' || c || {_N} || 'Assistant: '", "t"),
    "function": (f"CASE WHEN k = 'tool_response' THEN '<start_function_response>response:tool{{result:<escape>' || t || '<escape>}}<end_function_response>' || {_N} || '<start_of_turn>model' || {_N} ELSE '<start_of_turn>user' || {_N} || t || '<end_of_turn>' || {_N} || '<start_of_turn>model' || {_N} END", f"t || '<end_of_turn>' || {_N}"),
}


def _rendering(family: str):
    def render(spark, sf_dir):
        p = templates.to_prompt(F.col("text"), F.col("is_user"), F.col("type"), F.col("tool_name"), family)
        return _messages(spark, sf_dir).select("conv_id", "turn", p.alias("prompt"))

    render.__name__ = f"render_{family}"
    user, model = _FORMS[family]
    query(f"WITH {_M} SELECT conv_id, turn, CASE WHEN k = 'system_info' THEN '' WHEN u THEN {user} ELSE {model} END AS prompt FROM c")(render)


for _family in templates.FAMILIES:
    _rendering(_family)


@query(f"WITH {_M} SELECT conv_id, turn, c AS block FROM c")
def tool_response_block(spark, sf_dir):
    return _messages(spark, sf_dir).select("conv_id", "turn", templates.tool_response(F.col("text"), F.col("type"), F.col("tool_name")).alias("block"))


@query(f"WITH {_M} SELECT conv_id, turn, CASE WHEN k = 'system_info' THEN '' ELSE c END AS prompt FROM c")
def render_task_file(spark, sf_dir):
    p = templates.to_prompt(F.col("text"), F.col("is_user"), F.col("type"), F.col("tool_name"), "qwen", "task")
    return _messages(spark, sf_dir).select("conv_id", "turn", p.alias("prompt"))


@query("SELECT conv_id, turn, trim(text) AS stripped FROM conversations")
def strip_thinking(spark, sf_dir):
    t = F.concat(F.lit("<think>a\nb</think>"), F.col("text"), F.lit(" <think></think> "))
    return session.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.trim(templates.remove_thinking(t, "deepseek")).alias("stripped"))


@query("SELECT conv_id, turn, trim(text) || '<end_of_turn>' AS kept, trim(text) AS stripped FROM conversations")
def clean_response(spark, sf_dir):
    t = F.concat(F.lit(" "), F.trim("text"), F.lit("<end_of_turn>\n"))
    return session.table(spark, sf_dir, "conversations").select("conv_id", "turn", templates.clean(t, "instruct").alias("kept"), F.trim(templates.clean(t, "instruct", strip_end_tag=True)).alias("stripped"))


@query("WITH c AS (SELECT conv_id, turn, length(text) AS cost FROM conversations), s AS (SELECT *, sum(cost) OVER (PARTITION BY conv_id) - sum(cost) OVER (PARTITION BY conv_id ORDER BY turn) + cost AS rest FROM c) SELECT conv_id, turn, cost :: INTEGER AS cost FROM s WHERE rest < 600")
def history_evict(spark, sf_dir):
    rows = session.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("cost"))
    return conversation.evict(rows, 600)


@query(f"WITH {_M}, f AS (SELECT conv_id, min(turn) AS f FROM m WHERE u AND k = 'text' GROUP BY conv_id) SELECT m.conv_id, turn, CASE WHEN u AND k = 'text' AND turn = f THEN 'TOOLS' || chr(10) || t ELSE t END AS text FROM m LEFT JOIN f USING (conv_id)")
def tools_injection(spark, sf_dir):
    return conversation.inject_tools(_messages(spark, sf_dir), "TOOLS").select("conv_id", "turn", "text")


@query("SELECT conv_id, count(*) FILTER (WHERE turn % 7 = 3) AS images FROM conversations GROUP BY conv_id")
def image_message_count(spark, sf_dir):
    return conversation.image_messages(_messages(spark, sf_dir))


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS prompt FROM conversations GROUP BY conv_id")
def web_prompt(spark, sf_dir):
    parts = F.array_sort(F.collect_list(F.struct("turn", "text", F.lit(None).cast("string").alias("image"))))  # a conversation
    return session.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(parts.alias("p")).select("conv_id", templates.web_prompt(F.col("p")).alias("prompt"))


@query("SELECT conv_id, turn, 'task: search result | query: ' || text AS prompt FROM conversations")
def embedding_task_prefix(spark, sf_dir):
    return session.table(spark, sf_dir, "conversations").select("conv_id", "turn", templates.task_prefix(F.col("text")).alias("prompt"))


@query("SELECT conv_id, turn, ([2, 7, 8] || list_transform(string_split(text, ' '), lambda w: length(w) :: INTEGER) || [1] || list_resize(CAST([] AS INTEGER[]), 32, 0))[1:32] AS ids FROM conversations")
def prepare_tokens(spark, sf_dir):
    tokens = F.transform(F.split("text", " "), lambda w: F.length(w))
    ids = embed.prepare_tokens(F.array(F.lit(7), F.lit(8)), tokens, 32)
    return session.table(spark, sf_dir, "conversations").select("conv_id", "turn", ids.alias("ids"))


@query()
def embed_texts(spark, sf_dir):
    rows = session.table(spark, sf_dir, "conversations").where("text != ''")
    return rows.select("conv_id", "turn", embed.embedder(embed.hashed_model)("text").alias("embedding"))


def tokens_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations cut into words: every third is followed by a JSON call in four tokens."""
    rows = session.table(spark, sf_dir, "conversations")
    call = F.array(F.lit('{"name": '), F.lit('"show", '), F.lit('"parameters": {"a": '), F.lit('"b"}}'))
    parts = F.concat(F.filter(F.split("text", "(?<= )"), lambda w: w != ""), F.when(F.col("turn") % 3 == 0, call).otherwise(F.array().cast("array<string>")))
    made = rows.select(F.concat_ws("-", "conv_id", "turn").alias("stream_id"), parts.alias("parts")).where("size(parts) > 0")
    return made.select("stream_id", F.posexplode("parts").alias("seq", "token"), F.size("parts").alias("n")).select("stream_id", F.col("seq").cast("long").alias("seq"), "token", (F.col("seq") == F.col("n") - 1).alias("done"))


@query()
def stream_classify_batch(spark, sf_dir):
    return classifier.classify(tokens_of(spark, sf_dir))


#: For texts without braces and fences, which the tables have none of; those of a fixture are compared with brute force.
@query("SELECT conv_id || '-' || turn AS stream_id, text, '' AS thinking, CASE WHEN turn % 3 = 0 THEN 'show' END AS call, CASE WHEN turn % 3 = 0 THEN 'show' WHEN text = '' THEN '...' ELSE text END AS result FROM conversations WHERE text != '' OR turn % 3 = 0")
def stream_fold(spark, sf_dir):
    return conversation.fold_responses(QUERIES["stream_classify_batch"](spark, sf_dir))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) :: INTEGER AS position FROM conversations")
def message_positions(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return session.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.row_number().over(w).alias("position"))
