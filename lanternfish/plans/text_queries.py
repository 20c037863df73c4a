"""Queries of call parsing, response quality, sources and file names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish import session
from lanternfish.functions import parsing, quality, sources, templates
from lanternfish.operators import tools
from lanternfish.plans.registry import query

#: Calls in five syntaxes, made of conversations: conv_id and turn are the arguments.
_NAME, _JSON = "'fn_' || role", "'{\"name\": \"fn_' || role || '\", \"parameters\": {\"conv\": \"' || conv_id || '\", \"turn\": \"' || turn || '\"}}'"
_CALLS = f"""c AS (SELECT conv_id, turn, role, conv_id % 5 AS kind, CASE conv_id % 5
 WHEN 0 THEN '<tool_code>' || chr(10) || {_JSON} || chr(10) || '</tool_code>'
 WHEN 1 THEN 'Sure:' || chr(10) || '```json' || chr(10) || {_JSON} || chr(10) || '```'
 WHEN 2 THEN {_JSON}
 WHEN 3 THEN '<start_function_call>call:fn_' || role || '{{conv:<escape>' || conv_id || '<escape>,turn:<escape>' || turn || '<escape>}}<end_function_call>'
 ELSE 'plain words only ' || turn END AS raw FROM conversations)"""


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    session.table(spark, sf_dir, "conversations").createOrReplaceTempView("conversations_view")
    made = spark.sql("WITH " + _CALLS.replace("FROM conversations", "FROM conversations_view") + " SELECT * FROM c")
    return made.withColumn("family", F.when(F.col("kind") == 3, "function").otherwise("instruct"))


def _parsed(spark, sf_dir, kind: int) -> DataFrame:
    rows = _calls(spark, sf_dir).where(F.col("kind") == kind)
    call = rows.withColumn("c", parsing.parse_call(F.col("raw"), F.col("family")))
    args = F.from_json("c.args", "map<string,string>")
    return call.select("conv_id", "turn", F.col("c.name").alias("name"), args["conv"].alias("conv"), args["turn"].alias("turn_arg"))


_PARSED = f"WITH {_CALLS} SELECT conv_id, turn, 'fn_' || role AS name, CAST(conv_id AS VARCHAR) AS conv, CAST(turn AS VARCHAR) AS turn_arg FROM c WHERE kind = "


@query(_PARSED + "0")
def parse_tool_code(spark, sf_dir):
    return _parsed(spark, sf_dir, 0)


@query(_PARSED + "1")
def parse_markdown(spark, sf_dir):
    return _parsed(spark, sf_dir, 1)


@query(_PARSED + "2")
def parse_direct_json(spark, sf_dir):
    return _parsed(spark, sf_dir, 2)


@query(_PARSED + "3")
def parse_function_call(spark, sf_dir):
    return _parsed(spark, sf_dir, 3)


@query(f"WITH {_CALLS} SELECT conv_id, turn, regexp_extract(raw, 'call:(\\w+)', 1) AS name, regexp_extract(raw, 'conv:<escape>(.*?)<escape>', 1) AS conv, regexp_extract(raw, 'turn:<escape>(.*?)<escape>', 1) AS turn_arg FROM c WHERE kind = 3")
def parse_function_params(spark, sf_dir):
    rows = _calls(spark, sf_dir).where("kind = 3")
    p = parsing.function_params(F.col("raw"))
    return rows.select("conv_id", "turn", parsing.function_name(F.col("raw")).alias("name"), p["conv"].alias("conv"), p["turn"].alias("turn_arg"))


@query(f"WITH {_CALLS} SELECT conv_id, turn, kind IN (0, 2, 3) AS started FROM c")
def call_start(spark, sf_dir):
    return _calls(spark, sf_dir).select("conv_id", "turn", parsing.is_call_start(F.col("raw"), F.col("family")).alias("started"))


@query(f"WITH {_CALLS} SELECT conv_id, turn, kind < 4 AS complete FROM c")
def call_complete(spark, sf_dir):
    return _calls(spark, sf_dir).select("conv_id", "turn", parsing.is_call_complete(F.col("raw"), F.col("family")).alias("complete"))


@query(f"WITH {_CALLS} SELECT conv_id, turn, kind IN (3, 4) AS text FROM c")
def definitely_text(spark, sf_dir):
    """Calls of the function family begin like text to a reader of the other syntaxes."""
    return _calls(spark, sf_dir).select("conv_id", "turn", parsing.is_definitely_text(F.col("raw")).alias("text"))


@query(f"WITH {_CALLS}, t AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN raw ELSE raw || '}}' END AS raw FROM c) SELECT conv_id, turn, contains(raw, '{{') AND len(raw) - len(replace(raw, '{{', '')) = len(raw) - len(replace(raw, '}}', '')) AS balanced FROM t")
def balanced_json(spark, sf_dir):
    raw = F.when(F.col("turn") % 2 == 0, F.col("raw")).otherwise(F.concat("raw", F.lit("}")))
    return _calls(spark, sf_dir).select("conv_id", "turn", parsing.is_balanced(raw).alias("balanced"))


@query("SELECT conv_id, turn, trim(text) AS cleaned FROM conversations")
def clean_wrapped_response(spark, sf_dir):
    wrapped = F.concat(F.lit("<start_of_turn>model\n"), F.col("text"), F.lit("<end_of_turn>\n"))
    return session.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.trim(parsing.clean_response(wrapped)).alias("cleaned"))


@query("SELECT conv_id, turn, text AS message FROM conversations")
def json_message(spark, sf_dir):
    rows = session.table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", parsing.json_message(F.to_json(F.struct(F.col("text").alias("message")))).alias("message"))


@query("SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN '{\"status\":\"success\",\"message\":\"Background color changed to red\"}' WHEN 1 THEN '{\"error\":\"Title cannot be empty\"}' WHEN 2 THEN '{\"status\":\"success\",\"message\":\"Alert dialog shown with title \\\"Alert\\\"\"}' ELSE '{\"error\":\"Tool not found\"}' END AS result FROM conversations".replace('\\\\"', '\\"'))
def tool_dispatch(spark, sf_dir):
    k = F.col("conv_id") % 4
    name = F.when(k == 0, "change_background_color").when(k == 1, "change_app_title").when(k == 2, "show_alert").otherwise("other")
    args = F.when(k == 0, F.create_map(F.lit("color"), F.lit("RED"))).otherwise(F.create_map(F.lit("x"), F.lit("y")))
    return session.table(spark, sf_dir, "conversations").select("conv_id", "turn", tools.dispatch(name, args).alias("result"))


# --- quality of responses -----------------------------------------------------------------------------------

_WORDS = "string_split_regex(text, '\\s+')"


@query(f"SELECT doc_id, len({_WORDS}) :: INTEGER AS word_count, round(len(list_distinct({_WORDS})) / len({_WORDS}), 6) AS unique_ratio, len(list_distinct({_WORDS})) / len({_WORDS}) < 0.3 AS high_repetition FROM documents")
def word_statistics(spark, sf_dir):
    s = quality.word_stats(F.col("text"))
    return session.table(spark, sf_dir, "documents").select("doc_id", s["word_count"].alias("word_count"), F.round(s["unique_ratio"], 6).alias("unique_ratio"), s["high_repetition"].alias("high_repetition"))


@query(f"WITH w AS (SELECT doc_id, len({_WORDS}) AS n, unnest({_WORDS}) AS w FROM documents), c AS (SELECT doc_id, n, w, count(*) AS k FROM w WHERE length(w) <= 3 GROUP BY ALL), f AS (SELECT DISTINCT doc_id FROM c WHERE n > 10 AND k > n * 0.3) SELECT doc_id, doc_id IN (SELECT doc_id FROM f) AS flood FROM documents")
def short_word_flood(spark, sf_dir):
    return session.table(spark, sf_dir, "documents").select("doc_id", quality.short_word_flood(F.col("text")).alias("flood"))


_FLOOD = f"w AS (SELECT doc_id, len({_WORDS}) AS n, unnest({_WORDS}) AS w FROM documents), k AS (SELECT doc_id, n, w, count(*) AS k FROM w WHERE length(w) <= 3 GROUP BY ALL), f AS (SELECT DISTINCT doc_id FROM k WHERE n > 10 AND k > n * 0.3)"
#: The fixed patterns in the dialect of DuckDB; the one with a reference back is spelled out.
_CORRUPT = r"""text <> '' AND (doc_id IN (SELECT doc_id FROM f) OR regexp_matches(text, 'describe\.describe\.describe\.+') OR regexp_matches(text, '^[₹]{10,}')
 OR regexp_matches(text, '\bph\b.*\bph\b.*\bph\b') OR (left(text, 1) <> chr(10) AND length(text) > 10 AND left(text, 11) = repeat(left(text, 1), 11))
 OR regexp_matches(text, '\b\w+\.\w+\.\w+\.+') OR regexp_matches(text, '\b[a-zA-Z]{1,2}\s+[a-zA-Z]{1,2}\s+[a-zA-Z]{1,2}\b'))"""


@query(f"WITH {_FLOOD} SELECT doc_id, {_CORRUPT} AS corrupted FROM documents")
def corruption_flags(spark, sf_dir):
    return session.table(spark, sf_dir, "documents").select("doc_id", quality.is_corrupted(F.col("text")).alias("corrupted"))


@query("SELECT doc_id, length(text) :: INTEGER AS length, length(text) < 10 AS very_short, length(text) > 10000 AS very_long, regexp_matches(text, '\\.{3,}') AS repeating_dots, regexp_matches(text, '^[^a-zA-Z0-9\\s]{10,}') AS mostly_symbols, contains(text, 'describe.describe.describe') AS describe_loop FROM documents")
def response_analysis(spark, sf_dir):
    a = quality.analysis(F.col("text"))
    return session.table(spark, sf_dir, "documents").select("doc_id", *[a[n].alias(n) for n in ("length", "very_short", "very_long", "repeating_dots", "mostly_symbols", "describe_loop")])


_SCORE = "CASE WHEN doc_id % 2 = 0 THEN 0.5 ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN 0.3 ELSE 0 END + CASE WHEN doc_id % 5 = 0 THEN 0.2 ELSE 0 END + CASE WHEN doc_id % 7 = 0 THEN 0.4 ELSE 0 END + CASE WHEN doc_id % 11 = 0 THEN 0.1 ELSE 0 END"


def _confidence():
    m = lambda k: F.col("doc_id") % k == 0
    a = F.struct(m(3).alias("high_repetition"), m(5).alias("mostly_symbols"), m(7).alias("describe_loop"), m(11).alias("very_short"))
    return quality.confidence(m(2), a)


@query(f"SELECT doc_id, CAST(round(least(1.0, {_SCORE}), 6) AS DOUBLE) AS confidence FROM documents")
def corruption_confidence(spark, sf_dir):
    return session.table(spark, sf_dir, "documents").select("doc_id", F.round(_confidence(), 6).alias("confidence"))


@query(f"WITH s AS (SELECT doc_id, least(1.0, {_SCORE}) AS s FROM documents) SELECT doc_id, CASE WHEN s > 0.8 THEN 'reprocess_image' WHEN s > 0.5 THEN 'validate_image' WHEN s > 0.2 THEN 'monitor_response' ELSE 'none' END AS action FROM s")
def corruption_action(spark, sf_dir):
    return session.table(spark, sf_dir, "documents").select("doc_id", quality.action(_confidence()).alias("action"))


@query(
    f"WITH {_FLOOD}, j AS (SELECT doc_id, {_CORRUPT} AS corrupted, text, {_WORDS} AS words FROM documents), "
    "s AS (SELECT doc_id, corrupted, CASE WHEN corrupted THEN least(1.0 :: DOUBLE, 0.5 :: DOUBLE + CASE WHEN len(list_distinct(words)) / len(words) < 0.3 THEN 0.3 ELSE 0 END :: DOUBLE"
    " + CASE WHEN regexp_matches(text, '^[^a-zA-Z0-9\\s]{10,}') THEN 0.2 ELSE 0 END :: DOUBLE + CASE WHEN contains(text, 'describe.describe.describe') THEN 0.4 ELSE 0 END :: DOUBLE + CASE WHEN length(text) < 10 THEN 0.1 ELSE 0 END :: DOUBLE) ELSE 0 END AS c FROM j) "
    "SELECT doc_id, corrupted, round(c, 6) AS confidence, CASE WHEN c > 0.8 THEN 'reprocess_image' WHEN c > 0.5 THEN 'validate_image' WHEN c > 0.2 THEN 'monitor_response' ELSE 'none' END AS action FROM s"
)
def response_validation(spark, sf_dir):
    v = quality.validate_response(F.col("text"))
    return session.table(spark, sf_dir, "documents").select("doc_id", v["corrupted"].alias("corrupted"), F.round(v["confidence"], 6).alias("confidence"), v["action"].alias("action"))


@query("SELECT event_type, CASE WHEN contains(m, 'base64') THEN 'base64_encoding' WHEN contains(m, 'format') OR contains(m, 'decode') THEN 'image_format' WHEN contains(m, 'size') THEN 'image_dimensions' WHEN contains(m, 'memory') THEN 'memory_limit' ELSE 'unknown' END AS kind, count(*) AS n FROM (SELECT event_type, CASE event_id % 5 WHEN 0 THEN 'bad base64 format' WHEN 1 THEN 'cannot decode' WHEN 2 THEN 'size' WHEN 3 THEN 'out of memory' ELSE 'x' END AS m FROM events) GROUP BY ALL")
def error_categories(spark, sf_dir):
    k = F.col("event_id") % 5
    m = F.when(k == 0, "Bad BASE64 format").when(k == 1, "cannot decode").when(k == 2, "size").when(k == 3, "out of memory").otherwise("x")
    return session.table(spark, sf_dir, "events").select("event_type", quality.error_kind(m).alias("kind")).groupBy("event_type", "kind").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' WHEN 2 THEN 'webp' ELSE 'unknown' END AS format, CASE WHEN 12 + octet_length(encode(text)) < 1024 THEN 'warn_small' ELSE 'ok' END AS size FROM documents")
def image_formats(spark, sf_dir):
    k = F.col("doc_id") % 4
    head = F.unhex(F.when(k == 0, "89504E470D0A1A0A00000000").when(k == 1, "FFD8FFE00000000000000000").when(k == 2, "524946460000000057454250").otherwise("000000000000000000000000"))
    data = F.concat(head, F.col("text").cast("binary"))
    return session.table(spark, sf_dir, "documents").select("doc_id", quality.detect_format(data).alias("format"), quality.input_size(data).alias("size"))


@query("SELECT doc_id, base64(encode(text)) AS encoded, true AS valid, true AS same FROM documents")
def base64_round_trip(spark, sf_dir):
    data = F.col("text").cast("binary")
    return session.table(spark, sf_dir, "documents").select("doc_id", quality.to_base64(data).alias("encoded"), quality.base64_valid(quality.to_base64(data)).alias("valid"), quality.base64_round_trip(data).alias("same"))


@query("WITH p AS (SELECT doc_id, base64(encode(text)) AS p FROM documents), r AS (SELECT *, length(rtrim(p, '=')) >= 100 AS run FROM p) SELECT doc_id, CASE WHEN run THEN p END AS longest, CASE WHEN length(p) > 2000 THEN left(p, 2000) || '...[truncated]' WHEN run THEN '[IMAGE_DATA]' ELSE p END AS sanitized FROM r")
def base64_runs(spark, sf_dir):
    p = quality.to_base64(F.col("text").cast("binary"))
    return session.table(spark, sf_dir, "documents").select("doc_id", quality.longest_base64(p).alias("longest"), quality.sanitized(p, 2000).alias("sanitized"))


@query("SELECT doc_id, CASE WHEN n < 51200 THEN 200 WHEN n < 204800 THEN 400 WHEN n < 512000 THEN 600 ELSE 800 END :: INTEGER AS side, round(896.0 :: DOUBLE * (doc_id % 50 + 60) / 60, 6) AS width FROM (SELECT doc_id, octet_length(encode(text)) AS n FROM documents)")
def image_geometry(spark, sf_dir):
    width = quality.cover(F.col("doc_id") % 50 + 60, F.lit(60))["width"]
    return session.table(spark, sf_dir, "documents").select("doc_id", quality.estimated_side(F.octet_length("text")).alias("side"), F.round(width, 6).alias("width"))


@query("WITH b AS (SELECT doc_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents), t AS (SELECT doc_id, h, unnest(range(1, n - 1)) AS i FROM b WHERE n >= 100), g AS (SELECT doc_id, count(*) AS c FROM t GROUP BY doc_id, substr(h, 2 * i - 1, 6)), m AS (SELECT doc_id, max(c) AS c FROM g GROUP BY doc_id) SELECT b.doc_id, CASE WHEN n < 100 THEN true ELSE c > 0.01 * n END AS flood FROM b LEFT JOIN m USING (doc_id)")
def byte_trigrams(spark, sf_dir):
    return session.table(spark, sf_dir, "documents").select("doc_id", quality.trigram_flood(F.col("text").cast("binary")).alias("flood"))


# --- sources and file names ---------------------------------------------------------------------------------


@query("SELECT page_id, regexp_replace(regexp_replace(url, '\\?[^#]*', ''), '/$', '') AS normalized FROM pages")
def url_normalize(spark, sf_dir):
    return session.table(spark, sf_dir, "pages").select("page_id", sources.normalize_url(F.col("url")).alias("normalized"))


_FILE = "CASE page_id % 7 WHEN 0 THEN 'm' || page_id || '.task' WHEN 1 THEN 'm.bin.task' WHEN 2 THEN 'e' || page_id || '.tflite' WHEN 3 THEN 'tok.json' WHEN 4 THEN 'tok.model' WHEN 5 THEN 'plain' ELSE 'x.litertlm' END"


def _files(spark, sf_dir) -> DataFrame:
    return session.table(spark, sf_dir, "pages").selectExpr("page_id", f"{_FILE} AS name", "length(html) * 500L AS size")


@query(f"WITH f AS (SELECT page_id, {_FILE} AS n FROM pages) SELECT page_id, replace(replace(replace(replace(replace(replace(n, '.task', ''), '.bin', ''), '.tflite', ''), '.json', ''), '.model', ''), '.litertlm', '') AS base FROM f")
def filename_base(spark, sf_dir):
    return _files(spark, sf_dir).select("page_id", sources.base_name(F.col("name")).alias("base"))


@query(f"WITH f AS (SELECT page_id, {_FILE} AS n FROM pages) SELECT page_id, regexp_extract(n, '(\\.[^.]+)$', 1) AS ext, n != 'plain' AS supported, CASE WHEN contains(n, '.tflite') OR contains(n, '.json') THEN 'embedding' ELSE 'inference' END AS model_type FROM f")
def filename_ext(spark, sf_dir):
    n = F.col("name")
    return _files(spark, sf_dir).select("page_id", sources.extension(n).alias("ext"), sources.supported(n).alias("supported"), sources.model_type(n).alias("model_type"))


@query(f"WITH f AS (SELECT page_id, {_FILE} AS n, length(html) * 500 AS size FROM pages) SELECT page_id, size >= CASE WHEN n LIKE '%.json' OR n LIKE '%.model' THEN 1024 ELSE 1048576 END AS valid FROM f")
def min_size_check(spark, sf_dir):
    return _files(spark, sf_dir).select("page_id", sources.file_valid(F.col("name"), F.col("size")).alias("valid"))


_URL = "CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN 'asset://models/' || page_id WHEN 2 THEN 'native://res' || page_id WHEN 3 THEN 'file:///data/' || page_id ELSE 'a/../b' END"


@query("SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'network' WHEN 2 THEN 'bundled' WHEN 3 THEN 'file' ELSE 'asset' END AS type, CASE page_id % 5 WHEN 4 THEN 'parent reference' END AS error, page_id % 5 = 0 AS downloads FROM pages")
def source_classify(spark, sf_dir):
    rows = session.table(spark, sf_dir, "pages").selectExpr("page_id", f"{_URL} AS u").withColumn("s", sources.parse_source(F.col("u")))
    return rows.select("page_id", F.col("s.type").alias("type"), sources.source_error(F.col("s.type"), F.col("s.value")).alias("error"), sources.capabilities(F.col("s.type"))["requires_download"].alias("downloads"))


@query("SELECT page_id, regexp_extract(url, '([^/?#]*)(\\?[^#]*)?(#.*)?$', 1) AS name, 'assets/p' || page_id AS asset FROM pages")
def source_filenames(spark, sf_dir):
    asset = sources.asset_path(F.concat(F.lit("/p"), F.col("page_id")))
    return session.table(spark, sf_dir, "pages").select("page_id", sources.source_filename(F.lit("network"), F.col("url")).alias("name"), asset.alias("asset"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'fail' WHEN 1 THEN 'resume' ELSE CASE WHEN event_id % 12 < 10 THEN 'retry' ELSE 'give_up' END END AS decision, CASE WHEN event_id % 4 > 1 AND event_id % 12 < 10 THEN event_id % 12 * 2 END AS delay FROM events")
def retry_schedule(spark, sf_dir):
    k = F.col("event_id") % 4
    d = sources.retry_decision(F.when(k == 0, 403).otherwise(500), k == 1, F.col("event_id") % 12)
    return session.table(spark, sf_dir, "events").select("event_id", d["decision"].alias("decision"), d["delay"].alias("delay"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'unauthorized' WHEN 1 THEN 'not_found' WHEN 2 THEN 'rate_limited' WHEN 3 THEN 'server' ELSE 'network' END AS kind, event_id % 5 >= 2 AS retryable, event_id % 5 < 2 AS user_action FROM events")
def error_taxonomy(spark, sf_dir):
    k = F.col("event_id") % 5
    e = sources.error_of_status(F.when(k == 0, 401).when(k == 1, 404).when(k == 2, 429).when(k == 3, 503))
    return session.table(spark, sf_dir, "events").select("event_id", *[e[n].alias(n) for n in ("kind", "retryable", "user_action")])


@query("SELECT conv_id, turn, '<start_of_turn>user' || chr(10) || text || chr(10) || '<end_of_turn>' || chr(10) || '<start_of_turn>model' || chr(10) || '<start_function_call>call:show{role:<escape>' || role || '<escape>,n:<escape>' || turn || '<escape>}<end_function_call>' AS text FROM conversations")
def sft_render(spark, sf_dir):
    args = F.to_json(F.struct(F.col("role"), F.col("turn").cast("string").alias("n")))
    return session.table(spark, sf_dir, "conversations").select("conv_id", "turn", templates.sft_text("", F.col("text"), F.lit("show"), args).alias("text"))


@query("SELECT conv_id, turn, CASE WHEN ('0x' || left(md5(conv_id || '-' || turn), 8)) :: BIGINT % 10 = 0 THEN 'test' ELSE 'train' END AS part FROM conversations")
def sft_split(spark, sf_dir):
    from lanternfish.functions import embed

    return session.table(spark, sf_dir, "conversations").select("conv_id", "turn", embed.split(F.concat_ws("-", "conv_id", "turn")).alias("part"))


@query("SELECT doc_id, contains(text, '<start_function_call>') AND NOT contains(substr(text, 1, 50), '<pad>') AS valid FROM documents")
def sft_output_valid(spark, sf_dir):
    return session.table(spark, sf_dir, "documents").select("doc_id", templates.sft_output_valid(F.col("text")).alias("valid"))


@query("SELECT page_id, '/x/data/data/p/' || page_id AS path, contains(split_part(split_part(url, '/', 3), '?', 1), 'huggingface.co') AS hub FROM pages")
def download_paths(spark, sf_dir):
    p = session.table(spark, sf_dir, "pages")
    return p.select("page_id", sources.android_path(F.lit("/x/data/user/0/p"), F.col("page_id").cast("string")).alias("path"), sources.is_hub_url(F.col("url")).alias("hub"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'image_token_mismatch' WHEN 1 THEN 'missing_image_tokens' ELSE 'tokenization' END AS kind, event_id % 3 = 0 AS recoverable FROM events")
def token_errors(spark, sf_dir):
    k = F.col("event_id") % 3
    m = F.when(k == 0, "0 image tokens").when(k == 1, "prompt bad").otherwise("x")
    kind = quality.token_error_kind(m, F.lit("plain"))
    return session.table(spark, sf_dir, "events").select("event_id", kind.alias("kind"), quality.recoverable(kind).alias("recoverable"))


@query("SELECT doc_id, 'User provided an image but it could not be processed properly. ' || CASE WHEN doc_id % 2 = 0 THEN 'Error: e. ' ELSE '' END || 'Please respond to the following text only: ' || text AS prompt, 2 :: INTEGER AS tokens FROM documents")
def image_prompts(spark, sf_dir):
    error = F.when(F.col("doc_id") % 2 == 0, "e")
    marked = quality.image_prompt(F.lit("see image_data"), F.lit("abc"), "instruct")
    return session.table(spark, sf_dir, "documents").select("doc_id", quality.fallback_prompt(F.col("text"), error).alias("prompt"), quality.image_tokens(marked).alias("tokens"))


@query("SELECT conv_id, turn, role = 'user' AS same FROM conversations")
def message_equality(spark, sf_dir):
    rows = session.table(spark, sf_dir, "conversations")
    user = F.col("role") == "user"
    a = templates.message_of(F.col("text"), user, "text")
    b = templates.message_of(F.col("text"), F.lit(True), "text")
    return rows.select("conv_id", "turn", templates.same_message(a, b).alias("same"))


def _tools_sql() -> str:
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    lines = quoted("\n".join(templates.JSON_PROMPT) + "\n<tool_code>\n")
    schema = '{"properties": {"a": {"type": "string"}}, "required": ["a"]}'
    listed = f"{lines} || 'fn_' || role || ': does it Parameters: {schema}' || chr(10) || '</tool_code>' || chr(10)"
    turn = quoted(f"<start_of_turn>developer\n{templates.FUNCTION_PROMPT}\n<start_function_declaration>declaration:fn_")
    fields = "{description:<escape>does it<escape>,parameters:{properties:{a:{type:<escape>STRING<escape>}},required:[<escape>a<escape>],type:<escape>OBJECT<escape>}}"
    declared = f"{turn} || role || '{fields}<end_function_declaration>' || chr(10) || '<end_of_turn>' || chr(10)"
    return f"SELECT DISTINCT role, {listed} AS json, {declared} AS declarations FROM conversations"


@query(_tools_sql())
def tools_prompts(spark, sf_dir):
    tool = F.array(F.struct(F.concat(F.lit("fn_"), "role").alias("name"), F.lit("does it").alias("description"), F.lit('{"properties": {"a": {"type": "string"}}, "required": ["a"]}').alias("parameters")))
    rows = session.table(spark, sf_dir, "conversations").select("role").distinct()
    return rows.select("role", templates.json_tools_prompt(tool).alias("json"), templates.function_tools_prompt(tool).alias("declarations"))
