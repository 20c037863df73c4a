import json

import pytest
from pyspark.sql import functions as F

from lanternfish.functions import embed, quality, sources, templates
from lanternfish.operators import catalog, conversation


def one(spark, *columns):
    r = spark.range(1).select(*columns).first()
    return r[0] if len(columns) == 1 else list(r)


TOOL = {"name": "paint", "description": "Paints", "parameters": json.dumps({"type": "object", "properties": {"color": {"type": "string", "description": "which", "enum": ["red", "blue"]}, "n": {}, "e": {"enum": []}}, "required": ["color"]})}
TOOLS = "array<struct<name:string,description:string,parameters:string>>"


def test_tool_prompts(spark):
    df = spark.createDataFrame([([(TOOL["name"], TOOL["description"], TOOL["parameters"])],)], f"t {TOOLS}")
    text = df.select(templates.function_tools_prompt("t")).first()[0]
    want = "declaration:paint{description:<escape>Paints<escape>,parameters:{properties:{color:{description:<escape>which<escape>,enum:[<escape>red<escape>,<escape>blue<escape>],type:<escape>STRING<escape>},n:{type:<escape>STRING<escape>},e:{type:<escape>STRING<escape>}},required:[<escape>color<escape>],type:<escape>OBJECT<escape>}}<end_function_declaration>\n<end_of_turn>\n"
    assert text.endswith(want) and text.startswith("<start_of_turn>developer\n")
    listed = df.select(templates.json_tools_prompt(F.col("t"))).first()[0]
    assert f"<tool_code>\npaint: Paints Parameters: {TOOL['parameters']}\n</tool_code>\n" in listed
    for bad in ("a<escape>", "<start_x"):
        broken = spark.createDataFrame([([("p", "d", json.dumps({"properties": {"c": {"enum": [bad]}}}))],)], f"t {TOOLS}")
        with pytest.raises(Exception, match="control mark"):
            broken.select(templates.function_tools_prompt("t")).collect()


def test_cleaning(spark):
    t = F.lit(" <think>a\nb</think> x<|im_end|>\n")
    assert one(spark, templates.clean(t, "qwen"), templates.clean(t, "qwen", strip_end_tag=True), templates.clean(t, "deepseek", thinking=True)) == ["<think>a\nb</think> x<|im_end|>", "<think>a\nb</think> x", "x<|im_end|>"]


def test_corruption(spark):
    texts = ["describe.describe.describe.describe.", "₹" * 10, "ph ph ph ph ph", "aaaaaaaaaaaa", "", "The picture displays several mountains behind some beautiful forest.", "x.y.z.", "to be or not", "né n ph"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(quality.is_corrupted(F.col("t"))).collect()] == [True, True, True, True, False, False, True, True, False]
    v = df.select(quality.validate_response(F.col("t")).alias("v")).collect()
    assert (v[5].v.confidence, v[5].v.action) == (0.0, "none") and v[0].v.confidence == pytest.approx(0.9)


def test_images(spark):
    png = bytes.fromhex("89504E470D0A1A0A")
    df = spark.createDataFrame([(png,), (b"\xff\xd8\xff" + b"x" * 9,), (b"RIFF1234WEBP",), (b"RIFF1234",), (b"x",), (bytes(range(256)) * 300,)], "b binary")
    assert [r[0] for r in df.select(quality.detect_format(F.col("b"))).collect()] == ["png", "jpg", "webp", "unknown", "unknown", "unknown"]
    assert [r[0] for r in df.select(quality.trigram_flood("b")).collect()] == [True] * 5 + [False]
    big = spark.createDataFrame([(png + bytes(range(256)) * n, n) for n in (10, 60, 250, 30000)], "b binary, n int")
    assert [r[0] for r in big.select(quality.encoder_check(F.col("b"), "siglip")).collect()] == ["size_small", "dimensions_small", "valid", "size_large"]
    run = "A" * 120
    prompt = F.lit(f"<image>x</image> image_data {run} {'B' * 120}")
    assert one(spark, quality.image_tokens(prompt), quality.longest_base64(prompt), quality.longest_base64(F.lit("no"))) == [4, run, None]


def test_sources(spark):
    names = ["m-2b.task", "model.bin.task", "x", "a/b.json", "n.", "model.litertlm"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(sources.base_name(F.col("n"))).collect()] == ["m-2b", "model", "x", "a/b", "n.", "model"]
    assert [r[0] for r in df.select(sources.extension(F.col("n"))).collect()] == [".task", ".task", "", ".json", "", ".litertlm"]
    assert [r[0] for r in df.select(sources.file_extension(F.col("n"))).collect()] == [".task", ".task", "", ".json", ".", ".litertlm"]
    urls = ["https://h/m.task", "https://h/m.task?x=1", "https://h/m.task/", "https://h/a?b#c"]
    u = spark.createDataFrame([(x,) for x in urls], "u string")
    assert [r[0] for r in u.select(sources.normalize_url(F.col("u"))).collect()] == ["https://h/m.task"] * 3 + ["https://h/a#c"]
    checks = [("network", "https://h", None), ("network", "ftp://h", "not http"), ("asset", "a/../b", "parent reference"), ("asset", "http://x", "is a url"), ("bundled", "a/b", "separator"), ("bundled", "a b", "space"), ("file", "x", "not absolute"), ("file", "", "empty")]
    c = spark.createDataFrame([x[:2] for x in checks], "k string, v string")
    assert [r[0] for r in c.select(sources.source_error(F.col("k"), F.col("v"))).collect()] == [x[2] for x in checks]
    assert one(spark, sources.asset_path(F.lit("/a/b")), sources.asset_path(F.lit("assets/c")), sources.asset_key(F.lit("assets/c"))) == ["assets/a/b", "assets/c", "c"]
    assert one(spark, sources.progress(F.lit(1), F.lit(50), F.lit(2)), sources.progress(F.lit(0), F.lit(0), F.lit(0)), sources.size_in_mb(F.lit("3.1GB")), sources.size_in_mb(F.lit("171MB (Local - No Auth)")), sources.size_in_mb(F.lit("x"))) == [75, 0, pytest.approx(3174.4), 171.0, 0.0]
    assert one(spark, sources.file_valid(F.lit("a.json"), F.lit(1024)), sources.file_valid(F.lit("a"), F.lit(1024)), sources.file_valid(F.lit("a"), F.lit(-1))) == [True, False, None]


def test_eviction(spark):
    rows = spark.createDataFrame([(1, i, c) for i, c in enumerate([5, 7, 3, 9])], "conv_id long, turn int, cost int")
    assert [r.turn for r in conversation.evict(rows, 12).collect()] == [3]


def test_cache_ttl(spark):
    rows = spark.createDataFrame([("a", "u", 0), ("b", "u", -1), ("c", "u", -1), ("c", "v", 5)], "cache_key string, url string, s int").withColumn("timestamp", F.timestamp_seconds("s"))
    left = catalog.cache_survivors(rows, F.timestamp_seconds(F.lit(30 * 86400)))
    assert sorted((r.cache_key, r.url) for r in left.collect()) == [("a", "u"), ("c", "u"), ("c", "v")]


def test_tokens_and_embedding(spark):
    ids = embed.prepare_tokens(F.array(F.lit(9)), F.array(F.lit(5), F.lit(6)), 7)
    cut = embed.prepare_tokens(F.array(F.lit(9)), F.array(F.lit(5), F.lit(6)), 3)
    assert one(spark, ids, cut) == [[2, 9, 5, 6, 1, 0, 0], [2, 9, 5]]
    assert embed.dimension(embed.hashed_model()) == 64
    with pytest.raises(Exception, match="empty"):
        spark.createDataFrame([("",)], "t string").select(embed.embedder(embed.hashed_model)("t")).collect()
