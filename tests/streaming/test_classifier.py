import random

from lanternfish.operators import conversation
from lanternfish.sources import tables
from lanternfish.streaming import classifier


def kinds(tokens, **options):
    m = classifier.Machine(**options)
    rows = [r for t in tokens for r in m.push(t)] + list(m.finish())
    return [(r[1], r[2] if r[1] != "call" else r[3]) for r in rows]


def test_cases():
    assert kinds(["a ", "b"]) == [("text", "a "), ("text", "b")]
    assert kinds(["x", '{"name": "f", ', '"parameters": {}}']) == [("text", "x"), ("call", "f")]
    assert kinds(['{"name": "f", "parameters": {}}']) == [("call", "f")]
    assert kinds(['{"message": ', '"hi"}', "z"]) == [("text", "hi"), ("text", "z")]
    assert kinds(["{a", "b}"]) == [("text", "{ab}")]
    assert kinds(["{" + "x" * 150, "y"]) == [("text", "{" + "x" * 150 + "y")]
    assert kinds(["{", "x"]) == [("text", "{x")]
    assert kinds(["{"], tools=False) == [("text", "{")]
    assert kinds(["a", "b</think>c"], family="deepseek", thinking=True) == [("thinking", "a"), ("thinking", "ab"), ("text", "c")]
    assert kinds(["a</th", "ink>b"], family="deepseek", thinking=True) == [("thinking", "a</th"), ("thinking", "ink>b")]
    parts = ["<start_function_call>", "call:f", "{a:<escape>1<escape>}"]
    assert kinds(parts, family="function") == [("text", parts[0]), ("text", parts[1]), ("call", "f")]
    assert kinds(["words"], family="function") == [("text", "words"), ("reset", None)]


def test_text_without_braces_is_whole():
    rng = random.Random(2)
    for _ in range(50):
        text = "".join(rng.choice("ab c\n") for _ in range(60))
        at = sorted(rng.sample(range(1, 60), 5))
        tokens = [text[i:j] for i, j in zip([0, *at], [*at, 60], strict=True)]
        assert "".join(x for _, x in kinds(tokens)) == text


def test_stream_equals_batch(spark, tmp_path):
    streams = {"a": ["x ", '{"name": "f",', ' "parameters": {"k": 1}}', "end"], "b": ["{", "no"], "c": ['{"message": "m"', "}"], "d": ["only"]}
    rows = [(s, i, t, i == len(ts) - 1) for s, ts in streams.items() for i, t in enumerate(ts)]
    rows += [("a", 1, '{"name": "f",', False), ("d", 1, "after the end", False), ("d", 2, "later", True)]  # repeated, and too late
    tokens = spark.createDataFrame(rows, tables.TOKENS)
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    for i in range(0, len(shuffled), 3):
        spark.createDataFrame(shuffled[i : i + 3], tables.TOKENS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    query = classifier.classify_stream(tables.token_stream(spark, str(tmp_path / "in")), kept_ms=None).writeStream.format("memory").queryName("classified").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(240)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    batch = classifier.classify(tokens)
    assert sorted(map(tuple, spark.table("classified").collect()), key=str) == sorted(map(tuple, batch.collect()), key=str)
    folded = {r.stream_id: r.result for r in conversation.fold_responses(batch).collect()}
    assert folded == {"a": "f", "b": "{no", "c": "m", "d": "only"}
