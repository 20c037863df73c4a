import json

import pytest
from pyspark.sql import functions as F

from lanternfish.functions import embed, quality, sources
from lanternfish.operators import catalog


def one(spark, *columns):
    r = spark.range(1).select(*columns).first()
    return r[0] if len(columns) == 1 else list(r)


def test_registry_rules(spark):
    now = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    new = spark.createDataFrame([("b", 3), ("b", 5), ("c", 4)], "id string, n int")
    assert sorted(map(tuple, catalog.save(now, new).collect())) == [("a", 1), ("b", 5), ("c", 4)]
    for bad in ("", None):
        with pytest.raises(Exception, match="no id"):
            catalog.save(now, spark.createDataFrame([(bad, 1)], "id string, n int")).collect()
    typed = spark.createDataFrame([("a", "inference"), ("b", "embedding")], "id string, type string")
    assert [r.id for r in catalog.of_type(typed, "embedding").collect()] == ["b"]
    assert catalog.exists(typed, F.col("id") == "a") and not catalog.exists(typed, F.col("id") == "x")


def test_storage_and_migration_with_repeated_names(spark):
    files = spark.createDataFrame([("m.task", 10), ("n.bin", 20), ("x.txt", 40)], "filename string, size long")
    orphan = spark.createDataFrame([("m.task",), ("m.task",)], "filename string")
    assert tuple(catalog.storage(files, orphan).first())[:4] == (2, 30, 1, 10)
    lists = {("inference", False): files.select("filename").limit(2), ("inference", True): spark.createDataFrame([("lora.bin",)], "filename string")}
    paths = spark.createDataFrame([("m.task", "/b"), ("m.task", "/a")], "filename string, path string")
    made = catalog.migrate(lists, paths.limit(0), paths)
    assert sorted(tuple(r) for r in made.collect()) == [("lora.bin", "inference", True, "network", "https://unknown/lora.bin"), ("m.task", "inference", False, "file", "/a"), ("n.bin", "inference", False, "network", "https://unknown/n.bin")]
    assert catalog.migrate(lists, paths, paths, done=True).count() == 0
    assert tuple(catalog.migration_counts(made, spark.createDataFrame([("n.bin",)], "id string")).first()) == (2, 1)


def test_cache(spark):
    day = 86400
    entries = spark.createDataFrame([("https://a/x", "https://a/x", 0, 50), ("https://a/y", "https://a/y", 40 * day, 30)], "cache_key string, url string, timestamp long, size long")
    asked = spark.createDataFrame([("https://a/x?t=1",), ("https://a/z/",), ("https://a/z",)], "url string")
    assert sorted((r.cache_key, r.hit, r.percent) for r in catalog.cache_requests(asked, entries).collect()) == [("https://a/x", True, 100), ("https://a/z", False, 0), ("https://a/z", False, 0)]
    calls = []

    def load(misses):
        calls.append([r.cache_key for r in misses.collect()])
        return misses.withColumn("size", F.lit(40).cast("long"))

    now = F.lit(41 * day).cast("long")
    everything = catalog.get_or_load(asked, entries, load, now, quota=200)
    assert sorted(r.cache_key for r in everything.collect()) == ["https://a/x", "https://a/y", "https://a/z"]
    assert calls == [["https://a/z"]]
    tight = catalog.get_or_load(asked, entries, load, now, quota=100)
    assert sorted(r.cache_key for r in tight.collect()) == ["https://a/y", "https://a/z"]
    with pytest.raises(catalog.CacheQuotaError):
        catalog.get_or_load(asked, entries, load, now, quota=60)
    assert [r.cache_key for r in catalog.oldest_first(entries).collect()] == ["https://a/x", "https://a/y"]


def test_folders(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(bytes.fromhex("89504E470D0A1A0A"))
    (tmp_path / "b.bin").write_bytes(b"xyz")
    listed = catalog.directory(spark, str(tmp_path))
    assert sorted((r.filename, r.size) for r in listed.collect()) == [("a.png", 8), ("b.bin", 3)]
    found = {r.path.split("/")[-1]: r.mime for r in catalog.images(spark, str(tmp_path)).select("path", quality.mime_type(F.col("image_bytes")).alias("mime")).collect()}
    assert found == {"a.png": "image/png", "b.bin": "image/png"}


def test_validation_and_suggestions(spark):
    rows = spark.createDataFrame([(None,), ("describe.describe.describe.",), ("The picture displays several mountains behind some beautiful forest.",)], "t string")
    got = [tuple(r.v) for r in rows.select(quality.validate_response(F.col("t")).alias("v")).collect()]
    assert got[0] == (True, 0.8, "reprocess_image") and got[2] == (False, 0.0, "none")
    assert got[1][0] and got[1][1] == pytest.approx(0.9) and got[1][2] == "reprocess_image"
    keys = one(spark, quality.suggestions(F.lit("image_format")), quality.suggestions(F.lit("?")))
    assert keys == [list(quality.SUGGESTIONS["image_format"]), list(quality.OTHER_SUGGESTIONS)]


def test_encoders_and_messages(spark):
    webp = bytes.fromhex("524946460000000057454250")
    sizes = spark.createDataFrame([(webp + bytes(range(256)) * n,) for n in (1, 20, 400)], "b binary")
    assert [r[0] for r in sizes.select(quality.encoder_check(F.col("b"), "general")).collect()] == ["size_small", "compatibility", "valid"]
    assert one(spark, quality.has_image_tokens(F.lit("image_data"), 1), quality.has_image_tokens(F.lit("none"), 1)) == [True, False]
    message = json.loads(one(spark, quality.image_message(F.lit("look"), F.lit("QUJD"), F.lit("png"))))
    assert message == {"role": "user", "content": [{"type": "text", "text": "look"}, {"type": "image", "image_data": {"data": "QUJD", "format": "png"}}]}


def test_tokens_and_splits(spark):
    df = spark.createDataFrame([("a b c",), (None,)], "t string")
    assert [r[0] for r in df.select(embed.token_counter(lambda t: len(t.split()))("t")).collect()] == [3, 0]
    assert embed.dimension(embed.hashed_model()) == 64
    parts = [r[0] for r in spark.range(2000).select(embed.split(F.col("id").cast("string"))).collect()]
    assert 150 < parts.count("test") < 250 and set(parts) == {"train", "test"}


def test_source_urls(spark):
    for text in ("https://a.b/c", "file:///data/m", "native://res"):
        s = sources.parse_source(F.lit(text))
        assert one(spark, sources.source_url(s["type"], s["value"])) == text
