import math

import pytest
from pyspark.sql import functions as F

from lanternfish import session
from lanternfish.functions import codec, vector
from lanternfish.operators import store


@pytest.fixture()
def opened(spark):
    return store.VectorStore(spark, session.shared_dir(spark)).initialize()


def values(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def arr(*x):
    return F.array(*[F.lit(float(v)) for v in x]).cast("array<double>")


def test_cosine_and_distances(spark):
    got = values(spark, vector.cosine(arr(1, 0), arr(1, 0)), vector.cosine(arr(1, 0), arr(0, 1)), vector.cosine(arr(1, 0), arr(-1, 0)), vector.cosine(arr(1, 0, 0), arr(0.7, 0.7, 0)), vector.cosine(arr(1, 2), arr(1, 2, 3)), vector.cosine(arr(0, 0), arr(1, 1)), vector.euclidean(arr(0, 3), arr(4, 0)), vector.manhattan(arr(0, 3), arr(4, 0)), vector.euclidean(arr(1), arr(1, 2)), vector.percentage(F.lit(0.0)))
    assert got == pytest.approx([1, 0, -1, 0.70710678, 0, 0, 5, 7, math.inf, 50])


def test_validity_stats_and_normal_form(spark):
    empty = F.array().cast("array<double>")
    s = values(spark, vector.stats(empty), vector.stats(arr(3, 4)))
    assert s[0].dimensions == 0 and s[0].min == s[0].max == 0 and math.isnan(s[0].mean)
    assert (s[1].magnitude, s[1].min, s[1].max, s[1].mean, s[1].head) == (5, 3, 4, 3.5, [3, 4])
    assert values(spark, vector.valid(empty), vector.valid(arr(math.nan)), vector.valid(arr(math.inf)), vector.valid(arr(1))) == [False, False, False, True]
    assert values(spark, vector.normalize(arr(0, 0)), vector.normalize(arr(0, 5))) == [[0, 0], [0, 1]]
    assert values(spark, vector.safe_similarity(arr(1), arr(1, 2))) == [None]
    with pytest.raises(Exception, match="differ"):
        values(spark, vector.strict_cosine(arr(1), arr(1, 2)))


def test_blobs(spark):
    df = spark.createDataFrame([([1.0, 0.5, -0.25, 0.0],), ([],), (None,)], "v array<float>").select(codec.to_blob("v").alias("b"))
    assert [None if r.b is None else bytes(r.b).hex().upper() for r in df.collect()] == ["0000803F0000003F000080BE00000000", "", None]
    assert [r.v for r in df.select(codec.from_blob("b").alias("v")).collect()] == [[1.0, 0.5, -0.25, 0.0], [], None]


def test_store(opened):
    assert tuple(opened.stats().first()) == (0, 0)
    assert opened.search([1.0], 5).collect() == []
    for i, v in (("doc1", [1, 0, 0]), ("doc2", [0.7, 0.7, 0]), ("doc3", [0, 1, 0])):
        opened.add_document(i, f"text {i}", v, '{"by": "Alice"}' if i == "doc1" else None)
    assert tuple(opened.stats().first()) == (3, 3)
    assert [r.id for r in opened.search([1.0, 0, 0], 10, 0.8).collect()] == ["doc1"]
    assert [r.id for r in opened.search([1.0, 0, 0], 10, 0.0).collect()] == ["doc1", "doc2", "doc3"]
    assert opened.search([1.0, 0, 0], 0).collect() == []
    assert opened.search([1.0, 0, 0], 1).first().metadata == '{"by": "Alice"}'
    with pytest.raises(store.DimensionMismatchError):
        opened.add_document("doc4", "x", [1, 0, 0, 0])
    with pytest.raises(store.DimensionMismatchError):
        opened.search([1.0, 0])
    opened.add_document("doc1", "new", [0, 1, 0], "2")
    assert opened.stats().first().document_count == 3
    assert [(r.id, r.content, r.metadata) for r in opened.search([0, 1.0, 0], 1).collect()] == [("doc1", "new", "2")]
    opened.delete(["doc3"])
    opened.compact()
    assert sorted(r.id for r in opened.all().collect()) == ["doc1", "doc2"]
    again = store.VectorStore(opened.spark, opened.path).initialize()
    assert again.get("doc1").first().content == "new"
    again.clear()
    assert tuple(again.stats().first()) == (0, 0)
    again.close()
    again.close()
    with pytest.raises(store.VectorStoreError):
        again.rows()


def test_nan_ties_and_batch(spark):
    rows = spark.createDataFrame([("b", "x", [1.0, 0.0], None), ("a", "x", [2.0, 0.0], None), ("n", "x", [math.nan, 1.0], None), ("z", "x", [0.0, 0.0], None)], "id string, content string, embedding array<float>, metadata string")
    assert [r.id for r in store.search(rows, [1.0, 0.0], 10, -1.0).collect()] == ["a", "b", "z"]
    asked = spark.createDataFrame([("q", [3.0, 0.0])], "query_id string, embedding array<double>")
    assert [(r.id, r["rank"]) for r in store.search_batch(rows, asked, 2).orderBy("rank").collect()] == [("a", 1), ("b", 2)]
    long = [0.5] * 100
    wide = spark.createDataFrame([("a", "x", long, None)], rows.schema)
    assert store.search(wide, long, 1).first().similarity == pytest.approx(1)


def test_an_append_during_compaction_stays(opened, monkeypatch):
    opened.add_document("a", "one", [1, 0])
    opened.add_document("b", "one", [0, 1])
    live = opened._live

    def meanwhile(manifest):
        found = live(manifest)
        monkeypatch.undo()
        other = store.VectorStore(opened.spark, opened.path).initialize()
        other.add_document("c", "new", [1, 1])
        other.delete(["a"])
        return found

    monkeypatch.setattr(opened, "_live", meanwhile)
    opened.compact()
    assert sorted(r.id for r in opened.rows().collect()) == ["b", "c"]
    opened.compact()
    assert opened._manifest()[1]["writes"] == [] and tuple(opened.stats().first()) == (2, 2)


def test_writers_follow_each_other(opened):
    """A writer that read the last manifest before another one wrote the next comes after it."""
    other = store.VectorStore(opened.spark, opened.path).initialize()
    first = opened._manifest

    def late():
        opened._manifest = first
        seen = first()
        other.add_document("x", "other", [1, 0])
        return seen

    opened._manifest = late
    opened.add_document("x", "own", [0, 1])
    assert [(r.id, r.content) for r in opened.rows().collect()] == [("x", "own")]


def test_a_search_scores_a_row_once(opened):
    opened.add(opened.spark.createDataFrame([(str(i), "t", [float(i), 1.0]) for i in range(9)], "id string, content string, embedding array<float>"))
    plan = opened.search([1.0, 2.0], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("zip_with") == 1 and "Exchange" not in plan and "TakeOrdered" in plan
    assert [r.id for r in opened.search([0.0, 1.0], 2).collect()] == ["0", "1"]


def test_embedder_and_blocks_of_queries(spark, monkeypatch):
    made = store.VectorStore(spark, session.shared_dir(spark), embedder=lambda text: [float(len(text)), 1.0]).initialize()
    made.add(spark.createDataFrame([("a", "x"), ("b", "xxxx"), ("c", "xx")], "id string, content string"))
    assert [r.id for r in made.search("xxxxx", 1).collect()] == ["b"]
    asked = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(40)], "query_id long, embedding array<double>")
    want = sorted(map(tuple, made.search_batch(asked, 2).collect()))
    monkeypatch.setattr(store, "BATCH", 9)
    monkeypatch.setattr(store, "ROW_BLOCK", 2)
    assert sorted(map(tuple, made.search_batch(asked, 2).collect())) == want and len(want) == 80


def test_sql_functions(spark):
    vector.register(spark)
    r = spark.sql("select vec_normalize(array(3D, 4D)) as n, vec_percentage(0D) as p, vec_valid(array(1D)) as v, vec_valid(array(double('NaN'))) as w, vec_valid(array()) as e, vec_safe_similarity(array(1D, 0D), array(1D)) as s, vec_safe_similarity(array(1D, 0D), array(2D, 0D)) as t").first()
    assert tuple(r) == ([0.6, 0.8], 50.0, True, False, False, None, 1.0)
