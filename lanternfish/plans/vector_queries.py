"""Queries of the vector store and the vector functions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish import session
from lanternfish.functions import codec, vector
from lanternfish.operators import catalog, store
from lanternfish.plans.registry import query

V = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT v AS q FROM e WHERE vec_id = 0)"
COS = "list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q)))"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.table(spark, sf_dir, "embeddings")


def _probe(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(_rows(spark, sf_dir).where("vec_id = 0").first().embedding)


def _q(spark: SparkSession, sf_dir: str) -> Column:
    return vector.literal(_probe(spark, sf_dir))


def _r(c: Column) -> Column:
    return F.round(c, 6)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings and texts of equal ids as rows of a store."""
    docs = session.table(spark, sf_dir, "documents")
    return _rows(spark, sf_dir).join(docs, F.col("vec_id") == F.col("doc_id")).select(F.col("vec_id").alias("id"), F.col("text").alias("content"), "embedding", F.col("source").alias("metadata"))


@query(f"WITH {V} SELECT vec_id AS id, round({COS}, 6) AS similarity FROM e, q ORDER BY {COS} DESC, vec_id LIMIT 10")
def search_topk(spark, sf_dir):
    rows = _rows(spark, sf_dir).withColumnRenamed("vec_id", "id")
    probe = _probe(spark, sf_dir)
    return vector.top_similar(rows, vector.literal(probe), 10, -1.0, known=probe).select("id", _r(F.col("similarity")).alias("similarity"))


@query(f"WITH {V} SELECT vec_id, round({COS}, 6) AS similarity FROM e, q WHERE {COS} >= 0.3")
def search_threshold(spark, sf_dir):
    scored = _rows(spark, sf_dir).withColumn("s", vector.cosine(F.col("embedding"), _q(spark, sf_dir)))
    return scored.where(vector.meets(F.col("s"), 0.3) & ~F.isnan("s")).select("vec_id", _r(F.col("s")).alias("similarity"))


@query(f"WITH {V}, x AS (SELECT vec_id AS query_id, v AS q FROM e WHERE vec_id % 25 = 0), s AS (SELECT query_id, vec_id AS id, {COS} AS similarity FROM x, e), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s) SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round(similarity, 6) AS similarity FROM r WHERE rank <= 5")
def search_batch_top5(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    asked = rows.where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = store.search_batch(rows.withColumnRenamed("vec_id", "id"), asked, 5, -1.0)
    return found.withColumn("similarity", _r(F.col("similarity")))


@query(f"WITH {V} SELECT vec_id AS id, text AS content, round({COS}, 6) AS similarity, source AS metadata FROM e JOIN documents ON vec_id = doc_id, q ORDER BY {COS} DESC, vec_id LIMIT 10")
def search_with_content(spark, sf_dir):
    found = store.search(_documents(spark, sf_dir), _probe(spark, sf_dir), 10, -1.0)
    return found.withColumn("similarity", _r(F.col("similarity")))


@query("SELECT count(*) AS document_count, CAST(coalesce(max(len(embedding)), 0) AS BIGINT) AS vector_dimension FROM embeddings")
def store_stats(spark, sf_dir):
    return store.stats(_rows(spark, sf_dir))


@query("WITH w AS (SELECT vec_id % 50 AS id, label, vec_id AS write_seq FROM embeddings) SELECT id, arg_max(label, write_seq) AS label, max(write_seq) AS write_seq FROM w GROUP BY id")
def upsert_last_wins(spark, sf_dir):
    writes = _rows(spark, sf_dir).select((F.col("vec_id") % 50).alias("id"), "label", F.col("vec_id").alias("write_seq"), F.col("vec_id").alias("seq"))
    return catalog.latest(writes, "id", "seq").drop("seq")


@query("SELECT CAST(count(*) AS BIGINT) AS document_count, 64 :: BIGINT AS vector_dimension, CAST(count(*) FILTER (WHERE vec_id % 3 = 0) AS BIGINT) AS replaced FROM embeddings WHERE vec_id % 10 != 0")
def store_lifecycle(spark, sf_dir):
    """Open, add, replace, delete, compact; then count."""
    s = store.VectorStore(spark, f"{session.shared_dir(spark)}/store-{uuid.uuid4().hex}").initialize()
    rows = _rows(spark, sf_dir).select(F.col("vec_id").cast("string").alias("id"), F.lit("one").alias("content"), "embedding", F.lit(None).cast("string").alias("metadata"))
    s.add(rows)
    s.add(rows.where("id % 3 = 0").withColumn("content", F.lit("two")))
    s.delete(rows.where("id % 10 = 0"))
    s.compact()
    found = s.rows()
    return store.stats(found).crossJoin(F.broadcast(found.agg(F.count_if(F.col("content") == "two").alias("replaced"))))


@query("SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm FROM embeddings")
def vector_norms(spark, sf_dir):
    return _rows(spark, sf_dir).select("vec_id", _r(vector.magnitude(F.col("embedding"))).alias("norm"))


@query("WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT vec_id, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first, 1.0 :: DOUBLE AS norm FROM e")
def vector_normalize_check(spark, sf_dir):
    n = vector.normalize(F.col("embedding"))
    return _rows(spark, sf_dir).select("vec_id", _r(n[0]).alias("first"), _r(vector.magnitude(n)).alias("norm"))


@query(f"WITH {V} SELECT vec_id, round(list_dot_product(v, q), 6) AS dot FROM e, q")
def vector_dot(spark, sf_dir):
    return _rows(spark, sf_dir).select("vec_id", _r(vector.dot(F.col("embedding"), _q(spark, sf_dir))).alias("dot"))


@query(f"WITH {V} SELECT vec_id, round(list_distance(v, q), 6) AS distance FROM e, q ORDER BY list_distance(v, q), vec_id LIMIT 10")
def euclidean_topk(spark, sf_dir):
    d = vector.euclidean(F.col("embedding"), _q(spark, sf_dir))
    return _rows(spark, sf_dir).withColumn("d", d).orderBy("d", "vec_id").limit(10).select("vec_id", _r(F.col("d")).alias("distance"))


@query(f"WITH {V}, d AS (SELECT vec_id, list_sum(list_transform(list_zip(v, q), lambda p: abs(p[1] - p[2]))) AS d FROM e, q) SELECT vec_id, round(d, 6) AS distance FROM d ORDER BY d, vec_id LIMIT 10")
def manhattan_topk(spark, sf_dir):
    d = vector.manhattan(F.col("embedding"), _q(spark, sf_dir))
    return _rows(spark, sf_dir).withColumn("d", d).orderBy("d", "vec_id").limit(10).select("vec_id", _r(F.col("d")).alias("distance"))


@query(f"WITH {V} SELECT vec_id, round(({COS} + 1) / 2 * 100, 6) AS percentage FROM e, q")
def similarity_percentage(spark, sf_dir):
    s = vector.percentage(vector.cosine(F.col("embedding"), _q(spark, sf_dir)))
    return _rows(spark, sf_dir).select("vec_id", _r(s).alias("percentage"))


@query(f"WITH {V} SELECT vec_id AS id, round({COS}, 6) AS similarity FROM e, q WHERE vec_id != 0 ORDER BY {COS} DESC, vec_id LIMIT 1")
def argmax_neighbor(spark, sf_dir):
    rows = _rows(spark, sf_dir).where("vec_id != 0").withColumnRenamed("vec_id", "id")
    return vector.most_similar(rows, _q(spark, sf_dir)).select("id", _r(F.col("similarity")).alias("similarity"))


@query("WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT vec_id, len(v) :: INTEGER AS dimensions, round(sqrt(list_dot_product(v, v)), 6) AS magnitude, round(list_min(v), 6) AS min, round(list_max(v), 6) AS max, round(list_sum(v) / len(v), 6) AS mean, round(v[5], 6) AS fifth FROM e")
def vector_stats(spark, sf_dir):
    s = vector.stats(F.col("embedding"))
    return _rows(spark, sf_dir).select("vec_id", s["dimensions"].alias("dimensions"), *[_r(s[n]).alias(n) for n in ("magnitude", "min", "max", "mean")], _r(s["head"][4]).alias("fifth"))


@query("SELECT vec_id, vec_id % 7 != 0 AND vec_id % 11 != 0 AS valid FROM embeddings")
def valid_embeddings(spark, sf_dir):
    """Every seventh is emptied, every eleventh gets a NaN."""
    e = F.when(F.col("vec_id") % 7 == 0, F.array().cast("array<float>")).when(F.col("vec_id") % 11 == 0, F.concat("embedding", F.array(F.lit(float("nan")).cast("float")))).otherwise(F.col("embedding"))
    return _rows(spark, sf_dir).select("vec_id", vector.valid(e).alias("valid"))


@query(f"WITH {V} SELECT vec_id, CASE WHEN vec_id % 7 != 0 THEN round({COS}, 6) END AS similarity FROM e, q")
def safe_similarity(spark, sf_dir):
    e = F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding"))
    return _rows(spark, sf_dir).select("vec_id", _r(vector.safe_similarity(e, _q(spark, sf_dir))).alias("similarity"))


@query("SELECT vec_id, 4 * len(embedding) :: INTEGER AS bytes, true AS same FROM embeddings")
def blob_codec(spark, sf_dir):
    return _rows(spark, sf_dir).withColumn("b", codec.to_blob("embedding")).select("vec_id", F.octet_length("b").alias("bytes"), (codec.from_blob("b") == F.col("embedding")).alias("same"))


@query(f"WITH {V} SELECT label, count(*) AS n, round(avg({COS}), 6) AS similarity FROM e, q GROUP BY label")
def similarity_by_label(spark, sf_dir):
    s = vector.cosine(F.col("embedding"), _q(spark, sf_dir))
    return _rows(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), _r(F.avg(s)).alias("similarity"))


@query(f"WITH {V} SELECT vec_id, round({COS}, 6) AS similarity, round(list_dot_product(v, q), 6) AS dot FROM e, q WHERE list_distance(v, q) < 1.2")
def sql_functions(spark, sf_dir):
    vector.register(spark)
    _rows(spark, sf_dir).createOrReplaceTempView("embeddings_view")
    q = "array(" + ", ".join(f"{x!r}D" for x in _probe(spark, sf_dir)) + ")"
    return spark.sql(f"SELECT vec_id, round(vec_cosine(embedding, {q}), 6) AS similarity, round(vec_dot(embedding, {q}), 6) AS dot FROM embeddings_view WHERE vec_euclidean(embedding, {q}) < 1.2D")


@query("WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), m AS (SELECT *, list_max(list_transform(v, lambda x: abs(x))) AS top FROM e) SELECT vec_id, round(top / 127, 6) AS scale, CAST(round(v[1] * 127 / top) AS TINYINT) AS first FROM m")
def quantize_int8(spark, sf_dir):
    z = vector.quantized(F.col("embedding"))
    return _rows(spark, sf_dir).select("vec_id", _r(z["scale"]).alias("scale"), z["values"][0].alias("first"))


@query(f"WITH {V}, t AS (SELECT vec_id, text, {COS} AS s FROM e JOIN documents ON vec_id = doc_id, q ORDER BY s DESC, vec_id LIMIT 3) SELECT 'Context:' || chr(10) || string_agg(text, chr(10) ORDER BY s DESC, vec_id) || chr(10) || chr(10) || 'Question: what is it?' AS prompt FROM t")
def rag_prompt(spark, sf_dir):
    from lanternfish.functions import templates

    found = store.search(_documents(spark, sf_dir), _probe(spark, sf_dir), 3, -1.0)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "id", "content")))  # three rows
    return found.agg(F.transform(ordered, lambda x: x["content"]).alias("c")).select(templates.rag_prompt(F.col("c"), F.lit("what is it?")).alias("prompt"))
