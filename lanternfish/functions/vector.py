"""Vector arithmetic as column expressions over array<double> or array<float> (compute in double)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def literal(values: list[float]) -> Column:
    """A query vector for a plan; beyond 64 numbers broadcast a one-row table instead (see store.search)."""
    return F.array(*[F.lit(float(x)) for x in values])


def dot(a: Column, b: Column) -> Column:
    """Sum of products in order; 0 where the lengths differ."""
    return F.when(F.size(a) == F.size(b), _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))).otherwise(0.0)


def magnitude(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(doubles(v), lambda x: x * x)))


def normalize(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    m = magnitude(v)
    return F.when(m > 0, F.transform(doubles(v), lambda x: x / m)).otherwise(doubles(v))


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ or a norm is zero; NaN passes through; not clamped."""
    na, nb = magnitude(a), magnitude(b)
    return F.when((F.size(a) != F.size(b)) | (na == 0) | (nb == 0), 0.0).otherwise(dot(a, b) / (na * nb))


def strict_cosine(a: Column, b: Column) -> Column:
    """Raises where lengths differ."""
    return F.when(F.size(a) != F.size(b), F.raise_error("vectors differ in length").cast("double")).otherwise(cosine(a, b))


def euclidean(a: Column, b: Column) -> Column:
    d = F.sqrt(_sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))
    return F.when(F.size(a) == F.size(b), d).otherwise(float("inf"))


def manhattan(a: Column, b: Column) -> Column:
    d = _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y)))
    return F.when(F.size(a) == F.size(b), d).otherwise(float("inf"))


def percentage(similarity: Column) -> Column:
    return (similarity + 1) / 2 * 100


def meets(similarity: Column, threshold: float) -> Column:
    return similarity >= threshold


def valid(v: Column) -> Column:
    """Not empty, no NaN, no infinity."""
    bad = F.exists(doubles(v), lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True))


def safe_similarity(a: Column, b: Column) -> Column:
    """Null where either is invalid or lengths differ."""
    return F.when(valid(a) & valid(b) & (F.size(a) == F.size(b)), cosine(a, b))


def stats(v: Column) -> Column:
    """struct(dimensions, magnitude, min, max, mean, head): 0 for the least and greatest of nothing, NaN for its mean."""
    d = doubles(v)
    mean = F.when(F.size(v) > 0, F.try_divide(_sum(d), F.size(v).cast("double"))).otherwise(float("nan"))
    return F.struct(F.size(v).alias("dimensions"), magnitude(v).alias("magnitude"), F.coalesce(F.array_min(d), F.lit(0.0)).alias("min"), F.coalesce(F.array_max(d), F.lit(0.0)).alias("max"), mean.alias("mean"), F.slice(d, 1, 5).alias("head"))


def quantized(v: Column) -> Column:
    """8-bit form: struct(scale, values) with values in -127..127; a zero vector has scale 0."""
    top = F.array_max(F.transform(doubles(v), lambda x: F.abs(x)))
    values = F.transform(doubles(v), lambda x: F.coalesce(F.round(F.try_divide(x * 127, top)), F.lit(0.0)).cast("tinyint"))
    return F.struct((top / 127).alias("scale"), values.alias("values"))


def most_similar(rows: DataFrame, query: Column, vector: str = "embedding", row_id: str = "id") -> DataFrame:
    """The row of the greatest similarity above -1, the smaller id on ties; no row if there is none."""
    s = cosine(F.col(vector), query)
    return rows.withColumn("similarity", s).where((F.col("similarity") > -1) & ~F.isnan("similarity")).orderBy(F.desc("similarity"), row_id).limit(1)


def similarity_to(v: Column, query: Column, known: list[float], norm: Column | None = None) -> Column:
    """cosine(v, query) for a query whose numbers are known: its length is a constant, and v is gone through once where
    its length (norm) is known too, else twice."""
    size = math.sqrt(math.fsum(x * x for x in known))
    products = _sum(F.zip_with(v, query, lambda x, y: x.cast("double") * y))
    length = norm if norm is not None else F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    score = F.coalesce(F.try_divide(products, length * size), F.lit(0.0)) if size else F.lit(0.0)
    return F.when(F.size(v) == len(known), score).otherwise(0.0)


def top_similar(rows: DataFrame, query: Column, k: int, threshold: float = 0.0, vector: str = "embedding", row_id: str = "id", known: list[float] | None = None, norm: Column | None = None) -> DataFrame:
    """The k rows of the greatest similarity that reach the threshold.  The threshold is applied after the top k,
    which keeps the same rows; NaN scores become null, which sorts last and reaches no threshold.  No filter stands
    on the score before the top k, so it is computed once a row.  known: the query's numbers, norm: the rows' lengths."""
    if k <= 0:
        return rows.withColumn("similarity", F.lit(0.0)).limit(0)
    score = cosine(F.col(vector), query) if known is None else similarity_to(F.col(vector), query, known, norm)
    scored = rows.withColumn("similarity", F.nanvl(score, F.lit(None).cast("double")))
    return scored.orderBy(F.desc_nulls_last("similarity"), row_id).limit(k).where(F.col("similarity") >= threshold)


_V, _FLAG = "array<double>", "boolean"


def register(spark: SparkSession) -> None:
    """SQL functions that Catalyst inlines: vec_dot, vec_norm, vec_cosine, vec_normalize, vec_euclidean, vec_manhattan,
    vec_percentage, vec_valid, vec_safe_similarity."""
    dots = "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"
    norm = lambda n: f"sqrt(aggregate(transform({n}, x -> x * x), 0D, (s, x) -> s + x))"
    close = f"if(size(a) != size(b) or {norm('a')} = 0 or {norm('b')} = 0, 0D, {dots} / ({norm('a')} * {norm('b')}))"
    valid = lambda n: f"coalesce(size({n}) > 0 and not exists({n}, x -> isnan(x) or abs(x) = double('Infinity')), false)"
    for name, args, kind, body in (
        ("vec_dot", f"a {_V}, b {_V}", "double", f"if(size(a) = size(b), {dots}, 0D)"),
        ("vec_norm", f"a {_V}", "double", norm("a")),
        ("vec_cosine", f"a {_V}, b {_V}", "double", close),
        ("vec_normalize", f"a {_V}", _V, f"if({norm('a')} > 0, transform(a, x -> x / {norm('a')}), a)"),
        ("vec_euclidean", f"a {_V}, b {_V}", "double", "if(size(a) = size(b), sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)), double('Infinity'))"),
        ("vec_manhattan", f"a {_V}, b {_V}", "double", "if(size(a) = size(b), aggregate(zip_with(a, b, (x, y) -> abs(x - y)), 0D, (s, x) -> s + x), double('Infinity'))"),
        ("vec_percentage", "s double", "double", "(s + 1) / 2 * 100"),
        ("vec_valid", f"a {_V}", _FLAG, valid("a")),
        ("vec_safe_similarity", f"a {_V}, b {_V}", "double", f"if({valid('a')} and {valid('b')} and size(a) = size(b), {close}, null)"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind.upper()} RETURN {body}")
