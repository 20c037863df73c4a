"""A keyed vector store on Parquet with exact search.

Rows are (id, content, embedding, metadata, created_at).  A manifest names the base, a folder with one row for each
id, and the writes since, each a folder of its own, in order.  Every write makes its folder first and then the next
manifest, which it creates only if nobody else has: two writers follow each other, and a reader sees all of a write
or nothing.  A read takes the base as it is, without a shuffle, but for ids that later writes name.  compact() makes a
new base of what one manifest says; writes that came meanwhile stay behind it.  The manifest also keeps the
dimension, which comes from the data, and rows keep their vector's length, so that a search is one pass over
the rows with one product each.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternfish.functions import vector

SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("content", T.StringType(), False),
        T.StructField("embedding", T.ArrayType(T.FloatType()), False),
        T.StructField("metadata", T.StringType()),
        T.StructField("created_at", T.LongType()),
    ]
)
_STORED = T.StructType([T.StructField(f.name, f.dataType) for f in SCHEMA.fields] + [T.StructField("norm", T.DoubleType()), T.StructField("deleted", T.BooleanType())])
#: Vectors up to this many numbers are literals of the plan; longer ones are broadcast as one row.
LITERAL = 64
#: Query vectors that meet a block of rows at a time, and rows of such a block.
BATCH, ROW_BLOCK = 4096, 65536
#: Tries of a writer to be the next one.
TRIES = 100


class VectorStoreError(RuntimeError):
    pass


class DimensionMismatchError(ValueError):
    pass


class VectorStore:
    """initialize(), add, search, stats, clear, close; all take effect in the folder `path`."""

    def __init__(self, spark: SparkSession, path: str, embedder: Callable[[str], list[float]] | None = None) -> None:
        self.spark, self.path, self.embedder, self.open = spark, path.rstrip("/"), embedder, False

    # --- files -------------------------------------------------------------------------------------------

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _manifest(self) -> tuple[int, dict]:
        """The greatest manifest: its number, and base, rows (of the base), writes and dimension."""
        fs, folder = self._fs(), self._path("manifests")
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        numbers = sorted((int(n) for n in names if n.isdigit()), reverse=True)
        for number in numbers:
            stream = fs.open(self._path("manifests", f"{number:020d}"))
            try:
                text = bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
            if text.endswith("}"):  # else its writer is still at it
                return number, json.loads(text)
        return -1, {"base": None, "rows": 0, "writes": [], "dimension": 0}

    def _commit(self, change: Callable[[dict], dict]) -> None:
        """Makes the next manifest of what change() makes of the last one, again if another writer was faster."""
        fs = self._fs()
        for _ in range(TRIES):
            number, now = self._manifest()
            text = json.dumps(change(now)).encode()
            try:
                out = fs.create(self._path("manifests", f"{number + 1:020d}"), False)
            except Exception as error:  # noqa: BLE001  the file is there, or something else is wrong
                if not fs.exists(self._path("manifests", f"{number + 1:020d}")):
                    raise VectorStoreError("the manifest can't be written") from error
                continue
            out.write(text)
            out.close()
            return
        raise VectorStoreError(f"other writers were faster {TRIES} times")

    def initialize(self) -> VectorStore:
        if self._manifest()[0] < 0:
            self._commit(lambda now: now)
        self.open = True
        return self

    def _need(self) -> None:
        if not self.open:
            raise VectorStoreError("the store is not initialized")

    def _live(self, manifest: dict) -> DataFrame:
        """The last version of each id, with its norm."""
        read = self.spark.read.schema(_STORED)
        names = _STORED.names[1:]
        if not manifest["base"] and not manifest["writes"]:
            return self.spark.createDataFrame([], _STORED).drop("deleted")
        base = read.parquet(f"{self.path}/{manifest['base']}").drop("deleted") if manifest["base"] else None
        if not manifest["writes"]:
            return base
        writes = read.parquet(*(f"{self.path}/{w}" for w in manifest["writes"]))
        seq = F.create_map(*[F.lit(x) for pair in zip(manifest["writes"], range(len(manifest["writes"])), strict=True) for x in pair])
        folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        last = writes.select("*", F.element_at(seq, folder).alias("seq")).groupBy("id").agg(F.max_by(F.struct(*names), "seq").alias("row"))
        new = last.where(~F.col("row.deleted")).select("id", *[F.col(f"row.{n}") for n in names]).drop("deleted")
        return new if base is None else base.join(writes.select("id").distinct(), "id", "left_anti").unionByName(new)

    def rows(self) -> DataFrame:
        """The last version of each id."""
        self._need()
        return self._live(self._manifest()[1]).select(*SCHEMA.names)

    # --- writes ------------------------------------------------------------------------------------------

    def _write(self, rows: DataFrame, deleted: bool = False) -> str:
        """Writes rows into a folder that no manifest names yet."""
        folder = f"w{uuid.uuid4().hex}"
        out = rows.select("id", "content", F.col("embedding").cast("array<float>").alias("embedding"), "metadata", F.unix_timestamp().alias("created_at"))
        out.withColumn("norm", vector.magnitude(F.col("embedding"))).withColumn("deleted", F.lit(deleted)).write.parquet(f"{self.path}/{folder}")
        return folder

    def _drop(self, folder: str) -> None:
        self._fs().delete(self._path(folder), True)

    def add(self, rows: DataFrame) -> None:
        """Upserts rows (id, content, embedding?, metadata?); the last of equal ids in one call is the greatest row.
        Without an embedding column the embedder makes it."""
        self._need()
        if "metadata" not in rows.columns:
            rows = rows.withColumn("metadata", F.lit(None).cast("string"))
        if "embedding" not in rows.columns:
            if self.embedder is None:
                raise VectorStoreError("no embedder is set")
            embed = self.embedder

            @F.pandas_udf("array<float>")
            def embedded(texts: pd.Series) -> pd.Series:
                return texts.map(embed)

            rows = rows.withColumn("embedding", embedded("content"))
        names = ("content", "embedding", "metadata")
        one = rows.groupBy("id").agg(F.max(F.struct(*names)).alias("r")).select("id", *[F.col(f"r.{n}").alias(n) for n in names])
        folder = self._write(one)
        sizes = self.spark.read.schema(_STORED).parquet(f"{self.path}/{folder}").agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high")).first()

        def with_rows(now: dict) -> dict:
            if not sizes.n:
                return now
            if sizes.low != sizes.high or (now["dimension"] and now["dimension"] != sizes.low):
                self._drop(folder)
                raise DimensionMismatchError(f"store has {now['dimension']} dimensions, rows have {sizes.low} to {sizes.high}")
            if not now["base"] and not now["writes"]:
                return {"base": folder, "rows": sizes.n, "writes": [], "dimension": sizes.low}
            return now | {"writes": [*now["writes"], folder], "dimension": sizes.low}

        self._commit(with_rows)

    def add_document(self, doc_id: str, content: str, embedding: list[float] | None = None, metadata: str | None = None) -> None:
        if embedding is None:
            if self.embedder is None:
                raise VectorStoreError("no embedder is set")
            embedding = self.embedder(content)
        self.add(self.spark.createDataFrame([(doc_id, content, [float(x) for x in embedding], metadata)], "id string, content string, embedding array<float>, metadata string"))

    def delete(self, ids: list[str] | DataFrame) -> None:
        """Ids that the store hasn't are no error."""
        self._need()
        which = ids if isinstance(ids, DataFrame) else self.spark.createDataFrame([(i,) for i in ids], "id string")
        none = F.lit(None).cast("string")
        folder = self._write(which.select("id").distinct().select("id", none.alias("content"), F.lit(None).cast("array<float>").alias("embedding"), none.alias("metadata")), deleted=True)
        self._commit(lambda now: now | {"writes": [*now["writes"], folder]})

    def clear(self) -> None:
        self._need()
        self._commit(lambda now: {"base": None, "rows": 0, "writes": [], "dimension": 0})

    def compact(self) -> None:
        """A new base; writes that come while it is made stay behind it.  A store that was cleared meanwhile stays so."""
        self._need()
        _, seen = self._manifest()
        folder = f"w{uuid.uuid4().hex}"
        self._live(seen).withColumn("deleted", F.lit(False)).write.parquet(f"{self.path}/{folder}")
        made = stats(self.spark.read.schema(_STORED).parquet(f"{self.path}/{folder}")).first()

        def with_base(now: dict) -> dict:
            if now["base"] != seen["base"] or now["writes"][: len(seen["writes"])] != seen["writes"]:
                self._drop(folder)
                return now
            later = now["writes"][len(seen["writes"]) :]
            return {"base": folder, "rows": made.document_count, "writes": later, "dimension": made.vector_dimension or (now["dimension"] if later else 0)}

        self._commit(with_base)

    def close(self) -> None:
        self.open = False

    # --- reads -------------------------------------------------------------------------------------------

    def get(self, doc_id: str) -> DataFrame:
        return self.rows().where(F.col("id") == doc_id)

    def all(self) -> DataFrame:
        return self.rows().orderBy(F.desc("created_at"), "id")

    def stats(self) -> DataFrame:
        """document_count, vector_dimension; from the manifest alone where nothing was written since the base."""
        self._need()
        _, manifest = self._manifest()
        if not manifest["writes"]:
            return self.spark.createDataFrame([(manifest["rows"], manifest["dimension"])], "document_count long, vector_dimension long")
        return stats(self._live(manifest))

    def _query(self, query: list[float] | str) -> list[float]:
        if isinstance(query, str):
            if self.embedder is None:
                raise VectorStoreError("no embedder is set")
            query = self.embedder(query)
        return query

    def search(self, query: list[float] | str, k: int = 5, threshold: float = 0.0) -> DataFrame:
        self._need()
        query, manifest = self._query(query), self._manifest()[1]
        if manifest["dimension"] and manifest["dimension"] != len(query):
            raise DimensionMismatchError(f"store has {manifest['dimension']} dimensions, the query has {len(query)}")
        return search(self._live(manifest), query, k, threshold, norm=F.col("norm"))

    def search_batch(self, queries: DataFrame, k: int = 5, threshold: float = 0.0) -> DataFrame:
        return search_batch(self.rows(), queries, k, threshold)


def stats(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("document_count"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).cast("long").alias("vector_dimension"))


def search(rows: DataFrame, query: list[float], k: int = 5, threshold: float = 0.0, norm: Column | None = None) -> DataFrame:
    """(id, content, similarity, metadata) of the k most similar rows that reach the threshold; NaN rows go, ties
    rank by id, and one TakeOrdered does it.  norm: the vectors' lengths, where rows have them."""
    spark, values = rows.sparkSession, [float(x) for x in query]
    if len(query) <= LITERAL:
        q = vector.literal(query)
    else:
        one = spark.createDataFrame([(values,)], "__q array<double>")
        rows, q = rows.crossJoin(F.broadcast(one)), F.col("__q")  # one row
    found = vector.top_similar(rows, q, k, threshold, known=values, norm=norm)
    return found.select("id", "content", "similarity", "metadata")


def search_batch(rows: DataFrame, queries: DataFrame, k: int = 5, threshold: float = 0.0) -> DataFrame:
    """(query_id, id, rank, similarity) for queries (query_id, embedding).  Up to BATCH queries are broadcast and meet all
    rows in matrix products, each partition keeps its k best, and a window merges them.  More queries lie in
    blocks of about BATCH, and each block meets each block of about ROW_BLOCK rows in one task."""
    spark = rows.sparkSession
    count = queries.count()
    if not count:
        return spark.createDataFrame([], "query_id string, id string, rank int, similarity double")
    out = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, similarity double"
    asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("q"))
    vectors = rows.select("id", F.col("embedding").cast("array<double>").alias("v"))
    if count <= BATCH:
        part = asked.orderBy("query_id").collect()  # BATCH rows at most
        shared = spark.sparkContext.broadcast(([r.query_id for r in part], np.array([r.q for r in part], float)))
        found = vectors.mapInPandas(lambda batches: _scored(batches, *shared.value, k), out)
    else:
        blocks, parts = -(-count // BATCH), max(1, -(-rows.count() // ROW_BLOCK))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = vectors.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), every(blocks).alias("block"))
        right = asked.select("query_id", "q", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), every(parts).alias("part"))

        def meet(some: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
            made = list(_scored([some[["id", "v"]]], ask.query_id.to_numpy(), np.stack(ask.q.to_numpy()), k)) if len(some) and len(ask) else []
            return made[0] if made else pd.DataFrame({"query_id": ask.query_id[:0], "id": some.id[:0], "similarity": np.zeros(0)})

        found = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInPandas(meet, out)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("rank") <= k) & (F.col("similarity") >= threshold)).select("query_id", "id", "rank", "similarity")


def _scored(batches, ids, q: np.ndarray, k: int) -> Iterator[pd.DataFrame]:
    """The k best rows of all batches for each query."""
    qn = np.sqrt((q * q).sum(axis=1))
    best: list[tuple] = []
    for pdf in batches:
        pdf = pdf[pdf.v.map(lambda v: v is not None and len(v) == q.shape[1])]
        if pdf.empty:
            continue
        x = np.stack(pdf.v.to_numpy()).astype(float)
        norm = np.outer(qn, np.sqrt((x * x).sum(axis=1)))
        s = np.divide(q @ x.T, norm, out=np.zeros_like(norm), where=norm != 0)
        s[np.isnan(s)] = -np.inf
        # ties at the k-th place are kept, so that ids can decide in the end
        least = -np.partition(-s, k - 1, axis=1)[:, k - 1] if s.shape[1] > k else np.full(len(s), -np.inf)
        a, b = np.nonzero((s >= least[:, None]) & (s > -np.inf))
        best.append((a, pdf.id.to_numpy()[b], s[a, b]))
    if best:
        a, i, s = (np.concatenate(x) for x in zip(*best, strict=True))
        order = np.lexsort((i, -s, a))
        a, i, s = a[order], i[order], s[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        keep = rank < k
        yield pd.DataFrame({"query_id": np.array(ids)[a[keep]], "id": i[keep], "similarity": s[keep]})
