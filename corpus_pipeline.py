"""A training corpus from `documents`: five stages, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
A stage's result is written as Parquet into the shared folder and read again as the next one's input.

Defined results: the stages need doc_id and text; rows without a doc_id stay, but for toxic ones; null and empty texts
stay as they are; repeated rows are handled alike, so a toxic one goes in all its copies, and of near copies all rows
of the smallest doc_id stay; an empty table gives an empty one; other columns are kept, whatever their names, and
n_chars, where there is one, follows the text.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish import session
from lanternfish.llm import byte_bpe, decontaminate, line_dedup, ngram_join, toxicity
from lanternfish.llm.queries import RANKS


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs without columns of names that a stage makes itself, and what gives them their names back."""
    renamed = {c: f"__{c}" for c in docs.columns if c in names}
    return docs.withColumnsRenamed(renamed), lambda made: made.select([F.col(f"`{renamed.get(c, c)}`").alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold go."""
    own, named = _aside(docs, "held_out", "score", "predicted")
    return named(toxicity.score(own, session.table(spark, sf_dir, "labels")).where("predicted = 0"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, all documents stay."""
    return _counted(line_dedup.deduplicate(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of the smallest doc_id stays."""
    found = ngram_join.join(docs)
    gone = found.where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select([F.col(f"`{c}`") for c in docs.columns])


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans that occur in benchmark items go, all documents stay."""
    own, named = _aside(docs, "n_words", "hit_spans", "hit_items")
    return _counted(named(decontaminate.removed(own, session.table(spark, sf_dir, "benchmark"))))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds token ids, their number and digests of ids and of the text decoded from them."""
    return byte_bpe.tokenise(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_join", drop_near_copies),
    ("decontaminate", drop_benchmark_passages),
    ("byte_bpe", tokenise),
]

#: Scores of a fitted model can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = session.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = session.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
