"""Sources and sinks: token streams, training lines, Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENS = "stream_id string, seq long, token string, done boolean"
TRAINING = "user_content string, tool_name string, tool_arguments string"


def training_lines(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a line; lines that can't be read go."""
    rows = spark.read.schema(f"{TRAINING}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where("_corrupt is null").drop("_corrupt")


def token_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(TOKENS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def write_parquet(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).parquet(path)


def progress_events(rows: DataFrame) -> DataFrame:
    """(task, percent) of progress events (task, file_index, percent, files, ts): the last of each task, as overall
    percent; works on tables and, with update mode, on streams."""
    from lanternfish.functions.sources import progress

    last = rows.groupBy("task").agg(F.max_by(F.struct("file_index", "percent", "files"), "ts").alias("r"))
    return last.select("task", progress(F.col("r.file_index"), F.col("r.percent"), F.col("r.files")).alias("percent"))
