"""Session settings that the engine relies on, and small helpers around a SparkSession."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build(app: str = "lanternfish", cores: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster pass your own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="lanternfish-")) / "lanternfish.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(out))
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """A new path below the folder that driver and executors share: spark.checkpoint.dir of the session.  Only where
    that is unset and one process runs everything, as in tests, a local one stands in."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.gettempdir()}/lanternfish-{os.getpid()}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/lanternfish-{uuid.uuid4().hex}"


#: Fixed value: the setting by which Spark removes a query's shuffle files when the query has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows of a table that is known to be small that one file holds.
ROWS_A_FILE = 100_000


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: cuts lineage and outlives executors.  The
    shuffle files of the write go when it has ended, so that steps in a row need the disk of one.  rows: a bound of the
    rows that its last step reads and makes, where one is known; it then has as few tasks and files as hold them."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
    path = f"{shared_dir(spark)}/{name}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.lanternfish_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables that written() made, once all that is to be read from them has been written."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.lanternfish_path).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
