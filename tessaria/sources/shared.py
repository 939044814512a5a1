"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str = "tessaria") -> str:
    """A new folder in the place that spark.checkpoint.dir names; a session in one process may leave it unset and then gets a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = base or tempfile.mkdtemp(prefix="tessaria-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of at most `rows` rows in this session: texts and sets are long, and a worker holds a batch and its result at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def cut(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back, so a lost executor costs no more than that read."""
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def only(df: DataFrame, ids: DataFrame, most: int = 1_000_000) -> DataFrame:
    """The rows of df whose doc_id is among ids (doc_id), a table; up to `most` of them (counted) go to the tasks, so that df is not shuffled."""
    return df.join(F.broadcast(ids) if ids.count() <= most else ids, "doc_id", "left_semi")
