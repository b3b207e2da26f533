"""Where intermediate results are kept: the folder that the session names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ready(spark: SparkSession) -> None:
    """Takes the checkpoint folder from the session's setting; makes one of its own only in a local session without one, as in tests."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidelog-"))


def checkpoint(df: DataFrame) -> DataFrame:
    """df, computed once and read back from the shared folder; its lineage ends there, so a lost executor costs nothing that was done before."""
    ready(df.sparkSession)
    return df.checkpoint(eager=True)


def folder(spark: SparkSession) -> str:
    """The checkpoint folder of this session."""
    ready(spark)
    return spark.sparkContext.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the checkpoint folder: like checkpoint, but compressed."""
    path = f"{folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Texts are large: Arrow batches of at most `rows` rows keep a Python worker's memory low. A smaller setting of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)
