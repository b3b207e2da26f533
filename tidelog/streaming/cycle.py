"""The poll cycle as one query: cursor, gap from backups, keyed state, catalog versions of the start, and a commit of events, retractions and checkpoints.

    fill_gap(spark, log, backups, db, saved)         # once, before a start after a long pause
    poll(spark, log, catalog, store, checkpoint)     # follows the table of records at `log`

A batch is one upsert of the ranged event table under its number, so a batch that runs again changes nothing. When the fingerprint of the system tables changes,
stop the query and start it with the new catalog and the same checkpoint: offsets and state go on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.lsn import log_time
from ..functions.predicates import is_cleanup_delete
from ..operators.ranged_store import RangedStore
from ..sources import log_table
from ..sources.catalog import Catalog
from . import keyed, poller


def first_available(spark: SparkSession, path: str, db: str) -> str:
    """The lsn from which on a table of records has a database's log, by its ranges; '' without one."""
    found = spark.read.parquet(f"{path}/ranges").where(F.col("db_name") == db).agg(F.min("first_lsn")).first()[0]
    return found or ""


def fill_gap(spark: SparkSession, log: str, backups: str, db: str, saved: str) -> bool:
    """Puts the records of backups between the saved lsn and the log's first one into the log, if it no longer reaches back. Returns whether some may still be missing."""
    first = first_available(spark, log, db)
    if not poller.gap(saved, first):
        return False
    held = log_table.read_log(spark, backups, db=db, after=saved)
    found = held.where(F.col("lsn") < first)
    if found.head(1):
        log_table.write_log(found, log)
    # Backups that reach into the log, too, leave no hole before it.
    return not held.where(F.col("lsn") >= first).head(1)


def stamped(records: DataFrame) -> DataFrame:
    """Records with seen_at (of a begin or an end) and cleanup, from their own times and bytes."""
    time = F.when(F.col("begin_time") != "", F.col("begin_time")).otherwise(F.col("end_time"))
    return records.withColumn("seen_at", log_time(time)).withColumn("cleanup", F.coalesce(is_cleanup_delete(F.col("operation"), F.col("contents0")), F.lit(False)))


def poll(spark: SparkSession, log: str, catalog: Catalog, store: RangedStore, checkpoint: str, trigger: dict | None = None, shares: int = 8, timeout_hours: float = 2) -> StreamingQuery:
    """Starts the query; trigger as in poller.follow."""
    log_table.register(spark)
    source = stamped(spark.readStream.format("tidelog").option("path", log).load())

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        events = keyed.events(df, catalog).drop("skip_reason")
        last = {r.db_name: r.lsn for r in df.groupBy("db_name").agg(F.max("lsn").alias("lsn")).collect()}
        back = keyed.retractions(df).select("db_name", "txn_id")
        store.upsert(events, number, back if back.head(1) else None, last)
        df.unpersist()

    query = keyed.committed_records(source, catalog, shares, timeout_hours).writeStream.foreachBatch(batch)
    return query.option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "5 seconds"})).start()
