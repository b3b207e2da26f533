"""Following a log: micro-batches of records joined with the open transactions left by the batch before, run through the batch assembler.

State between batches is a table of carried-over records (of transactions without an end yet), written under the batch's number, so that a
batch that is run again reads the same state and writes the same rows: the upsert by (db_name, lsn) makes its output exactly-once."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas as S
from ..functions.predicates import is_base_row, is_data_op
from ..operators import generate, images, transactions
from ..sources.catalog import Catalog
from ..sources.log_sources import both


def split(records: DataFrame, now: datetime | None = None, timeout_hours: float = 2) -> tuple[DataFrame, DataFrame]:
    """(committed data records, records to carry over) of one batch with what was carried into it.

    Carried: all records of open epochs, their BEGIN and exclusions included, unless they began longer ago than the timeout."""
    marked = transactions.with_epochs(records)
    done = marked.where((F.col("kind") == S.COMMIT) & F.col("excluded_from").isNull() & ~F.col("undone")).where(F.col("operation").isin(*S.DATA_OPS))
    left = marked.where(F.col("kind").isNull())
    if now is not None:
        left = left.where(F.col("begin_at").isNull() | (F.col("begin_at") >= F.lit(now) - F.expr(f"make_dt_interval(0, 0, 0, {timeout_hours * 3600})")))
    return done, left.select(*records.columns)


def retractions(records: DataFrame) -> DataFrame:
    """(db_name, transaction_id) of ids with an excluded epoch: what was written of them before is taken back."""
    return transactions.with_epochs(records).where("excluded_from is not null").select("db_name", "transaction_id").distinct()


def follow(
    source: DataFrame, state_dir: str, sink: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None, retract: Callable[[DataFrame, int], None] | None = None, now: Callable[[], datetime] | None = None
) -> StreamingQuery:
    """Starts the query. sink(committed, batch_id) must be idempotent by (db_name, lsn); retract(ids, batch_id) likewise.

    trigger: {"processingTime": "5 seconds"} to poll, {"availableNow": True} for the first scan or a gap."""

    def batch(df: DataFrame, batch_id: int) -> None:
        spark: SparkSession = df.sparkSession
        records = _carried(spark, state_dir, batch_id - 1, df).unionByName(df)
        done, left = split(records, now() if now else None)
        if retract:
            retract(retractions(records), batch_id)
        sink(done, batch_id)
        _carry(left, state_dir, batch_id)

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "5 seconds"})).start()


def follow_events(source: DataFrame, catalog: Callable[[], Catalog], state_dir: str, sink: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None, retract: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Like `follow`, from records to events (see generate.scan): sink gets the events of the transactions that a batch ends.

    catalog() is asked for each batch, so a changed schema is seen at the next one. A row's image lives on from batch to batch: each record is
    folded once, in the batch that brings it, and an open transaction is carried over with the images of its records."""

    def batch(df: DataFrame, batch_id: int) -> None:
        spark, known, turn = df.sparkSession, catalog(), batch_id % FOLDERS
        kept = _carried(spark, f"{state_dir}/images", batch_id - 1, None)
        opened = _carried(spark, f"{state_dir}/open", batch_id - 1, None)
        every = df.withColumn("_new", F.lit(True))
        if opened is not None:
            every = every.unionByName(opened.select(*df.columns, F.lit(False).alias("_new")))
        marked = transactions.with_epochs(every).where("_new").where(F.col("excluded_from").isNull() | (F.col("lsn") < F.col("excluded_from")))
        data = generate.resolved(marked.where(is_data_op(F.col("operation")) & is_base_row(F.col("context"))).select(*df.columns), known).where("object_id is not null")
        seeds = data if kept is None else data.unionByName(images.as_records(kept), allowMissingColumns=True)
        # Written, as the events, the images and the carried rows all come from it; a batch that runs again writes the same.
        images.fold(seeds).write.mode("overwrite").parquet(f"{state_dir}/folded/{turn}")
        seen = spark.read.parquet(f"{state_dir}/folded/{turn}")
        folded = seen.where("lsn <> ''")
        records = folded.unionByName(df.where(~is_data_op(F.col("operation"))), allowMissingColumns=True)
        records = records.unionByName(opened, allowMissingColumns=True) if opened is not None else records
        done, left = split(records)
        if retract:
            retract(retractions(every), batch_id)
        sink(generate.event_columns(generate.statements(done, known)), batch_id)
        _carry(left, f"{state_dir}/open", batch_id)
        _carry(images.last_images(seen), f"{state_dir}/images", batch_id)

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "5 seconds"})).start()


#: State folders in turn: a batch overwrites the one of the third batch before it, so the one that it read itself stays until it is done.
FOLDERS = 3


def _carry(left: DataFrame, state_dir: str, batch_id: int) -> None:
    """Writes the state of a batch with its number on every row, and a row without a record, so that an empty state has a number too."""
    mark = left.sparkSession.createDataFrame([(True,)], "_mark boolean")
    rows = left.withColumn("_mark", F.lit(False)).unionByName(mark, allowMissingColumns=True)
    rows.withColumn("_batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{state_dir}/{batch_id % FOLDERS}")


def _carried(spark: SparkSession, state_dir: str, batch_id: int, like: DataFrame | None) -> DataFrame | None:
    """The state that a batch left, with like's columns if it is given; before the first batch empty (or None), an error if it is missing later."""
    if batch_id < 0:
        return None if like is None else like.limit(0)
    try:
        found = spark.read.parquet(f"{state_dir}/{batch_id % FOLDERS}")
        whole = found.where((F.col("_batch") == batch_id) & F.col("_mark")).count() == 1
    except AnalysisException:
        whole = False
    if not whole:
        raise RuntimeError(f"the open transactions that batch {batch_id} left are not in {state_dir}")
    rows = found.where(~F.col("_mark")).drop("_mark", "_batch")
    return rows if like is None else rows.select(*like.columns)


def new_records(log: DataFrame, stored: DataFrame | None, checkpoint: str) -> tuple[DataFrame, bool]:
    """(records after the checkpoint, whether some may be missing).

    Where the log no longer reaches back to the checkpoint, records of backups (stored) fill in, and what both hold counts once. Without a
    checkpoint all of the log is read; it may be missing some only if there is a gap and no backup reaches it."""
    first = log.agg(F.min("lsn").alias("lsn")).first()["lsn"]
    after = log.where(F.col("lsn") > checkpoint) if checkpoint else log
    if not checkpoint or not gap(checkpoint, first or ""):
        return after, False
    between = stored.where((F.col("lsn") > checkpoint) & (F.col("lsn") < F.lit(first))) if stored is not None else None
    if between is None or not between.head(1):
        return log, True
    return transactions.first_seen(both(stored.where(F.col("lsn") > checkpoint), log)).drop("source_rank"), False


def gap(checkpoint: str, first_available: str) -> bool:
    """Whether the log no longer reaches back to the checkpoint, so that backups must fill in."""
    return bool(checkpoint) and checkpoint < first_available


def activity(events: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """A running count of events by operation in tumbling windows, with a watermark for late ones."""
    timed = events.where("event_time is not null").withColumn("event_time", F.col("event_time").cast("timestamp"))
    return timed.withWatermark("event_time", late).groupBy(F.window("event_time", width), "operation").agg(F.count(F.lit(1)).alias("n"))
