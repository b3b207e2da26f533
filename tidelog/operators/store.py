"""The event table: appended versions, of which the last one of each (db_name, lsn) counts; retraction, retention, checkpoints."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.predicates import is_tombstone


def cleaned(events: DataFrame) -> DataFrame:
    """Adds columns that older tables lack, turns empty optional texts into null and drops stored clean-up deletes."""
    for c in S.LOG_EVENTS.split(", "):
        name, kind = c.split()
        if name not in events.columns:
            events = events.withColumn(name, F.lit(None).cast(kind))
    for name in S.OPTIONAL_TEXTS:
        events = events.withColumn(name, F.when(F.col(name) != "", F.col(name)))
    return events.where(~is_tombstone(F.col("operation"), F.col("status"), F.col("compressed_row_hex")))


def first_kept(events: DataFrame) -> DataFrame:
    """Of events with equal (db_name, lsn) the one of smallest id."""
    w = Window.partitionBy("db_name", "lsn").orderBy("id")
    return events.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def latest(versions: DataFrame, *by: str) -> DataFrame:
    """Of appended versions (column ingest_seq; is_deleted marks a retraction) the last of each (db_name, lsn), without retracted ones.

    max_by aggregates before the shuffle, so a key's versions don't meet in one sort. by: further columns, the same in all versions of a key; versions
    that are dealt by them already are not shuffled again."""
    keys = (*by, "db_name", "lsn")
    columns = [c for c in versions.columns if c not in keys]
    # Of versions with one sequence number the one of larger hash, so that the choice doesn't depend on the run.
    last = versions.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct("ingest_seq", F.xxhash64(*columns))).alias("v")).select(*keys, "v.*")
    return last.where(~F.coalesce("is_deleted", F.lit(False))) if "is_deleted" in versions.columns else last


def retracted(versions: DataFrame, keys: DataFrame, seq: int) -> DataFrame:
    """Retractions to append, for keys (db_name, lsn)."""
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in versions.schema if f.name not in ("db_name", "lsn", "ingest_seq", "is_deleted")]
    return keys.select("db_name", "lsn", F.lit(seq).cast("long").alias("ingest_seq"), F.lit(True).alias("is_deleted"), *blank)


def without_transactions(events: DataFrame, gone: DataFrame) -> DataFrame:
    """Without all events of the given (db_name, txn_id)."""
    return events.join(gone.select("db_name", "txn_id").distinct(), ["db_name", "txn_id"], "left_anti")


def retained(events: DataFrame, now: datetime, days: int = 30) -> DataFrame:
    """Events of the last days; those without a time stay."""
    return events.where(F.col("event_time").isNull() | (F.col("event_time") >= F.lit(now - timedelta(days=days))))


def checkpoints(events: DataFrame) -> DataFrame:
    """The last lsn of each database."""
    return events.groupBy("db_name").agg(F.max("lsn").alias("lsn"))


def append(events: DataFrame, path: str, most_rows: int = 5_000_000) -> None:
    """Appends versions, one folder per database and sorted by lsn, so that filters on either skip files.

    Ranges of (database, lsn) are dealt by quantiles of the data, so a large database gets many tasks; no file has over most_rows rows."""
    events.repartitionByRange("db_name", "lsn").sortWithinPartitions("db_name", "lsn").write.option("maxRecordsPerFile", most_rows).mode("append").partitionBy("db_name").parquet(path)


def reset(events: DataFrame, path: str, saved: str | None = None) -> None:
    """Empties the event table at path (and the checkpoints at `saved`)."""
    events.limit(0).write.mode("overwrite").parquet(path)
    if saved:
        events.limit(0).select("db_name", "lsn", F.lit(0).cast("long").alias("seq")).write.mode("overwrite").parquet(saved)


def save_checkpoints(last: DataFrame, seq: int, path: str) -> None:
    """Appends the last lsn of databases (db_name, lsn) under a number that grows; an empty lsn clears a database's checkpoint."""
    last.select("db_name", "lsn", F.lit(seq).cast("long").alias("seq")).write.mode("append").parquet(path)


def load_checkpoints(saved: DataFrame) -> DataFrame:
    """db_name and its last saved lsn; databases without one are left out."""
    return saved.groupBy("db_name").agg(F.max_by("lsn", F.struct("seq", "lsn")).alias("lsn")).where("lsn <> ''")


def overwrite_retained(spark, path: str, out: str, now: datetime, days: int = 30) -> None:
    """Writes the retained latest versions to a new place; readers change over when it is whole."""
    retained(latest(spark.read.parquet(path)), now, days).write.partitionBy("db_name").parquet(out)


def export(events: DataFrame, path: str) -> None:
    """NDJSON in the order of ids."""
    from ..plans.log_queries import export_ndjson

    export_ndjson(events).orderBy("id").select("line").write.text(path)


# Columns of the table of analysed updates.
UPDATE_COLUMNS = (
    "id", "source_database", "schema_name", "table_name", "current_lsn", "transaction_id", "operation", "context", "page_id", "slot_id", "alloc_unit_id", "partition_id", "rowlog0_hex", "rowlog1_hex", "rowlog2_hex", "rowlog3_hex",
    "mr1_hex", "mr0_hex", "before_json", "after_json", "changed_columns_json", "equivalent_redo_sql", "equivalent_undo_sql", "status", "confidence", "error_message", "debug_json", "created_at",
)


def update_events(analysed: DataFrame, schema_name: str, table_name: str) -> DataFrame:
    """Rows of `analyzer.analyze` over log records as UPDATE_COLUMNS. The id follows from database and lsn, so a record has one row however often it is read."""
    have, upper = set(analysed.columns), lambda c: F.when(F.length(c) > 0, F.upper(F.hex(c)))
    named = {"source_database": "db_name", "current_lsn": "lsn", "equivalent_redo_sql": "redo", "equivalent_undo_sql": "undo"}
    made = {
        "id": F.sha2(F.concat_ws("|", "db_name", "lsn"), 256), "schema_name": F.lit(schema_name), "table_name": F.lit(table_name), **{f"rowlog{k}_hex": upper(f"contents{k}") for k in range(4) if f"contents{k}" in have},
        "mr1_hex": upper("after_image"), "mr0_hex": upper("before_image"), "changed_columns_json": F.to_json("changed"), "created_at": F.current_timestamp(),
    }
    pick = lambda c: made.get(c, F.col(named.get(c, c)) if named.get(c, c) in have else F.lit(None).cast("string"))
    return analysed.select(*[pick(c).alias(c) for c in UPDATE_COLUMNS]).dropDuplicates(["id"])


def write_update_events(rows: DataFrame, path: str) -> None:
    """Appends the rows whose id the table at path does not have."""
    spark = rows.sparkSession
    try:
        rows = rows.join(spark.read.parquet(path).select("id"), "id", "left_anti").select(*UPDATE_COLUMNS)
    except AnalysisException:  # no table yet
        pass
    rows.write.mode("append").parquet(path)
