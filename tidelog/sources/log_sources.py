"""Log records, catalog, backups and page dumps as DataFrames, with the filters that the sources take."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.predicates import is_base_row, is_data_op
from ..operators.range_join import sweep_join
from ..operators.resolve import small


def normalized(raw: DataFrame, db: str | None = None) -> DataFrame:
    """Columns of S.LOG_RECORDS by name, whatever the source has: absent or null texts are '', ids 0, offset and size -1, slots under 0 null."""
    out = []
    have = {c.lower().replace(" ", "_"): c for c in raw.columns}
    for item in S.LOG_RECORDS.split(", "):
        name, kind = item.split()
        c = F.col(f"`{have[name]}`").cast(kind) if name in have else F.lit(None).cast(kind)
        if name == "db_name" and db is not None:
            c = F.lit(db)
        elif name == "slot_id":
            c = F.when(c >= 0, c)
        elif name in ("offset_in_row", "modify_size"):
            c = F.coalesce(c, F.lit(-1))
        elif kind == "bigint":
            c = F.coalesce(c, F.lit(0).cast("long"))
        elif name in ("begin_time", "end_time"):
            stamp = F.try_to_timestamp(F.replace(c, F.lit("T"), F.lit(" ")))
            c = F.coalesce(F.when(c.rlike(r"^\d{4}-"), F.date_format(stamp, "yyyy/MM/dd HH:mm:ss:SSS")), c, F.lit(""))
        elif kind == "string":
            c = F.coalesce(c, F.lit(""))
        out.append(c.alias(name))
    return raw.select(*out)


def read_records(spark: SparkSession, path: str, db: str | None = None, fmt: str = "parquet") -> DataFrame:
    return normalized(spark.read.format(fmt).load(path), db)


def live(records: DataFrame, after: str = "") -> DataFrame:
    """What the live log is asked for: control records, and rows of user tables' own storage, past the cursor."""
    name = F.coalesce("alloc_unit_name", F.lit(""))
    data = is_data_op(F.col("operation")) & is_base_row(F.col("context")) & ~name.like("sys.%") & ~name.like("Unknown Alloc Unit%")
    found = records.where(F.col("operation").isin(*S.CONTROL_OPS) | data)
    return found.where(F.col("lsn") > after) if after else found


def after_checkpoints(records: DataFrame, saved: DataFrame) -> DataFrame:
    """Records of many databases, each past its own checkpoint (db_name, lsn); all of those without one."""
    own = small(saved.select("db_name", F.col("lsn").alias("_saved")))
    return records.join(own, "db_name", "left").where(F.col("lsn") > F.coalesce("_saved", F.lit(""))).select(*records.columns)


def dump(records: DataFrame, operations: Iterable[str], start: str = "", end: str = "") -> DataFrame:
    """What a log backup is asked for: operations, after `start`, up to `end`."""
    found = records.where(F.col("operation").isin(*operations))
    if start:
        found = found.where(F.col("lsn") > start)
    return found.where(F.col("lsn") <= end) if end else found


def both(backups: DataFrame, log: DataFrame) -> DataFrame:
    """Backups, then the live log; source_rank says which was read first."""
    return backups.withColumn("source_rank", F.lit(0)).unionByName(log.withColumn("source_rank", F.lit(1)), allowMissingColumns=True)


def backup_window(backups: DataFrame, since: datetime, most: int = 512) -> DataFrame:
    """The first `most` backups finished since then and the one just before, each path once, at its first place (column row).

    The window of all rows is over `most` + 1 rows at most: both parts are top-k."""
    inside = backups.where(F.col("finished") >= F.lit(since)).orderBy("finished", "backup_id").limit(most)
    before = backups.where(F.col("finished") < F.lit(since)).orderBy(F.desc("finished"), F.desc("backup_id")).limit(1)
    numbered = inside.union(before).distinct().withColumn("row", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("finished", "backup_id")).cast("long"))
    return numbered.groupBy("path").agg(F.min("row").alias("row"), F.min_by("backup_id", "row").alias("backup_id"))


def backup_list(backups: DataFrame, most: int = 500) -> DataFrame:
    """The newest backups with their size in MB."""
    return backups.withColumn("size_mb", (F.col("bytes") / 1048576).cast("decimal(10,1)")).orderBy(F.desc("finished"), F.desc("backup_id")).limit(most)


def gap_backups(backups: DataFrame, lsn, now: datetime, most: int = 64, days: int = 7) -> DataFrame:
    """Backups of the last days that reach the lsn (a decimal), in log order."""
    return backups.where((F.col("last_lsn") >= F.lit(lsn)) & (F.col("finished") >= F.lit(now - timedelta(days=days)))).orderBy("first_lsn").limit(most)


def covering_backups(points: DataFrame, backups: DataFrame, lsn: str, most: int | None = None) -> DataFrame:
    """Points joined with the backups whose range [first_lsn, last_lsn] holds them; with `most`, with the first so many by backup_id. See range_join."""
    return sweep_join(points, backups, lsn, "first_lsn", "last_lsn", most, "backup_id")


def user_databases(databases: DataFrame) -> DataFrame:
    return databases.where("database_id > 4 and state_desc = 'ONLINE'").select("name").orderBy("name")


def table_columns(tables: DataFrame, columns: DataFrame, types: DataFrame) -> DataFrame:
    """Columns of user tables without computed ones: object_id, column_id, name, type id, size, precision, scale, nullable, identity."""
    return tables.where("not is_ms_shipped").join(columns.where("not is_computed"), "object_id").join(types.select("user_type_id", "system_type_id"), "user_type_id")


def physical_columns(physical: DataFrame, columns: DataFrame) -> DataFrame:
    """Stored columns; those whose logical column is gone are named after their id and marked."""
    logical = columns.select("object_id", "column_id", F.col("name").alias("_name"))
    j = physical.join(logical, ["object_id", "column_id"], "left")
    return j.withColumn("dropped", F.col("_name").isNull()).withColumn("name", F.coalesce("_name", F.concat(F.lit("_dropped_"), F.col("column_id")))).drop("_name")


def keys(index_columns: DataFrame) -> DataFrame:
    """Key columns of each table in key order, as an array."""
    ordered = F.sort_array(F.collect_list(F.struct("key_ordinal", "column_id")))
    return index_columns.where("is_primary_key").groupBy("object_id").agg(F.transform(ordered, lambda x: x["column_id"]).alias("key"))


def fingerprint(tables: DataFrame, columns: DataFrame, partitions: DataFrame) -> DataFrame:
    """One row that changes when the catalog does."""
    t = tables.agg(F.count(F.lit(1)).alias("n_tables"), F.max("modify_date").alias("modified"))
    c = columns.agg(F.count(F.lit(1)).alias("n_columns"))
    p = partitions.agg(F.bit_xor(F.xxhash64("object_id", "partition_id", "code")).alias("partitions"))
    return t.crossJoin(c).crossJoin(p)  # three single rows


def page_images(dump_lines: DataFrame) -> DataFrame:
    """Row images from page dumps. Lines have page_id, object (such as "Slot 3, Offset 0x60, ..."), field, value ("address: HEX HEX ... text").

    Hex words are read until the first that is no run of byte pairs; a slot's lines are put together by address."""
    lines = dump_lines.where(F.col("object").contains("Slot ") & F.col("object").contains("Memory Dump"))
    address = F.regexp_extract("value", r"^\s*([0-9A-Fa-f]+):", 1)
    words = F.split(F.trim(F.regexp_replace("value", r"^\s*[0-9A-Fa-f]+:", "")), r"\s+")
    stop = F.array_position(F.transform(words, lambda w: w.rlike("^([0-9A-Fa-f]{2})+$")), False)
    good = F.when(stop > 0, F.slice(words, F.lit(1), stop.cast("int") - 1)).otherwise(words)
    rows = lines.select("page_id", F.regexp_extract("object", r"Slot (\d+)", 1).cast("int").alias("slot_id"), F.conv(address, 16, 10).cast("long").alias("at"), F.unhex(F.array_join(good, "")).alias("data"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", F.hex("data").alias("h")))), lambda x: x["h"]), "")
    return rows.groupBy("page_id", "slot_id").agg(F.unhex(joined).alias("image"))
