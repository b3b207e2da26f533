"""Which table and which compression a log record belongs to: equi left joins with catalog tables, by priority.

The catalog grows with the number of tables and partitions, not with the log. Its size is checked: up to `most` rows it is broadcast, beyond
that the joins are left to Spark's own choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import is_data_op, is_other_index


def small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """df with a broadcast hint if it has at most `most` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def resolve_storage(records: DataFrame, tables: DataFrame, partitions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds object_id and match (alloc_unit, partition, name or null).

    A hit on an alloc unit is final, then one on a partition, even if its object is no known table; then the name, of two parts, or of three
    if the last is the table's base index. tables: object_id, schema_name, table_name, base_index; partitions: object_id, alloc_unit_id, partition_id.
    by: further columns of all three that have to agree, such as a version of the catalog."""
    units = partitions.where("alloc_unit_id <> 0").groupBy(*by, "alloc_unit_id").agg(F.min("object_id").alias("_unit"))
    parts = partitions.where("partition_id <> 0").groupBy(*by, "partition_id").agg(F.min("object_id").alias("_part"))
    # Names that differ in case alone mean the table of the smallest id, so that no record is doubled.
    names = tables.groupBy(*by, F.lower(F.concat_ws(".", "schema_name", "table_name")).alias("_name")).agg(F.min("object_id").alias("_named"), F.min_by(F.lower("base_index"), "object_id").alias("_base"))
    known = tables.select(F.col("object_id").alias("_known")).distinct()
    piece = F.split("alloc_unit_name", r"\.", 3)
    r = records.withColumn("_pieces", piece).withColumn("_name", F.lower(F.concat_ws(".", F.col("_pieces")[0], F.get("_pieces", F.lit(1)))))
    r = r.join(small(units), [*by, "alloc_unit_id"], "left").join(small(parts), [*by, "partition_id"], "left").join(small(names), [*by, "_name"], "left")
    named = F.when((F.size("_pieces") == 2) | ((F.size("_pieces") == 3) & (F.lower(F.get("_pieces", F.lit(2))) == F.col("_base"))), F.col("_named"))
    match = F.when(F.col("_unit").isNotNull(), "alloc_unit").when(F.col("_part").isNotNull(), "partition").when(named.isNotNull(), "name")
    r = r.withColumn("match", match).withColumn("_object", F.when(F.col("match") == "alloc_unit", F.col("_unit")).when(F.col("match") == "partition", F.col("_part")).otherwise(named))
    r = r.join(small(known), r["_object"] == F.col("_known"), "left")
    return r.withColumn("object_id", F.col("_known")).drop("_pieces", "_name", "_unit", "_part", "_named", "_base", "_object", "_known")


def unknown_storage(records: DataFrame, catalog) -> DataFrame:
    """What data records of no known table name: db_name, alloc_unit_name, alloc_unit_id, partition_id, records, first_lsn (and the catalog's further keys).

    A catalog that lacks them may be out of date. Other indexes of known tables are left out, since none of their rows is told anyway."""
    by, tables = catalog.by, catalog.tables
    data = records.where(is_data_op(F.col("operation"))).select("db_name", "lsn", "alloc_unit_name", "alloc_unit_id", "partition_id", *by)
    keys = ("db_name", "alloc_unit_name", "alloc_unit_id", "partition_id", *by)
    # A log names few allocation units; they are looked up, not its records.
    units = data.groupBy(*keys).agg(F.count(F.lit(1)).alias("records"), F.min("lsn").alias("first_lsn"))
    lost = resolve_storage(units, tables, catalog.partitions.select("object_id", "alloc_unit_id", "partition_id", *by), by).where("object_id is null").drop("object_id", "match")
    names = tables.groupBy(*by, F.lower(F.concat_ws(".", "schema_name", "table_name")).alias("_name")).agg(F.min_by("base_index", "object_id").alias("_base"))
    piece = F.split("alloc_unit_name", r"\.", 3)
    lost = lost.withColumn("_name", F.lower(F.concat_ws(".", piece[0], F.get(piece, F.lit(1))))).join(small(names), [*by, "_name"], "left")
    return lost.where(~is_other_index(F.col("alloc_unit_name"), F.coalesce("_base", F.lit("")))).select(*keys, "records", "first_lsn")


def compression_name(code: Column) -> Column:
    return F.when(code == 0, "NONE").when(code == 1, "ROW").when(code == 2, "PAGE").when(code.isin(3, 4), "COLUMNSTORE").otherwise("UNKNOWN")


def resolve_compression(records: DataFrame, partitions: DataFrame, table_default: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds compression: of the alloc unit, else the partition, else the table (object_id, code), else UNKNOWN."""
    units = partitions.where("alloc_unit_id <> 0").groupBy(*by, "alloc_unit_id").agg(F.max("code").alias("_u"))
    parts = partitions.where("partition_id <> 0").groupBy(*by, "partition_id").agg(F.max("code").alias("_p"))
    default = table_default.groupBy("object_id").agg(F.max("code").alias("_t"))
    r = records.join(small(units), [*by, "alloc_unit_id"], "left").join(small(parts), [*by, "partition_id"], "left").join(small(default), "object_id", "left")
    return r.withColumn("compression", compression_name(F.coalesce("_u", "_p", "_t"))).drop("_u", "_p", "_t")


def table_compression(default: DataFrame, partitions: DataFrame) -> DataFrame:
    """The highest code of each table, of its own and its partitions' codes."""
    return default.select("object_id", "code").union(partitions.select("object_id", "code")).groupBy("object_id").agg(F.max("code").alias("code"))


def partition_links(partitions: DataFrame, units: DataFrame) -> DataFrame:
    """Partitions with their alloc units, which name a container by either of two ids: two equi-joins instead of an OR join."""
    p = partitions.select("object_id", "partition_id", "hobt_id")
    by_hobt = p.join(units, p["hobt_id"] == units["container_id"])
    by_id = p.join(units, p["partition_id"] == units["container_id"])
    return by_hobt.union(by_id).distinct()
