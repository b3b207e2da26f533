"""The catalog of a database: frames of its system tables -> one TableSpec for each user table, and the small frames that resolution joins.

Frames by name (columns as the system tables have them; all but tables, columns and types may be missing):
tables (object_id, schema_name, table_name, is_ms_shipped), columns (object_id, column_id, name, user_type_id, max_length, precision, scale,
is_nullable, is_identity, is_computed), types (user_type_id, system_type_id), index_columns (object_id, column_id, key_ordinal, is_primary_key),
indexes (object_id, index_id, name), partitions (object_id, index_id, partition_number, partition_id, hobt_id, data_compression),
units (container_id, allocation_unit_id, type_desc), physical (object_id, partition_id, column_id, system_type_id, max_inrow_length, leaf_offset).

A catalog grows with the number of tables, not with the log; `most` bounds the columns that the driver takes."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import ColumnSpec, TableSpec
from ..operators import resolve
from . import log_sources as src

BASE_INDEXES = (0, 1)  # a heap, a clustered index


@dataclass
class Catalog:
    """Specs by object id; stored columns by partition id; tables, partitions and default compression as frames for resolution. by: columns besides that
    records have to agree in with tables and partitions (see catalog_history)."""

    specs: dict[int, TableSpec]
    stored: dict[int, tuple[ColumnSpec, ...]]
    tables: DataFrame
    partitions: DataFrame
    default: DataFrame
    by: tuple[str, ...] = ()

    def spec(self, object_id: int, partition_id: int | None = None) -> TableSpec | None:
        """The table, with the stored columns of the partition where they are known."""
        spec = self.specs.get(object_id)
        stored = self.stored.get(partition_id) if partition_id else None
        return replace(spec, physical=stored, places={}) if spec is not None and stored else spec


def column_rows(frames: dict[str, DataFrame]) -> DataFrame:
    """Logical columns of user tables: object_id, schema_name, table_name, column_id, name, type, length, precision, scale, nullable, identity."""
    found = src.table_columns(frames["tables"], frames["columns"], frames["types"])
    return found.select(
        F.col("object_id").cast("int").alias("object_id"), "schema_name", "table_name", F.col("column_id").cast("int").alias("column_id"), "name", F.col("system_type_id").cast("int").alias("type"), F.col("max_length").cast("int").alias("length"),
        F.col("precision").cast("int").alias("precision"), F.col("scale").cast("int").alias("scale"), F.col("is_nullable").alias("nullable"), F.col("is_identity").alias("identity"),
    )


def stored_rows(frames: dict[str, DataFrame]) -> DataFrame:
    """Stored columns of each partition in physical order: object_id, partition_id, place, column_id, name, type, length, dropped.

    A column that the table no longer has is named after its id, with the length of its stored form."""
    found = src.physical_columns(frames["physical"], frames["columns"].select("object_id", "column_id", "name"))
    place = F.row_number().over(src.Window.partitionBy("object_id", "partition_id").orderBy("leaf_offset", "column_id"))
    return found.select("object_id", "partition_id", place.alias("place"), "column_id", "name", F.col("system_type_id").cast("int").alias("type"), F.col("max_inrow_length").cast("int").alias("length"), "dropped")


def partition_rows(frames: dict[str, DataFrame]) -> DataFrame:
    """Base partitions with their alloc units: object_id, alloc_unit_id, partition_id, code."""
    base = frames["partitions"].where(F.col("index_id").isin(*BASE_INDEXES))
    links = resolve.partition_links(base, frames["units"].select("container_id", "allocation_unit_id")) if "units" in frames else None
    codes = base.select("partition_id", F.col("data_compression").cast("int").alias("code"))
    if links is None:
        return base.select("object_id", F.lit(0).cast("long").alias("alloc_unit_id"), "partition_id", F.col("data_compression").cast("int").alias("code"))
    units = links.select("partition_id", F.col("allocation_unit_id").alias("alloc_unit_id"))
    return base.select("object_id", "partition_id").join(codes, "partition_id").join(units, "partition_id", "left").select("object_id", F.coalesce("alloc_unit_id", F.lit(0)).cast("long").alias("alloc_unit_id"), "partition_id", "code")


def _bounded(df: DataFrame, most: int) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the catalog has over {most} rows; give a larger bound")
    return rows


def extract(spark: SparkSession, frames: dict[str, DataFrame], most: int = 1_000_000) -> Catalog:
    """The catalog of frames. A table's compression is the highest of its base partitions; its stored columns are those of its first partition."""
    columns: dict = {}
    heads: dict = {}
    for r in _bounded(column_rows(frames), most):
        heads[r.object_id] = (r.schema_name, r.table_name)
        columns.setdefault(r.object_id, []).append(ColumnSpec(r.column_id, r.name, r.type, r.length or 0, r.precision or 0, r.scale or 0, bool(r.nullable), bool(r.identity)))
    keys = {r.object_id: tuple(r.key) for r in _bounded(src.keys(frames["index_columns"]), most)} if "index_columns" in frames else {}
    base = {r.object_id: r.name for r in _bounded(frames["indexes"].where("index_id = 1").select("object_id", "name"), most)} if "indexes" in frames else {}
    empty = "object_id int, alloc_unit_id long, partition_id long, code int"
    partitions = partition_rows(frames) if "partitions" in frames else spark.createDataFrame([], empty)
    default = resolve.table_compression(partitions.select("object_id", "code"), partitions)
    codes = {r.object_id: r.code for r in _bounded(default, most)}
    stored: dict = {}
    first: dict = {}
    for r in sorted(_bounded(stored_rows(frames), most), key=lambda r: (r.object_id, r.partition_id, r.place)) if "physical" in frames else []:
        known = next((c for c in columns.get(r.object_id, ()) if c.id == r.column_id), None) if not r.dropped else None
        stored.setdefault(r.partition_id, []).append(known or ColumnSpec(r.column_id, r.name, r.type, r.length or 0, dropped=bool(r.dropped)))
        first.setdefault(r.object_id, r.partition_id)
    stored = {p: tuple(c) for p, c in stored.items()}
    names = {0: "NONE", 1: "ROW", 2: "PAGE", 3: "COLUMNSTORE", 4: "COLUMNSTORE"}
    specs = {
        i: TableSpec(*heads[i], tuple(sorted(c, key=lambda x: x.id)), keys.get(i, ()), names.get(codes.get(i), "UNKNOWN" if codes.get(i) is None else "NONE"), i, base.get(i, ""), stored.get(first.get(i), ()))
        for i, c in columns.items()
    }
    return of_specs(spark, specs, stored, partitions, default)


def of_specs(spark: SparkSession, specs: dict[int, TableSpec], stored: dict | None = None, partitions: DataFrame | None = None, default: DataFrame | None = None) -> Catalog:
    """A catalog of specs at hand. Without partitions, records resolve by name, and compression is the table's own."""
    codes = {"NONE": 0, "ROW": 1, "PAGE": 2, "COLUMNSTORE": 3}
    rows = [(i, s.schema, s.name, s.base_index) for i, s in specs.items()]
    tables = spark.createDataFrame(rows, "object_id int, schema_name string, table_name string, base_index string")
    if default is None:
        default = spark.createDataFrame([(i, codes[s.compression]) for i, s in specs.items() if s.compression in codes], "object_id int, code int")
    if partitions is None:
        partitions = spark.createDataFrame([], "object_id int, alloc_unit_id long, partition_id long, code int")
    return Catalog(specs, stored or {}, tables, partitions, default)


def only(catalog: Catalog, names: list[str]) -> Catalog:
    """The tables whose bracketed name is in the list, whatever its case; all of them if it is empty."""
    wanted = {n.lower() for n in names}
    return replace(catalog, specs={i: s for i, s in catalog.specs.items() if not wanted or s.full_name.lower() in wanted})


def save_json(catalog: Catalog, path: str) -> None:
    """One JSON text with all tables, as a text file of one line."""
    spark = catalog.tables.sparkSession
    spark.createDataFrame([(to_json(catalog),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def to_json(catalog: Catalog) -> str:
    tables = []
    for i, s in catalog.specs.items():
        t = asdict(s) | {"object_id": i}
        t.pop("places")
        tables.append(t)
    return json.dumps({"tables": tables})


def load_json(spark: SparkSession, path: str) -> Catalog:
    """What save_json wrote. Partitions and alloc units are not part of it, so records resolve by name."""
    return of_json(spark, "".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def of_json(spark: SparkSession, text: str) -> Catalog:
    specs = {}
    for t in json.loads(text)["tables"]:
        for k in ("columns", "physical"):
            t[k] = tuple(ColumnSpec(**c) for c in t[k])
        specs[t["object_id"]] = TableSpec(**(t | {"key": tuple(t["key"])}))
    return of_specs(spark, specs)


def spec_rows(catalog: Catalog) -> DataFrame:
    """The specs' columns as rows: object_id, full_name, column_id, name, type, declared, nullable, key."""
    from ..functions.types import type_name

    rows = [(i, s.full_name, c.id, c.name, c.type, type_name(c), c.nullable, c.id in s.key) for i, s in catalog.specs.items() for c in s.columns]
    return catalog.tables.sparkSession.createDataFrame(rows, "object_id int, full_name string, column_id int, name string, type int, declared string, nullable boolean, key boolean")
