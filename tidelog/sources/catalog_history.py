"""Versions of catalogs over the log: a record is read by the layout that held in its database at its lsn.

A version is (db_name, lsn from which on it holds, catalog). `merged` makes one catalog of all of them: a table has an id for each of its layouts, equal layouts of
versions that follow each other share one, and the frames of resolution carry the version as a further key. So the log is scanned once, whatever
the number of versions and databases, and joins stay equi-joins.

`refreshed` compares fingerprints of the system tables and adds a version where they differ; `renewed` asks for that where records are of no known table. Stored columns of a partition that change between versions are those of its
table's layout."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rows as R
from ..functions.predicates import is_data_op
from ..operators import resolve
from . import catalog as cat
from . import log_sources as src

VERSION = "_version"


class Version(NamedTuple):
    db_name: str
    lsn: str
    catalog: cat.Catalog
    fingerprint: tuple = ()


def _sorted(history: list[Version]) -> list[Version]:
    return sorted(history, key=lambda v: (v.db_name, v.lsn))


def with_version(records: DataFrame, history: list[Version]) -> DataFrame:
    """Adds _version, the place of the version that holds for a record (an as-of search in the sorted list); null before a database's first."""
    known = [(v.db_name, v.lsn) for v in _sorted(history)]

    def run(db, lsn):
        out = []
        for d, x in zip(db.to_pylist(), lsn.to_pylist(), strict=True):
            k = bisect_right(known, (d, x)) - 1 if d is not None and x is not None else -1
            out.append(k if k >= 0 and known[k][0] == d else None)
        return pa.array(out, pa.int32())

    return records.withColumn(VERSION, R.arrow_function(run, "int")(F.col("db_name"), F.col("lsn")))


def merged(spark: SparkSession, history: list[Version]) -> cat.Catalog:
    """One catalog of all versions, for records with _version."""
    history = _sorted(history)
    specs: dict = {}
    last: dict = {}  # (db_name, object_id): the id of the layout in the version before
    frames = []
    stored: dict = {}
    for k, v in enumerate(history):
        ids = {}
        for i, spec in v.catalog.specs.items():
            same = last.get((v.db_name, i))
            if same is None or specs[same] != spec:
                same = len(specs) + 1
                specs[same] = spec
            last[v.db_name, i] = ids[i] = same
        for p, columns in v.catalog.stored.items():
            stored[p] = columns if stored.get(p, columns) == columns else None
        names = spark.createDataFrame(list(ids.items()), "object_id int, _id int")
        # What belongs to no known table still ends the search for one.
        own = lambda df, names=names: df.join(names, "object_id", "left").withColumn("object_id", F.coalesce("_id", F.lit(-1))).drop("_id")
        mark = F.lit(k).cast("int").alias(VERSION)
        frames.append((own(v.catalog.tables).select("object_id", "schema_name", "table_name", "base_index", mark), own(v.catalog.partitions).select("object_id", "alloc_unit_id", "partition_id", "code", mark), own(v.catalog.default).select("object_id", "code")))
    tables, partitions, default = (reduce(DataFrame.unionByName, parts) for parts in zip(*frames, strict=True))
    return cat.Catalog(specs, {p: c for p, c in stored.items() if c is not None}, tables, partitions, default.distinct(), (VERSION,))


def refreshed(spark: SparkSession, history: list[Version], db: str, lsn: str, frames: dict[str, DataFrame]) -> tuple[list[Version], bool]:
    """(history, whether it changed): with a version of the system tables' frames from the lsn on, if they are not what the database's last version was made of."""
    partitions = frames["partitions"]
    partitions = partitions if "code" in partitions.columns else partitions.withColumnRenamed("data_compression", "code")
    now = tuple(src.fingerprint(frames["tables"], frames["columns"], partitions).first())
    own = [v for v in _sorted(history) if v.db_name == db]
    if own and own[-1].fingerprint == now:
        return history, False
    return [*history, Version(db, lsn, cat.extract(spark, frames), now)], True


def renewed(records: DataFrame, history: list[Version], frames_of: Callable[[str], dict[str, DataFrame]]) -> tuple[list[Version], bool]:
    """(history, whether it changed): where records are of no known table, `refreshed` by the database's system tables (frames_of its name), from the first of
    these records on. One row for each database comes to the driver."""
    spark = records.sparkSession
    known = {v.db_name for v in history}
    bare = records.where(is_data_op(F.col("operation")) & ~F.col("db_name").isin(*known)) if known else records.where(is_data_op(F.col("operation")))
    lost = bare.select("db_name", F.col("lsn").alias("first_lsn"))
    if history:
        lost = lost.unionByName(resolve.unknown_storage(with_version(records, history).where(F.col("db_name").isin(*known)), merged(spark, history)).select("db_name", "first_lsn"))
    changed = False
    for r in lost.where("db_name is not null").groupBy("db_name").agg(F.min("first_lsn").alias("lsn")).orderBy("db_name").collect():
        history, new = refreshed(spark, history, r.db_name, r.lsn, frames_of(r.db_name))
        changed |= new
    return history, changed


def forgotten(history: list[Version], db: str, lsn: str) -> list[Version]:
    """Without versions that no record past the lsn is read by."""
    own = [v for v in _sorted(history) if v.db_name == db and v.lsn <= lsn]
    return [v for v in history if v not in own[:-1]]
