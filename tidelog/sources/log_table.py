"""A table of log records that is read by cursor: batches of a range of the log, and a stream whose offsets are log sequence numbers by database.

`write_log` appends records in files sorted by (db_name, lsn), and a row of `ranges` for each file and database: its first and last lsn. A reader takes filters on
db_name, lsn and operation. It plans one task for each file whose range they touch, the others are never opened; in a file, groups of rows are skipped by their
statistics. Records come in pages of `chunk` rows; the last lsn of a page is the cursor of the next one, so a page that does not lie past it is an error.

    log_table.register(spark)
    spark.read.format("tidelog").option("path", p).option("after", lsn).load().where("db_name = 'db0' and operation in (...)")
    spark.readStream.format("tidelog").option("path", p).load()

Live log and backups have this form in common: `source_options` makes the options of either. A batch of rows whose ranges are not written (a writer
that failed between) is never seen."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .. import schemas as S


class StalledCursor(RuntimeError):
    """A page of records that does not lie past the cursor: reading on would not end, or skip records."""


def write_log(records: DataFrame, path: str, most_rows: int = 1_000_000, files: int | None = None) -> None:
    """Appends records (columns of S.LOG_RECORDS): files first, then the ranges that make them visible."""
    batch = f"{path}/data/{uuid.uuid4().hex}"
    ranged = records.repartitionByRange(files, "db_name", "lsn") if files else records.repartitionByRange("db_name", "lsn")
    ranged.sortWithinPartitions("db_name", "lsn").write.option("maxRecordsPerFile", most_rows).parquet(batch)
    written = records.sparkSession.read.parquet(batch)
    ranges = written.groupBy(F.col("_metadata.file_path").alias("file"), "db_name").agg(F.min("lsn").alias("first_lsn"), F.max("lsn").alias("last_lsn"), F.count(F.lit(1)).alias("n"))
    ranges.coalesce(1).write.mode("append").parquet(f"{path}/ranges")


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets it take filters."""
    spark.dataSource.register(LogTable)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def source_options(kind: str, path: str, start: str = "", end: str = "", chunk: int = 5000) -> dict[str, str]:
    """Options of the live log (everything past a cursor) or of backups (past start, up to end)."""
    if kind not in ("log", "backup"):
        raise ValueError(f"no such kind of source: {kind}")
    return {"path": path, "after": start, "chunk": str(chunk)} | ({"until": end} if kind == "backup" and end else {})


def read_log(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("tidelog").options(path=path, **options).load()


@dataclass
class Piece(InputPartition):
    """One file's records of some databases within bounds."""

    file: str
    bounds: dict[str, tuple[str, str]] = field(default_factory=dict)  # db_name: (past, up to)
    partition_id: int = 0

    def __post_init__(self):
        super().__init__(self.partition_id)


def _place(path: str):
    """(file system, path in it) of a path or URI."""
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def _ranges(path: str) -> list[dict]:
    system, at = _place(f"{path}/ranges")
    if system.get_file_info(at).type == fs.FileType.NotFound:
        return []
    return ds.dataset(at, filesystem=system, format="parquet").to_table().to_pylist()


KINDS = {"string": StringType(), "bigint": LongType(), "int": IntegerType(), "binary": BinaryType()}
#: Above every lsn.
END = "~"


class Reader:
    """What the batch reader and the stream reader share."""

    def __init__(self, schema: StructType, options: dict):
        self.names, self.arrow = schema.fieldNames(), to_arrow_schema(schema)
        self.path, self.chunk = options["path"], int(options.get("chunk", 5000))
        if self.chunk < 1:
            raise ValueError("chunk must be positive")
        self.after, self.until, self.db = options.get("after", ""), options.get("until") or END, options.get("db")
        self.dbs, self.operations = None, options["operations"].split(",") if options.get("operations") else None

    def pieces(self, low: dict[str, str] | None = None, high: dict[str, str] | None = None) -> list[Piece]:
        """A piece for each file that holds records past `low` and up to `high` by database (past `after`, up to `until` without them)."""
        out: dict[str, Piece] = {}
        for r in sorted(_ranges(self.path), key=lambda r: (r["db_name"], r["first_lsn"], r["file"])):
            db = r["db_name"]
            if (self.db and db != self.db) or (self.dbs is not None and db not in self.dbs):
                continue
            past, to = max(self.after, (low or {}).get(db, "")), min(self.until, high.get(db, "") if high is not None else END)
            if r["last_lsn"] > past and r["first_lsn"] <= to:
                out.setdefault(r["file"], Piece(r["file"])).bounds[db] = past, to
        return list(out.values())

    def pages(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        system, at = _place(piece.file)
        table = ds.dataset(at, filesystem=system, format="parquet")
        wanted = None
        for db, (past, to) in piece.bounds.items():
            own = (ds.field("db_name") == db) & (ds.field("lsn") > past) & (ds.field("lsn") <= to)
            wanted = own if wanted is None else wanted | own
        if self.operations is not None:
            wanted &= ds.field("operation").isin(self.operations)
        columns = list(dict.fromkeys([n for n in self.names if n in table.schema.names] + ["db_name", "lsn"]))
        cursor = None
        for batch in table.scanner(columns=columns, filter=wanted, batch_size=self.chunk, use_threads=False).to_batches():
            if not batch.num_rows:
                continue
            ends = [(batch["db_name"][k].as_py(), batch["lsn"][k].as_py()) for k in (0, batch.num_rows - 1)]
            if (cursor is not None and ends[0] <= cursor) or ends[1] < ends[0]:
                raise StalledCursor(f"{piece.file}: a page from {ends[0]} to {ends[1]} after {cursor}")
            cursor = ends[1]
            yield pa.RecordBatch.from_arrays([batch[n].cast(f.type) if n in batch.schema.names else pa.nulls(batch.num_rows, f.type) for n, f in zip(self.names, self.arrow, strict=True)], schema=self.arrow)


class BatchReader(Reader, DataSourceReader):
    def pushFilters(self, filters):
        for f in filters:
            column, value = (f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None), getattr(f, "value", None)
            if column == "lsn" and isinstance(f, GreaterThan):
                self.after = max(self.after, value)
            elif column == "lsn" and isinstance(f, LessThanOrEqual):
                self.until = min(self.until, value)
            elif column == "db_name" and isinstance(f, (EqualTo, In)):
                own = {value} if isinstance(f, EqualTo) else set(value)
                self.dbs = own if self.dbs is None else self.dbs & own
            elif column == "operation" and isinstance(f, (EqualTo, In)):
                own = [value] if isinstance(f, EqualTo) else list(value)
                self.operations = own if self.operations is None else [o for o in self.operations if o in own]
            else:
                # An upper bound without its end, or a lower one with it, bounds the files; Spark tests the rows.
                if column == "lsn" and isinstance(f, (LessThan, EqualTo)):
                    self.until = min(self.until, value)
                if column == "lsn" and isinstance(f, (GreaterThanOrEqual, EqualTo)) and value:
                    self.after = max(self.after, value[:-1] + chr(ord(value[-1]) - 1) + "￿")
                yield f

    def partitions(self) -> list[Piece]:
        return self.pieces() or [Piece("")]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return self.pages(partition) if partition.file else iter(())


class StreamReader(Reader, DataSourceStreamReader):
    """Offsets are {db_name: last lsn read}. A batch reads what the ranges written since tell, whichever databases they are of."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        last: dict[str, str] = {}
        for r in _ranges(self.path):
            if not self.db or r["db_name"] == self.db:
                last[r["db_name"]] = max(last.get(r["db_name"], ""), r["last_lsn"])
        return last

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return self.pieces(start, end)

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return self.pages(partition)


class LogTable(DataSource):
    """Options: path; db, after (cursor), until, operations (comma-separated), chunk (rows a page), columns (comma-separated; all by default)."""

    @classmethod
    def name(cls) -> str:
        return "tidelog"

    def schema(self) -> StructType:
        every = StructType([StructField(name, KINDS[kind]) for name, kind in (c.split() for c in S.LOG_RECORDS.split(", "))])
        if not self.options.get("columns"):
            return every
        return StructType([every[c.strip()] for c in self.options["columns"].split(",")])

    def reader(self, schema: StructType) -> BatchReader:
        return BatchReader(schema, dict(self.options))

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(schema, dict(self.options))
