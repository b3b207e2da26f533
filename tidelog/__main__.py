"""python -m tidelog schema FRAMES OUT | scan RECORDS CATALOG OUT: a catalog as JSON from tables of system views, and events from log records."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.lsn import log_time, parse_since
from .functions.predicates import is_cleanup_delete
from .operators import generate
from .sources import catalog, log_sources

FRAMES = ("tables", "columns", "types", "index_columns", "indexes", "partitions", "units", "physical")


def frames_of(spark: SparkSession, path: str) -> dict:
    """The Parquet tables of system views under a folder; of those that are optional, the ones that are there."""
    from pyspark.errors import AnalysisException

    found = {}
    for name in FRAMES:
        try:
            found[name] = spark.read.parquet(f"{path}/{name}")
        except AnalysisException:
            if name in FRAMES[:3]:
                raise
    return found


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tidelog", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    schema = commands.add_parser("schema", help="writes the catalog of a folder of system views as JSON")
    schema.add_argument("frames")
    schema.add_argument("out")
    scan = commands.add_parser("scan", help="writes the events of a Parquet table of log records")
    for name in ("records", "catalog", "out"):
        scan.add_argument(name)
    scan.add_argument("--db", help="name of the database, where the records have none")
    scan.add_argument("--since", default="all", help="all, now, 7d, 12h30m: transactions that began since then")
    scan.add_argument("--table", action="append", default=[], help="[schema].[table]; may be repeated")
    scan.add_argument("--uncommitted", action="store_true", help="also transactions without a commit")
    scan.add_argument("--pages", help="Parquet table of current row images (db_name, page_id, slot_id, image)")
    o = parser.parse_args(args)
    spark = SparkSession.builder.appName("tidelog").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if o.command == "schema":
        catalog.save_json(catalog.extract(spark, frames_of(spark, o.frames)), o.out)
        return
    records = log_sources.read_records(spark, o.records, o.db)
    records = records.withColumn("seen_at", F.coalesce(log_time(F.col("begin_time")), log_time(F.col("end_time")))).withColumn("cleanup", is_cleanup_delete(F.col("operation"), F.col("contents0")))
    known = catalog.only(catalog.load_json(spark, o.catalog), o.table)
    pages = spark.read.parquet(o.pages) if o.pages else None
    since = parse_since(o.since)
    generate.scan(records, known, pages, since.replace(tzinfo=None) if since else None, not o.uncommitted).write.mode("overwrite").parquet(o.out)


if __name__ == "__main__":
    main()
