"""Activity over time in sessions whose zone is not UTC."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidelog.operators.indexed_store import IndexedStore
from tidelog.plans import log_queries as Q

SINCE = datetime(2024, 3, 10, 0, 0, 0, 500000)
UNTIL = SINCE + timedelta(hours=6)
# One in the hour that New York skips on that day, one a microsecond behind the last second that counts.
TIMES = [datetime(2024, 3, 10, 0, 30), datetime(2024, 3, 10, 2, 30), datetime(2024, 3, 10, 3, 30, 0, 1), datetime(2024, 3, 10, 6, 0), datetime(2024, 3, 10, 6, 0, 0, 1), None]
WANT = [(0, 1), (2, 1), (3, 1), (5, 1)]


def _events(spark):
    rows = [(i, f"{i:04d}", "t", "INSERT", "db0", "dbo", "T", "x", "y", t, t, "ok") for i, t in enumerate(TIMES)]
    kinds = "id long, lsn string, txn_id string, operation string, db_name string, schema_name string, table_name string, sql_stmt string, rollback_sql string, event_time timestamp_ntz, commit_time timestamp_ntz, status string"
    return spark.createDataFrame(rows, kinds)


def test_times_without_a_zone(spark, tmp_path):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            events = _events(spark)
            assert sorted((r.bucket, r.total) for r in Q.timeline(events, SINCE, UNTIL, 6, dense=False).collect()) == WANT
            store = IndexedStore(spark, f"{tmp_path}/{zone.replace('/', '-')}")
            store.upsert(events, 0)
            assert sorted((r.bucket, r.total) for r in store.timeline(SINCE, UNTIL, 6).collect()) == WANT
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_times_with_a_zone(spark):
    """Instants count as they are."""
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        events = spark.range(3).select(F.timestamp_seconds(F.lit(int((SINCE - datetime(1970, 1, 1)).total_seconds())) + 1800 + F.col("id") * 3600).alias("event_time"), F.lit("UPDATE").alias("operation"))
        assert sorted((r.bucket, r.updates) for r in Q.timeline(events, SINCE, UNTIL, 6, dense=False).collect()) == [(0, 1), (1, 1), (2, 1)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
