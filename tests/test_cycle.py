"""The poll cycle: a log followed in two starts, the gap between them filled from backups, equal to a scan of everything."""

from pyspark.sql import functions as F

from tidelog.operators import generate
from tidelog.operators.ranged_store import RangedStore
from tidelog.scan_queries import _catalog, _records
from tidelog.sources import log_table
from tidelog.streaming import cycle

SF = "/root/testdata/sf0.001"


def test_two_starts_and_a_gap(spark, tmp_path):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        frame = _records(spark, SF).where("transaction_id in ('o2', 'o11', 'c1')")
        frame = frame.withColumn("begin_time", F.coalesce(F.date_format("seen_at", "yyyy/MM/dd HH:mm:ss:SSS"), F.lit(""))).withColumn("end_time", F.lit("")).drop("seen_at", "cleanup")
        every = sorted(frame.collect(), key=lambda r: r.lsn)
        part = lambda a, b: spark.createDataFrame(every[a:b], frame.schema)
        log, backups, known = str(tmp_path / "log"), str(tmp_path / "backups"), _catalog(spark)
        table = RangedStore(spark, str(tmp_path / "events"), 100)

        def run():
            q = cycle.poll(spark, log, known, table, str(tmp_path / "ck"), {"availableNow": True}, shares=2)
            assert q.awaitTermination(200)

        n = len(every)
        a, b = n // 3, n // 2
        log_table.write_log(part(0, a), log, files=1)
        run()
        saved = every[a - 1].lsn
        # The log goes on after a pause; what lies between is in a backup, and so is its first record.
        after = str(tmp_path / "after")
        log_table.write_log(part(b, n), after, files=1)
        log_table.write_log(part(0, b + 1), backups, files=1)
        assert cycle.fill_gap(spark, after, backups, "db0", "") is False and cycle.fill_gap(spark, after, backups, "db0", saved) is False
        assert log_table.read_log(spark, after).where(f"lsn > '{saved}'").count() == n - a
        assert cycle.fill_gap(spark, after, backups, "db0", saved) is False
        log_table.write_log(log_table.read_log(spark, after), log, files=1)
        run()
        want = generate.scan(cycle.stamped(spark.createDataFrame(every, frame.schema)), known)
        key = lambda r: (r.lsn, r.sql_stmt, r.rollback_sql, r.status)
        assert sorted(map(key, table.read().collect()), key=str) == sorted(map(key, want.collect()), key=str) and want.count() > 3
        assert table.state().checkpoints["db0"] == max(r.lsn for r in table.read().collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
