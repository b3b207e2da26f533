"""The source by cursor: ranges, pushed filters, pages, the stalled cursor, and the stream by offsets."""

import glob
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidelog import schemas as S
from tidelog.sources import log_sources, log_table


def records(spark, n, dbs=("db0", "db1"), start=0):
    i = F.col("id")
    raw = spark.range(start, start + n).select(
        F.element_at(F.array(*map(F.lit, dbs)), (i % len(dbs) + 1).cast("int")).alias("db_name"), F.format_string("%08x:%08x:%04x", F.lit(34), i, F.lit(1)).alias("lsn"),
        F.element_at(F.array(*map(F.lit, S.DATA_OPS + S.CONTROL_OPS)), (i % 7 + 1).cast("int")).alias("operation"), F.format_string("0000:%04x", i % 50).alias("transaction_id"), i.cast("int").alias("slot_id"), F.lit(b"x").alias("contents0"),
    )
    return log_sources.normalized(raw)


def test_batches_by_range(spark, tmp_path):
    path = str(tmp_path / "log")
    assert log_table.read_log(spark, path).count() == 0
    all_ = records(spark, 3000)
    log_table.write_log(all_, path, files=8)
    log_table.write_log(records(spark, 1000, ("db2",), 5000), path, files=3)
    both = all_.unionByName(records(spark, 1000, ("db2",), 5000))
    low, high = "00000022:00000200:0001", "00000022:00000600:0001"
    for where in (None, f"lsn > '{low}'", f"lsn > '{low}' and lsn <= '{high}'", f"lsn >= '{low}' and lsn < '{high}'", f"lsn = '{low}'", f"lsn > '{low}' and db_name = 'db1'", "db_name in ('db2', 'db9') and operation = 'LOP_INSERT_ROWS'", "operation in ('LOP_INSERT_ROWS', 'LOP_BEGIN_XACT') and slot_id % 3 = 0", "lsn > 'zz'", "db_name = 'db0' or lsn > 'x'"):
        got, want = log_table.read_log(spark, path, chunk=100), both
        if where:
            got, want = got.where(where), want.where(where)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), where
    got = log_table.read_log(spark, path, columns="lsn,transaction_id", after=low, until=high, db="db0", operations="LOP_INSERT_ROWS,LOP_DELETE_ROWS", chunk=7)
    want = both.where(f"lsn > '{low}' and lsn <= '{high}' and db_name = 'db0' and operation in ('LOP_INSERT_ROWS', 'LOP_DELETE_ROWS')").select("lsn", "transaction_id")
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() > 10
    assert log_table.source_options("backup", path, "a", "b") == {"path": path, "after": "a", "chunk": "5000", "until": "b"} and "until" not in log_table.source_options("log", path, "a")
    with pytest.raises(ValueError):
        log_table.source_options("tape", path)


def test_files_outside_the_range_are_not_opened(spark, tmp_path):
    """They are gone, and the read does not notice; a range that needs them does."""
    path = str(tmp_path / "log")
    log_table.write_log(records(spark, 2000, ("db0",)), path, files=10)
    ranges = spark.read.parquet(f"{path}/ranges").orderBy("first_lsn").collect()
    assert len(ranges) == 10
    for r in ranges[:3] + ranges[6:]:
        os.remove(r.file.removeprefix("file:"))
    inside = log_table.read_log(spark, path).where(f"lsn > '{ranges[2].last_lsn}' and lsn <= '{ranges[5].last_lsn}' and db_name = 'db0'")
    assert inside.count() == sum(r.n for r in ranges[3:6]) and inside.rdd.getNumPartitions() == 3
    with pytest.raises(Exception, match="FileNotFound|No such file|does not exist"):
        log_table.read_log(spark, path).where(f"lsn > '{ranges[1].first_lsn}'").count()


def test_a_cursor_that_stalls(spark, tmp_path):
    path = str(tmp_path / "log")
    log_table.write_log(records(spark, 500, ("db0",)), path, files=1)
    file = glob.glob(f"{path}/data/*/*.parquet")[0]
    table = pq.read_table(file)
    pq.write_table(table.take(list(range(200)) + list(range(100, 300))), file)
    with pytest.raises(Exception, match="StalledCursor"):
        log_table.read_log(spark, path, chunk=50).count()
    with pytest.raises(Exception, match="positive"):
        log_table.read_log(spark, path, chunk=0).count()


def test_stream_by_offsets(spark, tmp_path):
    """Each batch reads what was written since, of every database; a second start goes on from the saved offsets."""
    path, seen = str(tmp_path / "log"), []
    log_table.register(spark)

    def run():
        source = spark.readStream.format("tidelog").option("path", path).option("columns", "db_name,lsn").option("chunk", "64").load()
        q = source.writeStream.foreachBatch(lambda df, i: seen.append([(r.db_name, r.lsn) for r in df.collect()])).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)

    log_table.write_log(records(spark, 300), path, files=2)
    run()
    log_table.write_log(records(spark, 200, start=300), path, files=2)
    log_table.write_log(records(spark, 50, ("db7",), start=10), path, files=1)
    run()
    run()
    parts = [p for p in seen if p]
    assert [len(p) for p in parts] == [300, 250]
    want = records(spark, 500).select("db_name", "lsn").unionByName(records(spark, 50, ("db7",), start=10).select("db_name", "lsn"))
    assert sorted(x for p in parts for x in p) == sorted((r.db_name, r.lsn) for r in want.collect())
