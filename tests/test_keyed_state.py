"""Following a log with keyed state: equal to a scan whatever the cuts, expiry, and work that follows the batch and not the state."""

import random

from pyspark.sql import functions as F

from tidelog.operators import generate
from tidelog.scan_queries import _catalog, _records
from tidelog.streaming import keyed

SF = "/root/testdata/sf0.001"


def followed(spark, tmp_path, batches, schema, known, timeout_hours=2, name="q"):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name / "in" / str(k)))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name / "in" / "*"))
    out, back = [], []

    def sink(df, i):
        df = df.persist()
        out.extend((r.lsn, r.txn_id, r.sql_stmt, r.rollback_sql, r.status) for r in keyed.events(df, known).collect())
        back.extend((r.txn_id, r.lsn) for r in keyed.retractions(df).collect())
        df.unpersist()

    # Timers of processing time ask for batches without data for ever; a query that is to end has to do without.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    q = keyed.committed_records(source, known, shares=3, timeout_hours=timeout_hours).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / name / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    return out, back, q.recentProgress


def test_equals_a_scan(spark, tmp_path):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        frame, known = _records(spark, SF).where("transaction_id in ('o1', 'o2', 'o7', 'o11', 'o22', 'c1', 'c9', 'b9')"), _catalog(spark)
        records, schema = frame.orderBy("lsn").collect(), frame.schema
        rng = random.Random(5)
        cuts = [0, *sorted(rng.sample(range(1, len(records)), 2)), len(records)]
        got, back, progress = followed(spark, tmp_path, [records[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], schema, known)
        want = generate.scan(spark.createDataFrame(records, schema), known)
        assert sorted(got, key=str) == sorted(((r.lsn, r.txn_id, r.sql_stmt, r.rollback_sql, r.status) for r in want.collect()), key=str) and len(got) > 6
        assert not back
        # State is kept by key: no batch updates more keys than it brings (a control record goes to every share).
        for p in progress:
            assert all(s.numRowsUpdated <= 10 * (p.numInputRows + 1) for s in p.stateOperators)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_open_transactions_expire(spark, tmp_path):
    """With a timeout of nothing an open transaction is dropped before its end comes; its id is free again after that."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        frame, known = _records(spark, SF).where("transaction_id = 'o2'"), _catalog(spark)
        rows = sorted(frame.collect(), key=lambda r: r.lsn)
        first = [k for k, r in enumerate(rows) if r.operation == "LOP_COMMIT_XACT"][0]
        got, _, _ = followed(spark, tmp_path, [rows[:first], rows[first : first + 1], rows[first + 1 :]], frame.schema, known, timeout_hours=0, name="short")
        every, _, _ = followed(spark, tmp_path, [rows[:first], rows[first : first + 1], rows[first + 1 :]], frame.schema, known, name="long")
        assert {x[0] for x in got} == {r.lsn for r in rows[first + 1 :] if r.operation in ("LOP_MODIFY_ROW", "LOP_DELETE_ROWS")}
        assert set(got) < set(every)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_what_was_written_is_taken_back(spark, tmp_path):
    """A clean-up under an id that has had a transaction before takes its events back."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        frame, known = _records(spark, SF).where("transaction_id = 'o2'"), _catalog(spark)
        last = frame.agg(F.max("lsn")).first()[0]
        frame = frame.withColumn("cleanup", (F.col("lsn") == last) | (F.col("operation") == "LOP_DELETE_ROWS"))
        rows = sorted(frame.collect(), key=lambda r: r.lsn)
        got, back, _ = followed(spark, tmp_path, [rows[:4], rows[4:]], frame.schema, known)
        assert got and back and {t for t, _ in back} == {"o2"}
        want = generate.scan(frame, known)
        assert [x for x in got if not any(x[1] == t and x[0] < at for t, at in back)] == [] and want.count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
