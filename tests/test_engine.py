"""The log engine: parameters, predicates, transaction assembly against a sequential model, resolution, sources, store, streaming."""

import importlib
import random
import sys
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from tidelog.functions import lsn, predicates
from tidelog.operators import store, transactions
from tidelog.plans import log_queries
from tidelog.sources import log_sources
from tidelog.streaming import poller

SF = "/root/testdata/sf0.001"


def test_parameters():
    now = datetime(2024, 1, 2, tzinfo=UTC)
    assert lsn.parse_since("", now) is None and lsn.parse_since("all", now) is None and lsn.parse_since(" NOW ", now) == now
    assert lsn.parse_since("1d", now) == datetime(2024, 1, 1, tzinfo=UTC) and lsn.parse_since("1h30m", now) == datetime(2024, 1, 1, 22, 30, tzinfo=UTC)
    assert lsn.parse_since("1m1h500ms", now) == datetime(2024, 1, 1, 22, 58, 59, 500000, tzinfo=UTC) and lsn.parse_since("-1.5h", now) == datetime(2024, 1, 2, 1, 30, tzinfo=UTC) and lsn.parse_since("0", now) == now and lsn.parse_since("+.5s", now).microsecond == 500000
    for bad in ("0d", "x", "-1d", "1", "1h2", "h", "+", "1.5d", "1y", "--1h"):
        with pytest.raises(ValueError):
            lsn.parse_since(bad, now)
    assert [lsn.includes_history(x) for x in ("now", " NOW ", "24h", "7d", "all")] == [False, False, True, True, True]
    assert [lsn.positive(x, 5) for x in ("3", "0", "x", None, -1)] == [3, 5, 5, 5, 5]


def test_only_queries_pass_the_guard(spark):
    """Judged by the parsed tree: neither comments, raw strings nor quotes hide a write."""
    for bad in (
        "drop table x", "select 1; drop table x", "WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x", "FROM v INSERT INTO t1 SELECT a INSERT INTO t2 SELECT b", "with x as (select 1) delete from t", "with x as (select 1) update t set a = 1",
        "with x as (select 1) merge into t using x on 1 = 1", "", ";", "WITH x AS (SELECT 'k' AS a) INSERT/**/INTO t SELECT a FROM x", r"WITH x AS (SELECT r'\' AS a) INSERT INTO t SELECT a FROM x WHERE a <> 'z'", "insert overwrite directory '/tmp/x' select 1",
        "select reflect('java.lang.System', 'exit', '0')", "select a from t where b = (select JAVA_METHOD('java.lang.Runtime', 'x'))", "select `try_reflect`('a', 'b')", "select identifier('refl' || 'ect')('a', 'b')", "with x as (select reflect('a', 'b')) select * from x",
        "select transform(a) using 'cat' from t", "execute immediate 'drop table x'", "begin select 1; end", "cache table t", "set x = 1", "explain select 1", "create table t as select 1", "select * from nothing_known(1)", "select * from (select 1", "add jar 'x'",
    ):
        with pytest.raises(ValueError):
            log_queries.read_only(spark, bad)
    for good in (
        "select 'insert into x; y' as a", "(select 1) union (select 2);", "with x as (select 1 as updates) select * from x -- delete from t", "select replace(a, ';', '') from t", "values (1)", "select 'reflect(1)'", "table t", "select r'\\' as insert_into",
        "select a, count(*) from t where b > (select max(b) from t) and exists (select 1) group by a having count(*) > 1 order by 1 limit 5 offset 2", "select *, row_number() over (partition by a order by b) from t lateral view explode(c) d as q", "select * from range(5)",
        "with recursive r as (select 1 as n union all select n + 1 from r where n < 3) select * from r", "select * from t pivot (sum(a) for b in (1, 2))", "select a from t intersect select 1 except select 2", "from t |> where a > 1", "select * from t a join lateral (select a.b) x",
    ):
        assert log_queries.read_only(spark, good)


def test_scalar_functions(spark):
    rows = [("00000022:000001f0:0002", "2024/01/02 03:04:05:678", "[sales].[T.x]", "1.500"), ("", "2024/01/02 03:04:05", "T", "12"), (None, "bad", "[a]", "1.0"), ("0:0:1", None, None, None)]
    df = spark.createDataFrame(rows, "l string, t string, n string, d string")
    s, t = lsn.split_table(F.col("n"))
    got = df.select(lsn.lsn_decimal(F.col("l")).cast("string"), lsn.lsn_short(F.col("l")), lsn.log_time(F.col("t")).cast("string"), s, t, lsn.canonical_decimal(F.col("d"))).collect()
    assert [tuple(r) for r in got] == [
        (str(34 * 2**48 + 0x1F0 * 2**16 + 2), "22:1f0", "2024-01-02 03:04:05.678", "sales", "T.x", "1.5"), (None, "?", "2024-01-02 03:04:05", "dbo", "T", "12"), (None, "?", None, "dbo", "a", "1"), ("1", "0:0", None, "dbo", None, None)
    ]


def test_predicates(spark):
    names = ["ShrinkFile", " AllocFirstPage ", "QDS base transaction", "Backup:x", "user_transaction", "", None, "shrinkfile"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(predicates.is_internal_transaction(F.col("n"))).collect()] == [True, True, True, True, False, False, False, False]
    sqls = ["DELETE x", "  -- no", "", None]
    df = spark.createDataFrame([(n,) for n in sqls], "n string")
    assert [r[0] for r in df.select(predicates.is_executable(F.col("n"))).collect()] == [True, False, False, False]


def _model(records):
    """Committed lsns by a walk over the records, one at a time."""
    pending, out, excluded, written = {}, set(), set(), {}
    for lsn_, op, txn, name, cleanup in records:
        if op == "LOP_BEGIN_XACT" and name.strip().startswith("Backup:") or cleanup:
            excluded.add(txn)
            pending.pop(txn, None)
            out -= written.pop(txn, set())
        if op in ("LOP_COMMIT_XACT", "LOP_ABORT_XACT"):
            if op == "LOP_COMMIT_XACT" and txn not in excluded:
                done = set(pending.get(txn, ()))
                out |= done
                written.setdefault(txn, set()).update(done)
            pending.pop(txn, None)
            excluded.discard(txn)
        elif op == "LOP_INSERT_ROWS" and txn not in excluded:
            pending.setdefault(txn, []).append(lsn_)
    return out


def _random_records(n=3000, seed=4):
    rng, out = random.Random(seed), []
    for k in range(n):
        op = rng.choices(["LOP_BEGIN_XACT", "LOP_INSERT_ROWS", "LOP_COMMIT_XACT", "LOP_ABORT_XACT"], [2, 6, 2, 1])[0]
        out.append((f"{k:08x}", op, rng.randrange(60), rng.choice(["user", "user", "user", " Backup:1"]) if op == "LOP_BEGIN_XACT" else "", op == "LOP_INSERT_ROWS" and rng.random() < 0.03))
    return out


def _frame(spark, records):
    df = spark.createDataFrame(records, "lsn string, operation string, transaction_id long, transaction_name string, cleanup boolean")
    return df.withColumn("db_name", F.lit("d")).withColumn("seen_at", F.lit(None).cast("timestamp"))


def test_assembly_matches_model(spark):
    records = _random_records()
    got = {r.lsn for r in transactions.committed(_frame(spark, records)).select("lsn").collect()}
    assert got == _model(records) and got


def test_streaming_equals_batch(spark, tmp_path):
    records = _random_records(600, 9)
    for k in range(3):
        _frame(spark, records[k * 200 : (k + 1) * 200]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / str(k)))
    schema = _frame(spark, records[:1]).schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    written = {}

    def sink(df, i):
        written.update({r.lsn: r.transaction_id for r in df.select("lsn", "transaction_id").collect()})

    def retract(ids, i):
        gone = {r.transaction_id for r in ids.collect()}
        for lsn_ in [k for k, v in written.items() if v in gone]:
            written.pop(lsn_)

    q = poller.follow(source, str(tmp_path / "state"), sink, str(tmp_path / "ck"), {"availableNow": True}, retract)
    q.awaitTermination(180)
    assert set(written) == _model(records) and written
    # A batch that runs again reads the same state and writes the same rows; a state that is gone is an error, not an empty one.
    like = _frame(spark, records[:1])
    state = poller._carried(spark, str(tmp_path / "state"), 1, like)
    assert sorted(state.collect()) == sorted(poller._carried(spark, str(tmp_path / "state"), 1, like).collect()) and state.count() > 0
    with pytest.raises(RuntimeError):
        poller._carried(spark, str(tmp_path / "state"), 7, like)
    assert poller._carried(spark, str(tmp_path / "state"), -1, like).count() == 0
    assert poller.gap("0005", "0007") and not poller.gap("", "0007")


def test_store(spark, tmp_path):
    e = importlib.import_module("tidelog.plans.fixtures").log_events(spark, SF)
    path = str(tmp_path / "events")
    store.append(e.withColumn("ingest_seq", F.col("id")), path)
    assert store.latest(spark.read.parquet(path)).count() == e.count()
    tomb = store.cleaned(e.limit(3).withColumn("operation", F.lit("DELETE")).withColumn("status", F.lit("compressed_row_parse_failed")).withColumn("compressed_row_hex", F.lit("07" + "0" * 28)))
    assert tomb.count() == 0 and store.cleaned(e).count() == e.count()
    again = spark.read.parquet(path).select(*e.columns, "ingest_seq")
    assert store.latest(again.union(again.withColumn("sql_stmt", F.lit("x")))).where("sql_stmt = 'x'").count() in range(e.count() + 1)
    gone = store.retracted(again.withColumn("is_deleted", F.lit(False)), e.limit(5), 10**9)
    assert store.latest(again.withColumn("is_deleted", F.lit(False)).unionByName(gone)).count() == e.count() - 5
    saved = str(tmp_path / "saved")
    store.save_checkpoints(store.checkpoints(e), 1, saved)
    store.save_checkpoints(spark.createDataFrame([("db0", ""), ("db1", "ff")], "db_name string, lsn string"), 2, saved)
    assert {r.db_name: r.lsn for r in store.load_checkpoints(spark.read.parquet(saved)).collect()} == {"db1": "ff", "db2": e.where("db_name = 'db2'").agg(F.max("lsn")).first()[0]}
    store.overwrite_retained(spark, path, str(tmp_path / "kept"), datetime(2024, 2, 1))
    assert 0 < spark.read.parquet(str(tmp_path / "kept")).count() <= e.count()
    store.reset(e, str(tmp_path / "kept"), saved)
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 0 and spark.read.parquet(saved).count() == 0
    store.export(e, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == e.count()
    spark.range(3).createOrReplaceTempView("log_events")
    assert log_queries.ad_hoc(e, "SELECT count(*) AS n FROM log_events").first()["n"] == e.count()
    assert log_queries.ad_hoc(e, "WITH x AS (SELECT * FROM log_events) SELECT count(*) AS n FROM x").first()["n"] == e.count()
    assert spark.table("log_events").count() == 3 and [t.name for t in spark.catalog.listTables() if t.name.startswith("log_events")] == ["log_events"]
    spark.catalog.dropTempView("log_events")
    log_queries.write_script(log_queries.rollback_script(e, "all"), str(tmp_path / "script"))
    assert spark.read.text(str(tmp_path / "script")).where("value = 'BEGIN TRANSACTION;'").count() == 1


def test_sources(spark):
    raw = spark.createDataFrame([("a", None, -1, bytearray(b"x"))], "`lsn` string, `alloc_unit_id` long, `slot_id` int, `contents0` binary")
    r = log_sources.normalized(raw, "db1").first()
    assert (r.db_name, r.alloc_unit_id, r.slot_id, r.offset_in_row, r.operation, bytes(r.contents0)) == ("db1", 0, None, -1, "", b"x")
    lines = [("1:2", "Slot 0, Memory Dump @0x1", "x", "0000000000000010:   0A0B 0C zz"), ("1:2", "Slot 0, Memory Dump @0x1", "x", "0000000000000000:   0102 03 abc"), ("1:2", "Other", "x", "00: FF")]
    got = log_sources.page_images(spark.createDataFrame(lines, "page_id string, object string, field string, value string")).collect()
    assert [(x.slot_id, bytes(x.image)) for x in got] == [(0, bytes.fromhex("0102030A0B0C"))]


def test_entry_without_corpus_operators(spark, monkeypatch):
    """The rest works when the package llm and the pipeline are gone."""
    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name in ("tidelog.llm", "corpus_pipeline") else real(name, *a))
    sys.modules.pop("__spark_entry__", None)
    entry = importlib.import_module("__spark_entry__")
    assert not entry.HAS_LLM and set(entry.oracle_sql()) == set(entry.queries())
    assert entry.entry(spark).count() == 72
    sys.modules.pop("__spark_entry__", None)
