"""The way from records to events, and the sources and helpers that no registered query reaches."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidelog.functions import lsn, predicates
from tidelog.functions.types import CHAR, DATETIME2, DECIMAL, INT, NVARCHAR, VARCHAR, ColumnSpec, type_name
from tidelog.operators import analyzer, deltas, generate, images, resolve, store, transactions
from tidelog.scan_queries import ORDERS, _catalog, _records, catalog_frames
from tidelog.sources import catalog, log_sources
from tidelog.streaming import poller

SF = "/root/testdata/sf0.001"


def test_scan_options(spark):
    records = _records(spark, SF).where("transaction_id in ('o1', 'o7', 'o11', 'c9', 'b9')")
    found = _catalog(spark)
    every = {r.lsn[-4:] + r.table_name[0] for r in generate.scan(records, found, committed=False).collect()}
    done = {r.lsn[-4:] + r.table_name[0] for r in generate.scan(records.where("transaction_id = 'o11'"), found).collect()}
    assert "0006o" in every and done == {"0002o"}  # the change of o11 is never committed
    assert generate.scan(records, found, since=datetime(1970, 1, 1, 1)).count() < generate.scan(records, found).count()
    assert generate.scan(records, catalog.only(found, ["[sales].[customer]"])).select("table_name").distinct().collect() == [("customer",)]
    columns = generate.scan(records, found).columns
    assert columns[0] == "id" and columns[-1] == "skip_reason" and "decompressed_debug_json" in columns


def test_command_line(spark, tmp_path):
    from tidelog.__main__ import main

    for name, frame in catalog_frames(spark, SF).items():
        frame.write.parquet(str(tmp_path / "frames" / name))
    main(["schema", str(tmp_path / "frames"), str(tmp_path / "from_frames")])
    assert len(catalog.load_json(spark, str(tmp_path / "from_frames")).specs) == catalog_frames(spark, SF)["tables"].where("not is_ms_shipped").count()
    catalog.save_json(_catalog(spark), str(tmp_path / "catalog"))
    # Partitions are not part of the file, so orders are resolved by name here.
    records = _records(spark, SF).withColumn("alloc_unit_name", F.when(F.col("alloc_unit_id") == 7001, "dbo.orders").otherwise(F.col("alloc_unit_name")))
    stamped = records.withColumn("begin_time", F.date_format("seen_at", "yyyy/MM/dd HH:mm:ss:SSS")).drop("seen_at", "cleanup")
    stamped.write.parquet(str(tmp_path / "records"))
    main(["scan", str(tmp_path / "records"), str(tmp_path / "catalog"), str(tmp_path / "events"), "--table", "[dbo].[ORDERS]"])
    found = spark.read.parquet(str(tmp_path / "events"))
    want = generate.scan(_records(spark, SF), _catalog(spark)).where("table_name = 'orders'")
    assert sorted(found.select("lsn", "sql_stmt", "rollback_sql").collect()) == sorted(want.select("lsn", "sql_stmt", "rollback_sql").collect())


def test_following_a_log_gives_the_events_of_a_scan(spark, tmp_path):
    records, known = _records(spark, SF).where("transaction_id in ('o1', 'o2', 'o7', 'o11', 'o22', 'c1', 'c9', 'b9')").orderBy("lsn").collect(), _catalog(spark)
    schema = _records(spark, SF).schema
    cuts = [0, len(records) // 3, 2 * len(records) // 3, len(records)]
    for k in range(3):
        spark.createDataFrame(records[cuts[k] : cuts[k + 1]], schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    got = []
    q = poller.follow_events(source, lambda: known, str(tmp_path / "state"), lambda df, i: got.extend((r.lsn, r.sql_stmt, r.rollback_sql, r.status) for r in df.collect()), str(tmp_path / "ck"), {"availableNow": True})
    q.awaitTermination(600)
    want = generate.scan(spark.createDataFrame(records, schema), known)
    assert sorted(got, key=str) == sorted(((r.lsn, r.sql_stmt, r.rollback_sql, r.status) for r in want.collect()), key=str) and len(got) > 6
    each = generate.scan_each(spark.createDataFrame(records, schema), {"db0": known, "db9": known})
    assert each.count() == want.count()


def test_statements_of_rows_that_cannot_be_read(spark):
    found = _catalog(spark)
    good = _records(spark, SF).where("transaction_id = 'o2' and operation = 'LOP_INSERT_ROWS' and context = 'LCX_CLUSTERED'")
    damaged = {
        "good": "contents0", "lob": "concat(substring(contents0, 1, 42), unhex(concat(hex(substring(contents0, 43, 1)), '80')), substring(contents0, 45, 1000))", "wide": "concat(substring(contents0, 1, 37), X'0900', substring(contents0, 40, 1000))",
        "cut": "substring(contents0, 1, 3)", "packed": "concat(X'30000000', substring(contents0, 5, 1000))",
    }
    got = {}
    for name, image in damaged.items():
        row = generate.statements(images.fold(generate.resolved(good.withColumn("contents0", F.expr(image)), found)), found).first()
        got[name] = (row.skip_reason, row.status, row.confidence, row.sql_stmt.startswith("--"))
    assert got == {
        "good": (None, None, None, False), "lob": ("OFF_ROW_LOB_NOT_SUPPORTED", None, None, True), "wide": ("SCHEMA_MISMATCH", None, None, True), "cut": ("DECODE_ERROR", None, None, True),
        "packed": ("compressed_row_parse_failed", "compressed_row_parse_failed", "low", True),
    }


def test_keys_that_cannot_be_right(spark):
    from dataclasses import replace

    from tidelog.functions import rows as R

    spec = R.TableSpec("dbo", "T", (R.ColumnSpec(1, "id", R.INT, nullable=False), R.ColumnSpec(2, "v", R.INT)), (1,))
    found = catalog.of_specs(spark, {1: spec, 2: replace(spec, key=(), places={})})
    image = F.expr("concat(X'30000C00', X'0100000002000000', X'0200', case when n = 1 then X'01' else X'00' end)")
    base = _records(spark, SF).where("transaction_id = 'o2' and operation = 'LOP_INSERT_ROWS'").limit(1).select([c for c in _records(spark, SF).columns if c not in ("operation", "contents0")])
    rows = base.crossJoin(spark.createDataFrame([(0, 1), (1, 1), (1, 2)], "n int, object_id int")).withColumn("contents0", image).withColumn("operation", F.lit("LOP_DELETE_ROWS")).withColumn("compression", F.lit("NONE"))
    rows = rows.withColumn("before_image", F.col("contents0")).withColumn("after_image", F.lit(None).cast("binary")).withColumn("fold_path", F.lit("delete"))
    got = {(r.n, r.object_id): r for r in generate.statements(rows, found).collect()}
    assert got[0, 1].sql_stmt == "DELETE FROM [dbo].[T] WHERE [id] = 1;" and got[0, 1].status is None
    assert got[1, 1].status == "compressed_key_decode_invalid" and got[1, 1].sql_stmt.startswith("-- compressed_key_decode_invalid") and got[1, 1].rollback_sql.startswith("INSERT INTO")
    assert got[1, 2].sql_stmt == "DELETE FROM [dbo].[T] WHERE [id] IS NULL AND [v] = 2;"


def test_backups_of_real_lsns(spark):
    """A backup that reaches over two files of the log spans 2^48 numbers."""
    number = lambda f, b, s: str(f * 2**48 + b * 2**16 + s)
    backups = spark.createDataFrame([(1, number(34, 1, 1), number(35, 9, 1)), (2, number(35, 9, 1), number(35, 400, 7)), (3, number(36, 0, 0), number(40, 0, 0)), (4, "0", number(90, 0, 0))], "backup_id int, a string, b string").selectExpr("backup_id", "cast(a as decimal(25,0)) as first_lsn", "cast(b as decimal(25,0)) as last_lsn")
    points = spark.createDataFrame([("00000022:00000005:0001",), ("00000023:00000009:0001",), ("00000023:00000200:0001",), ("00000025:00000000:0000",)], "t string").withColumn("lsn", lsn.lsn_decimal(F.col("t")))
    got = {(r.t[6:8], r.backup_id) for r in log_sources.covering_backups(points, backups, "lsn").collect()}
    assert got == {("22", 1), ("22", 4), ("23", 1), ("23", 2), ("23", 4), ("25", 3), ("25", 4)}
    assert log_sources.covering_backups(points, backups, "lsn", most=1).count() == 4
    many = spark.range(3000).selectExpr("id as backup_id", "cast(id * 281474976710656 as decimal(25,0)) as first_lsn", "cast(id * 281474976710656 + 300000000000000 as decimal(25,0)) as last_lsn")
    asked = spark.range(3000).selectExpr("cast(id * 281474976710656 + 5 as decimal(25,0)) as lsn")
    found = log_sources.covering_backups(asked, many, "lsn")
    assert found.count() == 3000 + 2999  # each range reaches into the next file


def test_names_that_differ_in_case(spark):
    tables = spark.createDataFrame([(1, "dbo", "T", ""), (2, "DBO", "t", "")], "object_id int, schema_name string, table_name string, base_index string")
    parts = spark.createDataFrame([], "object_id int, alloc_unit_id long, partition_id long")
    records = spark.createDataFrame([("dbo.T", 0, 0)], "alloc_unit_name string, alloc_unit_id long, partition_id long")
    assert [(r.object_id, r.match) for r in resolve.resolve_storage(records, tables, parts).collect()] == [(1, "name")]


def test_gap_in_the_log(spark):
    frame = lambda *n: spark.createDataFrame([("d", f"{k:04x}", s) for k, s in n], "db_name string, lsn string, src string")
    log = frame(*[(k, "log") for k in (7, 8, 9)])
    stored = frame(*[(k, "backup") for k in (3, 4, 5, 6, 7)])
    got, missing = poller.new_records(log, stored, "0004")
    assert sorted((r.lsn, r.src) for r in got.collect()) == [("0005", "backup"), ("0006", "backup"), ("0007", "backup"), ("0008", "log"), ("0009", "log")] and not missing
    got, missing = poller.new_records(log, None, "0004")
    assert got.count() == 3 and missing
    got, missing = poller.new_records(log, None, "0008")
    assert [r.lsn for r in got.collect()] == ["0009"] and not missing


def test_activity_in_windows(spark, tmp_path):
    spark.createDataFrame([("INSERT", datetime(2024, 1, 1, 0, k)) for k in range(30)], "operation string, event_time timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("operation string, event_time timestamp").parquet(str(tmp_path / "in"))
    q = poller.activity(stream).writeStream.format("memory").queryName("activity").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.n for r in spark.table("activity").orderBy("window").collect()] == [10, 10, 10]


def test_update_events(spark, tmp_path):
    image = lambda v: bytearray(b"\x30\x00\x0c\x00" + (1).to_bytes(4, "little") + v.to_bytes(4, "little") + b"\x02\x00\x00")
    from tidelog.functions import rows as R

    spec = R.TableSpec("dbo", "T", (R.ColumnSpec(1, "id", R.INT), R.ColumnSpec(2, "v", R.INT)), (1,))
    folded = spark.createDataFrame([("d", f"{k}", "LOP_MODIFY_ROW", image(k), image(k + 1), "splice", bytearray(b"x")) for k in range(3)], "db_name string, lsn string, operation string, before_image binary, after_image binary, fold_path string, contents0 binary")
    rows = store.update_events(analyzer.analyze(folded, spec), "dbo", "T")
    assert rows.columns == list(store.UPDATE_COLUMNS)
    for _ in range(2):  # the second time adds nothing
        store.write_update_events(rows, str(tmp_path / "u"))
    found = spark.read.parquet(str(tmp_path / "u")).orderBy("current_lsn").collect()
    assert [r.equivalent_redo_sql for r in found] == [f"update top(1) [dbo].[T] set [v]={k + 1} where [id]=1;" for k in range(3)] and found[0].rowlog0_hex == "78" and "before" in found[0].changed_columns_json
    assert found[0].before_json == '{"id":"1","v":"0"}' and found[0].after_json == '{"id":"1","v":"1"}'


def test_pages_leave_out_what_is_no_json(spark):
    from tidelog.plans import log_queries

    e = spark.createDataFrame([(1, "INSERT", '{"a":1}'), (2, "INSERT", "{a")], "id long, operation string, decompressed_debug_json string").withColumn("event_time", F.lit(None).cast("timestamp"))
    assert [(r.id, r.decompressed_debug_json) for r in log_queries.by_id(e).collect()] == [(1, '{"a":1}'), (2, None)]


def test_catalog(spark):
    frames = catalog_frames(spark, SF)
    found = catalog.extract(spark, frames)
    assert found.specs[0].compression == "NONE" and found.specs[1].compression == "ROW" and found.specs[2].compression == "PAGE"
    assert found.specs[0].base_index == "PK_0" and found.specs[0].key == (1,) and len(found.specs[0].physical) == 4 and len(found.specs[1].physical) == 3
    bare = catalog.extract(spark, {k: frames[k] for k in ("tables", "columns", "types")})
    assert bare.specs[0].key == () and bare.specs[0].compression == "UNKNOWN" and not bare.specs[0].physical
    with pytest.raises(ValueError):
        catalog.extract(spark, frames, most=10)
    a = log_sources.fingerprint(frames["tables"].withColumn("modify_date", F.lit(1)), frames["columns"], frames["partitions"].withColumnRenamed("data_compression", "code")).first()
    b = log_sources.fingerprint(frames["tables"].withColumn("modify_date", F.lit(1)), frames["columns"], frames["partitions"].withColumn("code", F.lit(9))).first()
    assert a != b and a.n_columns == frames["columns"].count()


def test_catalog_file(spark, tmp_path):
    found = catalog.extract(spark, catalog_frames(spark, SF))
    catalog.save_json(found, str(tmp_path / "c"))
    again = catalog.load_json(spark, str(tmp_path / "c"))
    assert again.specs == found.specs and again.specs[0].places == found.specs[0].places and not again.stored


def test_type_names():
    c = lambda *a, **k: type_name(ColumnSpec(1, "c", *a, **k))
    assert [c(INT), c(VARCHAR, 20), c(VARCHAR, -1), c(NVARCHAR, 40), c(CHAR, 3), c(DECIMAL, precision=9, scale=2), c(DATETIME2, scale=3), c(999)] == ["int", "varchar(20)", "varchar(max)", "nvarchar(20)", "char(3)", "decimal(9,2)", "datetime2(3)", "type_999"]


def test_columns_of_records(spark):
    df = spark.createDataFrame([(bytearray.fromhex("16AABB11223344"), "dbo.T.ix", "LOP_MODIFY_COLUMNS", 1234567), (bytearray.fromhex("36" + "00" * 7 + "CCDD"), "dbo.T.pk", "LOP_DELETE_ROWS", 5), (bytearray.fromhex("99"), "dbo.T", "LOP_BEGIN_XACT", 0)], "k binary, u string, o string, n long")
    got = df.select(lsn.key_probe(F.col("k")).alias("k"), predicates.is_other_index(F.col("u"), F.lit("PK")).alias("x"), lsn.operation_of(F.col("o")).alias("o"), lsn.thousands(F.col("n")).alias("n")).collect()
    assert [tuple(r) for r in got] == [("AABB", True, "UPDATE", "1,234,567"), ("CCDD", False, "DELETE", "5"), ("", False, None, "0")]
    mixed = spark.createDataFrame([(bytearray(b"\x01\x02\x03"), bytearray(b"\xff\x02")), (bytearray(b"\x01"), None)], "a binary, b binary").select(deltas.xor_image("a", "b").alias("c")).collect()
    assert [bytes(r.c) for r in mixed] == [b"\xfe\x00\x03", b"\x01"]


def test_lists_of_sources(spark):
    names = spark.createDataFrame([(1, "master", "ONLINE"), (5, "b", "ONLINE"), (6, "a", "ONLINE"), (7, "c", "OFFLINE")], "database_id int, name string, state_desc string")
    assert [r.name for r in log_sources.user_databases(names).collect()] == ["a", "b"]
    backups = spark.createDataFrame([(k, datetime(2024, 1, k + 1), k * 100, k * 100 + 99, 2**20 * k) for k in range(10)], "backup_id int, finished timestamp, first_lsn long, last_lsn long, bytes long")
    assert [r.backup_id for r in log_sources.backup_list(backups, 2).collect()] == [9, 8] and str(log_sources.backup_list(backups, 1).first().size_mb) == "9.0"
    assert [r.backup_id for r in log_sources.gap_backups(backups, 450, datetime(2024, 1, 11), 3).collect()] == [4, 5, 6]
    a, b = backups.select(F.lit("d").alias("db_name"), F.lit("1").alias("lsn"), F.lit("old").alias("s")).limit(1), backups.select(F.lit("d").alias("db_name"), F.lit("1").alias("lsn"), F.lit("new").alias("s")).limit(1)
    assert [r.s for r in transactions.first_seen(log_sources.both(a, b)).collect()] == ["old"]
    codes = spark.createDataFrame([(1, 0), (2, 2)], "object_id int, code int")
    assert {r.object_id: r.code for r in resolve.table_compression(codes, spark.createDataFrame([(1, 1), (2, 1)], "object_id int, code int")).collect()} == {1: 1, 2: 2}


def test_old_open_transactions_are_dropped(spark):
    rows = [("d", "1", "LOP_BEGIN_XACT", 1, "", datetime(2024, 1, 1), False), ("d", "2", "LOP_INSERT_ROWS", 1, "", None, False), ("d", "3", "LOP_BEGIN_XACT", 2, "", datetime(2024, 1, 1, 9), False), ("d", "4", "LOP_INSERT_ROWS", 2, "", None, False)]
    df = spark.createDataFrame(rows, "db_name string, lsn string, operation string, transaction_id long, transaction_name string, seen_at timestamp, cleanup boolean")
    assert {r.lsn for r in transactions.pending(df).collect()} == {"2", "4"} and {r.lsn for r in transactions.pending(df, datetime(2024, 1, 1, 10)).collect()} == {"4"}
    assert {r.lsn for r in transactions.cacheable(df).collect()} == {"2", "4"}
    # A transaction whose records all share one stretch is numbered as one over many.
    assert {r.lsn: r.epoch for r in transactions.with_epochs(df, 0).collect()} == {r.lsn: r.epoch for r in transactions.with_epochs(df).collect()}


def test_orders_spec_reads_as_declared():
    assert [type_name(c) for c in ORDERS.columns] == ["bigint", "bigint", "varchar(1)", "decimal(15,2)", "datetime2(6)", "varchar(15)"]


def test_unknown_storage_asks_for_a_new_version(spark):
    """A table that the catalog lacks gets a version from its first record on; another index, or system tables that are the same, do not."""
    from tidelog.functions.types import BIGINT, TableSpec
    from tidelog.sources.catalog_history import Version, renewed

    frames = catalog_frames(spark, SF)
    frames |= {"tables": frames["tables"].withColumn("modify_date", F.lit("2024-01-01").cast("timestamp"))}
    name = frames["tables"].where("not is_ms_shipped").orderBy("object_id").first().table_name
    old = catalog.of_specs(spark, {1: TableSpec("dbo", "known", (ColumnSpec(1, "id", BIGINT),), (1,), base_index="PK")})
    rows = [("db0", "3", "dbo.known.PK", "LOP_INSERT_ROWS"), ("db0", "4", "dbo.known.IX", "LOP_INSERT_ROWS"), ("db0", "6", f"dbo.{name}", "LOP_INSERT_ROWS"), ("db0", "5", f"DBO.{name}", "LOP_DELETE_ROWS"), ("db0", "2", f"dbo.{name}", "LOP_BEGIN_XACT")]
    records = spark.createDataFrame(rows, "db_name string, lsn string, alloc_unit_name string, operation string").withColumns({"alloc_unit_id": F.lit(0).cast("long"), "partition_id": F.lit(0).cast("long")})
    history = [Version("db0", "", old)]
    same, changed = renewed(records.where("lsn < '5'"), history, lambda db: frames)
    assert same == history and not changed
    found, changed = renewed(records, history, lambda db: frames)
    assert changed and [(v.db_name, v.lsn) for v in found] == [("db0", ""), ("db0", "5")]
    # The records are known now; the one of a table that no system table names asks again, for nothing new.
    more = records.unionByName(records.limit(1).withColumns({"lsn": F.lit("7"), "alloc_unit_name": F.lit("dbo.nowhere")}))
    assert renewed(records, found, lambda db: frames) == (found, False) and renewed(more, found, lambda db: frames) == (found, False)
    # A database without any version.
    assert [(v.db_name, v.lsn) for v in renewed(records.withColumn("db_name", F.lit("db9")), found, lambda db: frames)[0]] == [("db0", ""), ("db0", "5"), ("db9", "3")]
    assert renewed(records.limit(0), [], lambda db: frames) == ([], False)


def test_tasks_of_a_scan_grow_in_number(spark, monkeypatch):
    """Twice the records give twice the tasks that sort them, not larger ones."""
    from tidelog import scan_queries
    from tidelog.operators import generate, images

    monkeypatch.setattr(images, "ROWS_EACH", 500)
    records = scan_queries._records(spark, "/root/testdata/sf0.001")
    made = generate.scan(records, scan_queries._catalog(spark))
    n = -(-records.count() // 500)
    assert n > 10 and made.rdd.getNumPartitions() == n
