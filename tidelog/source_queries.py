"""Registered queries over the source by cursor, catalog versions, the event table in ranges and what is kept beside it, pages by rank, shared folding and the
analyzer of many tables, each with SQL for comparison."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.sql import functions as F

from .functions import rows as R
from .more_queries import _DATE, _LITERALS, _NAMES, _ORDER_VALUES, ORDERS, _read
from .operators import analyzer, generate, images, resolve, shared_fold, transactions
from .operators.indexed_store import IndexedStore
from .operators.ranged_store import RangedStore
from .plans import fixtures
from .plans import log_queries as Q
from .plans.ranked_pages import RankedPages
from .scan_queries import _C_NAME, _CUSTOMER_ID, _LSN, _ORDERS_ID, CUSTOMER, _catalog, _customers, _record
from .sources import catalog as cat
from .sources import log_sources, log_table
from .sources.catalog_history import Version
from .storage import durable, new_folder

_queries: dict = {}
_oracles: dict = {}


def query(oracle: str):
    def register(f):
        _queries[f.__name__], _oracles[f.__name__] = f, oracle
        return f

    return register


_REC = f"({fixtures.sql(fixtures.RECORDS, True)})"


@query(f"""SELECT lsn, operation, CAST(transaction_id AS VARCHAR) AS transaction_id, transaction_name FROM {_REC} WHERE lsn > '00000022:00000040:0003' AND lsn <= '00000022:000001f0:0004' AND operation IN ('LOP_BEGIN_XACT', 'LOP_INSERT_ROWS', 'LOP_COMMIT_XACT')""")
def read_pages(spark, sf_dir):
    """A part of the log, read by cursor from a table of records: pushed bounds and operations, pages of 500 rows."""
    path = new_folder(spark, "log")
    log_table.write_log(log_sources.normalized(fixtures.log_records(spark, sf_dir), "db0"), path)
    read = log_table.read_log(spark, path, chunk=500).where("db_name = 'db0' and lsn > '00000022:00000040:0003' and lsn <= '00000022:000001f0:0004' and operation in ('LOP_BEGIN_XACT', 'LOP_INSERT_ROWS', 'LOP_COMMIT_XACT')")
    return read.select("lsn", "operation", "transaction_id", "transaction_name")


@query(f"SELECT lsn, operation, CAST(transaction_id AS VARCHAR) AS transaction_id, CASE WHEN lsn <= '00000022:00000300:0004' THEN 0 ELSE 1 END AS source FROM {_REC} WHERE lsn > '00000022:00000100:0001'")
def scan_backups_then_log(spark, sf_dir):
    """Records past a checkpoint that the live log no longer reaches: those of a backup up to its end, then the log's; what both hold counts once."""
    every = log_sources.normalized(fixtures.log_records(spark, sf_dir), "db0")
    backup, log = new_folder(spark, "backup"), new_folder(spark, "log")
    log_table.write_log(every.where("lsn <= '00000022:00000300:0004'"), backup)
    log_table.write_log(every.where("lsn > '00000022:00000200:0001'"), log)
    log_table.register(spark)
    saved = "00000022:00000100:0001"
    stored = spark.read.format("tidelog").options(**log_table.source_options("backup", backup, saved)).load()
    live = spark.read.format("tidelog").options(**log_table.source_options("log", log, saved)).load()
    found = transactions.first_seen(log_sources.both(stored, live))
    return found.select("lsn", "operation", "transaction_id", F.col("source_rank").alias("source"))


# ---- a table that changes ----------------------------------------------------------------------------------------------------------------

_SHORT_NAMES = ", ".join(f"[{c.name}]" for c in ORDERS.columns[:-1])
_SHORT = "CAST(o_orderkey AS VARCHAR) || ', ' || CAST(o_custkey + 1 AS VARCHAR) || ', ''' || o_orderstatus || ''', ' || CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) || ', ' || " + _DATE.format(c="o_orderdate")


@query(f"""SELECT {_LSN.format(g=1, k='o_orderkey', n=2)}, 'INSERT INTO [dbo].[orders] ({_NAMES}) VALUES (' || {_LITERALS} || ');' AS sql_stmt FROM orders
UNION ALL SELECT {_LSN.format(g=2, k='o_orderkey', n=2)}, 'INSERT INTO [dbo].[orders] ({_SHORT_NAMES}) VALUES (' || {_SHORT} || ');' FROM orders WHERE o_orderkey % 3 = 0""")
def scan_schema_change(spark, sf_dir):
    """The last column is dropped between two records of one table: each is read by the layout that held at its lsn."""
    orders, k = _read(spark, sf_dir, "orders", *_ORDER_VALUES), "o_orderkey"
    short = replace(ORDERS, columns=ORDERS.columns[:-1], places={})
    first = orders.withColumn("image", F.expr(R.encode_sql(ORDERS, _ORDER_VALUES)))
    then = orders.where("o_orderkey % 3 = 0").withColumn("image", F.expr(R.encode_sql(short, {c.name: _ORDER_VALUES[c.name] for c in short.columns} | {"o_custkey": "o_custkey + 1"})))
    parts = []
    for df, group in ((first, 1), (then, 2)):
        parts += [_record(df, k, 1, "LOP_BEGIN_XACT", "v", group=group), _record(df, k, 2, "LOP_INSERT_ROWS", "v", unit=7001, c0=F.col("image"), group=group), _record(df, k, 3, "LOP_COMMIT_XACT", "v", group=group)]
    records = parts[0]
    for p in parts[1:]:
        records = records.unionByName(p)
    units = spark.createDataFrame([(_ORDERS_ID, 7001, 0, 0)], "object_id int, alloc_unit_id long, partition_id long, code int")
    layout = lambda spec: cat.of_specs(spark, {_ORDERS_ID: replace(spec, places={})}, partitions=units)
    history = [Version("db0", "", layout(ORDERS)), Version("db0", "00000002:00000000:0000", layout(short))]
    return generate.scan_history(records, history).select("lsn", "sql_stmt")


# ---- the event table in ranges -----------------------------------------------------------------------------------------------------------

_EV = f"({fixtures.sql(fixtures.EVENTS, True)})"


@query(f"""SELECT db_name, lsn, id, coalesce(CASE WHEN id % 5 = 0 THEN 'late' ELSE status END, '-') AS status FROM {_EV} WHERE id % 7 <> 0 AND NOT (db_name = 'db1' AND txn_id IN (SELECT txn_id FROM {_EV} WHERE id % 50 = 0) AND id % 5 <> 0)""")
def upsert_ranged(spark, sf_dir):
    """Three batches: all events; some with a new status; the events of some transactions taken back, but for those of the second batch, and single events retracted."""
    events = fixtures.log_events(spark, sf_dir)
    table = RangedStore(spark, new_folder(spark, "events"), 2000)
    table.upsert(events, 0)
    gone = events.where("id % 50 = 0 and db_name = 'db1'").select("db_name", "txn_id")
    table.upsert(events.where("id % 5 = 0").withColumn("status", F.lit("late")), 1, gone)
    blank = events.where("id % 7 = 0").withColumn("is_deleted", F.lit(True))
    table.upsert(blank, 2, checkpoints={"db0": "x"})
    return table.read().select("db_name", "lsn", "id", F.coalesce("status", F.lit("-")).alias("status"))


# ---- what is kept beside the event table -------------------------------------------------------------------------------------------------

#: What upserts and retractions leave: every fifth event came again as an INSERT, every seventh is taken back, and so are some transactions of db1.
_LEFT = f"""(SELECT * REPLACE (CASE WHEN id % 5 = 0 THEN 'INSERT' ELSE operation END AS operation) FROM {_EV} WHERE id % 7 <> 0 AND NOT (db_name = 'db1' AND txn_id IN (SELECT txn_id FROM {_EV} WHERE id % 50 = 0) AND id % 5 <> 0))"""
_COUNTS = ", ".join(f"CAST(sum(CASE WHEN operation = '{o}' THEN 1 ELSE 0 END) AS BIGINT) AS {a}" for o, a in (("INSERT", "inserts"), ("UPDATE", "updates"), ("DELETE", "deletes")))
_SINCE, _UNTIL = datetime(2024, 1, 5, 3, 4, 5, 678000), datetime(2024, 2, 20, 1, 2, 3, 456000)
_START, _STEP = int((_SINCE - datetime(1970, 1, 1)).total_seconds() * 1000), int((_UNTIL - _SINCE).total_seconds() * 1000) // 72


def _indexed(spark, sf_dir) -> IndexedStore:
    events = fixtures.log_events(spark, sf_dir)
    table = IndexedStore(spark, new_folder(spark, "indexed"), max(2000, events.count() // 16), 200)
    table.upsert(events, 0)
    table.upsert(events.where("id % 5 = 0").withColumn("operation", F.lit("INSERT")), 1, events.where("id % 50 = 0 and db_name = 'db1'").select("db_name", "txn_id"))
    table.upsert(events.where("id % 7 = 0").withColumn("is_deleted", F.lit(True)), 2)
    return table


@query(f"""SELECT bucket, {_COUNTS}, CAST(count(*) AS BIGINT) AS total FROM (SELECT CAST(floor((epoch_ms(event_time) - {_START}) / {_STEP}) AS BIGINT) AS bucket, operation FROM {_LEFT}
WHERE event_time >= TIMESTAMP '2024-01-05 03:04:05' AND event_time <= TIMESTAMP '2024-02-20 01:02:03') WHERE bucket BETWEEN 0 AND 71 GROUP BY bucket""")
def timeline_kept(spark, sf_dir):
    """Activity over time from counts by minute; only the minutes that a border cuts are read as events."""
    return _indexed(spark, sf_dir).timeline(_SINCE, _UNTIL)


@query(f"""SELECT db_name, txn_id, min(event_time) AS event_time, max(commit_time) AS commit_time, min(lsn) AS first_lsn, max(lsn) AS last_lsn, count(*) AS events, {_COUNTS} FROM {_LEFT}
WHERE txn_id IS NOT NULL AND txn_id <> '' GROUP BY db_name, txn_id ORDER BY max(coalesce(commit_time, event_time)) DESC NULLS LAST, max(lsn) DESC LIMIT 50 OFFSET 50""")
def txn_groups_kept(spark, sf_dir):
    """A page of transactions from what is kept of each in the ranges that hold its events."""
    return _indexed(spark, sf_dir).transaction_groups(page=2, limit=50)


@query(f"SELECT operation, count(*) AS n, CAST(sum(CASE WHEN trim(rollback_sql) <> '' AND NOT starts_with(trim(rollback_sql), '--') THEN 1 ELSE 0 END) AS BIGINT) AS rollbacks FROM {_LEFT} GROUP BY operation")
def stats_kept(spark, sf_dir):
    """Counts by operation, and rollbacks that can run, after events were replaced and taken back."""
    return _indexed(spark, sf_dir).counts("operation")


@query(f"SELECT id, lsn, operation, sql_stmt FROM {_LEFT} WHERE sql_stmt LIKE '%purchase%77%' AND db_name = 'db2'")
def search_indexed(spark, sf_dir):
    """A search term by an index of three-character pieces, then LIKE."""
    return _indexed(spark, sf_dir).matching(Q.LogFilter(search="purchase%77", db="db2")).select("id", "lsn", "operation", "sql_stmt")


_PAGE = "id, lsn, txn_id, operation, db_name, schema_name, table_name, sql_stmt, rollback_sql, event_time, commit_time, status"


@query(f"(SELECT {_PAGE} FROM {_EV} ORDER BY event_time DESC NULLS LAST, id DESC LIMIT 200 OFFSET 800) UNION ALL (SELECT {_PAGE} FROM {_EV} WHERE operation = 'DELETE' ORDER BY event_time DESC NULLS LAST, id DESC LIMIT 30 OFFSET 120)")
def logs_page_ranked(spark, sf_dir):
    """A page of all events and one of those that a filter keeps, read from the partitions of the order that hold them."""
    events = fixtures.log_events(spark, sf_dir)
    pages = RankedPages.build(events, new_folder(spark, "order"), rows_each=max(500, events.count() // 16))
    return pages.page(page=5).unionByName(pages.page(Q.LogFilter(operation="DELETE"), page=5, limit=30))


# ---- columns lost in decoding ------------------------------------------------------------------------------------------------------------

_CENTS = "CAST(round(c_acctbal * 10000) AS BIGINT)"
_FITS = f"{_CENTS} BETWEEN -32768 AND 32767"


@query(f"""SELECT CAST(c_custkey AS BIGINT) AS k, 'ok' AS status, CASE WHEN {_FITS} THEN 'high' ELSE 'medium' END AS confidence, CASE WHEN NOT ({_FITS}) THEN '1 column(s) set to NULL, their bytes cannot be decoded: c_acctbal' END AS warning,
 'INSERT INTO [sales].[customer] ([c_custkey], [c_name], [c_nationkey], [c_acctbal], [c_mktsegment], [c_odd]) VALUES (' || c_custkey || ', ''' || {_C_NAME} || ''', ' || c_nationkey || ', ' || CASE WHEN {_FITS} THEN CAST({_CENTS} AS VARCHAR) ELSE 'NULL' END || ', '
 || CASE WHEN c_custkey % 5 > 0 THEN 'N''' || c_mktsegment || '''' ELSE 'NULL' END || ', ' || (c_custkey % 2) || ');' AS sql_stmt FROM customer""")
def scan_lost_columns(spark, sf_dir):
    """Compressed rows whose catalog has a narrower type for one column: told with NULL where its bytes are too many, with a warning."""
    narrow = lambda columns: tuple(replace(c, type=R.SMALLINT) if c.name == "c_acctbal" else c for c in columns)
    spec = replace(CUSTOMER, columns=narrow(CUSTOMER.columns), physical=narrow(CUSTOMER.physical), base_index="PK_customer", places={})
    customers, k = _customers(spark, sf_dir), "c_custkey"
    parts = [_record(customers, k, 1, "LOP_BEGIN_XACT", "c"), _record(customers, k, 2, "LOP_INSERT_ROWS", "c", name="sales.customer.PK_customer", c0=F.col("image")), _record(customers, k, 3, "LOP_COMMIT_XACT", "c")]
    made = generate.scan(parts[0].unionByName(parts[1]).unionByName(parts[2]), cat.of_specs(spark, {_CUSTOMER_ID: spec}))
    return made.select(F.conv(F.substring("lsn", 10, 8), 16, 10).cast("long").alias("k"), "status", "confidence", F.get_json_object("decompressed_debug_json", "$.warning").alias("warning"), "sql_stmt")


# ---- folding and analysis ----------------------------------------------------------------------------------------------------------------


@query("""SELECT CAST(o_orderkey AS BIGINT) AS k, CAST(row_number() OVER (ORDER BY o_orderkey) AS BIGINT) AS nth, 'splice' AS path FROM orders""")
def fold_one_slot(spark, sf_dir):
    """A slot with a change for each order, shared by all partitions: the number in the row counts them."""
    orders = _read(spark, sf_dir, "orders", "o_orderkey").select(F.col("o_orderkey").cast("long").alias("k"))
    # Numbers by range partitions, from the rows before each. The ranges are cut by a sample, another one in each run, so they are kept: counts and places are of the same ranges.
    ranged = durable(orders.repartitionByRange("k").sortWithinPartitions("k").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id() % F.lit(1 << 33)))
    before = {r.part: r.n for r in ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts = spark.createDataFrame([(p, sum(n for q, n in before.items() if q < p)) for p in before] or [(0, 0)], "part int, start long")
    numbered = ranged.join(F.broadcast(starts), "part").select("k", (F.col("at") + F.col("start") + 1).alias("nth"))
    number = lambda c: F.expr(R._bytes(c, 8))
    common = {"db_name": F.lit("db0"), "alloc_unit_id": F.lit(7001).cast("long"), "page_id": F.lit("p"), "slot_id": F.lit(1)}
    changes = numbered.withColumns(common | {"lsn": F.format_string("%016x", "nth"), "operation": F.lit("LOP_MODIFY_ROW"), "contents0": number("nth - 1"), "contents1": number("nth"), "offset_in_row": F.lit(4)})
    first = spark.range(1).select(F.lit(-1).cast("long").alias("k"), F.lit(0).cast("long").alias("nth")).withColumns(common | {"lsn": F.lit(""), "operation": F.lit("LOP_INSERT_ROWS"), "contents0": F.expr(f"concat(X'10000C00', {R._bytes('nth', 8)}, X'0100')"), "contents1": F.lit(None).cast("binary"), "offset_in_row": F.lit(-1)})
    folded = shared_fold.fold(first.unionByName(changes)).where("k >= 0")
    value = sum((F.conv(F.hex(F.expr(f"substring(after_image, {5 + i}, 1)")), 16, 10).cast("long") * F.lit(1 << (8 * i)) for i in range(6)), F.lit(0).cast("long"))
    return folded.select("k", value.alias("nth"), F.col("fold_path").alias("path"))


@query("""SELECT CAST(o_orderkey AS BIGINT) AS k, CASE o_orderkey % 4 WHEN 1 THEN 'mr1_not_found' WHEN 2 THEN 'variable_length_patch_required' ELSE 'ok' END AS status, CASE o_orderkey % 4 WHEN 1 THEN 'none' WHEN 2 THEN 'page_reader' WHEN 3 THEN 'page_reader' ELSE 'cache' END AS source,
 CASE WHEN o_orderkey % 4 IN (0, 3) THEN 'update top(1) [dbo].[orders] set [o_orderpriority]=''9-' || o_orderkey || ''' where [o_orderkey]=' || o_orderkey || ';' END AS redo FROM orders""")
def analyze_many(spark, sf_dir):
    """Updates by the folded image, by the page, without any image, and of another length, decoded by the catalog."""
    orders, k = _read(spark, sf_dir, "orders", *_ORDER_VALUES), "o_orderkey"
    text, new = "concat('1-', o_orderkey)", "concat('9-', o_orderkey)"
    before, after = (R.encode_sql(ORDERS, _ORDER_VALUES | {"o_orderpriority": t}) for t in (text, new))
    df = orders.selectExpr("*", f"{before} AS image", f"{after} AS now", f"cast({text} as binary) AS old", f"cast({new} as binary) AS new")
    inserts = _record(df.where("o_orderkey % 4 = 0"), k, 1, "LOP_INSERT_ROWS", "a", unit=7001, c0=F.col("image"))
    # The fold reads contents0 as what stood there, the search on a page as what stands there now.
    known = _record(df.where("o_orderkey % 4 = 0"), k, 2, "LOP_MODIFY_ROW", "a", unit=7001, c0=F.col("old"), c1=F.col("new"), offset=0)
    at = F.length("image") - F.length("old")
    known = known.drop("offset_in_row").join(df.select(F.format_string("%08x:%08x:%04x", F.lit(1).cast("long"), F.col(k).cast("long"), F.lit(2).cast("long")).alias("lsn"), at.alias("offset_in_row")), "lsn")
    paged = _record(df.where("o_orderkey % 4 > 0"), k, 2, "LOP_MODIFY_ROW", "a", unit=7001, c0=F.col("new"), c1=F.when(F.col(k) % 4 == 2, F.lit(b"?")).otherwise(F.col("old")))
    pages = _record(df.where("o_orderkey % 4 > 1"), k, 1, "LOP_INSERT_ROWS", "a", c0=F.col("now")).select("db_name", "page_id", "slot_id", F.col("contents0").alias("image"))
    folded = images.fold(generate.resolved(inserts.unionByName(known).unionByName(paged), _catalog(spark)))
    made = analyzer.analyze_many(folded, _catalog(spark), pages)
    return made.select(F.conv(F.substring("lsn", 10, 8), 16, 10).cast("long").alias("k"), "status", F.col("image_source").alias("source"), "redo")

@query(f"""SELECT CAST(o_orderkey AS BIGINT) AS k, CASE WHEN o_orderkey % 3 = 0 THEN '-- no decoded column of [dbo].[orders] changed' ELSE 'UPDATE [dbo].[orders] SET [o_custkey] = ' || (o_custkey + 1) || ' WHERE [o_orderkey] = ' || o_orderkey || ';' END AS forward,
 CASE WHEN o_orderkey % 3 = 0 THEN '-- no decoded column of [dbo].[orders] changed' ELSE 'UPDATE [dbo].[orders] SET [o_custkey] = ' || o_custkey || ' WHERE [o_orderkey] = ' || o_orderkey || ';' END AS inverse FROM orders""")
def scan_xor_images(spark, sf_dir):
    """Updates that hold the whole row after them, and what it was XORed by; every third lacks the latter."""
    orders, k = _read(spark, sf_dir, "orders", *_ORDER_VALUES), "o_orderkey"
    image = F.expr(R.encode_sql(ORDERS, _ORDER_VALUES | {"o_custkey": "o_custkey + 1"}))
    mask = F.when(F.col(k) % 3 > 0, F.concat(F.lit(bytes(12)), F.expr(R._bytes("o_custkey ^ (o_custkey + 1)", 8))))
    records = _record(orders, k, 2, "LOP_MODIFY_ROW", "x", unit=7001, c0=image, c1=mask)
    made = generate.statements(images.fold(generate.resolved(records, _catalog(spark))), _catalog(spark))
    return made.select(F.conv(F.substring("lsn", 10, 8), 16, 10).cast("long").alias("k"), F.col("sql_stmt").alias("forward"), F.col("rollback_sql").alias("inverse"))


@query("""SELECT CASE o_orderkey % 5 WHEN 3 THEN 'dbo.new_' || (o_custkey % 3) ELSE '' END AS alloc_unit_name, CAST(CASE o_orderkey % 5 WHEN 4 THEN 9000 + o_custkey % 2 ELSE 0 END AS BIGINT) AS alloc_unit_id, count(*) AS records,
 min(printf('%08x:%08x:%04x', CAST(1 AS BIGINT), CAST(o_orderkey AS BIGINT), CAST(2 AS BIGINT))) AS first_lsn FROM orders WHERE o_orderkey % 5 > 2 GROUP BY 1, 2""")
def unknown_storage(spark, sf_dir):
    """What records of no known table name; other indexes of known tables are none of it."""
    orders, k = _read(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), "o_orderkey"
    kind = F.col(k) % 5
    records = _record(orders.withColumn("kind", kind), k, 2, "LOP_INSERT_ROWS", "u").drop("alloc_unit_name", "alloc_unit_id")
    names = F.when(kind == 1, "SALES.customer.pk_customer").when(kind == 2, "sales.customer.IX_name").when(kind == 3, F.concat(F.lit("dbo.new_"), F.col("o_custkey") % 3)).otherwise("")
    units = F.when(kind == 0, 7001).when(kind == 4, 9000 + F.col("o_custkey") % 2).otherwise(0).cast("long")
    known = orders.select(F.format_string("%08x:%08x:%04x", F.lit(1).cast("long"), F.col(k).cast("long"), F.lit(2).cast("long")).alias("lsn"), names.alias("alloc_unit_name"), units.alias("alloc_unit_id"))
    found = resolve.unknown_storage(records.join(known, "lsn"), _catalog(spark))
    return found.select("alloc_unit_name", "alloc_unit_id", "records", "first_lsn")


def queries() -> dict:
    return _queries


def oracle_sql() -> dict[str, str]:
    return _oracles
