"""Registered queries from records to events, compressed images, changes of several places, and the catalog, each with SQL for comparison."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import compressed
from .functions import rows as R
from .more_queries import _DATE, _LITERALS, _NAMES, _ORDER_VALUES, ORDERS, _read
from .operators import generate, images, transactions
from .sources import catalog as cat

_queries: dict = {}
_oracles: dict = {}

CUSTOMER = R.TableSpec(
    "sales",
    "customer",
    (R.ColumnSpec(1, "c_custkey", R.BIGINT, nullable=False), R.ColumnSpec(2, "c_name", R.VARCHAR, 40), R.ColumnSpec(4, "c_nationkey", R.INT), R.ColumnSpec(5, "c_acctbal", R.MONEY), R.ColumnSpec(6, "c_mktsegment", R.NVARCHAR, 40), R.ColumnSpec(7, "c_odd", R.BIT)),
    (1,),
    "ROW",
    physical=(
        R.ColumnSpec(1, "c_custkey", R.BIGINT, nullable=False), R.ColumnSpec(2, "c_name", R.VARCHAR, 40), R.ColumnSpec(3, "_dropped_3", R.INT, dropped=True), R.ColumnSpec(4, "c_nationkey", R.INT),
        R.ColumnSpec(5, "c_acctbal", R.MONEY), R.ColumnSpec(6, "c_mktsegment", R.NVARCHAR, 40), R.ColumnSpec(7, "c_odd", R.BIT),
    ),
)


def query(oracle: str):
    def register(f):
        _queries[f.__name__], _oracles[f.__name__] = f, oracle
        return f

    return register


# ---- an encoder of the compressed form, for fixtures ----------------------------------------------------------------------------------


def _short(value: int) -> bytes:
    """The fewest bytes of a signed number, most significant first, its sign bit inverted; none for zero."""
    if not value:
        return b""
    n = (value if value >= 0 else ~value).bit_length() // 8 + 1
    raw = value.to_bytes(n, "big", signed=True)
    return bytes((raw[0] ^ 128,)) + raw[1:]


def pack(parts: list) -> bytes:
    """A compressed image of bytes (or None, or a bool for a bit) by physical column."""
    kinds, short, long = [], b"", []
    for p in parts:
        if p is None:
            kinds.append(0)
        elif p is True or p is False:
            kinds.append(11 if p else 1)
        elif len(p) <= 8:
            kinds.append(len(p) + 1)
            short += p
        else:
            kinds.append(10)
            long.append(p)
    kinds += [0] * (len(kinds) % 2)
    out = b"\x30\x00" + bytes(a | b << 4 for a, b in zip(kinds[::2], kinds[1::2], strict=True)) + short
    if long:
        ends = [sum(map(len, long[: k + 1])) for k in range(len(long))]
        out += b"\x01" + bytes((len(long),)) + b"".join(e.to_bytes(2, "big") for e in ends) + b"\x00" + b"".join(long)
    return out


def _customers(spark, sf_dir) -> DataFrame:
    """c_custkey and the compressed image of a customer; every fifth has no segment, every seventh name is over eight bytes."""

    def run(key, name, nation, cents, segment):
        rows = zip(*(c.to_pylist() for c in (key, name, nation, cents, segment)), strict=True)
        return pa.array([pack([_short(k), n.encode(), _short(99), _short(a), _short(m), None if s is None else s.encode(), k % 2 == 1]) for k, n, a, m, s in rows], pa.binary())

    df = _read(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    name = F.when(F.col("c_custkey") % 7 == 0, F.col("c_name")).otherwise(F.concat(F.lit("n"), F.col("c_custkey") % 1000))
    image = R.arrow_function(run, "binary")(F.col("c_custkey").cast("long"), name, F.col("c_nationkey").cast("long"), F.round(F.col("c_acctbal") * 10000).cast("long"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_mktsegment")))
    return df.select(F.col("c_custkey").cast("long").alias("c_custkey"), image.alias("image"))


_C_NAME = "CASE WHEN c_custkey % 7 = 0 THEN c_name ELSE 'n' || (c_custkey % 1000) END"
_C_MONEY = "CAST(CAST(round(c_acctbal * 10000) AS BIGINT) * CAST(0.0001 AS DECIMAL(5,4)) AS DECIMAL(18,4))"
_C_VALUES = f"""CAST(c_custkey AS VARCHAR) AS c_custkey, '''' || {_C_NAME} || '''' AS c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, CAST({_C_MONEY} AS VARCHAR) AS c_acctbal,
 CASE WHEN customer.c_custkey % 5 > 0 THEN 'N''' || c_mktsegment || '''' END AS c_mktsegment, CAST(customer.c_custkey % 2 AS VARCHAR) AS c_odd"""


@query(f"SELECT {_C_VALUES} FROM customer")
def decode_row_compressed(spark, sf_dir):
    """Rows with a column that the table has dropped since."""
    d = compressed.decode(_customers(spark, sf_dir), CUSTOMER, "image", "row")
    return d.select(*[F.col("row.vals")[i].alias(c.name) for i, c in enumerate(CUSTOMER.columns)])


@query("""SELECT how, status, used, count(*) AS n FROM (SELECT how, CASE how WHEN 'dictionary' THEN 'page_dictionary_required' WHEN 'cut' THEN 'compressed_row_parse_failed' WHEN 'unknown' THEN 'schema_compression_metadata_missing' WHEN 'stale' THEN 'compressed_row_parse_failed' END AS status,
 CASE how WHEN 'unknown' THEN 'UNKNOWN' WHEN 'stale' THEN 'NONE' WHEN 'plain' THEN 'NONE' ELSE 'PAGE' END AS used FROM (SELECT ['good', 'dictionary', 'cut', 'unknown', 'stale', 'plain'][1 + c_custkey % 6] AS how FROM customer)) GROUP BY how, status, used""")
def decode_page_compressed(spark, sf_dir):
    """Images under PAGE compression: good, with a reference to the page's dictionary, cut; of unknown compression; compressed under NONE; plain under PAGE."""
    how = F.element_at(F.array(*map(F.lit, ("good", "dictionary", "cut", "unknown", "stale", "plain"))), (1 + F.col("c_custkey") % 6).cast("int"))
    plain = F.expr(R.encode_sql(CUSTOMER, {"c_custkey": "c_custkey", "c_name": "'x'", "c_nationkey": "1", "c_acctbal": "1.5", "c_mktsegment": "'y'", "c_odd": "1"}, stored=5))
    df = _customers(spark, sf_dir).withColumn("how", how).withColumn("plain", plain)
    image = F.expr("case how when 'dictionary' then concat(substring(image, 1, 2), X'CC', substring(image, 4, 1000)) when 'cut' then substring(image, 1, 7) when 'plain' then concat(X'10', substring(plain, 2, 1000)) else image end")
    compression = F.when(F.col("how") == "unknown", "UNKNOWN").when(F.col("how") == "stale", "NONE").otherwise("PAGE")
    read = generate.image_values(cat.of_specs(spark, {1: CUSTOMER}))
    d = df.withColumn("r", read(F.lit(1), F.lit(None).cast("long"), compression, image))
    return d.groupBy("how", F.col("r.status").alias("status"), F.col("r.used").alias("used")).agg(F.count(F.lit(1)).alias("n"))


# ---- records of several tables --------------------------------------------------------------------------------------------------------

_ORDERS_ID, _CUSTOMER_ID = 11, 12


def _record(df: DataFrame, key: str, n: int, operation: str, txn: str, context: str = "LCX_CLUSTERED", unit: int | None = None, name: str = "", c0=None, c1=None, c3=None, record=None, offset: int = -1, title: str = "", group: int = 1) -> DataFrame:
    raw = lambda c: (F.lit(None) if c is None else c).cast("binary")
    return df.select(
        F.lit("db0").alias("db_name"), F.format_string(f"%08x:%08x:%04x", F.lit(group).cast("long"), F.col(key).cast("long"), F.lit(n).cast("long")).alias("lsn"), F.lit(operation).alias("operation"), F.lit(context).alias("context"),
        F.concat(F.lit(txn), F.col(key).cast("string")).alias("transaction_id"), F.lit(title).alias("transaction_name"), F.lit(name).alias("alloc_unit_name"), F.lit(unit or 0).cast("long").alias("alloc_unit_id"), F.lit(0).cast("long").alias("partition_id"),
        F.format_string("%s:%08x", F.lit(txn), F.floor(F.col(key) / 40)).alias("page_id"), (F.col(key) % 40).cast("int").alias("slot_id"), raw(c0).alias("contents0"), raw(c1).alias("contents1"),
        raw(None).alias("contents2"), raw(c3).alias("contents3"), raw(None).alias("contents4"), raw(record).alias("log_record"), F.lit(offset).alias("offset_in_row"), F.lit(-1).alias("modify_size"),
        F.when(F.lit(operation).isin("LOP_BEGIN_XACT", "LOP_COMMIT_XACT"), F.timestamp_seconds(F.col(key) * 60 + n)).alias("seen_at"), F.lit(False).alias("cleanup"),
    )


def _catalog(spark):
    """orders resolves by alloc unit, customer (compressed) by name; a third table's unit is in no catalog."""
    from dataclasses import replace

    found = cat.of_specs(spark, {_ORDERS_ID: replace(ORDERS, places={}), _CUSTOMER_ID: replace(CUSTOMER, base_index="PK_customer", places={})})
    found.partitions = spark.createDataFrame([(_ORDERS_ID, 7001, 0, 0)], "object_id int, alloc_unit_id long, partition_id long, code int")
    return found


def _records(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders", *_ORDER_VALUES).withColumn("image", F.expr(R.encode_sql(ORDERS, _ORDER_VALUES)))
    moved = orders.withColumn("image", F.expr(R.encode_sql(ORDERS, _ORDER_VALUES | {"o_custkey": "o_custkey + 1"})))
    customers, k, au = _customers(spark, sf_dir), "o_orderkey", 7001
    old, new = F.expr(R._bytes("o_custkey", 8)), F.expr(R._bytes("o_custkey + 1", 8))
    parts = [
        _record(orders, k, 1, "LOP_BEGIN_XACT", "o"),
        _record(orders, k, 2, "LOP_INSERT_ROWS", "o", unit=au, c0=F.col("image")),
        _record(orders, k, 3, "LOP_INSERT_ROWS", "o", "LCX_INDEX_LEAF", unit=au, c0=F.lit(b"key of an index")),
        _record(orders.where("o_orderkey % 7 <> 0"), k, 4, "LOP_COMMIT_XACT", "o"),
        _record(orders.where("o_orderkey % 7 = 0"), k, 4, "LOP_ABORT_XACT", "o"),
        # The id is used again; this transaction changes the row by a fragment that its image confirms.
        _record(orders, k, 5, "LOP_BEGIN_XACT", "o"),
        _record(orders, k, 6, "LOP_MODIFY_ROW", "o", unit=au, c0=old, c1=new, offset=12),
        _record(orders.where("o_orderkey % 11 <> 0"), k, 7, "LOP_COMMIT_XACT", "o"),
        # A deletion of the changed row, and another of a row whose key reads as NULL.
        _record(moved.where("o_orderkey % 2 = 0"), k, 8, "LOP_DELETE_ROWS", "o", unit=au, c0=F.col("image"), group=2),
        _record(moved.where("o_orderkey % 2 = 0"), k, 9, "LOP_COMMIT_XACT", "o", group=2),
        _record(customers, "c_custkey", 1, "LOP_BEGIN_XACT", "c", group=3),
        _record(customers, "c_custkey", 2, "LOP_INSERT_ROWS", "c", name="SALES.Customer.pk_customer", c0=F.col("image"), group=3),
        _record(customers, "c_custkey", 3, "LOP_INSERT_ROWS", "c", name="sales.customer.ix_name", c0=F.col("image"), group=3),
        _record(customers, "c_custkey", 4, "LOP_COMMIT_XACT", "c", group=3),
        _record(customers.where("c_custkey % 9 = 0"), "c_custkey", 1, "LOP_BEGIN_XACT", "b", title="Backup: log", group=4),
        _record(customers.where("c_custkey % 9 = 0"), "c_custkey", 2, "LOP_INSERT_ROWS", "b", name="sales.customer", c0=F.col("image"), group=4),
        _record(customers.where("c_custkey % 9 = 0"), "c_custkey", 3, "LOP_COMMIT_XACT", "b", group=4),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_MOVED = _LITERALS.replace("CAST(o_custkey AS VARCHAR)", "CAST(o_custkey + 1 AS VARCHAR)")
_LSN = "printf('%08x:%08x:%04x', CAST({g} AS BIGINT), CAST({k} AS BIGINT), CAST({n} AS BIGINT)) AS lsn"
_AS_TEXT = "coalesce({}, 'NULL')"
_C_ALL = " || ', ' || ".join(f"coalesce({c}, 'NULL')" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "c_odd"))
_SCAN = f"""
SELECT {_LSN.format(g=1, k='o_orderkey', n=2)}, 'INSERT' AS operation, 'orders' AS table_name, 'INSERT INTO [dbo].[orders] ({_NAMES}) VALUES (' || {_LITERALS} || ');' AS sql_stmt, 'DELETE FROM [dbo].[orders] WHERE [o_orderkey] = ' || o_orderkey || ';' AS rollback_sql,
 CAST(NULL AS VARCHAR) AS status, CAST(NULL AS VARCHAR) AS compression_type FROM orders WHERE o_orderkey % 7 <> 0
UNION ALL SELECT {_LSN.format(g=1, k='o_orderkey', n=6)}, 'UPDATE', 'orders', 'UPDATE [dbo].[orders] SET [o_custkey] = ' || (o_custkey + 1) || ' WHERE [o_orderkey] = ' || o_orderkey || ';', 'UPDATE [dbo].[orders] SET [o_custkey] = ' || o_custkey || ' WHERE [o_orderkey] = ' || o_orderkey || ';', NULL, NULL
 FROM orders WHERE o_orderkey % 11 <> 0 OR o_orderkey % 2 = 0
UNION ALL SELECT {_LSN.format(g=2, k='o_orderkey', n=8)}, 'DELETE', 'orders', 'DELETE FROM [dbo].[orders] WHERE [o_orderkey] = ' || o_orderkey || ';', 'INSERT INTO [dbo].[orders] ({_NAMES}) VALUES (' || {_MOVED} || ');', NULL, NULL FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT lsn, 'INSERT', 'customer', 'INSERT INTO [sales].[customer] ([c_custkey], [c_name], [c_nationkey], [c_acctbal], [c_mktsegment], [c_odd]) VALUES (' || {_C_ALL} || ');', 'DELETE FROM [sales].[customer] WHERE [c_custkey] = ' || c_custkey || ';', 'ok', 'ROW'
 FROM (SELECT {_LSN.format(g=3, k='customer.c_custkey', n=2)}, {_C_VALUES} FROM customer)
"""


@query(_SCAN)
def scan_events(spark, sf_dir):
    """Records of two tables in many transactions: inserts, updates and deletions, aborted, open and internal ones, other indexes."""
    e = generate.scan(_records(spark, sf_dir), _catalog(spark))
    return e.select("lsn", "operation", "table_name", "sql_stmt", "rollback_sql", "status", "compression_type")


@query(f"SELECT count(*) AS generated, count(*) FILTER (operation = 'INSERT') AS inserts, count(*) FILTER (operation = 'UPDATE') AS updates, count(*) FILTER (operation = 'DELETE') AS deletes, CAST(0 AS BIGINT) AS errors, (SELECT 3 * count(*) + count(*) FILTER (o_orderkey % 2 = 0) FROM orders) AS data, (SELECT 2 * count(*) + count(*) FILTER (o_orderkey % 2 = 0) FROM orders) AS eligible FROM ({_SCAN}) WHERE table_name = 'orders'")
def scan_details(spark, sf_dir):
    """Counters of a scan of one table out of two."""
    records, both = _records(spark, sf_dir).where("transaction_id like 'o%'"), _catalog(spark)
    one = cat.only(both, ["[DBO].[orders]"])
    data = generate.resolved(records.where("operation in ('LOP_INSERT_ROWS', 'LOP_MODIFY_ROW', 'LOP_DELETE_ROWS')"), one)
    return transactions.detail_counters(data, generate.scan(records, one)).select("generated", "inserts", "updates", "deletes", "errors", "data", "eligible")


_FRAGMENT = """SELECT CAST(o_orderkey AS BIGINT) AS k, '-- No key in the fragment at offset 12; the changed columns may match more rows than one.' || chr(10) || 'UPDATE [dbo].[orders] SET [o_custkey] = ' || now || ' WHERE [o_custkey] = ' || o_custkey || ';' AS forward,
 '-- No key in the fragment at offset 12; the changed columns may match more rows than one.' || chr(10) || 'UPDATE [dbo].[orders] SET [o_custkey] = ' || o_custkey || ' WHERE [o_custkey] = ' || now || ';' AS inverse
FROM (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey + 1 ELSE 262192 END AS now FROM orders)"""


@query(_FRAGMENT)
def scan_fragments(spark, sf_dir):
    """Updates of rows without a known image: half of the records give the fragment's offset, half only the raw record."""
    orders, k = _read(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), "o_orderkey"
    old, new = F.expr(R._bytes("o_custkey", 8)), F.expr(R._bytes("o_custkey + 1", 8))
    placed = _record(orders.where("o_orderkey % 2 = 0"), k, 2, "LOP_MODIFY_ROW", "u", unit=7001, c0=old, c1=new, offset=12)
    # In the raw record the old bytes come first, in the record's own parts the new ones. These read as an image without a value.
    blank = F.expr("X'3000040000000000'")
    raw = F.concat(F.expr("X'AABBCC'"), F.expr("X'0C0008000800'"), old, blank)
    loose = _record(orders.where("o_orderkey % 2 = 1"), k, 2, "LOP_MODIFY_ROW", "u", unit=7001, c0=blank, c1=old, record=raw)
    folded = images.fold(generate.resolved(placed.unionByName(loose), _catalog(spark)))
    made = generate.statements(folded, _catalog(spark))
    key = F.conv(F.substring("lsn", 10, 8), 16, 10).cast("long")
    return made.select(key.alias("k"), F.col("sql_stmt").alias("forward"), F.col("rollback_sql").alias("inverse"))


# ---- changes of several places --------------------------------------------------------------------------------------------------------


def _priority_changes(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(insertions, changes, pages): the priority of each order grows to CHANGED, with the end offset in the row's table of ends."""
    after = _ORDER_VALUES | {"o_orderpriority": "'CHANGED'"}
    df = _read(spark, sf_dir, "orders", *_ORDER_VALUES).selectExpr("*", f"{R.encode_sql(ORDERS, _ORDER_VALUES)} AS image", f"{R.encode_sql(ORDERS, after)} AS now")
    u16 = lambda x: R._bytes(x, 2)
    size = "length(o_orderpriority)"
    pad = lambda b: f"concat({b}, substring(X'000000', 1, cast(pmod(4 - length({b}), 4) as int)))"
    ends = lambda b: f"substring({b}, 45, 2)"
    text, new = "cast(o_orderpriority as binary)", "cast('CHANGED' as binary)"
    c0 = f"concat({u16('44')}, {u16('44')}, {u16('47')}, {u16('47')})"
    record = f"concat(X'0102030405060708', X'AABBCCDD', {pad(ends('image'))}, {pad(ends('now'))}, {pad(text)}, {new})"
    c1 = f"concat({u16('2')}, {u16(size)})"
    changes = _record(df, "o_orderkey", 2, "LOP_MODIFY_COLUMNS", "m", unit=7001, c0=F.expr(c0), c1=F.expr(c1), c3=F.expr("X'AABBCCDD'"), record=F.expr(record))
    inserts = _record(df, "o_orderkey", 1, "LOP_INSERT_ROWS", "m", unit=7001, c0=F.col("image"))
    pages = _record(df, "o_orderkey", 1, "LOP_INSERT_ROWS", "m", c0=F.col("now")).select("db_name", "page_id", "slot_id", F.col("contents0").alias("image"))
    return inserts, changes, pages


_COLUMNS = """SELECT CAST(o_orderkey AS BIGINT) AS k, '{}' AS path, 'UPDATE [dbo].[orders] SET [o_orderpriority] = ''CHANGED'' WHERE [o_orderkey] = ' || o_orderkey || ';' AS forward, 'UPDATE [dbo].[orders] SET [o_orderpriority] = ''' || o_orderpriority || ''' WHERE [o_orderkey] = ' || o_orderkey || ';' AS inverse FROM orders"""


def _changed(folded: DataFrame, spark) -> DataFrame:
    made = generate.statements(folded.where("operation = 'LOP_MODIFY_COLUMNS'"), _catalog(spark))
    return made.select(F.conv(F.substring("lsn", 10, 8), 16, 10).cast("long").alias("k"), F.col("fold_path").alias("path"), F.col("sql_stmt").alias("forward"), F.col("rollback_sql").alias("inverse"))


@query(_COLUMNS.format("splice_columns"))
def modify_columns_forward(spark, sf_dir):
    """From the row's image before the change."""
    inserts, changes, _ = _priority_changes(spark, sf_dir)
    return _changed(images.fold(generate.resolved(inserts.unionByName(changes), _catalog(spark))), spark)


@query(_COLUMNS.format("reverse_page"))
def modify_columns_reverse(spark, sf_dir):
    """From the row's current image on its page."""
    _, changes, pages = _priority_changes(spark, sf_dir)
    return _changed(images.fold(images.with_page_images(generate.resolved(changes, _catalog(spark)), pages)), spark)


@query("SELECT CAST(o_orderkey AS BIGINT) AS k, '-- modify_columns_not_decoded: [dbo].[orders]' AS forward, 'modify_columns_not_decoded' AS status, 'low' AS confidence, 'no_image' AS images FROM orders")
def modify_columns_undecoded(spark, sf_dir):
    """Without any image a record keeps its bytes as JSON."""
    _, changes, _ = _priority_changes(spark, sf_dir)
    made = generate.statements(images.fold(generate.resolved(changes, _catalog(spark))), _catalog(spark))
    return made.select(F.conv(F.substring("lsn", 10, 8), 16, 10).cast("long").alias("k"), F.col("sql_stmt").alias("forward"), "status", "confidence", F.get_json_object("decompressed_debug_json", "$.images").alias("images"))


# ---- catalog --------------------------------------------------------------------------------------------------------------------------


def catalog_frames(spark, sf_dir) -> dict[str, DataFrame]:
    """A catalog with a table for each nation: a key, a computed column that is left out, two partitions, a column dropped in every third table."""
    n = _read(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")
    tables = n.select(F.col("n_nationkey").cast("int").alias("object_id"), F.lit("dbo").alias("schema_name"), F.col("n_name").alias("table_name"), (F.col("n_regionkey") == 4).alias("is_ms_shipped"))
    ids = tables.select("object_id")
    column = lambda i, name, kind, size, key=False, computed=False, p=0, s=0: ids.select(
        "object_id", F.lit(i).alias("column_id"), F.lit(name).alias("name"), F.lit(kind).alias("user_type_id"), F.lit(size).alias("max_length"), F.lit(p).alias("precision"), F.lit(s).alias("scale"), F.lit(not key).alias("is_nullable"), F.lit(key).alias("is_identity"), F.lit(computed).alias("is_computed")
    )
    columns = column(1, "id", 56, 4, True).union(column(3, "price", 106, 9, p=12, s=2)).union(column(4, "title", 231, 80)).union(column(5, "twice", 56, 4, computed=True))
    types = spark.createDataFrame([(56, 56), (106, 106), (231, 231)], "user_type_id int, system_type_id int")
    keys = ids.select("object_id", F.lit(1).alias("column_id"), F.lit(1).alias("key_ordinal"), F.lit(True).alias("is_primary_key"))
    indexes = ids.select("object_id", F.lit(1).alias("index_id"), F.concat(F.lit("PK_"), F.col("object_id")).alias("name"))
    part = lambda k, code: ids.select("object_id", F.lit(1).alias("index_id"), F.lit(k).alias("partition_number"), (F.col("object_id") * 10 + k).cast("long").alias("partition_id"), (F.col("object_id") * 100 + k + 1_000_000).cast("long").alias("hobt_id"), code.cast("int").alias("data_compression"))
    partitions = part(1, F.lit(0)).union(part(2, F.col("object_id") % 3))
    units = partitions.select(F.when(F.col("partition_number") == 1, F.col("hobt_id")).otherwise(F.col("partition_id")).alias("container_id"), (F.col("partition_id") + 5000).alias("allocation_unit_id"), F.lit("IN_ROW_DATA").alias("type_desc"))
    stored = partitions.select("object_id", "partition_id").join(spark.createDataFrame([(1, 56, 4, 4), (2, 56, 4, 8), (3, 106, 9, 12), (4, 231, 80, -1)], "column_id int, system_type_id int, max_inrow_length int, leaf_offset int"), F.expr("column_id <> 2 or object_id % 3 = 0"))
    return {"tables": tables, "columns": columns, "types": types, "index_columns": keys, "indexes": indexes, "partitions": partitions, "units": units, "physical": stored}


_SPEC_SQL = """SELECT CAST(n_nationkey AS INTEGER) AS object_id, '[dbo].[' || n_name || ']' AS full_name, c.id AS column_id, c.name, c.kind AS type, c.declared, c.id > 1 AS nullable, c.id = 1 AS key FROM nation,
 (VALUES (1, 'id', 56, 'int'), (3, 'price', 106, 'decimal(12,2)'), (4, 'title', 231, 'nvarchar(40)')) c(id, name, kind, declared) WHERE n_regionkey <> 4"""


@query(_SPEC_SQL)
def catalog_columns(spark, sf_dir):
    return cat.spec_rows(cat.extract(spark, catalog_frames(spark, sf_dir)))


@query("""SELECT CAST(n_nationkey AS BIGINT) AS object_id, n_nationkey * 10 + p AS partition_id, c.id AS column_id, CASE WHEN c.id = 2 THEN '_dropped_2' ELSE c.name END AS name, c.id = 2 AS dropped FROM nation, range(1, 3) t(p),
 (VALUES (1, 'id'), (2, ''), (3, 'price'), (4, 'title')) c(id, name) WHERE n_regionkey <> 4 AND (c.id <> 2 OR n_nationkey % 3 = 0)""")
def catalog_dropped(spark, sf_dir):
    """The stored columns that compressed rows of each partition are cut by."""
    found = cat.extract(spark, catalog_frames(spark, sf_dir))
    rows = [(i, p, c.id, c.name, c.dropped) for i in found.specs for p in (i * 10 + 1, i * 10 + 2) for c in found.spec(i, p).physical]
    return spark.createDataFrame(rows, "object_id long, partition_id long, column_id int, name string, dropped boolean")


@query("""SELECT CAST(n_nationkey AS BIGINT) AS object_id, n_nationkey * 10 + p AS partition_id, n_nationkey * 10 + p + 5000 AS alloc_unit_id, CASE p WHEN 1 THEN 0 ELSE n_nationkey % 3 END AS code FROM nation, range(1, 3) t(p)""")
def catalog_partitions(spark, sf_dir):
    p = cat.partition_rows(catalog_frames(spark, sf_dir))
    return p.select(F.col("object_id").cast("long").alias("object_id"), "partition_id", "alloc_unit_id", F.col("code").cast("int").alias("code"))


@query(_SPEC_SQL)
def schema_json_roundtrip(spark, sf_dir):
    return cat.spec_rows(cat.of_json(spark, cat.to_json(cat.extract(spark, catalog_frames(spark, sf_dir)))))


def queries() -> dict:
    return _queries


def oracle_sql() -> dict[str, str]:
    return _oracles
