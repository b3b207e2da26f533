"""Registered queries over row images, storage resolution, sources and backups, each with SQL for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import lsn
from .functions import predicates as P
from .functions import rows as R
from .operators import analyzer, deltas, images, resolve, statements
from .sources import log_sources as src

ORDERS = R.TableSpec(
    "dbo",
    "orders",
    (
        R.ColumnSpec(1, "o_orderkey", R.BIGINT, nullable=False), R.ColumnSpec(2, "o_custkey", R.BIGINT), R.ColumnSpec(3, "o_orderstatus", R.VARCHAR, 1),
        R.ColumnSpec(4, "o_totalprice", R.DECIMAL, precision=15, scale=2), R.ColumnSpec(5, "o_orderdate", R.DATETIME2, scale=6), R.ColumnSpec(6, "o_orderpriority", R.VARCHAR, 15),
    ),
    (1,),
)
CUSTOMER = R.TableSpec(
    "dbo",
    "customer",
    (
        R.ColumnSpec(1, "c_custkey", R.BIGINT, nullable=False), R.ColumnSpec(2, "c_name", R.NVARCHAR, 200), R.ColumnSpec(3, "c_nationkey", R.INT),
        R.ColumnSpec(4, "c_acctbal", R.MONEY), R.ColumnSpec(5, "c_mktsegment", R.VARCHAR, 20), R.ColumnSpec(6, "c_odd", R.BIT), R.ColumnSpec(7, "c_third", R.BIT),
    ),
    (1,),
)
LINEITEM = R.TableSpec(
    "dbo",
    "lineitem",
    (
        R.ColumnSpec(1, "l_orderkey", R.BIGINT), R.ColumnSpec(2, "l_partkey", R.BIGINT), R.ColumnSpec(3, "l_linenumber", R.INT), R.ColumnSpec(4, "l_quantity", R.DECIMAL, precision=9, scale=2),
        R.ColumnSpec(5, "l_extendedprice", R.MONEY), R.ColumnSpec(6, "l_returnflag", R.CHAR, 1), R.ColumnSpec(7, "l_linestatus", R.CHAR, 1), R.ColumnSpec(8, "l_shipdate", R.DATETIME2, scale=6),
    ),
    (1, 3),
)
_ORDER_VALUES = {"o_orderkey": "o_orderkey", "o_custkey": "o_custkey", "o_orderstatus": "o_orderstatus", "o_totalprice": "cast(o_totalprice as decimal(15,2))", "o_orderdate": "o_orderdate", "o_orderpriority": "o_orderpriority"}
_queries: dict = {}
_oracles: dict = {}


def query(oracle: str):
    def register(f):
        _queries[f.__name__], _oracles[f.__name__] = f, oracle
        return f

    return register


def _read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def _orders(spark, sf_dir, nulls=None, stored=None) -> DataFrame:
    df = _read(spark, sf_dir, "orders", *_ORDER_VALUES)
    return df.withColumn("image", F.expr(R.encode_sql(ORDERS, _ORDER_VALUES, nulls, stored)))


def _values(df: DataFrame, spec: R.TableSpec, out: str = "row") -> DataFrame:
    return df.select(*[F.col(f"{out}.vals")[i].alias(c.name) for i, c in enumerate(spec.columns)])


_DATE = "'''' || strftime({c}, '%Y-%m-%d %H:%M:%S.%f') || '0'''"
_ORDER_SQL = f"""CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, '''' || o_orderstatus || '''' AS o_orderstatus, CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) AS o_totalprice,
 {_DATE.format(c='o_orderdate')} AS o_orderdate, '''' || o_orderpriority || '''' AS o_orderpriority"""


@query(f"SELECT {_ORDER_SQL} FROM orders")
def decode_orders_roundtrip(spark, sf_dir):
    return _values(R.decode(_orders(spark, sf_dir), ORDERS, "image", "row"), ORDERS)


@query(f"""SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_partkey AS VARCHAR) AS l_partkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber, CAST(CAST(l_quantity AS DECIMAL(9,2)) AS VARCHAR) AS l_quantity,
 CAST(CAST(round(l_extendedprice, 2) AS DECIMAL(15,4)) AS VARCHAR) AS l_extendedprice, '''' || l_returnflag || '''' AS l_returnflag, '''' || l_linestatus || '''' AS l_linestatus, {_DATE.format(c='l_shipdate')} AS l_shipdate FROM lineitem""")
def decode_lineitem_roundtrip(spark, sf_dir):
    df = _read(spark, sf_dir, "lineitem", *[c.name for c in LINEITEM.columns])
    values = {c.name: c.name for c in LINEITEM.columns} | {"l_quantity": "cast(l_quantity as decimal(9,2))", "l_extendedprice": "round(l_extendedprice, 2)"}
    return _values(R.decode(df.withColumn("image", F.expr(R.encode_sql(LINEITEM, values))), LINEITEM, "image", "row"), LINEITEM)


@query("""SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, 'N''' || c_name || '''' AS c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, CAST(CAST(round(c_acctbal, 2) AS DECIMAL(15,4)) AS VARCHAR) AS c_acctbal,
 '''' || c_mktsegment || '''' AS c_mktsegment, CAST(c_custkey % 2 AS VARCHAR) AS c_odd, CASE WHEN c_custkey % 3 = 0 THEN '1' ELSE '0' END AS c_third FROM customer""")
def decode_customer_varlen(spark, sf_dir):
    df = _read(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    values = {c.name: c.name for c in CUSTOMER.columns} | {"c_acctbal": "round(c_acctbal, 2)", "c_odd": "c_custkey % 2", "c_third": "if(c_custkey % 3 = 0, 1, 0)"}
    return _values(R.decode(df.withColumn("image", F.expr(R.encode_sql(CUSTOMER, values))), CUSTOMER, "image", "row"), CUSTOMER)


@query(f"""SELECT * REPLACE (CASE WHEN k % 7 = 0 THEN NULL ELSE o_custkey END AS o_custkey, CASE WHEN k % 5 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority) FROM (SELECT {_ORDER_SQL}, orders.o_orderkey AS k FROM orders)""")
def decode_null_bitmap(spark, sf_dir):
    df = _orders(spark, sf_dir, {"o_custkey": "o_orderkey % 7 = 0", "o_orderpriority": "o_orderkey % 5 = 0"}).withColumn("k", F.col("o_orderkey"))
    d = R.decode(df, ORDERS, "image", "row")
    return d.select("k", *[F.col("row.vals")[i].alias(c.name) for i, c in enumerate(ORDERS.columns)])


@query("""SELECT 'compressed_row' AS err, count(*) FILTER (o_orderkey % 4 = 0) AS n FROM orders UNION ALL SELECT 'off_row_lob', count(*) FILTER (o_orderkey % 4 = 1) FROM orders
UNION ALL SELECT 'schema_mismatch', count(*) FILTER (o_orderkey % 4 = 2) FROM orders UNION ALL SELECT 'ok', count(*) FILTER (o_orderkey % 4 = 3) FROM orders""")
def decode_errors(spark, sf_dir):
    """Images damaged in four ways: fixed end 0, an off-row mark, too many columns, and one cut to fewer columns, which reads well."""
    short = "concat(substring(image, 1, 2), X'0000', substring(image, 5, 1000))"
    end = 4 + 8 + 8 + 9 + 8
    lob = f"concat(substring(image, 1, {end + 5}), unhex(concat(hex(substring(image, {end + 6}, 1)), '80')), substring(image, {end + 8}, 1000))"
    wide = f"concat(substring(image, 1, {end}), X'0900', substring(image, {end + 3}, 1000))"
    df = _orders(spark, sf_dir).withColumn("image", F.expr(f"case o_orderkey % 4 when 0 then {short} when 1 then {lob} when 2 then {wide} else image end"))
    return R.decode(df, ORDERS, "image", "row").groupBy(F.coalesce("row.err", F.lit("ok")).alias("err")).agg(F.count(F.lit(1)).alias("n"))


_NAMES = ", ".join(f"[{c.name}]" for c in ORDERS.columns)
_LITERALS = "CAST(o_orderkey AS VARCHAR) || ', ' || CAST(o_custkey AS VARCHAR) || ', ''' || o_orderstatus || ''', ' || CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) || ', ' || " + _DATE.format(c="o_orderdate") + " || ', ''' || o_orderpriority || ''''"


@query(f"SELECT 'INSERT INTO [dbo].[orders] ({_NAMES}) VALUES (' || {_LITERALS} || ');' AS sql_stmt, 'DELETE FROM [dbo].[orders] WHERE [o_orderkey] = ' || o_orderkey || ';' AS rollback_sql, 'high' AS confidence FROM orders")
def gen_insert_sql(spark, sf_dir):
    d = R.decode(_orders(spark, sf_dir), ORDERS, "image", "row")
    g = statements.generated(ORDERS, F.lit("INSERT"), F.col("row"), F.col("row"))
    return d.select(g["sql_stmt"].alias("sql_stmt"), g["rollback_sql"].alias("rollback_sql"), g["confidence"].alias("confidence"))


@query(f"SELECT 'DELETE FROM [dbo].[orders] WHERE [o_orderkey] = ' || o_orderkey || ';' AS sql_stmt, 'INSERT INTO [dbo].[orders] ({_NAMES}) VALUES (' || {_LITERALS} || ');' AS rollback_sql FROM orders")
def gen_delete_sql(spark, sf_dir):
    d = R.decode(_orders(spark, sf_dir), ORDERS, "image", "row")
    g = statements.generated(ORDERS, F.lit("DELETE"), F.col("row"), F.col("row"))
    return d.select(g["sql_stmt"].alias("sql_stmt"), g["rollback_sql"].alias("rollback_sql"))


def _slot_history(spark, sf_dir) -> DataFrame:
    """Each order inserted, its customer changed twice (the second change names old bytes that are not there for every third order), deleted."""
    image = F.expr(R.encode_sql(ORDERS, _ORDER_VALUES))
    base = _read(spark, sf_dir, "orders", *_ORDER_VALUES).withColumn("image", image)
    key = F.expr(R._bytes("o_custkey", 8))
    one, two, wrong = (F.expr(R._bytes(f"o_custkey + {k}", 8)) for k in (1, 2, 77))
    old = F.when(F.col("o_orderkey") % 3 == 0, wrong).otherwise(one)
    names, none = ("n", "operation", "contents0", "contents1", "offset_in_row"), F.lit(None).cast("binary")
    step = lambda *c: F.struct(*[x.alias(n) for x, n in zip(c, names, strict=True)])
    steps = F.array(
        step(F.lit(1), F.lit("LOP_INSERT_ROWS"), F.col("image"), none, F.lit(-1)),
        step(F.lit(2), F.lit("LOP_MODIFY_ROW"), key, one, F.lit(12)),
        step(F.lit(3), F.lit("LOP_MODIFY_ROW"), old, two, F.lit(12)),
        step(F.lit(4), F.lit("LOP_DELETE_ROWS"), F.col("image"), none, F.lit(-1)),
    )
    rows = base.select("o_orderkey", F.explode(steps).alias("s")).select("o_orderkey", "s.*")
    return rows.select(
        F.lit("db0").alias("db_name"), F.lit(1).cast("long").alias("alloc_unit_id"), F.format_string("0001:%08x", F.floor(F.col("o_orderkey") / 50)).alias("page_id"), (F.col("o_orderkey") % 50).cast("int").alias("slot_id"),
        F.format_string("%016x:%d", "o_orderkey", "n").alias("lsn"), "o_orderkey", "n", "operation", "contents0", "contents1", "offset_in_row",
    )


@query("""SELECT CAST(o_orderkey AS BIGINT) AS k, n.n AS n, CASE n.n WHEN 1 THEN 'insert' WHEN 2 THEN 'splice' WHEN 3 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'not_verified' ELSE 'splice' END ELSE 'delete' END AS path,
 CASE WHEN n.n = 2 THEN CAST(o_custkey AS VARCHAR) WHEN n.n = 3 AND o_orderkey % 3 <> 0 THEN CAST(o_custkey + 1 AS VARCHAR) WHEN n.n = 4 THEN CAST(o_custkey AS VARCHAR) END AS before,
 CASE WHEN n.n = 1 THEN CAST(o_custkey AS VARCHAR) WHEN n.n = 2 THEN CAST(o_custkey + 1 AS VARCHAR) WHEN n.n = 3 AND o_orderkey % 3 <> 0 THEN CAST(o_custkey + 2 AS VARCHAR) END AS after
FROM orders, (SELECT CAST(unnest([1, 2, 3, 4]) AS INTEGER) AS n) n""")
def update_fold(spark, sf_dir):
    f = images.fold(_slot_history(spark, sf_dir))
    f = R.decode(R.decode(f, ORDERS, "before_image", "b"), ORDERS, "after_image", "a")
    return f.select(F.col("o_orderkey").cast("long").alias("k"), "n", F.col("fold_path").alias("path"), F.col("b.vals")[1].alias("before"), F.col("a.vals")[1].alias("after"))


def _updates(spark, sf_dir) -> DataFrame:
    f = images.fold(_slot_history(spark, sf_dir)).where("fold_path = 'splice'")
    return R.decode(R.decode(f, ORDERS, "before_image", "b"), ORDERS, "after_image", "a")


_TWO = "FROM orders, (SELECT CAST(unnest([2, 3]) AS INTEGER) AS n) n WHERE n.n = 2 OR o_orderkey % 3 <> 0"


@query(f"SELECT CAST(o_orderkey AS BIGINT) AS k, n.n AS n, 'o_custkey:' || (o_custkey + n.n - 2) || '>' || (o_custkey + n.n - 1) AS changed {_TWO}")
def update_diff(spark, sf_dir):
    d = statements.diff(ORDERS, F.col("b.vals"), F.col("a.vals"))
    text = F.array_join(F.transform(d, lambda x: F.concat(x["column"], F.lit(":"), x["before"], F.lit(">"), x["after"])), ",")
    return _updates(spark, sf_dir).select(F.col("o_orderkey").cast("long").alias("k"), "n", text.alias("changed"))


@query(f"""SELECT CAST(o_orderkey AS BIGINT) AS k, n.n AS n, 'update top(1) [dbo].[orders] set [o_custkey]=' || (o_custkey + n.n - 1) || ' where [o_orderkey]=' || o_orderkey || ';' AS redo,
 'update top(1) [dbo].[orders] set [o_custkey]=' || (o_custkey + n.n - 2) || ' where [o_orderkey]=' || o_orderkey || ';' AS undo,
 'UPDATE [dbo].[orders] SET [o_custkey] = ' || (o_custkey + n.n - 1) || ' WHERE [o_orderkey] = ' || o_orderkey || ';' AS forward,
 'UPDATE [dbo].[orders] SET [o_custkey] = ' || (o_custkey + n.n - 2) || ' WHERE [o_orderkey] = ' || o_orderkey || ';' AS inverse {_TWO}""")
def update_redo_undo(spark, sf_dir):
    b, a = F.col("b.vals"), F.col("a.vals")
    redo, undo = statements.redo_undo(ORDERS, b, a)
    there, back = statements.update_sql(ORDERS, b, a)
    return _updates(spark, sf_dir).select(F.col("o_orderkey").cast("long").alias("k"), "n", redo.alias("redo"), undo.alias("undo"), there.alias("forward"), back.alias("inverse"))


@query("""SELECT CAST(o_orderkey AS BIGINT) AS k, '-- No key in the fragment at offset 12; the changed columns may match more rows than one.' || chr(10) || 'UPDATE [dbo].[orders] SET [o_custkey] = ' || (o_custkey + 1) || ' WHERE [o_custkey] = ' || o_custkey || ';' AS forward,
 '-- No key in the fragment at offset 12; the changed columns may match more rows than one.' || chr(10) || 'UPDATE [dbo].[orders] SET [o_custkey] = ' || o_custkey || ' WHERE [o_custkey] = ' || (o_custkey + 1) || ';' AS inverse FROM orders""")
def update_from_fragment(spark, sf_dir):
    """The fragment's place is read from the end of the raw record."""
    old, new = R._bytes("o_custkey", 8), R._bytes("o_custkey + 1", 8)
    df = _read(spark, sf_dir, "orders", "o_orderkey", "o_custkey").selectExpr("o_orderkey", f"{old} AS old", f"{new} AS new")
    df = df.withColumn("record", F.expr("concat(X'AABBCC', X'0C0008000800', old, new)")).withColumn("at", deltas.fragment_offset("record", "new", "old"))
    forward, inverse = deltas.delta_update(ORDERS, F.col("delta"), F.col("at"))
    return deltas.fragment_values(df, ORDERS, "old", "new", "at").select(F.col("o_orderkey").cast("long").alias("k"), forward.alias("forward"), inverse.alias("inverse"))


@query("""SELECT status, confidence, count(*) AS n FROM (SELECT CASE WHEN n.n = 3 AND o_orderkey % 3 = 0 THEN 'patch_not_found' ELSE 'ok' END AS status, CASE WHEN n.n = 3 AND o_orderkey % 3 = 0 THEN 'low' ELSE 'high' END AS confidence
 FROM orders, (SELECT unnest([2, 3]) AS n) n) GROUP BY status, confidence""")
def update_analysis(spark, sf_dir):
    folded = images.fold(_slot_history(spark, sf_dir)).where("operation = 'LOP_MODIFY_ROW'")
    return analyzer.analyze(folded, ORDERS).groupBy("status", "confidence").agg(F.count(F.lit(1)).alias("n"))


# ---- resolution -----------------------------------------------------------------------------------------------------------------

_RECORD = """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 100 + event_id % 9 ELSE 0 END AS alloc_unit_id, CASE WHEN event_id % 3 = 0 THEN 200 + event_id % 7 ELSE 0 END AS partition_id,
 concat('DBO.t', CAST(user_id % 6 AS {s}), CASE WHEN event_id % 5 = 0 THEN '.pk_T1' WHEN event_id % 5 = 1 THEN '.ix_other' ELSE '' END) AS alloc_unit_name FROM {events}"""


def _catalog(spark):
    tables = spark.range(5).select(F.col("id").alias("object_id"), F.lit("dbo").alias("schema_name"), F.concat(F.lit("T"), F.col("id")).alias("table_name"), F.concat(F.lit("PK_T"), F.col("id")).alias("base_index"))
    parts = spark.range(9).select((F.col("id") % 6).alias("object_id"), (100 + F.col("id")).alias("alloc_unit_id"), (200 + F.col("id")).alias("partition_id"), (F.col("id") % 5).alias("code"))
    return tables, parts.where("alloc_unit_id <> 107 and partition_id <> 203")


def _records(spark, sf_dir):
    return spark.sql(_RECORD.format(s="STRING", events="{events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


_PARTS = "p AS (SELECT range % 6 AS object_id, 100 + range AS au, 200 + range AS pid, range % 5 AS code FROM range(9) WHERE range NOT IN (7, 3))"
_REC = f"r AS ({_RECORD.format(s='VARCHAR', events='events')}), {_PARTS}"
_MATCH = f"""{_REC},
j AS (SELECT r.*, u.object_id AS u, q.object_id AS q, CASE WHEN user_n < 5 AND (n_parts = 2 OR (tail = 'pk_t' || user_n)) THEN user_n END AS nm FROM
 (SELECT r.*, CAST(substr(split_part(alloc_unit_name, '.', 2), 2) AS BIGINT) AS user_n, len(string_split(alloc_unit_name, '.')) AS n_parts, lower(split_part(alloc_unit_name, '.', 3)) AS tail FROM r) r
 LEFT JOIN p u ON r.alloc_unit_id = u.au LEFT JOIN p q ON r.partition_id = q.pid)
"""


@query(f"""WITH {_MATCH} SELECT event_id, CASE WHEN u IS NOT NULL THEN 'alloc_unit' WHEN q IS NOT NULL THEN 'partition' WHEN nm IS NOT NULL THEN 'name' END AS match,
 CASE WHEN coalesce(u, q, nm) < 5 THEN coalesce(u, q, nm) END AS object_id FROM j""")
def resolve_storage(spark, sf_dir):
    tables, parts = _catalog(spark)
    return resolve.resolve_storage(_records(spark, sf_dir), tables, parts).select("event_id", "match", "object_id")


@query(f"""WITH {_REC} SELECT event_id, CASE coalesce(u.code, q.code, CASE WHEN event_id % 5 = 4 THEN NULL ELSE event_id % 5 END) WHEN 0 THEN 'NONE' WHEN 1 THEN 'ROW' WHEN 2 THEN 'PAGE' WHEN 3 THEN 'COLUMNSTORE' WHEN 4 THEN 'COLUMNSTORE' ELSE 'UNKNOWN' END AS compression
FROM r LEFT JOIN p u ON r.alloc_unit_id = u.au LEFT JOIN p q ON r.partition_id = q.pid""")
def resolve_compression(spark, sf_dir):
    _, parts = _catalog(spark)
    default = spark.range(4).select(F.col("id").alias("object_id"), F.col("id").alias("code"))
    r = _records(spark, sf_dir).withColumn("object_id", F.col("event_id") % 5)
    return resolve.resolve_compression(r, parts, default).select("event_id", "compression")


# ---- sources --------------------------------------------------------------------------------------------------------------------

_RAW = """SELECT event_id, {fmt}('%08x:%08x:%04x', CAST(34 AS BIGINT), CAST(floor(event_id/16) AS BIGINT), CAST(event_id % 16 + 1 AS BIGINT)) AS lsn,
 CASE event_id % 7 WHEN 0 THEN 'LOP_BEGIN_XACT' WHEN 1 THEN 'LOP_COMMIT_XACT' WHEN 2 THEN 'LOP_FORMAT_PAGE' WHEN 3 THEN 'LOP_INSERT_ROWS' ELSE 'LOP_MODIFY_ROW' END AS operation,
 CASE WHEN event_id % 5 = 0 THEN 'LCX_INDEX_LEAF' WHEN event_id % 5 = 1 THEN 'LCX_HEAP' ELSE 'LCX_CLUSTERED' END AS context,
 CASE WHEN user_id % 9 = 0 THEN 'sys.sysobj' WHEN user_id % 9 = 1 THEN 'Unknown Alloc Unit' WHEN user_id % 9 = 2 THEN NULL ELSE 'dbo.T1' END AS alloc_unit_name FROM {events}"""


def _raw(spark, sf_dir):
    return spark.sql(_RAW.format(fmt="format_string", events="{events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


_RAW_SQL = f"({_RAW.format(fmt='printf', events='events')})"


@query(f"""SELECT event_id FROM {_RAW_SQL} WHERE lsn > '00000022:00000010:0003' AND (operation IN ('LOP_BEGIN_XACT', 'LOP_COMMIT_XACT', 'LOP_ABORT_XACT') OR (operation IN ('LOP_INSERT_ROWS', 'LOP_DELETE_ROWS', 'LOP_MODIFY_ROW', 'LOP_MODIFY_COLUMNS')
 AND context IN ('LCX_HEAP', 'LCX_CLUSTERED', 'LCX_MARK_AS_GHOST') AND coalesce(alloc_unit_name, '') NOT LIKE 'sys.%' AND coalesce(alloc_unit_name, '') NOT LIKE 'Unknown Alloc Unit%'))""")
def log_filter_live(spark, sf_dir):
    return src.live(_raw(spark, sf_dir), "00000022:00000010:0003").select("event_id")


@query(f"SELECT event_id FROM {_RAW_SQL} WHERE operation IN ('LOP_INSERT_ROWS', 'LOP_MODIFY_ROW') AND lsn > '00000022:00000010:0003' AND lsn <= '00000022:00000100:0001'")
def log_filter_dump(spark, sf_dir):
    return src.dump(_raw(spark, sf_dir), ["LOP_INSERT_ROWS", "LOP_MODIFY_ROW"], "00000022:00000010:0003", "00000022:00000100:0001").select("event_id")


_BACKUP = """SELECT o_orderkey AS backup_id, o_orderdate AS finished, CAST(o_orderkey * 1000 AS DECIMAL(25,0)) AS first_lsn, CAST(o_orderkey * 1000 + 1500 AS DECIMAL(25,0)) AS last_lsn,
 concat('/b/', CAST(o_orderkey % 700 AS {s}), '.trn') AS path FROM {orders}"""


def _backups(spark, sf_dir):
    return spark.sql(_BACKUP.format(s="STRING", orders="{orders}"), orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))


_BACKUP_SQL = f"b AS ({_BACKUP.format(s='VARCHAR', orders='orders')})"


@query(f"""WITH {_BACKUP_SQL}, w AS ((SELECT * FROM b WHERE finished >= TIMESTAMP '1995-06-01' ORDER BY finished, backup_id LIMIT 512) UNION (SELECT * FROM b WHERE finished < TIMESTAMP '1995-06-01' ORDER BY finished DESC, backup_id DESC LIMIT 1))
SELECT path, min(row) AS row FROM (SELECT path, row_number() OVER (ORDER BY finished, backup_id) AS row FROM w) GROUP BY path""")
def backup_window_union(spark, sf_dir):
    from datetime import datetime

    return src.backup_window(_backups(spark, sf_dir), datetime(1995, 6, 1)).select("path", "row")


# Log numbers as the log writes them, an event in every fifth file; backups reach from file to file, every 25th over ten files.
_REAL_BACKUPS = """SELECT backup_id, CAST(f AS DECIMAL(25,0)) * CAST(281474976710656 AS DECIMAL(25,0)) + 65536 AS first_lsn, CAST(f + CASE WHEN backup_id % 25 = 0 THEN 10 ELSE 1 END AS DECIMAL(25,0)) * CAST(281474976710656 AS DECIMAL(25,0)) + 655361 AS last_lsn
 FROM (SELECT backup_id, 34 + backup_id AS f FROM {b})"""


@query(f"""WITH {_BACKUP_SQL}, r AS ({_REAL_BACKUPS.format(b="b")}), p AS (SELECT event_id, CAST(34 + event_id * 5 AS DECIMAL(25,0)) * CAST(281474976710656 AS DECIMAL(25,0)) + (event_id % 40) * 65536 + 1 AS lsn FROM events)
SELECT CAST(event_id AS BIGINT) AS event_id, backup_id FROM p JOIN r ON lsn BETWEEN first_lsn AND last_lsn""")
def lsn_range_join(spark, sf_dir):
    """Records and the backups that hold them, by the numbers of their texts."""
    backups = spark.sql(_REAL_BACKUPS.format(b="{b}"), b=_backups(spark, sf_dir))
    k = F.col("event_id").cast("long")
    text = F.format_string("%08x:%08x:%04x", 34 + k * 5, k % 40, F.lit(1).cast("long"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(k.alias("event_id"), lsn.lsn_decimal(text).alias("lsn"))
    return src.covering_backups(events, backups, "lsn").select("event_id", "backup_id")


@query("SELECT CAST(o_orderkey AS BIGINT) AS k, o_orderkey % 10 < 2 AS cleanup, o_orderkey % 5 = 0 AS url FROM orders")
def record_predicates(spark, sf_dir):
    df = _read(spark, sf_dir, "orders", "o_orderkey")
    contents = F.expr("case o_orderkey % 10 when 0 then X'070000000000000000010203040506' when 1 then X'4E0000000000000000010203040506' when 2 then X'080000000000000000010203040506' when 3 then X'070000000000000001010203040506' else X'07' end")
    path = F.when(F.col("o_orderkey") % 5 == 0, " S3://bucket/x.trn").otherwise("C:/x.trn")
    return df.select(F.col("o_orderkey").cast("long").alias("k"), P.is_cleanup_delete(F.lit("LOP_DELETE_ROWS"), contents).alias("cleanup"), P.is_url_device(path).alias("url"))


def queries() -> dict:
    return _queries


def oracle_sql() -> dict[str, str]:
    return _oracles
