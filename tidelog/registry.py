"""Registered queries of the log engine, by name, each with SQL for comparison."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import more_queries, scan_queries, source_queries
from .functions import lsn as L
from .operators import store, transactions
from .plans import fixtures
from .plans import log_queries as Q
from .sources import log_sources

EV = f"({fixtures.sql(fixtures.EVENTS, True)}) AS log_events"
REC = f"({fixtures.sql(fixtures.RECORDS, True)}) AS log_records"
PAGE = "id, lsn, txn_id, operation, db_name, schema_name, table_name, sql_stmt, rollback_sql, event_time, commit_time, status"
COUNTS = ", ".join(f"CAST(sum(CASE WHEN operation = '{o}' THEN 1 ELSE 0 END) AS BIGINT) AS {a}" for o, a in (("INSERT", "inserts"), ("UPDATE", "updates"), ("DELETE", "deletes")))
IN_TXN = "txn_id IS NOT NULL AND txn_id <> ''"
SINCE, UNTIL = datetime(2024, 1, 5, 3, 4, 5, 678000), datetime(2024, 2, 20, 1, 2, 3, 456000)

_queries: dict = {}
_oracles: dict = {}


def events_query(oracle: str | None):
    """Registers f(events) as a query over the fixture events."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(fixtures.log_events(spark, sf_dir))

        _queries[f.__name__] = run
        if oracle:
            _oracles[f.__name__] = oracle
        return f

    return register


def records_query(oracle: str):
    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(fixtures.log_records(spark, sf_dir).withColumn("db_name", F.lit("db0")))

        _queries[f.__name__] = run
        _oracles[f.__name__] = oracle
        return f

    return register


# ---- pages ----------------------------------------------------------------------------------------------------------------------


@events_query(f"SELECT {PAGE} FROM {EV} ORDER BY event_time DESC NULLS LAST, id DESC LIMIT 200 OFFSET 200")
def logs_page(e):
    return Q.logs(e, page=2)


@events_query(f"SELECT {PAGE} FROM {EV} ORDER BY lsn ASC NULLS LAST, id LIMIT 50")
def logs_sort_lsn_asc(e):
    return Q.logs(e, sort="lsn", direction="asc", limit=50)


@events_query(f"SELECT {PAGE} FROM {EV} WHERE operation IN ('INSERT', 'DELETE') AND db_name = 'db1' ORDER BY event_time ASC NULLS LAST, id LIMIT 300")
def logs_multi_op(e):
    return Q.logs(e, Q.LogFilter(operation="INSERT, DELETE", db="db1"), direction="asc", limit=300)


@events_query(f"SELECT {PAGE} FROM {EV} WHERE schema_name = 'sales' AND table_name = 'T3' ORDER BY operation DESC NULLS LAST, id DESC LIMIT 200")
def logs_table_dotted(e):
    return Q.logs(e, Q.LogFilter(table="sales.T3"), sort="operation")


@events_query(f"SELECT {PAGE} FROM {EV} WHERE sql_stmt LIKE '%purchase%1%' ORDER BY event_time DESC NULLS LAST, id DESC LIMIT 200")
def logs_search_like(e):
    return Q.logs(e, Q.LogFilter(search="purchase%1"))


@events_query(f"SELECT {PAGE} FROM {EV} WHERE event_time >= TIMESTAMP '2024-01-05 03:04:05.678' AND event_time <= TIMESTAMP '2024-02-20 01:02:03.456' ORDER BY event_time DESC NULLS LAST, id DESC LIMIT 200")
def logs_time_range(e):
    return Q.logs(e, Q.LogFilter(since=SINCE, until=UNTIL))


@events_query(f"SELECT count(*) AS total FROM {EV} WHERE operation = 'UPDATE'")
def logs_total(e):
    return Q.total(e, Q.LogFilter(operation="UPDATE"))


@events_query(f"SELECT {PAGE} FROM {EV} WHERE sql_stmt LIKE '%click%' ORDER BY event_time DESC NULLS LAST, id DESC LIMIT 100 OFFSET 30")
def search_page(e):
    return Q.search(e, Q.LogFilter(search="click"), offset=30)


@events_query(f"SELECT {PAGE} FROM {EV} WHERE db_name = 'db2' ORDER BY id LIMIT 100 OFFSET 10")
def events_legacy(e):
    return Q.by_id(e, Q.LogFilter(db="db2"), offset=10)


@events_query(f"SELECT {PAGE} FROM {EV} WHERE status IS NOT NULL AND status <> 'ok' AND schema_name = 'dbo' ORDER BY event_time DESC NULLS LAST, id DESC LIMIT 200")
def diagnostics(e):
    return Q.diagnostics(e, Q.LogFilter(schema="dbo"), 5000)


@events_query(f"SELECT operation, count(*) AS n FROM {EV} GROUP BY operation")
def stats_by_op(e):
    return Q.stats_by_operation(e)


@events_query(f"SELECT DISTINCT schema_name || '.' || table_name AS name FROM {EV}")
def stats_tables(e):
    return Q.stats_tables(e)


@events_query(f"SELECT DISTINCT db_name FROM {EV} WHERE db_name <> ''")
def stats_databases(e):
    return Q.stats_databases(e)


# ---- transactions and activity --------------------------------------------------------------------------------------------------

GROUPS = f"""SELECT db_name, txn_id, min(event_time) AS event_time, max(commit_time) AS commit_time, min(lsn) AS first_lsn, max(lsn) AS last_lsn, count(*) AS events, {COUNTS}
FROM {EV} WHERE {IN_TXN} GROUP BY db_name, txn_id ORDER BY max(coalesce(commit_time, event_time)) DESC NULLS LAST, max(lsn) DESC LIMIT 50 OFFSET 50"""


@events_query(f"SELECT count(*) AS total FROM (SELECT DISTINCT db_name, txn_id FROM {EV} WHERE {IN_TXN} AND operation = 'DELETE')")
def txn_count(e):
    return Q.transaction_count(e, Q.LogFilter(operation="DELETE"))


@events_query(GROUPS)
def txn_groups(e):
    return Q.transaction_groups(e, page=2, limit=50)


@events_query(f"WITH g AS ({GROUPS}) SELECT {PAGE} FROM {EV} WHERE EXISTS (SELECT 1 FROM g WHERE g.db_name = log_events.db_name AND g.txn_id = log_events.txn_id)")
def txn_detail_semi(e):
    return Q.transaction_events(e, Q.transaction_groups(e, page=2, limit=50))


@events_query(f"WITH g AS ({GROUPS}) SELECT db_name, txn_id, CAST(sum(CASE WHEN trim(rollback_sql) <> '' AND NOT starts_with(trim(rollback_sql), '--') THEN 1 ELSE 0 END) AS BIGINT) AS rollbacks FROM {EV} WHERE (db_name, txn_id) IN (SELECT (db_name, txn_id) FROM g) GROUP BY db_name, txn_id")
def txn_rollback_count(e):
    return Q.transaction_details(e, Q.transaction_groups(e, page=2, limit=50)).select("db_name", "txn_id", "rollbacks")


@events_query(f"WITH g AS ({GROUPS}) SELECT db_name, txn_id, string_agg(DISTINCT schema_name || '.' || table_name, ',' ORDER BY schema_name || '.' || table_name) AS tables, string_agg(lsn || ' ' || operation, ',' ORDER BY lsn) AS log FROM {EV} WHERE (db_name, txn_id) IN (SELECT (db_name, txn_id) FROM g) GROUP BY db_name, txn_id")
def txn_tables(e):
    d = Q.transaction_details(e, Q.transaction_groups(e, page=2, limit=50))
    return d.select("db_name", "txn_id", F.array_join("tables", ",").alias("tables"), F.array_join(F.transform("log", lambda x: F.concat_ws(" ", x["lsn"], x["operation"])), ",").alias("log"))


_MS = int((SINCE - datetime(1970, 1, 1)).total_seconds() * 1000)
_STEP = int((UNTIL - SINCE).total_seconds() * 1000) // 72
TIMELINE = f"""SELECT bucket, {COUNTS}, count(*) AS total FROM
 (SELECT CAST(floor((epoch_ms(event_time) - {_MS}) / {_STEP}) AS BIGINT) AS bucket, operation FROM {EV}
  WHERE event_time >= TIMESTAMP '2024-01-05 03:04:05' AND event_time <= TIMESTAMP '2024-02-20 01:02:03')
WHERE bucket BETWEEN 0 AND 71 GROUP BY bucket"""


@events_query(TIMELINE)
def timeline_counts(e):
    return Q.timeline(e, SINCE, UNTIL, dense=False)


@events_query(f"""SELECT CAST(b.range AS BIGINT) AS bucket, coalesce(inserts, 0) AS inserts, coalesce(updates, 0) AS updates, coalesce(deletes, 0) AS deletes, coalesce(total, 0) AS total
FROM range(72) b LEFT JOIN ({TIMELINE}) t ON b.range = t.bucket""")
def timeline_dense(e):
    return Q.timeline(e, SINCE, UNTIL)


# ---- the store ------------------------------------------------------------------------------------------------------------------

TWICE = f"(SELECT * REPLACE (CASE WHEN id % 3 = 0 THEN lsn ELSE lsn || 'x' END AS lsn), id AS seq FROM {EV} UNION ALL SELECT * REPLACE (id + 1000000 AS id, CASE WHEN id % 2 = 0 THEN 'late' ELSE status END AS status), id + 1000000 FROM {EV} WHERE id % 3 = 0 OR id % 5 = 0)"


def _twice(e: DataFrame) -> DataFrame:
    early = e.withColumn("ingest_seq", F.col("id")).withColumn("lsn", F.when(F.col("id") % 3 == 0, F.col("lsn")).otherwise(F.concat("lsn", F.lit("x"))))
    late = e.where("id % 3 = 0 or id % 5 = 0").withColumn("status", F.when(F.col("id") % 2 == 0, F.lit("late")).otherwise(F.col("status"))).withColumn("id", F.col("id") + 1000000)
    return early.unionByName(late.withColumn("ingest_seq", F.col("id")))


@events_query(f"SELECT db_name, lsn, min(id) AS id FROM {TWICE} GROUP BY db_name, lsn")
def dedup_first(e):
    return store.first_kept(_twice(e)).select("db_name", "lsn", "id")


@events_query(f"SELECT db_name, lsn, max(id) AS id, arg_max(coalesce(status, '-'), seq) AS status FROM {TWICE} GROUP BY db_name, lsn")
def upsert_latest(e):
    return store.latest(_twice(e)).select("db_name", "lsn", "id", F.coalesce("status", F.lit("-")).alias("status"))


@events_query(f"SELECT db_name, lsn, id FROM {EV} WHERE id % 7 <> 0")
def upsert_retracted(e):
    v = e.withColumn("ingest_seq", F.col("id")).withColumn("is_deleted", F.lit(False))
    return store.latest(v.unionByName(store.retracted(v, e.where("id % 7 = 0"), 10**9))).select("db_name", "lsn", "id")


@events_query(f"SELECT {PAGE} FROM {EV} WHERE (db_name, txn_id) NOT IN (SELECT (db_name, txn_id) FROM {EV} WHERE operation = 'DELETE')")
def retract_txn_anti(e):
    return store.without_transactions(e, e.where("operation = 'DELETE'"))


@events_query(f"SELECT {PAGE} FROM {EV} WHERE event_time IS NULL OR event_time >= TIMESTAMP '2024-01-21 01:02:03.456'")
def ttl_filter(e):
    return store.retained(e, UNTIL)


@events_query(f"SELECT db_name, max(lsn) AS lsn FROM {EV} GROUP BY db_name")
def checkpoints(e):
    return store.checkpoints(e)


@events_query(f"SELECT id, lsn FROM {EV} WHERE db_name = 'db0' AND lsn > '00000022:00000008:0003' OR db_name = 'db1' AND lsn > '00000022:00000010:0001' OR db_name = 'db2'")
def log_after_checkpoints(e):
    """What is new in each of three databases, of which one has no checkpoint and one was cleared and set again."""
    saved = e.sparkSession.createDataFrame([("db0", "00000022:00000008:0003", 1), ("db1", "00000022:00000020:0001", 1), ("db1", "", 2), ("db1", "00000022:00000010:0001", 3), ("db2", "00000022:00000010:0001", 1), ("db2", "", 2)], "db_name string, lsn string, seq long")
    return log_sources.after_checkpoints(e.select("id", "db_name", "lsn"), store.load_checkpoints(saved)).select("id", "lsn")


@events_query(f"SELECT id, to_json(struct_pack(lsn := lsn, operation := operation, db := db_name)) AS line FROM {EV}")
def export_ndjson(e):
    return Q.export_ndjson(e.select("id", "lsn", "operation", "db_name"))


_EXPORTED = {"lsn": "lsn", "txn_id": "txn_id", "operation": "operation", "db": "db_name", "schema": "schema_name", "table": "table_name", "sql": "sql_stmt", "rollback_sql": "rollback_sql", "event_time": "CAST(event_time AS VARCHAR)", "commit_time": "CAST(commit_time AS VARCHAR)", "status": "status"}


@events_query(" UNION ALL ".join(f"SELECT id, '{k}' AS key, {v} AS value FROM {EV} WHERE {v} IS NOT NULL" for k, v in _EXPORTED.items()))
def export_keys(e):
    """Every key of every exported line."""
    return Q.export_ndjson(e).select("id", F.explode(F.from_json("line", "map<string,string>")).alias("key", "value"))


@events_query(f"SELECT db_name, lsn, rollback_sql AS line FROM {EV} WHERE rollback_sql <> ''")
def rollback_lines(e):
    return Q.rollback_lines(e)


@events_query(f"""SELECT 0 AS part, NULL AS lsn, CAST(NULL AS BIGINT) AS id, '-- Rollback of db1' || chr(10) || '-- Review before running.' || chr(10) || chr(10) || 'BEGIN TRANSACTION;' || chr(10) AS line
UNION ALL SELECT 1, lsn, CAST(id AS BIGINT), rollback_sql FROM {EV} WHERE db_name = 'db1' AND rollback_sql <> ''
UNION ALL SELECT 2, NULL, NULL, chr(10) || '-- COMMIT TRANSACTION;' || chr(10) || '-- ROLLBACK TRANSACTION;'""")
def rollback_script(e):
    return Q.rollback_script(e, "db1", Q.LogFilter(db="db1"))


# ---- numbers and names ----------------------------------------------------------------------------------------------------------


@events_query(f"SELECT id, CAST(CAST('0x' || substr(lsn, 1, 8) AS HUGEINT) * 281474976710656 + CAST('0x' || substr(lsn, 10, 8) AS HUGEINT) * 65536 + CAST('0x' || substr(lsn, 19, 4) AS HUGEINT) AS VARCHAR) AS n FROM {EV}")
def lsn_decimal(e):
    return e.select("id", L.lsn_decimal(F.col("lsn")).cast("string").alias("n"))


@events_query(f"SELECT id, ltrim(substr(lsn, 1, 8), '0') || ':' || CASE WHEN ltrim(substr(lsn, 10, 8), '0') = '' THEN '0' ELSE ltrim(substr(lsn, 10, 8), '0') END AS s FROM {EV}")
def lsn_short(e):
    return e.select("id", L.lsn_short(F.col("lsn")).alias("s"))


# ---- log records ----------------------------------------------------------------------------------------------------------------

MARKED = f"""n AS (SELECT *, coalesce(sum(CASE WHEN operation IN ('LOP_COMMIT_XACT', 'LOP_ABORT_XACT') THEN 1 ELSE 0 END) OVER (PARTITION BY transaction_id ORDER BY lsn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM {REC}),
m AS (SELECT transaction_id, epoch, max(CASE WHEN operation IN ('LOP_COMMIT_XACT', 'LOP_ABORT_XACT') THEN operation END) AS kind,
 bool_or((operation = 'LOP_BEGIN_XACT' AND trim(transaction_name) LIKE 'Backup:%') OR cleanup) AS excluded,
 max(CASE WHEN operation = 'LOP_BEGIN_XACT' THEN seen_at END) AS begin_at, max(CASE WHEN operation IN ('LOP_COMMIT_XACT', 'LOP_ABORT_XACT') THEN seen_at END) AS end_at FROM n GROUP BY transaction_id, epoch),
u AS (SELECT transaction_id, max(epoch) FILTER (excluded) AS last FROM m GROUP BY transaction_id),
x AS (SELECT n.*, kind, excluded, begin_at, end_at, coalesce(u.last > n.epoch, FALSE) AS undone FROM n JOIN m USING (transaction_id, epoch) JOIN u USING (transaction_id))"""
DATA = "operation IN ('LOP_INSERT_ROWS', 'LOP_DELETE_ROWS', 'LOP_MODIFY_ROW')"
GOOD = f"{DATA} AND kind = 'LOP_COMMIT_XACT' AND NOT excluded AND NOT undone"


@records_query(f"WITH {MARKED} SELECT lsn, operation, transaction_id FROM x WHERE {GOOD}")
def txn_committed(r):
    return transactions.committed(r).select("lsn", "operation", "transaction_id")


@records_query(f"WITH {MARKED} SELECT lsn FROM x WHERE {DATA} AND kind = 'LOP_ABORT_XACT'")
def txn_aborted_dropped(r):
    return transactions.with_epochs(r).where("kind = 'LOP_ABORT_XACT'").where(F.col("operation").isin("LOP_INSERT_ROWS", "LOP_DELETE_ROWS", "LOP_MODIFY_ROW")).select("lsn")


@records_query(f"WITH {MARKED} SELECT lsn FROM x WHERE excluded AND {DATA}")
def txn_internal_excluded(r):
    return transactions.with_epochs(r).where("excluded_from is not null").where(F.col("operation").isin("LOP_INSERT_ROWS", "LOP_DELETE_ROWS", "LOP_MODIFY_ROW")).select("lsn")


@records_query(f"WITH {MARKED} SELECT lsn, transaction_id FROM x WHERE {DATA} AND kind IS NULL AND NOT excluded")
def txn_open_pending(r):
    return transactions.pending(r).select("lsn", "transaction_id")


@records_query(f"WITH {MARKED} SELECT lsn FROM x WHERE {GOOD} AND coalesce(begin_at, end_at) >= TIMESTAMP '2024-01-05 03:04:05.678'")
def txn_since(r):
    return transactions.committed(r, SINCE).select("lsn")


@records_query(f"""WITH {MARKED} SELECT count(*) FILTER (operation = 'LOP_BEGIN_XACT') AS begins, count(*) FILTER (operation = 'LOP_COMMIT_XACT') AS commits, count(*) FILTER (operation = 'LOP_ABORT_XACT') AS aborts,
 count(*) FILTER ({DATA}) AS data, count(*) FILTER ({GOOD}) AS committed, count(*) FILTER ({DATA} AND kind IS NULL AND NOT excluded) AS pending, max(lsn) AS last_lsn FROM x""")
def scan_counters(r):
    return transactions.scan_counters(r)


def queries() -> dict:
    return _queries | more_queries.queries() | scan_queries.queries() | source_queries.queries()


def oracle_sql() -> dict[str, str]:
    return _oracles | more_queries.oracle_sql() | scan_queries.oracle_sql() | source_queries.oracle_sql()
