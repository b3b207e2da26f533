"""Log events and log records made from the table `events`, in SQL that Spark and DuckDB both read (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

EVENTS = """
SELECT event_id + 1 AS id,
 {fmt}('%08x:%08x:%04x', CAST(34 AS BIGINT), CAST(floor(event_id/16) AS BIGINT), CAST(event_id % 16 + 1 AS BIGINT)) AS lsn,
 {fmt}('0000:%08x', CAST(floor(event_id/5) AS BIGINT)) AS txn_id,
 CASE WHEN event_type IN ('signup','purchase') THEN 'INSERT'
      WHEN event_type IN ('click','view') THEN 'UPDATE' ELSE 'DELETE' END AS operation,
 concat('db', CAST(CAST(floor(event_id/5) AS BIGINT) % 3 AS {s})) AS db_name,
 CASE WHEN user_id % 2 = 0 THEN 'dbo' ELSE 'sales' END AS schema_name,
 concat('T', CAST(user_id % 7 AS {s})) AS table_name,
 concat(event_type, ' ', props) AS sql_stmt,
 CASE WHEN event_id % 11 = 0 THEN '-- not recoverable' WHEN event_id % 19 = 0 THEN NULL
      ELSE concat('undo ', event_type) END AS rollback_sql,
 CASE WHEN event_id % 97 = 0 THEN NULL ELSE ts END AS event_time,
 max(ts) OVER (PARTITION BY floor(event_id/5)) AS commit_time,
 CASE WHEN event_id % 13 = 0 THEN 'compressed_row_parse_failed' WHEN event_id % 5 = 0 THEN 'ok' END AS status
FROM {events}
"""

#: Transactions reuse ids (txn % 400), so epochs matter; some are open, aborted, internal, or hold a physical clean-up.
RECORDS = """
SELECT {fmt}('%08x:%08x:%04x', CAST(34 AS BIGINT), txn, CAST(1 AS BIGINT)) AS lsn, 'LOP_BEGIN_XACT' AS operation, txn % 400 AS transaction_id,
       CASE WHEN txn % 23 = 0 THEN ' Backup:x' ELSE 'user_transaction' END AS transaction_name, bt AS seen_at, FALSE AS cleanup FROM
  (SELECT CAST(floor(event_id/5) AS BIGINT) AS txn, min(ts) AS bt FROM {events} GROUP BY CAST(floor(event_id/5) AS BIGINT))
UNION ALL
SELECT {fmt}('%08x:%08x:%04x', CAST(34 AS BIGINT), CAST(floor(event_id/5) AS BIGINT), CAST(2 + event_id % 5 AS BIGINT)),
       CASE WHEN event_type IN ('signup','purchase') THEN 'LOP_INSERT_ROWS'
            WHEN event_type IN ('click','view') THEN 'LOP_MODIFY_ROW' ELSE 'LOP_DELETE_ROWS' END,
       CAST(floor(event_id/5) AS BIGINT) % 400, '', NULL, event_id % 211 = 7 FROM {events}
UNION ALL
SELECT {fmt}('%08x:%08x:%04x', CAST(34 AS BIGINT), txn, CAST(9 AS BIGINT)),
       CASE WHEN txn % 10 = 0 THEN 'LOP_ABORT_XACT' ELSE 'LOP_COMMIT_XACT' END, txn % 400, '', ct, FALSE FROM
  (SELECT CAST(floor(event_id/5) AS BIGINT) AS txn, max(ts) AS ct FROM {events} GROUP BY CAST(floor(event_id/5) AS BIGINT))
WHERE txn % 17 <> 0
"""


def sql(text: str, duck: bool, events: str = "events") -> str:
    return text.format(fmt="printf" if duck else "format_string", s="VARCHAR" if duck else "STRING", events=events)


def _view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(sql(text, False, "{events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, EVENTS)


def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, RECORDS)
