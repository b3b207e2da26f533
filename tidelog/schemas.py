"""Column names, operation names and statuses of log records and log events."""

from __future__ import annotations

# Names as the database writes them into its log.
BEGIN, COMMIT, ABORT = "LOP_BEGIN_XACT", "LOP_COMMIT_XACT", "LOP_ABORT_XACT"
INSERT, DELETE, MODIFY_ROW, MODIFY_COLUMNS = "LOP_INSERT_ROWS", "LOP_DELETE_ROWS", "LOP_MODIFY_ROW", "LOP_MODIFY_COLUMNS"
CONTROL_OPS = (BEGIN, COMMIT, ABORT)
DATA_OPS = (INSERT, DELETE, MODIFY_ROW, MODIFY_COLUMNS)
BASE_CONTEXTS = ("LCX_HEAP", "LCX_CLUSTERED", "LCX_MARK_AS_GHOST")
INTERNAL_TRANSACTIONS = ("ShrinkFile", "AllocHeapPageSimpleXactDML", "AllocFirstPage", "QDS base transaction", "QDS nested transaction")
BACKUP_PREFIX = "Backup:"

LOG_RECORDS = (
    "db_name string, lsn string, operation string, context string, transaction_id string, transaction_name string, alloc_unit_name string, "
    "alloc_unit_id bigint, partition_id bigint, page_id string, slot_id int, begin_time string, end_time string, contents0 binary, "
    "contents1 binary, contents2 binary, contents3 binary, contents4 binary, log_record binary, offset_in_row int, modify_size int"
)
LOG_EVENTS = (
    "id bigint, lsn string, txn_id string, operation string, db_name string, schema_name string, table_name string, primary_key string, "
    "sql_stmt string, rollback_sql string, event_time timestamp, commit_time timestamp, status string, confidence string, "
    "compression_type string, compressed_row_hex string, decompressed_debug_json string, compression_decode_status string"
)
EVENT_COLUMNS = [c.split()[0] for c in LOG_EVENTS.split(", ")]
OPTIONAL_TEXTS = EVENT_COLUMNS[-6:]
