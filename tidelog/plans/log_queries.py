"""The query layer over log events: filters, pages, transactions, activity over time, counts, diagnostics, export.

Each function takes the events DataFrame and returns one; filters reach the scan, pages are ordered top-k, counts aggregate before a
shuffle. Where a page of groups needs its events, the page (its size is a parameter of at most 200) is joined back by a semi join.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from ..functions.predicates import is_executable
from ..operators.resolve import small

SORTABLE = ("event_time", "lsn", "operation", "db_name", "table_name")
PAGE_COLUMNS = ("id", "lsn", "txn_id", "operation", "db_name", "schema_name", "table_name", "sql_stmt", "rollback_sql", "event_time", "commit_time", "status")
EXPORT_NAMES = {"db_name": "db", "schema_name": "schema", "table_name": "table", "sql_stmt": "sql"}


@dataclass(frozen=True)
class LogFilter:
    """Optional terms, all of which must hold. operation may be a list with commas, table may be schema.table."""

    operation: str = ""
    db: str = ""
    schema: str = ""
    table: str = ""
    search: str = ""
    since: datetime | None = None
    until: datetime | None = None

    def terms(self) -> list[Column]:
        out = []
        if self.operation:
            out.append(F.col("operation").isin(*[o.strip() for o in self.operation.split(",")]))
        if self.db:
            out.append(F.col("db_name") == self.db)
        if self.schema:
            out.append(F.col("schema_name") == self.schema)
        if self.table:
            first, dot, rest = self.table.partition(".")
            out += [F.col("schema_name") == first, F.col("table_name") == rest] if dot else [F.col("table_name") == self.table]
        if self.search:
            out.append(F.col("sql_stmt").like("%" + self.search.replace("\\", "\\\\") + "%"))
        if self.since is not None:
            out.append(F.col("event_time") >= F.lit(self.since))
        if self.until is not None:
            out.append(F.col("event_time") <= F.lit(self.until))
        return out

    def apply(self, events: DataFrame) -> DataFrame:
        terms = self.terms()
        return events.where(reduce(Column.__and__, terms)) if terms else events


def _page_columns(events: DataFrame) -> list[str]:
    return [c for c in events.columns if c in PAGE_COLUMNS or c in ("confidence", "compression_type", "compressed_row_hex", "decompressed_debug_json", "compression_decode_status")]


def ordered(events: DataFrame, by: str = "event_time", direction: str = "desc") -> DataFrame:
    """By a known column (else event_time), nulls last either way, ties by id in the same direction."""
    by = by if by in SORTABLE else "event_time"
    up = direction.lower() == "asc"
    c = F.col(by)
    return events.orderBy(c.asc_nulls_last() if up else c.desc_nulls_last(), F.col("id").asc() if up else F.col("id").desc())


def _page(events: DataFrame) -> DataFrame:
    """The columns of a page; a debug text that is no JSON is left out."""
    page = events.select(*_page_columns(events))
    if "decompressed_debug_json" in page.columns:
        page = page.withColumn("decompressed_debug_json", F.when(F.try_parse_json("decompressed_debug_json").isNotNull(), F.col("decompressed_debug_json")))
    return page


def logs(events: DataFrame, where: LogFilter = LogFilter(), sort: str = "event_time", direction: str = "desc", page: int = 1, limit: int = 200) -> DataFrame:
    found = ordered(_page(where.apply(events)), sort, direction)
    return found.offset((page - 1) * limit).limit(limit)


def total(events: DataFrame, where: LogFilter = LogFilter()) -> DataFrame:
    return where.apply(events).agg(F.count(F.lit(1)).alias("total"))


def search(events: DataFrame, where: LogFilter = LogFilter(), limit: int = 100, offset: int = 0) -> DataFrame:
    return ordered(_page(where.apply(events))).offset(offset).limit(limit)


def by_id(events: DataFrame, where: LogFilter = LogFilter(), limit: int = 100, offset: int = 0) -> DataFrame:
    return _page(where.apply(events)).orderBy("id").offset(offset).limit(limit)


def diagnostics(events: DataFrame, where: LogFilter = LogFilter(), limit: int = 20) -> DataFrame:
    """Events whose decoding did not go well."""
    bad = where.apply(events).where("status is not null and status <> 'ok'")
    return ordered(_page(bad)).limit(min(max(limit, 1), 200))


def _in_transactions(events: DataFrame, where: LogFilter) -> DataFrame:
    return where.apply(events).where("txn_id is not null and txn_id <> ''")


def transaction_count(events: DataFrame, where: LogFilter = LogFilter()) -> DataFrame:
    return _in_transactions(events, where).select("db_name", "txn_id").distinct().agg(F.count(F.lit(1)).alias("total"))


def transaction_groups(events: DataFrame, where: LogFilter = LogFilter(), page: int = 1, limit: int = 20) -> DataFrame:
    """A page of transactions, newest first; the numbers cover the events that the filter keeps."""
    limit = min(limit, 200)
    count = lambda op: F.sum(F.when(F.col("operation") == op, 1).otherwise(0))
    groups = _in_transactions(events, where).groupBy("db_name", "txn_id").agg(
        F.min("event_time").alias("event_time"),
        F.max("commit_time").alias("commit_time"),
        F.min("lsn").alias("first_lsn"),
        F.max("lsn").alias("last_lsn"),
        F.count(F.lit(1)).alias("events"),
        count("INSERT").alias("inserts"),
        count("UPDATE").alias("updates"),
        count("DELETE").alias("deletes"),
        F.max(F.coalesce("commit_time", "event_time")).alias("newest"),
    )
    return groups.orderBy(F.col("newest").desc_nulls_last(), F.col("last_lsn").desc()).offset((page - 1) * limit).limit(limit).drop("newest")


def transaction_events(events: DataFrame, groups: DataFrame, where: LogFilter = LogFilter()) -> DataFrame:
    """The events of a page of groups. A page has at most 200 rows; it is broadcast after a count."""
    return where.apply(events).join(small(groups.select("db_name", "txn_id")), ["db_name", "txn_id"], "left_semi")


def transaction_details(events: DataFrame, groups: DataFrame, where: LogFilter = LogFilter()) -> DataFrame:
    """Per group: its events as an array in log order, rollbacks that can run, and its tables in order."""
    name = F.when(F.coalesce("schema_name", F.lit("")) != "", F.concat_ws(".", "schema_name", "table_name")).otherwise(F.col("table_name"))
    own = transaction_events(events, groups, where).withColumn("full_name", name)
    return own.groupBy("db_name", "txn_id").agg(
        F.sort_array(F.collect_list(F.struct("lsn", "id", "operation", "sql_stmt", "rollback_sql"))).alias("log"),
        F.sum(is_executable(F.col("rollback_sql")).cast("long")).alias("rollbacks"),
        F.sort_array(F.collect_set(F.when(F.col("full_name") != "", F.col("full_name")))).alias("tables"),
    )


def unix_micros(events: DataFrame, name: str = "event_time") -> Column:
    """Microseconds since 1970 of a time. One without a zone is read as UTC by its fields, whatever the session's zone is; a cast would shift it by that zone."""
    c = F.col(name)
    if not isinstance(events.schema[name].dataType, TimestampNTZType):
        return F.unix_micros(c.cast("timestamp"))
    seconds = F.unix_date(c.cast("date")).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    return seconds * 1_000_000 + F.pmod(F.unix_micros(c.cast("timestamp")), F.lit(1_000_000))  # a zone shifts whole seconds


def _moment(events: DataFrame, t: datetime) -> Column:
    """A naive time as a literal of the type of event_time, read as UTC."""
    if isinstance(events.schema["event_time"].dataType, TimestampNTZType):
        return F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(t.replace(tzinfo=UTC))


def timeline(events: DataFrame, since: datetime, until: datetime, buckets: int = 72, where: LogFilter = LogFilter(), dense: bool = True) -> DataFrame:
    """Counts by operation in equal steps from since on; dense: a row for every bucket. Milliseconds that the steps don't divide are left out.

    An event counts if its time lies in the whole seconds of [since, until]; the steps start at since itself. Times without a zone are UTC."""
    buckets = buckets if 1 <= buckets <= 2000 else 72
    start = int((since - datetime(1970, 1, 1)) / timedelta(milliseconds=1))
    step = max(int((until - since) / timedelta(milliseconds=1)) // buckets, 1)
    kept = where.apply(events).where((F.col("event_time") >= _moment(events, since.replace(microsecond=0))) & (F.col("event_time") <= _moment(events, until.replace(microsecond=0))))
    number = F.floor((F.floor(unix_micros(events) / 1000) - F.lit(start)) / F.lit(step)).cast("long")
    count = lambda op: F.sum(F.when(F.col("operation") == op, 1).otherwise(0))
    sums = kept.withColumn("bucket", number).where(F.col("bucket").between(0, buckets - 1)).groupBy("bucket").agg(
        count("INSERT").alias("inserts"), count("UPDATE").alias("updates"), count("DELETE").alias("deletes"), F.count(F.lit(1)).alias("total")
    )
    if not dense:
        return sums
    grid = events.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    return grid.join(F.broadcast(sums), "bucket", "left").fillna(0)


def stats_by_operation(events: DataFrame) -> DataFrame:
    return events.groupBy("operation").agg(F.count(F.lit(1)).alias("n"))


def stats_tables(events: DataFrame) -> DataFrame:
    """Distinct schema.table; null if either part is."""
    return events.select(F.concat("schema_name", F.lit("."), "table_name").alias("name")).where("name is not null").distinct().orderBy("name")


def stats_databases(events: DataFrame) -> DataFrame:
    return events.where("db_name is not null and db_name <> ''").select("db_name").distinct().orderBy("db_name")


def export_ndjson(events: DataFrame) -> DataFrame:
    """One JSON text per event; null keys are left out. Write it with .orderBy('id').select('line').write.text(...)."""
    columns = [c for c in _page_columns(events) if c != "id"]
    return events.select("id", F.to_json(F.struct(*[F.col(c).cast("string").alias(EXPORT_NAMES.get(c, c)) for c in columns])).alias("line"))


def rollback_lines(events: DataFrame, where: LogFilter = LogFilter()) -> DataFrame:
    """The rollbacks that can run as rows in script order (newest first), for selections too large for one text; sorted by range, so
    write.text gives files in order."""
    chosen = where.apply(events).where("rollback_sql is not null and rollback_sql <> ''")
    return chosen.orderBy(F.desc("lsn"), F.desc("id")).select("db_name", "lsn", F.col("rollback_sql").alias("line"))


def rollback_script(events: DataFrame, title: str, where: LogFilter = LogFilter()) -> DataFrame:
    """The script as rows (part, lsn, id, line): a head, the rollbacks that can run, newest first, and a tail, inside a transaction to be closed by hand.

    Its order is part, then lsn and id from the last on; a selection of any size is sorted by range, never gathered."""
    head = f"-- Rollback of {title}\n-- Review before running.\n\nBEGIN TRANSACTION;\n"
    tail = "\n-- COMMIT TRANSACTION;\n-- ROLLBACK TRANSACTION;"
    ends = events.sparkSession.createDataFrame([(0, None, None, head), (2, None, None, tail)], "part int, lsn string, id long, line string")
    chosen = where.apply(events).where("rollback_sql is not null and rollback_sql <> ''")
    return ends.unionByName(chosen.select(F.lit(1).alias("part"), "lsn", F.col("id").cast("long").alias("id"), F.col("rollback_sql").alias("line")))


def write_script(script: DataFrame, path: str) -> None:
    """The rows of rollback_script as text files whose names are in the script's order."""
    script.orderBy("part", F.desc("lsn"), F.desc("id")).select("line").write.text(path)


#: What a query may be made of; anything else (commands, inserts, scripts, programs that rows are piped through) is refused.
QUERY_NODES = frozenset((
    "Aggregate", "Distinct", "Except", "Filter", "Generate", "GlobalLimit", "Intersect", "Join", "LateralJoin", "LimitAll", "LocalLimit", "LocalRelation", "Offset", "OneRowRelation", "PipeOperator", "Pivot", "Project",
    "RepartitionByExpression", "Repartition", "Sample", "Sort", "SubqueryAlias", "Tail", "Union", "UnresolvedHaving", "UnresolvedHint", "UnresolvedInlineTable", "UnresolvedRelation", "UnresolvedSubqueryColumnAliases", "UnresolvedTVFAliases",
    "UnresolvedTableValuedFunction", "UnresolvedWith", "Unpivot", "Window", "WithWindowDefinition",
))
#: Functions that call into the virtual machine, and names worked out at run time, which could be one of them.
REFUSED_FUNCTIONS = frozenset(("reflect", "java_method", "try_reflect"))
TABLE_FUNCTIONS = frozenset(("range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple"))


def _sequence(of) -> list:
    return [of.apply(i) for i in range(of.size())]


def read_only(spark: SparkSession, text: str) -> str:
    """The text of an ad-hoc query, if it is one single query: judged by the tree that Spark's parser makes of it, which runs nothing. A write at any
    depth, a second statement, and functions that call into the virtual machine are refused."""
    text = text.strip().rstrip(";")
    try:
        tree = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:
        raise ValueError("only a single query is accepted") from e
    nodes, terms = [tree], []
    while nodes:
        node = nodes.pop()
        name = node.getClass().getSimpleName().rstrip("$")
        if name not in QUERY_NODES or (name == "UnresolvedTableValuedFunction" and ".".join(_sequence(node.name())).lower() not in TABLE_FUNCTIONS):
            raise ValueError(f"only a single query is accepted, not {node.nodeName()}")
        nodes += _sequence(node.children()) + _sequence(node.innerChildren())
        terms += _sequence(node.expressions())
    while terms:
        term = terms.pop()
        name = term.getClass().getSimpleName()
        if "UnresolvedIdentifier" in name or (name == "UnresolvedFunction" and _sequence(term.nameParts())[-1].lower() in REFUSED_FUNCTIONS):
            raise ValueError("only functions of SQL itself are accepted")
        terms += _sequence(term.children())
    return text


def ad_hoc(events: DataFrame, text: str) -> DataFrame:
    """Spark SQL over log_events. The name is one of the query's own, so views of the session stay as they are."""
    query, view = read_only(events.sparkSession, text), f"log_events_{uuid.uuid4().hex}"
    events.createOrReplaceTempView(view)
    own = f"WITH log_events AS (SELECT * FROM {view})"
    named = re.match(r"\s*with\s+(?!recursive\b)", query, re.I)
    try:
        return events.sparkSession.sql(f"{own}, {query[named.end() :]}" if named else f"{own} {query}")
    finally:
        events.sparkSession.catalog.dropTempView(view)
