"""The event table in ranges, with what its queries need kept beside the rows of each range: counts by minute, transactions, and an index of the statements' text.

    times/<batch>/r=<range>          events by database, table, operation, status and minute
    transactions/<batch>/r=<range>   first and last times and lsns of each transaction, and its events by operation
    grams/<batch>/r=<range>          the three-character pieces of the statements of each block of rows

They belong to the rows of a range as a batch wrote them, and are found through the folder that the manifest names: a batch makes those of its own ranges only,
they become visible with its rows, and what is retracted or replaced goes with the range that held it. What they say of a range is merged over all ranges by one
aggregation, of minimums and maximums too, which a running total could not take back.

Statements, times and names may be null or empty; their rows are counted under null."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import is_executable
from ..plans import log_queries as Q
from .ranged_store import RangedStore, State

MINUTE = 60_000
TIME_KEYS = ("db_name", "schema_name", "table_name", "operation", "status", "minute")
#: Blocks that are named one by one in a query; beyond that the ranges that hold them are read as a whole.
MOST_BLOCKS = 10_000
#: What is kept of a table without rows.
KEPT = {
    "times": "name string, db_name string, schema_name string, table_name string, operation string, status string, minute bigint, n bigint, rollbacks bigint",
    "transactions": "db_name string, txn_id string, event_time timestamp, commit_time timestamp, first_lsn string, last_lsn string, events bigint, inserts bigint, updates bigint, deletes bigint, newest timestamp, rollbacks bigint",
    "grams": "name string, block bigint, gram string",
}
OPERATIONS = (("INSERT", "inserts"), ("UPDATE", "updates"), ("DELETE", "deletes"))


def _minute(events: DataFrame):
    return F.floor(Q.unix_micros(events) / F.lit(MINUTE * 1000)).cast("long")


def grams_of(term: str) -> list[str]:
    """The three-character pieces that a statement has to hold where it is like %term%; % and _ are wild, and what lies between them must stand there."""
    return sorted({piece[i : i + 3] for piece in re.split("[%_]", term) for i in range(len(piece) - 2)})


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, block, gram) of rows (name, block, sql_stmt) that come block by block; each block has the empty gram too. One block's grams are held at a time."""

    def rows(key, grams):
        n = len(grams)
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.int64()), pa.array(sorted(grams), pa.string())], ["name", "block", "gram"])

    key, grams = None, {""}
    for batch in batches:
        for name, block, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if (name, block) != key:
                if key is not None:
                    yield rows(key, grams)
                key, grams = (name, block), {""}
            if text:
                grams.update([text[i : i + 3] for i in range(len(text) - 2)])
    if key is not None:
        yield rows(key, grams)


class IndexedStore(RangedStore):
    """Events with the columns of `schemas.LOG_EVENTS` at a path; block_rows: of a block of the text index."""

    def __init__(self, spark: SparkSession, path: str, rows_each: int = 1_000_000, block_rows: int = 1000):
        super().__init__(spark, path, rows_each)
        self.block_rows = block_rows

    # ---- writing ----

    def _arranged(self, rows: DataFrame) -> DataFrame:
        place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        number = F.floor(place / F.lit(self.block_rows)).cast("long")
        return rows.withColumn("block", F.shiftleft(F.xxhash64("r").bitwiseAND(F.lit((1 << 31) - 1)), 32).bitwiseOR(number))

    def _written(self, folder: str) -> None:
        events = self.spark.read.parquet(folder).withColumn("r", F.col("r").cast("string"))
        rolled = F.sum(is_executable(F.col("rollback_sql")).cast("long")).alias("rollbacks")
        # Minutes hold few events of one table, operation and status in a range: rows are dealt by range at once, not summed up first and dealt then.
        timed = events.select("r", *TIME_KEYS[:-1], _minute(events).alias("minute"), "rollback_sql").repartition("r")
        times = timed.groupBy("r", *TIME_KEYS).agg(F.count(F.lit(1)).alias("n"), rolled).withColumn("name", F.col("r"))
        counts = [F.sum((F.coalesce(F.col("operation") == op, F.lit(False))).cast("long")).alias(a) for op, a in OPERATIONS]
        own = events.groupBy("r", "db_name", "txn_id").agg(
            F.min("event_time").alias("event_time"), F.max("commit_time").alias("commit_time"), F.min("lsn").alias("first_lsn"), F.max("lsn").alias("last_lsn"),
            F.count(F.lit(1)).alias("events"), *counts, F.max(F.coalesce("commit_time", "event_time")).alias("newest"), rolled,
        )
        grams = events.select(F.col("r").alias("name"), "block", "sql_stmt").mapInArrow(_posted, "name string, block bigint, gram string").withColumn("r", F.col("name"))
        for what, rows, order in (("times", times, "minute"), ("transactions", own.repartition("r"), "txn_id"), ("grams", grams.repartition("r"), "gram")):
            rows.sortWithinPartitions("r", order).write.mode("overwrite").partitionBy("r").parquet(self._beside(folder, what))

    def _beside(self, folder: str, what: str) -> str:
        return f"{self.path}/{what}/{folder.removeprefix(f'{self.path}/data/')}"

    # ---- reading ----

    def _kept(self, state: State, what: str) -> DataFrame:
        folders = [self._beside(r["folder"], what) for r in state.ranges.values() if r["n"]]
        return self.spark.read.parquet(*folders) if folders else self.spark.createDataFrame([], KEPT[what])

    def read(self, db: str | None = None, low: str = "", high: str = "￿") -> DataFrame | None:
        rows = super().read(db, low, high)
        return rows if rows is None else rows.drop("block")

    def _times(self, where: Q.LogFilter) -> tuple[State, DataFrame]:
        if where.search or where.since is not None or where.until is not None:
            raise ValueError("counts are kept by database, table and operation")
        state = self.state()
        return state, where.apply(self._kept(state, "times"))

    def total(self, where: Q.LogFilter = Q.LogFilter()) -> DataFrame:
        return self._times(where)[1].agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))

    def counts(self, *by: str, where: Q.LogFilter = Q.LogFilter()) -> DataFrame:
        """Events (n) and rollbacks that can run, by any of TIME_KEYS."""
        return self._times(where)[1].groupBy(*by).agg(F.sum("n").alias("n"), F.sum("rollbacks").alias("rollbacks"))

    def tables(self) -> DataFrame:
        return Q.stats_tables(self._times(Q.LogFilter())[1])

    def databases(self) -> DataFrame:
        return Q.stats_databases(self._times(Q.LogFilter())[1])

    def transaction_groups(self, db: str = "", page: int = 1, limit: int = 20) -> DataFrame:
        """As the query of that name gives them for all events, or a database's."""
        limit = min(limit, 200)
        parts = Q.LogFilter(db=db).apply(self._kept(self.state(), "transactions")).where("txn_id is not null and txn_id <> ''")
        sums = [F.sum(c).alias(c) for c in ("events", "inserts", "updates", "deletes")]
        groups = parts.groupBy("db_name", "txn_id").agg(
            F.min("event_time").alias("event_time"), F.max("commit_time").alias("commit_time"), F.min("first_lsn").alias("first_lsn"), F.max("last_lsn").alias("last_lsn"), *sums, F.max("newest").alias("newest")
        )
        return groups.orderBy(F.col("newest").desc_nulls_last(), F.col("last_lsn").desc()).offset((page - 1) * limit).limit(limit).drop("newest")

    def timeline(self, since: datetime, until: datetime, buckets: int = 72, where: Q.LogFilter = Q.LogFilter()) -> DataFrame:
        """As the query of that name gives it, without empty buckets. Minutes that lie within one bucket are counted from what is kept; the events of those
        that a border cuts, at most one for each border, are read from the ranges that have such minutes."""
        buckets = buckets if 1 <= buckets <= 2000 else 72
        ms = lambda t: int((t - datetime(1970, 1, 1)) / timedelta(milliseconds=1))
        start, low, high = ms(since), ms(since.replace(microsecond=0)), ms(until.replace(microsecond=0))
        step = max(int((until - since) / timedelta(milliseconds=1)) // buckets, 1)
        borders = [start + k * step for k in range(buckets + 1)] + [low]
        cut = sorted({b // MINUTE for b in borders if b % MINUTE} | {high // MINUTE})  # the last second counts, the rest of its minute does not
        state, times = self._times(where)
        times = times.where(F.col("minute").between(low // MINUTE, high // MINUTE))
        whole = times.where(~F.col("minute").isin(cut) & (F.col("minute") * MINUTE >= start) & ((F.col("minute") + 1) * MINUTE <= min(high, start + buckets * step)))
        number = F.floor((F.col("minute") * MINUTE - F.lit(start)) / F.lit(step)).cast("long")
        count = lambda op: F.sum(F.when(F.col("operation") == op, F.col("n")).otherwise(0))
        sums = whole.groupBy(number.alias("bucket")).agg(*[count(op).alias(a) for op, a in OPERATIONS], F.sum("n").alias("total"))
        names = [r.name for r in times.where(F.col("minute").isin(cut)).select("name").distinct().collect()]
        events = self._rows(state, names)
        if events is not None:
            sums = sums.unionByName(Q.timeline(events.where(_minute(events).isin(cut)), since, until, buckets, where, dense=False))
        return sums.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("inserts", "updates", "deletes", "total")])

    # ---- text ----

    def blocks(self, term: str, state: State | None = None) -> DataFrame | None:
        """(name, block) of the blocks that hold all pieces of the term, of any of their statements; None if the term has no piece of three characters."""
        grams = grams_of(term)
        if not grams:
            return None
        kept = self._kept(state or self.state(), "grams")
        # A block that two tasks read may have a piece twice.
        return kept.where(F.col("gram").isin(grams)).groupBy("name", "block").agg(F.count_distinct("gram").alias("k")).where(F.col("k") == len(grams)).select("name", "block")

    def matching(self, where: Q.LogFilter) -> DataFrame | None:
        """The events that a filter keeps; with a search term only blocks that can hold it are read, then compared with LIKE. None before the first batch."""
        state = self.state()
        blocks = self.blocks(where.search, state)
        if blocks is None:
            rows = self._rows(state, list(state.ranges))
        else:
            found = blocks.limit(MOST_BLOCKS + 1).collect()
            many = len(found) > MOST_BLOCKS
            names = sorted({r.name for r in (blocks.select("name").distinct().collect() if many else found)})
            rows = self._rows(state, names)
            if rows is None:
                some = self._rows(state, list(state.ranges)[:1] if state.ranges else [])
                rows = some if some is None else some.limit(0)
            elif not many:
                rows = rows.where(F.col("block").isin([r.block for r in found]))
        return rows if rows is None else where.apply(rows).drop("block")
