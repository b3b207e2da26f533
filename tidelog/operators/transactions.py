"""Assembly of committed transactions from log records, in batch form.

A transaction id can come again after its COMMIT or ABORT, so records are numbered by epoch: how many of these the id has had before.
Records are dealt by (db_name, transaction_id, stretch of the log), once; only begins, ends and clean-ups meet by transaction.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.predicates import is_base_row, is_data_op, is_executable, is_internal_transaction

KEY = ("db_name", "transaction_id")


def first_seen(records: DataFrame, rank: str = "source_rank") -> DataFrame:
    """One record per (db_name, lsn): that of the source read first (backups before the live log)."""
    w = Window.partitionBy("db_name", "lsn").orderBy(rank)
    return records.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def with_epochs(records: DataFrame, lsn_prefix: int = 14, parts: int | None = None, only: Column | None = None) -> DataFrame:
    """Adds epoch, kind (COMMIT, ABORT or null), begin_at, end_at, excluded_from (lsn) and undone (a later epoch of the id is excluded).

    Needs columns lsn, operation, transaction_name, seen_at (timestamp of a begin or an end) and cleanup (boolean).

    A transaction may hold a third of the log, so records never meet by id: they are shuffled once, by id and stretch of the log (records that
    share `lsn_prefix` characters of the lsn). Begins, ends and clean-ups alone tell what an epoch is like; each stretch gets
    the epochs of its ids that reach into it, so what goes by id is a narrow row for each stretch, or each begin and end, and it goes there once.
    parts: partitions of these shuffles (else the session's number). only: the records that are wanted back, of those all (a term over columns of
    records); epochs follow from the others too, but these are not shuffled as they are."""
    ended, begun = F.col("operation").isin(S.COMMIT, S.ABORT), F.col("operation") == S.BEGIN
    excludes = (begun & is_internal_transaction(F.col("transaction_name"))) | F.col("cleanup")
    # One text for both parts of the id, null or not: quicker to sort than a struct, and equal where both have a null.
    part = records.withColumn("_id", F.concat_ws("\x01", *[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in reversed(KEY)])).withColumn("_stretch", F.substring("lsn", 1, lsn_prefix))
    control = part.where(ended | begun | F.col("cleanup")).select(
        "_id", "lsn", F.when(ended, F.col("operation")).alias("_end"), F.coalesce(begun, F.lit(False)).alias("_begin"), F.col("seen_at"), F.coalesce(excludes, F.lit(False)).alias("_excludes"), F.lit(1).alias("_place")
    )
    if only is not None:
        part = part.where(only)
    # A row for each stretch of an id; the stretch itself comes before each lsn of it, and behind those of the stretches before.
    starts = part.select("_id", "_stretch").distinct().select("_id", F.col("_stretch").alias("lsn"), F.lit(None).cast("string").alias("_end"), F.lit(False).alias("_begin"), F.lit(None).cast(records.schema["seen_at"].dataType).alias("seen_at"), F.lit(False).alias("_excludes"), F.lit(0).alias("_place"))
    rows = control.unionByName(starts)
    rows = rows.repartition(parts, "_id") if parts else rows
    # Behind each end another epoch reaches into the stretch, which may have no begin nor end of its own.
    rows = rows.withColumn("_place", F.explode(F.when(F.col("_end").isNotNull(), F.array(F.lit(1), F.lit(2))).otherwise(F.array("_place"))))
    own = F.col("_place") == 1
    end, begin, excluding = own & F.col("_end").isNotNull(), own & F.col("_begin"), own & F.col("_excludes")
    so_far = Window.partitionBy("_id").orderBy("lsn", "_place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("epoch", F.coalesce(F.sum(end.cast("long")).over(so_far), F.lit(0).cast("long")))
    # All of these go by id, so that nothing is shuffled again. What an exclusion takes back: everything of the same id that was written before it.
    epoch, all_of_id = Window.partitionBy("_id", "epoch"), Window.partitionBy("_id")
    told = {
        "kind": F.max(F.when(end, F.col("_end"))).over(epoch),
        "begin_at": F.max_by(F.when(begin, F.col("seen_at")), F.when(begin, F.col("lsn"))).over(epoch),
        "end_at": F.max(F.when(end, F.col("seen_at"))).over(epoch),
        "excluded_from": F.min(F.when(excluding, F.col("lsn"))).over(epoch),
        "undone": F.coalesce(F.max(F.when(excluding, F.col("epoch"))).over(all_of_id) > F.col("epoch"), F.lit(False)),
        "end_lsn": F.max(F.when(end, F.col("lsn"))).over(epoch),
    }
    reached = rows.withColumns(told).groupBy("_id", F.substring("lsn", 1, lsn_prefix).alias("_stretch")).agg(
        F.sort_array(F.collect_list(F.when(~own, F.struct("epoch", *told)))).alias("_epochs"), F.max(F.col("_place") == 0).alias("_there")
    )
    stretches = reached.where("_there").drop("_there")

    # A record's epoch: as many ends of the stretch lie before it. So the payload is shuffled once and not sorted.
    inside = F.size(F.filter("_epochs", lambda e: e["end_lsn"] < F.col("lsn")))
    if parts:
        part, stretches = part.repartition(parts, "_id", "_stretch"), stretches.repartition(parts, "_id", "_stretch")
    own_epoch = part.join(stretches.hint("shuffle_hash"), ["_id", "_stretch"]).withColumn("_own", F.element_at("_epochs", inside + 1))
    every = [F.col("`" + c.replace("`", "``") + "`") for c in records.columns]
    return own_epoch.select(*every, *[F.col(f"_own.{c}").alias(c) for c in ("epoch", "kind", "begin_at", "end_at", "excluded_from", "undone")])


def committed(records: DataFrame, since: datetime | None = None) -> DataFrame:
    """The data records that the log commits: of epochs that end in COMMIT, are not excluded nor taken back, and began (or ended) since then."""
    rows = with_epochs(records).where(is_data_op(F.col("operation")) & (F.col("kind") == S.COMMIT) & F.col("excluded_from").isNull() & ~F.col("undone"))
    return rows if since is None else rows.where(F.coalesce("begin_at", "end_at") >= F.lit(since))


def pending(records: DataFrame, now: datetime | None = None, timeout_hours: float = 2) -> DataFrame:
    """Data records of epochs without an end, not excluded. With `now`, those that began longer ago than the timeout are dropped."""
    rows = with_epochs(records).where(is_data_op(F.col("operation")) & F.col("kind").isNull() & F.col("excluded_from").isNull())
    if now is None:
        return rows
    return rows.where(F.col("begin_at").isNull() | (F.col("begin_at") >= F.lit(now) - F.expr(f"make_dt_interval(0, 0, 0, {timeout_hours * 3600})")))


def cacheable(records: DataFrame) -> DataFrame:
    """Data records that may change row images: those before their epoch's exclusion, whether the epoch commits or not."""
    return with_epochs(records).where(is_data_op(F.col("operation")) & (F.col("excluded_from").isNull() | (F.col("lsn") < F.col("excluded_from"))))


def _n(c: Column) -> Column:
    return F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))


def counters() -> list[Column]:
    """Counts over records with epochs, and the last lsn (the next checkpoint): for an aggregate, or to observe a scan on its way."""
    data = is_data_op(F.col("operation"))
    good = data & (F.col("kind") == S.COMMIT) & F.col("excluded_from").isNull() & ~F.col("undone")
    return [
        _n(F.col("operation") == S.BEGIN).alias("begins"), _n(F.col("operation") == S.COMMIT).alias("commits"), _n(F.col("operation") == S.ABORT).alias("aborts"),
        _n(data).alias("data"), _n(F.coalesce(good, F.lit(False))).alias("committed"), _n(data & F.col("kind").isNull() & F.col("excluded_from").isNull()).alias("pending"), F.max("lsn").alias("last_lsn"),
    ]


def event_counters() -> list[Column]:
    """Counts over events: all, by operation, and those without executable SQL."""
    return [F.count(F.lit(1)).alias("generated"), *[_n(F.col("operation") == o).alias(o.lower() + "s") for o in ("INSERT", "UPDATE", "DELETE")], _n(~is_executable(F.col("sql_stmt"))).alias("errors")]


def scan_counters(records: DataFrame) -> DataFrame:
    """One row of counts over a scan, and the last lsn. A scan that runs anyway gives them by itself: see generate.scan's watch."""
    return with_epochs(records).agg(*counters())


def detail_counters(resolved: DataFrame, events: DataFrame) -> DataFrame:
    """One row for each database of what a scan made of its data records: eligible by context, of a known table, events, of those by operation and
    without executable SQL. resolved: data records with context and object_id; events: of `generate.scan`."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    base = is_base_row(F.col("context"))
    seen = resolved.groupBy("db_name").agg(F.count(F.lit(1)).alias("data"), n(base).alias("eligible"), n(base & F.col("object_id").isNotNull()).alias("resolved"))
    made = events.groupBy("db_name").agg(*event_counters())
    return seen.join(made, "db_name", "left").fillna(0)
