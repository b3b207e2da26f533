"""Following a log with keyed state: epochs by transaction, images by row slot, open transactions with timers.

    records -> marks (transaction: epoch, exclusion) -> images (slot) -> open transactions -> committed records -> statements

Each operator keeps its state in the state store (RocksDB), by key: a batch reads and writes the state of the keys that it brings and no other, however
many slots the log has touched. Exactly-once follows from Spark's own commit of offsets and state.

A transaction may be a third of the log. Its data records are dealt over `shares` by lsn; begins, ends and clean-ups go to every share, so each share marks
and holds its own part and releases it at the end. An open transaction's share expires `timeout_hours` after its first held record: what it holds is dropped, and so is what
comes of it later, up to its end.

Results equal `generate.scan` over the same records, but that events of a transaction which a later exclusion of its id takes back have left already: a
retraction row (retract = true) says so. An excluded transaction and records of unknown tables give nothing."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, BooleanType, LongType, StringType, StructField, StructType, TimestampType

from .. import schemas as S
from ..functions.predicates import is_base_row, is_data_op, is_internal_transaction
from ..operators import generate, images
from ..sources.catalog import Catalog

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MARKS = [StructField("epoch", LongType()), StructField("excluded", BooleanType()), StructField("begin_at", TimestampType()), StructField("retract", BooleanType())]
IMAGES = [StructField("before_image", BinaryType()), StructField("after_image", BinaryType()), StructField("fold_path", StringType())]


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _in_order(rows: Iterator[Row]) -> list[Row]:
    return sorted(rows, key=lambda r: r.lsn)


class Marks(StatefulProcessor):
    """Of a share of a transaction: how many ends its id has had, whether it is excluded, when it began."""

    def __init__(self, schema: StructType):
        self.columns = schema.fieldNames()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("mark", StructType(MARKS[:3]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        epoch, excluded, begin_at = self.state.get() if self.state.exists() else (0, False, None)
        make = Row(*self.columns)
        for r in _in_order(rows):
            takes_back = False
            if r.operation == S.BEGIN:
                begin_at = r.seen_at
            if (r.internal or r.cleanup) and not excluded:
                excluded, takes_back = True, epoch > 0
            yield make(*r, epoch, excluded, begin_at, takes_back)
            if r.operation in (S.COMMIT, S.ABORT):
                epoch, excluded, begin_at = epoch + 1, False, None
        self.state.update((epoch, excluded, begin_at))

    def close(self) -> None:
        pass


class Images(StatefulProcessor):
    """Of a row slot: its image. Records that have no slot, or are excluded, pass."""

    def __init__(self, schema: StructType):
        self.columns = schema.fieldNames()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("image", StructType([StructField("image", BinaryType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        make, loose = Row(*self.columns), key[-1] is not None
        image = None if loose or not self.state.exists() else self.state.get()[0]
        before_all = image
        for r in _in_order(rows):
            if r.control or r.excluded:
                yield make(*r, None, None, None)
                continue
            at, before, after, path = images.step(None if loose else image, r.operation, r.contents0, r.contents1, r.offset_in_row, r.contents3, r.log_record)
            image = None if loose else at
            yield make(*r, before, after, path)
        if image is None and before_all is not None:
            self.state.clear()
        elif image is not before_all:
            self.state.update((image,))

    def close(self) -> None:
        pass


class OpenTransactions(StatefulProcessor):
    """Of a share of a transaction: its data records until the end, which releases or drops them. A timer drops those of a transaction that never ends."""

    def __init__(self, held: StructType, schema: StructType, timeout_hours: float):
        self.held, self.columns, self.timeout = held, schema.fieldNames(), int(timeout_hours * 3_600_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.held)
        self.expired = handle.getValueState("expired", StructType([StructField("yes", BooleanType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        make, new, dead = Row(*self.columns), [], self.expired.exists()
        before = held = self.rows.exists()
        for r in _in_order(rows):
            if r.retract:
                yield make(*r, None)
            if r.excluded:  # what is held of this transaction will not be asked for
                if held:
                    self.rows.clear()
                new, held = [], False
            elif not r.control and not dead:
                new.append(r)
            if r.operation in (S.COMMIT, S.ABORT):
                if r.operation == S.COMMIT and not r.excluded and not dead:
                    old = self.rows.get() if held else ()
                    for x in (*old, *new):
                        yield make(*x, r.seen_at)
                if held:
                    self.rows.clear()
                if dead:
                    self.expired.clear()
                new, held, dead = [], False, False
        if new:
            self.rows.appendList([tuple(x) for x in new])
        if (held or new) and not before:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout)
        elif before and not held and not new:
            self._forget_timers()

    def _forget_timers(self) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.rows.clear()
        self.expired.update((True,))
        yield from ()

    def close(self) -> None:
        pass


def committed_records(source: DataFrame, catalog: Catalog, shares: int = 8, timeout_hours: float = 2) -> DataFrame:
    """A stream of the data records that the log commits, with object_id, compression, images, begin_at and end_at; and retractions (retract is true).

    source: a stream with the columns of S.LOG_RECORDS, seen_at and cleanup."""
    use_rocksdb(source.sparkSession)
    data = is_data_op(F.col("operation")) & is_base_row(F.col("context"))
    control = F.col("operation").isin(*S.CONTROL_OPS) | F.coalesce("cleanup", F.lit(False))
    known = generate.resolved(source.where(control | data), catalog).where(control | F.col("object_id").isNotNull())
    internal = (F.col("operation") == S.BEGIN) & is_internal_transaction(F.col("transaction_name"))
    every = F.sequence(F.lit(0), F.lit(shares - 1))
    dealt = known.withColumn("control", control).withColumn("internal", F.coalesce(internal, F.lit(False)))
    dealt = dealt.withColumn("share", F.explode(F.when(control, every).otherwise(F.array(F.pmod(F.xxhash64("lsn"), F.lit(shares)).cast("int")))))
    marked = StructType([*dealt.schema.fields, *MARKS])
    marks = dealt.groupBy("db_name", "transaction_id", "share").transformWithState(Marks(marked), marked, "Append", "ProcessingTime")

    # Control records and those without a slot have no image: any key will do.
    loose = F.when(F.col("control") | F.col("page_id").isNull() | F.col("slot_id").isNull(), F.pmod(F.xxhash64("lsn", "share"), F.lit(64)).cast("int"))
    slots = marks.withColumn("loose", loose).withColumns({f"at_{c}": F.when(F.col("loose").isNull(), F.col(c)) for c in ("alloc_unit_id", "page_id", "slot_id")})
    imaged = StructType([*slots.schema.fields, *IMAGES])
    folded = slots.groupBy("db_name", "at_alloc_unit_id", "at_page_id", "at_slot_id", "loose").transformWithState(Images(imaged), imaged, "Append", "ProcessingTime")

    out = StructType([*imaged.fields, StructField("end_at", TimestampType())])
    done = folded.groupBy("db_name", "transaction_id", "share").transformWithState(OpenTransactions(imaged, out, timeout_hours), out, "Append", "ProcessingTime")
    return done.where(~F.col("retract") | (F.col("share") == 0)).drop("loose", "at_alloc_unit_id", "at_page_id", "at_slot_id")


def events(committed: DataFrame, catalog: Catalog) -> DataFrame:
    """Events of a batch of committed records; retractions are left out."""
    return generate.event_columns(generate.statements(committed.where(~F.col("retract")), catalog))


def retractions(committed: DataFrame) -> DataFrame:
    """(db_name, txn_id) of ids of which earlier events are taken back, with the lsn from which on."""
    return committed.where("retract").select("db_name", F.col("transaction_id").cast("string").alias("txn_id"), "lsn")
