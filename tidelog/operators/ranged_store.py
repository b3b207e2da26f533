"""The event table in ranges of (db_name, lsn): a batch rewrites the ranges that it touches and no other, and is committed as a whole.

    data/<batch>/r=<range>   the rows of ranges that a batch rewrote
    manifest/seq=<number>    for each range its low key, folder, rows and a Bloom filter of its transactions; and the checkpoints

A key lies in one range, so an upsert finds its ranges by a search in the list of low keys. A transaction may lie in any; those whose filter does not have it are
left alone. Events, retractions and checkpoints become visible together, with the manifest, which is the last thing written and says how many rows it has: a
reader takes the newest whole one. A batch that comes again, by its number, changes nothing. Ranges that outgrow `rows_each` twice are cut when they are next written.

The manifest passes through the driver: a row of at most 9 KB for each range."""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rows as R
from .store import latest

MANIFEST = "total int, kind string, name string, low string, folder string, n bigint, filter binary"
#: Bits of a filter for each transaction of its range, and looks at it: one in 100 ranges without a transaction is read all the same.
BITS, LOOKS = 10, 7
MOST_BITS = 1 << 16
#: Transactions taken back that are sent to every task; more are joined by shuffle.
MOST_BROADCAST = 1_000_000


def _key(db: str = "db_name", lsn: str = "lsn"):
    return F.concat(F.coalesce(F.col(db), F.lit("")), F.lit("\x01"), F.coalesce(F.col(lsn), F.lit("")))


def _mixed(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = h.astype(np.int64).view(np.uint64)
    return x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)


def bloom(hashes: np.ndarray) -> bytes:
    size = int(min(MOST_BITS, max(64, BITS * len(hashes))))
    a, b = _mixed(hashes)
    out = np.zeros(size, bool)
    for k in range(LOOKS):
        out[((a + np.uint64(k) * b) % np.uint64(size)).astype(np.int64)] = True
    return np.int32(size).tobytes() + np.packbits(out).tobytes()


#: Hashes looked up at a time; of so many, some are found in a filter sooner or later, so a long list is hardly ever read to its end.
LOOKED_UP = 512


def may_have(data: bytes, hashes: np.ndarray) -> bool:
    size = int(np.frombuffer(data, np.int32, 1)[0])
    bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=4))[:size].astype(bool)
    for at in range(0, len(hashes), LOOKED_UP):
        a, b = _mixed(hashes[at : at + LOOKED_UP])
        hit = np.ones(len(a), bool)
        for k in range(LOOKS):
            hit &= bits[((a + np.uint64(k) * b) % np.uint64(size)).astype(np.int64)]
        if hit.any():
            return True
    return False


@dataclass
class State:
    """What a manifest says."""

    seq: int = -1
    ranges: dict[str, dict] = field(default_factory=dict)  # name: low, folder, n, filter
    checkpoints: dict[str, str] = field(default_factory=dict)

    def lows(self) -> list[tuple[str, str]]:
        return sorted((r["low"], name) for name, r in self.ranges.items())


class RangedStore:
    """Events (with db_name, lsn, txn_id) at a path; rows_each: of a range."""

    def __init__(self, spark: SparkSession, path: str, rows_each: int = 1_000_000):
        self.spark, self.path, self.rows_each = spark, path, rows_each

    # ---- reading ----

    def state(self) -> State:
        try:
            found = self.spark.read.schema(MANIFEST + ", seq bigint").parquet(f"{self.path}/manifest")
        except AnalysisException:
            return State()
        whole = [r.seq for r in found.groupBy("seq").agg((F.count(F.lit(1)) == F.max("total")).alias("whole")).where("whole").collect()]
        if not whole:
            return State()
        out = State(max(whole))
        for r in found.where(F.col("seq") == out.seq).collect():
            if r.kind == "range":
                out.ranges[r.name] = {"low": r.low, "folder": r.folder, "n": r.n, "filter": r.filter}
            elif r.kind == "checkpoint":
                out.checkpoints[r.name] = r.low
        return out

    def _rows(self, state: State, names: Iterable[str]) -> DataFrame | None:
        folders = [state.ranges[n]["folder"] for n in names if state.ranges[n]["n"]]
        return self.spark.read.parquet(*folders) if folders else None

    def read(self, db: str | None = None, low: str = "", high: str = "￿") -> DataFrame | None:
        """The events, or those of a database between two lsns, from the ranges that may hold them; None before the first batch."""
        state = self.state()
        lows = state.lows()
        names = [n for _, n in lows]
        if db is not None:
            keys = [k for k, _ in lows]
            names = names[max(0, bisect_right(keys, f"{db}\x01{low}") - 1) : bisect_right(keys, f"{db}\x01{high}")]
        rows = self._rows(state, names)
        if rows is None or db is None:
            return rows
        return rows.where((F.col("db_name") == db) & F.col("lsn").between(low, high))

    # ---- writing ----

    def _cuts(self, rows: DataFrame, n: int) -> list[str]:
        """Low keys of n ranges of about even size; the first is the lowest of all."""
        if n <= 1:
            return [""]
        lows = rows.select(_key().alias("k")).repartitionByRange(n, "k").groupBy(F.spark_partition_id()).agg(F.min("k").alias("k")).collect()
        return ["", *sorted(r.k for r in lows)[1:]]

    def upsert(self, batch: DataFrame, seq: int, gone: DataFrame | None = None, checkpoints: dict[str, str] | None = None) -> list[str]:
        """Puts events in, the last of each key as `store.latest` has it (a column is_deleted retracts), takes out all events of transactions in `gone`
        (db_name, txn_id) that were there before, and sets checkpoints. Returns the names of the ranges that it wrote."""
        state = self.state()
        if seq <= state.seq:
            return []
        batch = batch.withColumn("ingest_seq", F.lit(seq).cast("long"))
        if "is_deleted" not in batch.columns:
            batch = batch.withColumn("is_deleted", F.lit(False))
        if not state.ranges:
            new = {uuid.uuid4().hex: {"low": k, "folder": "", "n": 0, "filter": b""} for k in self._cuts(batch, -(-batch.count() // self.rows_each))}
            state = State(state.seq, new, state.checkpoints)
        lows = state.lows()
        keys, names = [k for k, _ in lows], [n for _, n in lows]
        name_of = R.arrow_function(lambda k: pa.array([names[bisect_right(keys, x) - 1] for x in k.to_pylist()], pa.string()), "string")
        dealt = batch.withColumn("r", name_of(_key()))
        more = {r.r: r["count"] for r in dealt.groupBy("r").count().collect()}
        hit = set(more)
        if gone is not None:
            gone = gone.select("db_name", "txn_id").distinct()
            hashes = np.array([r.h for r in gone.select(F.xxhash64("db_name", "txn_id").alias("h")).collect()], np.int64)
            hit |= {n for n, r in state.ranges.items() if n not in hit and r["n"] and may_have(r["filter"], hashes)}
        before = self._rows(state, sorted(hit))
        if before is not None:
            # The folder of a range names it.
            before = before.withColumn("r", F.regexp_extract("_metadata.file_path", "/r=([^/]+)/[^/]+$", 1)).withColumn("is_deleted", F.lit(False))
            if gone is not None:
                before = before.join(F.broadcast(gone) if len(hashes) <= MOST_BROADCAST else gone, ["db_name", "txn_id"], "left_anti")
            dealt = dealt.unionByName(before, allowMissingColumns=True)
        # Dealt by range, the versions of a key are in one task, which sorts by range and key once, for the last of each key and for the files.
        merged = latest(dealt.repartition("r"), "r").drop("is_deleted")
        out = dict(state.ranges)
        if hit:
            split = self._split(merged, state, sorted(hit), out, more)
            folder = f"{self.path}/data/{uuid.uuid4().hex}"
            split = split if split is merged else split.repartition("r")
            self._arranged(split.sortWithinPartitions("r", "db_name", "lsn")).write.partitionBy("r").parquet(folder)
            self._written(folder)
            for name, n, data in self._filters(merged.sparkSession.read.schema(merged.schema).parquet(folder)):
                out[name] = out[name] | {"folder": f"{folder}/r={name}", "n": n, "filter": data}
        self._commit(seq, out, state.checkpoints | (checkpoints or {}))
        return sorted(n for n, r in out.items() if r["n"] and state.ranges.get(n) != r)

    def _arranged(self, rows: DataFrame) -> DataFrame:
        """The rows of a batch, in ranges r and in order, as they are written."""
        return rows

    def _written(self, folder: str) -> None:
        """Called with the folder of a batch before the batch is committed."""

    def _split(self, merged: DataFrame, state: State, hit: list[str], out: dict[str, dict], more: dict[str, int]) -> DataFrame:
        """Names in column r for the rows of the ranges hit, those too large cut anew; `out` gets the new ranges, empty so far. more: rows of the batch in each range.
        Rows are merged for their number only in ranges that may have become too large."""
        large = [n for n in hit if state.ranges[n]["n"] + more.get(n, 0) > 2 * self.rows_each]
        sizes = {r.r: r["count"] for r in merged.where(F.col("r").isin(large)).groupBy("r").count().collect()} if large else {}
        for n in hit:
            out[n] = state.ranges[n] | {"n": 0, "folder": "", "filter": b""}
        lows = {out[n]["low"]: n for n in hit}
        for n, rows in sizes.items():
            if rows > 2 * self.rows_each:
                for k in self._cuts(merged.where(F.col("r") == n), -(-rows // self.rows_each))[1:]:
                    lows[k] = name = uuid.uuid4().hex
                    out[name] = {"low": k, "folder": "", "n": 0, "filter": b""}
        if len(lows) == len(hit):
            return merged
        keys = sorted(lows)
        return merged.withColumn("r", R.arrow_function(lambda k: pa.array([lows[keys[bisect_right(keys, x) - 1]] for x in k.to_pylist()], pa.string()), "string")(_key()))

    @staticmethod
    def _filters(rows: DataFrame) -> list[tuple[str, int, bytes]]:
        def one(table: pa.Table) -> pa.Table:
            h = table["h"].to_numpy()
            return pa.table({"r": [table["r"][0].as_py()], "n": pa.array([len(h)], pa.int64()), "filter": pa.array([bloom(np.unique(h))], pa.binary())})

        one.__annotations__ = {"table": pa.Table, "return": pa.Table}
        found = rows.select("r", F.xxhash64("db_name", "txn_id").alias("h")).groupBy("r").applyInArrow(one, "r string, n bigint, filter binary")
        return [(x.r, x.n, bytes(x.filter)) for x in found.collect()]

    def _commit(self, seq: int, ranges: dict[str, dict], checkpoints: dict[str, str]) -> None:
        rows = [("range", n, r["low"], r["folder"], r["n"], r["filter"]) for n, r in ranges.items()] + [("checkpoint", db, lsn, None, None, None) for db, lsn in checkpoints.items()]
        rows = [(len(rows), *r) for r in rows]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/seq={seq}")
