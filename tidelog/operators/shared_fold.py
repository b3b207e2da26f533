"""Folding a slot's history in many tasks: for slots that hold a large part of all changes.

The records are cut by (slot, lsn) into ranges of even size, so one slot may fill many partitions. A partition needs one thing from before it: the image that
its first slot has by then.

1. Each partition sums up the stretch of its last slot, without knowing the image it will start from: either as the image that it leaves (after an insertion or
   deletion), or as a patch: a map from bytes of the result to bytes of the start or to new ones, with the bytes that the start must have for
   this to hold. Splices compose, so a stretch of any length is one patch of the size of a row.
2. The stretches of a slot are chained, in order: a patch applies if the start has the bytes it asks for. If not (a record that does not fit its
   row, or goes back from a page), the stretch is walked with its start, which is known by then, and the chain goes on.
3. All partitions are walked with their starts, which gives the rows that `images.fold` gives.

What passes from partition to partition is one row image each, whatever the number of records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import durable, new_folder
from . import images

SUMMARY = "part int, slot string, only boolean, kind string, image binary, patch binary"


class Patch:
    """An image in terms of the one it starts from: `cells` are its first bytes (n >= 0: byte n of the start, -1 - b: the byte b), what follows is the start from `rest`
    on. needs: bytes that the start must have; least: its length at least."""

    def __init__(self):
        self.cells, self.rest, self.least = np.zeros(0, np.int32), 0, 0
        self.needs: dict[int, int] = {}

    def _reach(self, n: int) -> None:
        if n > len(self.cells):
            more = n - len(self.cells)
            self.cells = np.concatenate([self.cells, np.arange(self.rest, self.rest + more, dtype=np.int32)])
            self.rest += more

    def splice(self, old: bytes, new: bytes, offset: int) -> bool:
        """As images.splice: True if it takes effect on every start that has the needs, False if on none of them."""
        if offset < 0:
            return False
        # Nothing is changed before all of `old` is known to fit.
        end, size = offset + len(old), len(self.cells)
        have = self.cells[offset:end]
        known = have < 0
        if (-1 - have[known] != np.frombuffer(old, np.uint8)[: len(have)][known]).any():
            return False
        asked = {int(c): b for c, b in zip(have, old, strict=False) if c >= 0} | {self.rest + offset + k - size: old[k] for k in range(max(0, size - offset), len(old))}
        if any(self.needs.get(at, b) != b for at, b in asked.items()):
            return False
        self.needs |= asked
        self.least = max([self.least, self.rest + end - size if end > size else 0, *(at + 1 for at in asked)])
        self._reach(end)
        self.cells = np.concatenate([self.cells[:offset], -1 - np.frombuffer(new, np.uint8).astype(np.int32), self.cells[end:]])
        return True

    def apply(self, start: bytes) -> bytes | None:
        if len(start) < self.least:
            return None
        x = np.frombuffer(start, np.uint8)
        at = np.fromiter(self.needs, np.int64, len(self.needs))
        if (x[at] != np.fromiter(self.needs.values(), np.int64, len(self.needs))).any():
            return None
        cells = self.cells
        return np.where(cells < 0, -1 - cells, x[np.maximum(cells, 0)] if len(x) else 0).astype(np.uint8).tobytes() + start[self.rest :]

    def dump(self) -> bytes:
        at, of = (np.fromiter(v, np.int32, len(self.needs)) for v in (self.needs, self.needs.values()))
        return np.concatenate([np.array([len(self.cells), len(at), self.rest, self.least], np.int32), self.cells, at, of]).astype("<i4").tobytes()

    @classmethod
    def load(cls, data: bytes) -> Patch:
        x, out = np.frombuffer(data, "<i4"), cls()
        n, m, out.rest, out.least = x[:4].tolist()
        out.cells, out.needs = x[4 : 4 + n].astype(np.int32), dict(zip(x[4 + n : 4 + n + m].tolist(), x[4 + n + m :].tolist(), strict=True))
        return out


class Stretch:
    """What a run of records of one slot makes of an image that is not known."""

    def __init__(self):
        self.kind, self.image, self.patch = "patch", None, Patch()

    def add(self, operation, c0, c1, offset, c3, record, page) -> None:
        if operation == "LOP_DELETE_ROWS" or (operation == "LOP_INSERT_ROWS" and c0):
            self.kind, self.image = "image", c0 if operation == "LOP_INSERT_ROWS" else None
        elif self.kind == "image":
            self.image = images.step(self.image, operation, c0, c1, offset, c3, record, page)[0]
        elif self.kind == "patch":
            c0, c1 = c0 or b"", c1 or b""
            if operation == "LOP_MODIFY_ROW":
                self.patch.splice(c0, c1, -1 if offset is None else offset)
            elif operation == "LOP_MODIFY_COLUMNS":
                parts, shift = images.fragments(c0, c1, c3 or b"", record or b""), 0
                # Forward if every part fits; else the way depends on the image.
                for at, old, new in parts or []:
                    if not self.patch.splice(old, new, at + shift):
                        self.kind = "walk"
                        break
                    shift += len(new) - len(old)
                if not parts or page is not None:
                    self.kind = "walk"

    def after(self, start: bytes | None) -> tuple[bool, bytes | None]:
        """(whether it can be told, the image that is left)."""
        if self.kind == "image":
            return True, self.image
        if self.kind == "walk":
            return False, None
        if start is None:  # without an image nothing but an insertion or deletion makes one
            return True, None
        out = self.patch.apply(start)
        return out is not None, out


COLUMNS = ("operation", "contents0", "contents1", "offset_in_row", "contents3", "log_record", "page_image")


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    n = batch.num_rows
    names = batch.schema.names
    columns = [batch.column(names.index(c)).to_pylist() if c in names else [None] * n for c in COLUMNS]
    yield from zip(*columns, strict=True)


def _slots(batch: pa.RecordBatch) -> list[str | None]:
    return batch.column(batch.schema.names.index("_slot")).to_pylist()


def fold(records: DataFrame, parts: int | None = None) -> DataFrame:
    """The rows of images.fold(records), by ranges of (slot, lsn)."""
    spark = records.sparkSession
    loose = F.col("page_id").isNull() | F.col("slot_id").isNull()
    # One text names a slot; records without one stand alone.
    name = F.when(~loose, F.to_json(F.struct(*images.KEY)))
    ranged = records.withColumn("_slot", name)
    ranged = ranged.repartitionByRange(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), "_slot", "lsn").sortWithinPartitions("_slot", "lsn")
    ranged = durable(ranged.withColumn("_part", F.spark_partition_id()))

    def sum_up(starts: dict | None):
        """Of each partition: its first slot's stretch (needed if it fills the partition), and its last slot's."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, first, slot, stretch, only = None, None, None, None, True
            for batch in batches:
                if part is None and batch.num_rows:
                    part = batch.column(batch.schema.names.index("_part"))[0].as_py()
                for s, row in zip(_slots(batch), _rows(batch), strict=True):
                    if s is None:
                        continue
                    if s != slot:
                        only, first = first is None, first or s
                        slot, stretch = s, Stretch()
                        if not only or starts is not None:  # it begins here, or its start is known
                            stretch.kind, stretch.image = "image", None if not only else starts[part][1]
                    stretch.add(*row)
            if slot is not None:
                columns = [[part], [slot], [only], [stretch.kind], [stretch.image], [stretch.patch.dump() if stretch.kind == "patch" else None]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.binary(), pa.binary()), strict=True)], ["part", "slot", "only", "kind", "image", "patch"])

        return run

    summaries = {r.part: r for r in ranged.mapInArrow(sum_up(None), SUMMARY).collect()}
    by_part = []

    def left_by(part: int, start: tuple) -> bytes | None:
        """The image that a stretch leaves, by walking it from its start."""
        if not by_part:  # written by part at the first need, so that one is read alone
            path = new_folder(spark, "fold")
            ranged.write.partitionBy("_part").parquet(path)
            by_part.append(spark.read.schema(ranged.schema).parquet(path))
        one = by_part[0].where(F.col("_part") == part).select(ranged.columns).coalesce(1).sortWithinPartitions("_slot", "lsn")
        return one.mapInArrow(sum_up({part: start}), SUMMARY).first().image

    # A row of a patch's size for each partition; the chain is one pass over them.
    starts: dict[int, tuple] = {}
    slot, image = None, None
    for part in sorted(summaries):
        r = summaries[part]
        starts[part] = slot, image  # of the slot before: its records go on here, or there are none
        if r.only:
            start = image if r.slot == slot else None
            stretch = Stretch()
            stretch.kind, stretch.image = r.kind, r.image
            if r.kind == "patch":
                stretch.patch = Patch.load(r.patch)
            told, image = stretch.after(start)
            if not told:
                image = left_by(part, (r.slot, start))
        else:
            image = r.image
        slot = r.slot

    sent = spark.sparkContext.broadcast(starts)
    names = records.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema.fields) + ", " + images.ADDED

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, state, begun = None, None, False
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if not begun:
                begun = True
                slot, state = sent.value.get(batch.column(batch.schema.names.index("_part"))[0].as_py(), (None, None))
            before, after, paths = [None] * n, [None] * n, [None] * n
            for i, (s, row) in enumerate(zip(_slots(batch), _rows(batch), strict=True)):
                if s is None or s != slot:
                    slot, state = s, None
                state, before[i], after[i], paths[i] = images.step(state, *row)
            kept = [batch.column(batch.schema.names.index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(before, pa.binary()), pa.array(after, pa.binary()), pa.array(paths, pa.string())], [*names, "before_image", "after_image", "fold_path"])

    return ranged.mapInArrow(walk, schema)
