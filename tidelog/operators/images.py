"""Row images over time: each row slot's changes in log order, folded into a before and an after image for every update.

The state of a slot is one image; slots are dealt by key and read in order, so a task holds one slot's rows at a time however many
slots it has, and a slot's rows are streamed in batches."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ("db_name", "alloc_unit_id", "page_id", "slot_id")
ADDED = "before_image binary, after_image binary, fold_path string"


def splice(image: bytes, old: bytes, new: bytes, offset: int) -> bytes | None:
    """The image with `old` at offset replaced by `new`; None if it isn't there."""
    if offset < 0 or image[offset : offset + len(old)] != old or offset + len(old) > len(image):
        return None
    return image[:offset] + new + image[offset + len(old) :]


def reverse_patch(image: bytes, new: bytes, old: bytes) -> tuple[bytes | None, str]:
    """The image before `new` (which must occur just once) replaced `old` of the same length, and what is wrong otherwise."""
    if not new or len(new) != len(old):
        return None, "length_change"
    at = image.find(new)
    if at < 0:
        return None, "not_found"
    if image.find(new, at + 1) >= 0:
        return None, "ambiguous"
    return image[:at] + old + image[at + len(new) :], "ok"


def _u16(data: bytes, k: int) -> int:
    return int.from_bytes(data[2 * k : 2 * k + 2], "little")


def _up4(n: int) -> int:
    return -(-n // 4) * 4


def _places(c0: bytes, c1: bytes, c3: bytes, record: bytes) -> tuple[list[tuple[int, int, int]], bytes] | None:
    """((offset before, offset after, old length) of each changed place, payload) of a record that changes several; None if its parts don't fit.

    c0 has pairs (offset before, offset after), c1 the old lengths; the payload follows c3 in the record, moved on by the remainder of its
    place by 4 (not to the next multiple)."""
    n = len(c0) // 4
    at = record.find(c3) if c0 and len(c0) % 4 == 0 and len(c1) >= 2 * n else -1
    if at < 0:
        return None
    at += len(c3)
    at += at % 4
    return ([(_u16(c0, 2 * k), _u16(c0, 2 * k + 1), _u16(c1, k)) for k in range(n)], record[at:]) if at <= len(record) else None


def fragments(c0: bytes, c1: bytes, c3: bytes, record: bytes, after: bytes | None = None) -> list[tuple[int, bytes, bytes]] | None:
    """(old offset, old bytes, new bytes) of a record that changes several places; None if its parts don't fit.

    The payload holds old and new bytes in turn, each padded to 4. A new length follows from how the offsets shift at the next place. The last
    one takes the rest, or, where the image after the change is given, as much of the rest as stands there in it."""
    found = _places(c0, c1, c3, record)
    if found is None:
        return None
    places, data = found
    out, at = [], 0
    for k, (old_at, new_at, size) in enumerate(places):
        old, at = data[at : at + size], at + _up4(size)
        if len(old) < size or at > len(data):
            return None
        if k + 1 < len(places):
            size += places[k + 1][1] - places[k + 1][0] - (new_at - old_at)
        elif after is None:
            size = len(data) - at
        else:
            size = len(os.path.commonprefix([data[at:], after[new_at:]])) if new_at <= len(after) else -1
        if size < 0 or at + size > len(data):
            return None
        out.append((old_at, old, data[at : at + size]))
        at = min(at + _up4(size), len(data))
    return out


def reversed_columns(after: bytes, c0: bytes, c1: bytes, c3: bytes, record: bytes) -> bytes | None:
    """The image before a change of several places, from the one after it; None if the new bytes are not where they should be.

    Places are put back from the first on, so what stands before a place is old already and its old offset holds."""
    parts = fragments(c0, c1, c3, record, after)
    if parts is None:
        return None
    image = after
    for (old_at, old, new), (_, new_at, _) in zip(parts, _places(c0, c1, c3, record)[0], strict=True):
        if after[new_at : new_at + len(new)] != new or old_at + len(new) > len(image):
            return None
        image = image[:old_at] + old + image[old_at + len(new) :]
    return image


def apply_fragments(image: bytes, parts: list[tuple[int, bytes, bytes]]) -> bytes | None:
    """The image with all parts spliced in; None if any old bytes are not where they should be."""
    shift = 0
    for offset, old, new in parts:
        image = splice(image, old, new, offset + shift)
        if image is None:
            return None
        shift += len(new) - len(old)
    return image


def step(state: bytes | None, operation: str, c0: bytes | None, c1: bytes | None, offset: int | None, c3: bytes | None = None, record: bytes | None = None, page: bytes | None = None):
    """(new state, before, after, path) of one record.

    A change of several places is tried forward from the image at hand, then backward from it (it may be newer than the record), then
    backward from the row's current image on its page, if there is one."""
    c0, c1 = c0 or b"", c1 or b""
    if operation == "LOP_INSERT_ROWS":
        return (c0 or state), None, c0 or None, "insert"
    if operation == "LOP_DELETE_ROWS":
        return None, c0 or None, None, "delete"
    if operation == "LOP_MODIFY_ROW":
        if state is None:
            return None, None, None, "no_image"
        if offset is None or offset < 0:
            return state, None, None, "no_offset"
        after = splice(state, c0, c1, offset)
        return (after, state, after, "splice") if after is not None else (state, None, None, "not_verified")
    c3, record = c3 or b"", record or b""
    if state is not None:
        parts = fragments(c0, c1, c3, record)
        after = apply_fragments(state, parts) if parts else None
        if after is not None:
            return after, state, after, "splice_columns"
    for image, path in ((state, "reverse_columns"), (page, "reverse_page")):
        before = reversed_columns(image, c0, c1, c3, record) if image else None
        if before is not None:
            return image, before, image, path
    return state, None, None, "no_image" if state is None and not page else "columns_not_decoded"


def _changes(batch: pa.RecordBatch) -> np.ndarray:
    """Whether a row's slot is another one than the row's before it; the first row is not compared."""
    out = np.zeros(batch.num_rows, bool)
    for k in KEY:
        c = batch.column(batch.schema.get_field_index(k))
        differ = pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, max(len(c) - 1, 0))), True)
        out[1:] |= differ.to_numpy(zero_copy_only=False)
    return out


#: Rows of a task that sorts whole records: they set its memory, whatever the input.
ROWS_EACH = 100_000


def parts_for(rows: int, records: DataFrame) -> int:
    """Partitions for so many rows: a task for each ROWS_EACH, and one for each core at least."""
    return max(records.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_EACH))


def fold(records: DataFrame, parts: int | None = None) -> DataFrame:
    """Records with page and slot, with before and after images. Needs KEY, lsn, operation, contents0, contents1, offset_in_row; contents3 and log_record serve
    changes of several places, page_image (the row's current image, see `with_page_images`) those of rows without a known image.

    One shuffle by slot and a sort within partitions; the walk keeps the image of the slot at hand, across batches. A record without a page
    or slot has no image but its own, so such records need not meet and are dealt by lsn. parts: partitions of that shuffle (else the session's number)."""
    names = records.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema.fields) + ", " + ADDED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, state = None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            column = lambda name, b=batch, n=n: b.column(b.schema.get_field_index(name)).to_pylist() if name in names else [None] * n
            new = _changes(batch)
            key_at = lambda i, b=batch: tuple(b.column(b.schema.get_field_index(k))[i].as_py() for k in KEY)
            new[0] = key_at(0) != slot
            loose = pc.or_(pc.is_null(batch.column(batch.schema.get_field_index("page_id"))), pc.is_null(batch.column(batch.schema.get_field_index("slot_id")))).to_numpy(zero_copy_only=False)
            before, after, paths = [None] * n, [None] * n, [None] * n
            rows = zip(column("operation"), column("contents0"), column("contents1"), column("offset_in_row"), column("contents3"), column("log_record"), column("page_image"), strict=True)
            for i, (fresh, row) in enumerate(zip((new | loose).tolist(), rows, strict=True)):
                state, before[i], after[i], paths[i] = step(None if fresh else state, *row)
            slot = key_at(n - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.binary()), pa.array(after, pa.binary()), pa.array(paths, pa.string())], [*names, "before_image", "after_image", "fold_path"])

    loose = F.col("page_id").isNull() | F.col("slot_id").isNull()
    keys = (*KEY, F.when(loose, F.xxhash64("lsn")))
    return (records.repartition(parts, *keys) if parts else records.repartition(*keys)).sortWithinPartitions(*KEY, "lsn").mapInArrow(run, schema)


#: Paths after which a slot's image is the record's after image (none after a deletion).
SETTLED = ("insert", "delete", "splice", "splice_columns", "reverse_columns", "reverse_page")


def last_images(folded: DataFrame) -> DataFrame:
    """KEY and image: what each slot holds after folded records."""
    last = folded.where(F.col("fold_path").isin(*SETTLED) & F.col("page_id").isNotNull() & F.col("slot_id").isNotNull()).groupBy(*KEY).agg(F.max_by(F.struct("after_image"), "lsn").alias("_last"))
    return last.select(*KEY, F.col("_last.after_image").alias("image")).where("image is not null")


def as_records(held: DataFrame) -> DataFrame:
    """Images held from before, as insertions that come before every lsn; fold them with the records that follow."""
    return held.select(*KEY, F.lit("").alias("lsn"), F.lit("LOP_INSERT_ROWS").alias("operation"), F.col("image").alias("contents0"))


def with_page_images(records: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds page_image, the current image of each record's row: pages has db_name, page_id, slot_id and image (of `log_sources.page_images`)."""
    current = pages.groupBy("db_name", "page_id", "slot_id").agg(F.max("image").alias("page_image"))
    return records.join(current, ["db_name", "page_id", "slot_id"], "left")
