"""A lookup of 64-bit keys across chunks of a corpus, as two Spark shuffles of packed rows.

Documents are dealt into chunks by a hash of their id and text; equal rows that would fill a chunk are worked on once. A chunk asks for its distinct keys once each: a row per range of keys
(`bucket`) holds them in sorted order, Elias-Fano packed, with a number for each. The bucket's task sees all chunks' rows of its range
and answers each row with a number per key, in the row's order; the chunk's task gets the answers beside its documents again. So a key
that a third of all documents hold costs a row entry per chunk, not per occurrence, and no task sees more than a chunk or a range.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import checkpoint

REQUEST = "bucket int, chunk int, n int, keys binary, vals binary"
REPLY = "chunk int, bucket int, vals binary"


def typed(fn: Callable, *tables: str) -> Callable:
    """Marks fn(key, table...) -> table for applyInArrow."""
    fn.__annotations__ = {"key": tuple[pa.Scalar, ...], **{t: pa.Table for t in tables}, "return": pa.Table}
    return fn


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """The low `width` bits of each value."""
    if not width or not len(values):
        return b""
    bits = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(bits[:, 64 - width :]).tobytes()


def unpack_bits(data: bytes, n: int, width: int) -> np.ndarray:
    if not width or not n:
        return np.zeros(n, np.uint64)
    bits = np.zeros((n, 64), np.uint8)
    bits[:, 64 - width :] = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width).reshape(n, width)
    return np.packbits(bits, axis=1).view(">u8").reshape(-1).astype(np.uint64)


def _low_bits(n: int, span: int) -> int:
    return max(0, span - max(0, (n - 1).bit_length()))


def pack_sorted(keys: np.ndarray, span: int) -> bytes:
    """Elias-Fano code of sorted keys below 2**span: about 2 bits a key beyond its low bits."""
    low = _low_bits(len(keys), span)
    high = (keys >> np.uint64(low)).astype(np.int64) if low < 64 else np.zeros(len(keys), np.int64)
    marks = np.zeros(len(keys) + (1 << (span - low)) + 1, np.uint8)
    marks[high + np.arange(len(keys))] = 1
    return pack_bits(keys, low) + np.packbits(marks).tobytes()


def unpack_sorted(data: bytes, n: int, span: int) -> np.ndarray:
    low = _low_bits(n, span)
    cut = (n * low + 7) // 8
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=cut)))
    high = (ones - np.arange(n)).astype(np.uint64)
    return (high << np.uint64(low) if low < 64 else high) | unpack_bits(data[:cut], n, low)


def pack_numbers(values: np.ndarray) -> bytes:
    """Unsigned numbers as base, byte width and byte planes; small or similar numbers take a byte or less once compressed."""
    if not len(values):
        return b""
    values = values.astype(np.int64)
    base = int(values.min())
    rest = (values - base).astype("<u8")
    width = (int(rest.max()).bit_length() + 7) // 8
    return np.int64(base).tobytes() + bytes([width]) + rest.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack_numbers(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    width = data[8]
    planes = np.zeros((n, 8), np.uint8)
    planes[:, :width] = np.frombuffer(data, np.uint8, n * width, 9).reshape(width, n).T
    return planes.view("<i8").reshape(-1) + np.frombuffer(data, np.int64, 1)[0]


def sizes(docs: DataFrame, least: int = 48, chunk_mb: tuple[float, float] = (2, 32), keys_each: int = 1 << 20) -> tuple[int, int]:
    """How many chunks, and log2 of how many buckets: from the bytes of all texts (one pass over them).

    There is a row for each chunk and bucket. Up to 16 GB of texts both keep their size; then both grow with the root of the input, so
    that rows grow in proportion to it, until tasks would get too large (chunks of twice chunk_mb, buckets of four times keys_each)."""
    total = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    grown = max(1.0, (total / 2**34) ** 0.5)
    chunk = min(max(total / 512, chunk_mb[0] * 2**20), chunk_mb[1] * 2**20 * min(grown, 2.0))
    return max(least, int(total / chunk) + 1), max(6, int(total / 6 / (keys_each * min(grown, 4.0))).bit_length())


def spread() -> Column:
    """A number that deals rows into chunks; rows that share an id are dealt by their texts, too."""
    return F.xxhash64("doc_id", "text")


def without_hot(docs: DataFrame, most_bytes: int = 1 << 20) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(rows, restore): doc_id, text, copies and hot of docs, in which equal rows that would fill a chunk (more than most_bytes of one id and
    text) stand once, with their number and a key; restore gives such rows' results back to each of them.

    No more than (bytes of all texts and 64 a row) / most_bytes rows are hot, and their results are joined back by broadcast only after a count."""
    plain = docs.select("doc_id", "text")
    # Rows without a text take up room, too.
    keys = plain.groupBy(spread().alias("hot")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.octet_length("text")), F.lit(0)).alias("b"))
    hot = checkpoint(keys.where((F.col("n") > 1) & (F.col("n") * (F.col("b") + 64) > most_bytes)).select("hot"))
    n_hot = hot.count()
    if not n_hot:
        return plain.withColumn("copies", F.lit(1).cast("long")).withColumn("hot", F.lit(None).cast("long")), lambda found: found.drop("hot")
    small = (lambda df: F.broadcast(df)) if n_hot <= 1_000_000 else (lambda df: df)
    marked = plain.withColumn("key", spread()).join(small(hot.withColumnRenamed("hot", "key").withColumn("is_hot", F.lit(True))), "key", "left")
    once = marked.where("is_hot").groupBy("doc_id", "text", "key").agg(F.count(F.lit(1)).alias("copies"))
    rows = marked.where("is_hot is null").select("doc_id", "text", F.lit(1).cast("long").alias("copies"), F.lit(None).cast("long").alias("hot"))
    rows = rows.unionByName(once.select("doc_id", "text", "copies", F.col("key").alias("hot")))

    def restore(found: DataFrame) -> DataFrame:
        ids = marked.where("is_hot").select(F.col("doc_id").alias("own"), "key")
        of = checkpoint(found)
        back = ids.join(small(of.where("hot is not null")), (F.col("key") == F.col("hot")) & F.col("own").eqNullSafe(F.col("doc_id")))
        return of.where("hot is null").drop("hot").unionByName(back.drop("own", "key", "hot"))

    return rows, restore


def ranges(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, start, stop) of the buckets that sorted keys fall in."""
    top = (keys >> np.uint64(64 - bits)).astype(np.int64)
    starts = np.flatnonzero(np.diff(top, prepend=-1))
    return list(zip(top[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True)) if len(keys) else []


def requests(chunk: int, keys: np.ndarray, vals: np.ndarray, bits: int, tag: int = 0, drop: int = 0) -> pa.Table:
    """Rows of REQUEST for sorted distinct keys; `tag` sets apart kinds of keys. `drop` low bits of all keys are zero and are not sent."""
    rows = []
    for b, start, stop in ranges(keys, bits):
        part = slice(start, stop)
        rest = keys[part] - (np.uint64(int(b) << (64 - bits)))
        rows.append(((tag << bits) + int(b), chunk, part.stop - part.start, pack_sorted(rest >> np.uint64(drop), 64 - bits - drop), pack_numbers(vals[part])))
    types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    columns = list(zip(*rows, strict=True)) or [()] * 5
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["bucket", "chunk", "n", "keys", "vals"])


def answer(rows: DataFrame, bits: int, combine: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], sums_below: int = 0, drops: tuple[int, ...] = (0, 0)) -> DataFrame:
    """REPLY for REQUEST. combine(starts, sizes, vals) gets the values in key order with the runs of equal keys, and returns a number for each.

    drops: the bits not sent, by tag. A bucket under sums_below adds a row of chunk -1 with the sum of its values (`total`) and its keys whose values' sum is positive."""

    def run(table: pa.Table) -> pa.Table:
        n = table["n"].to_numpy()
        drop = drops[table["bucket"][0].as_py() >> bits]
        keys = np.concatenate([unpack_sorted(k, int(m), 64 - bits - drop) for k, m in zip(table["keys"].to_pylist(), n, strict=True)])
        vals = np.concatenate([unpack_numbers(v, int(m)) for v, m in zip(table["vals"].to_pylist(), n, strict=True)])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        out = np.empty(len(keys), np.int64)
        out[order] = combine(starts, np.diff(np.append(starts, len(keys))), vals[order])
        cuts = np.cumsum(n)[:-1]
        packed = [pack_numbers(x) for x in np.split(out, cuts)]
        chunks, buckets = table["chunk"].to_pylist(), table["bucket"].to_pylist()
        if not sums_below:
            return pa.table([pa.array(chunks, pa.int32()), pa.array(buckets, pa.int32()), pa.array(packed, pa.binary())], ["chunk", "bucket", "vals"])
        total, positive = [None] * len(chunks), [None] * len(chunks)
        if buckets[0] < sums_below:
            each = np.add.reduceat(vals[order], starts)
            chunks, buckets, packed = [*chunks, -1], [*buckets, buckets[0]], [*packed, b""]
            total, positive = [*total, int(each.sum())], [*positive, int((each > 0).sum())]
        types = (pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip((chunks, buckets, packed, total, positive), types, strict=True)], ["chunk", "bucket", "vals", "total", "positive"])

    run.__annotations__ = {"table": pa.Table, "return": pa.Table}
    return rows.groupBy("bucket").applyInArrow(run, REPLY + (", total bigint, positive bigint" if sums_below else ""))


def gathered(replies: pa.Table, keys: np.ndarray, bits: int, tag: int = 0) -> np.ndarray:
    """The answers for a chunk's sorted distinct keys, in their order."""
    out, places = np.zeros(len(keys), np.int64), {b: (start, stop) for b, start, stop in ranges(keys, bits)}
    for b, vals in zip(replies["bucket"].to_pylist(), replies["vals"].to_pylist(), strict=True):
        if b >> bits == tag:
            start, stop = places[b - (tag << bits)]
            out[start:stop] = unpack_numbers(vals, stop - start)
    return out
