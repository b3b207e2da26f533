"""Vectorised tokenising and hashing of whole Arrow text columns with numpy.

Texts stay in the UTF-8 buffer that Arrow delivers; words are byte ranges of it. A range is hashed eight bytes at a time, each block mixed
into a 64-bit state before the next one. A window of words is a Rabin-Karp polynomial of the word hashes modulo the prime 2**61 - 1, built
by doubling, so its cost grows with the logarithm of the width. Among n distinct windows about n^2 / 2^62 pairs collide by chance.
A null text counts as an empty one everywhere.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes that separate words: space and \t \n \v \f \r.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_M = np.uint64
#: Rabin-Karp: the modulus, and a base drawn at random once.
PRIME = (1 << 61) - 1
BASE = 0x1A2B3C4D5E6F7081 % PRIME
_P = _M(PRIME)
_LOW = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
#: Ranges over this many bytes are hashed one by one.
LONG = 4096


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply and shift rounds); a bijection."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(29))


def slices(ids: pa.Array, texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[np.ndarray, bytes, np.ndarray]]:
    """(ids, UTF-8 buffer, document offsets) of runs of documents of about `limit` bytes; a longer document is a run of its own."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = memoryview(texts.buffers()[2]) if texts.buffers()[2] is not None else memoryview(b"")
    ids = np.array(ids.to_pylist(), object) if ids.null_count else ids.to_numpy(zero_copy_only=False)
    at = 0
    while at < len(ids):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield ids[at:to], data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(buf: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the index of each document's first word (one more entry at the end)."""
    n = len(buf)
    inside = np.zeros(n + 1, bool)
    np.logical_not(separator[buf], out=inside[:n])
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begin = inside[:n].copy()
    begin[1:] &= ~inside[: n - 1] | edge[1:n]
    end = inside[:n] & (~inside[1:] | edge[1:])
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def blocks_at(buf: np.ndarray) -> np.ndarray:
    """For each byte, the eight bytes from it on as a number; zeros follow the buffer."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray(len(buf) + 1, "<u8", padded.data, strides=(1,))


def first_bytes(blocks: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first eight bytes of ranges as numbers, zeros beyond their size (which may be negative)."""
    return blocks[np.minimum(at, len(blocks) - 1)] & _LOW[np.clip(size, 0, 8)]


def range_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range."""
    size = ends - starts
    blocks = blocks_at(buf)
    h = mix(size.astype(np.uint64) * _M(0x9E3779B97F4A7C15) ^ first_bytes(blocks, starts, size))
    live, k = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while len(live):
        h[live] = mix((h[live] + _M(0xA24BAED4963EE407)) ^ first_bytes(blocks, starts[live] + k, size[live] - k))
        k += 8
        live = live[size[live] > k]
    for i in np.flatnonzero(size > LONG):
        h[i] = xxhash.xxh3_64_intdigest(buf[starts[i] : ends[i]].tobytes(), 91)
    return h


def same_ranges(buf: np.ndarray, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], blocks: np.ndarray | None = None) -> np.ndarray:
    """Whether ranges (starts, ends) of the buffer hold the same bytes, pair by pair; exact. blocks: of blocks_at(buf), where they are at hand."""
    (a0, a1), (b0, b1) = a, b
    size, blocks = a1 - a0, blocks_at(buf) if blocks is None else blocks
    same = size == b1 - b0
    live, k = np.flatnonzero(same & (size > 0)), 0
    while len(live) and k < 64:
        equal = first_bytes(blocks, a0[live] + k, size[live] - k) == first_bytes(blocks, b0[live] + k, size[live] - k)
        same[live[~equal]] = False
        k += 8
        live = live[equal & (size[live] > k)]
    for i in live:
        same[i] = np.array_equal(buf[a0[i] : a1[i]], buf[b0[i] : b1[i]])
    return same


def _folded(x: np.ndarray) -> np.ndarray:
    """Equal modulo the prime, below 2**61 + 8."""
    return (x & _P) + (x >> _M(61))


def _times(a: np.ndarray, by: int) -> np.ndarray:
    """a * by modulo the prime (not fully reduced), from halves of 31 and 30 bits so that nothing overflows."""
    high, low = _M(by >> 31), _M(by & 0x7FFFFFFF)
    a1, a0 = a >> _M(31), a & _M(0x7FFFFFFF)
    middle = a1 * low + a0 * high
    return _folded(_folded(_M(2) * (a1 * high) + (middle >> _M(30)) + ((middle & _M(0x3FFFFFFF)) << _M(31))) + _folded(a0 * low))


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of each run of `width` consecutive word hashes; entry i starts at word i."""
    if len(h) < width:
        return np.zeros(0, np.uint64)
    part, size, out, done = _folded(h), 1, None, 0
    while True:  # part: polynomials of `size` words; out: of the `done` words that the low bits of the width add up to
        if width & size:
            n = len(h) - done - size + 1
            out = part if out is None else _folded(_times(out[:n], pow(BASE, size, PRIME)) + part[done : done + n])
            done += size
        if done == width:
            break
        n = len(part) - size
        part, size = _folded(_times(part[:n], pow(BASE, size, PRIME)) + part[size : size + n]), 2 * size
    out = np.where(out >= _P, out - _P, out)
    return mix(np.where(out >= _P, out - _P, out) + _M(0x632BE59BD9B4E019))


def window_starts(first: np.ndarray, width: int) -> np.ndarray:
    """Word indexes at which a window of `width` words lies in one document."""
    keep = np.ones(int(first[-1]), bool)
    for k in range(1, width):
        at = first[1:] - k
        keep[at[at >= first[:-1]]] = False
    return np.flatnonzero(keep)


def owner(first: np.ndarray) -> np.ndarray:
    """For each word, the index of its document."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def per_document(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of a value per word over each document."""
    sums = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return sums[first[1:]] - sums[first[:-1]]


def fold(doc_ids: np.ndarray, of: int) -> np.ndarray:
    """crc32 of each id as text, modulo `of`; a null id falls in fold of the empty text."""
    return np.array([zlib.crc32(b"" if i is None or i != i else str(int(i)).encode()) % of for i in doc_ids], np.int64)


def map_documents(docs, per_slice, schema: str, limit: int = 1 << 20):
    """mapInArrow over (doc_id, text): `per_slice(ids, data, offsets)` returns the columns of one run of documents.

    Needs no shuffle; memory is bounded by one Arrow batch and one run (or the longest document)."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    from .shared import small_batches

    small_batches(docs.sparkSession)
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            for ids, data, offsets in slices(batch.column(0), batch.column(1), limit):
                columns = per_slice(ids, data, offsets)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type, from_pandas=f.name == "doc_id") for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def plain_ids(ids: np.ndarray) -> list:
    """Ids as Python integers, None for null (a null makes numpy hold the column as floats or objects)."""
    if ids.dtype.kind == "i":
        return ids.tolist()
    return [None if i is None or i != i else int(i) for i in ids]
