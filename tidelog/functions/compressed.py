"""Row- and page-compressed images: each column's bytes are brought into the uncompressed form and printed as usual.

Layout: a header byte pair, a descriptor of four bits per physical column (low half first), short values in line (descriptor d in 2..9: d - 1
bytes), then long values (descriptor 10) behind a table of big-endian end offsets. Descriptor 0 is NULL, 1 zero or empty, 11 a set bit,
12 and 13 refer to the page's dictionary, which a log row does not hold: such rows give an error, never values.
A row is cut into columns by its descriptors; the columns of a batch are then printed together."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rows as R
from . import values

DAY_LIKE = (R.DATE, R.TIME, R.DATETIME2, R.DATETIMEOFFSET)
INT_LIKE = {R.SMALLINT: 2, R.INT: 4, R.BIGINT: 8, R.SMALLMONEY: 4, R.MONEY: 8, R.SMALLDATETIME: 4, R.DATETIME: 8}
ZERO, BIT_SET, LONG = 1, 11, 10


def expand_unicode(data: bytes) -> bytes:
    """UTF-16LE bytes of the compressed Unicode form."""
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        c, left = data[i], n - i - 1
        if c == 0x10 and not left:
            break
        if left and c and data[i + 1] == 0:
            out += bytes((c, 0))
            i += 2
        elif c == 0x0E:
            if left < 2:
                raise ValueError("cut marker")
            out += bytes((data[i + 2], data[i + 1]))
            i += 3
        elif left and 1 <= c <= 0x0D and data[i + 1] >= 0x80:
            out += bytes((data[i + 1] ^ 0xC0, c - 1))
            i += 2
        else:
            out += bytes((c, 0))
            i += 1
    return bytes(out)


def split(image: bytes | None, n: int) -> tuple[str | None, list[int], list[bytes | None]]:
    """(error, descriptors, bytes of each of n physical columns)."""
    start = 2 + (n + 1) // 2
    if image is None or len(image) < start:
        return "truncated", [], []
    if image[0] & 0x30 not in (0x20, 0x30):
        return "not_compressed", [], []
    kinds = [image[2 + i // 2] >> 4 * (i % 2) & 15 for i in range(n)]
    if 12 in kinds or 13 in kinds:
        return "page_dictionary", [], []
    at, out = start, []
    for k in kinds:
        size = k - 1 if 2 <= k <= 9 else 0
        out.append(image[at : at + size] if size else b"" if k in (ZERO, BIT_SET) else None)
        at += size
    if at > len(image):
        return "parse_failed", [], []
    long = [i for i, k in enumerate(kinds) if k == LONG]
    data, last = at + 3 + 2 * len(long), 0
    for j, i in enumerate(long):
        end = int.from_bytes(image[at + 2 + 2 * j : at + 4 + 2 * j], "big") & 0x7FFF
        if data > len(image) or end < last or data + end > len(image):
            return "tail_parse_failed", [], []
        out[i], last = image[data + last : data + end], end
    return None, kinds, out


def vardecimal(v: bytes, scale: int) -> str:
    """Sign bit and excess-64 exponent, then digits in groups of ten bits for three of them; cut or padded to the scale."""
    zero = "0" + ("." + "0" * scale if scale else "")
    if not v:
        return zero
    bits = "".join(f"{b:08b}" for b in v[1:])
    digits = "".join(f"{int(bits[k : k + 10].ljust(10, '0'), 2):03d}" for k in range(0, len(bits), 10)).lstrip("0")
    if not digits:
        return zero
    exponent = (v[0] & 127) - 63
    digits = "0" * (1 - exponent) + digits if exponent <= 0 else digits.ljust(exponent, "0")
    cut = max(1, exponent)
    text = digits[:cut] + ("." + digits[cut : cut + scale].ljust(scale, "0") if scale else "")
    return text if v[0] >= 128 or text == zero else "-" + text


def _whole(v: bytes, n: int) -> bytes | None:
    """n little-endian bytes of a big-endian number of up to n bytes with its sign bit inverted."""
    if not v:
        return b"\0" * n
    if len(v) > n:
        return None
    value = int.from_bytes(bytes((v[0] ^ 128,)) + v[1:], "big", signed=True)
    return value.to_bytes(n, "little", signed=True)


def column_literals(c: R.ColumnSpec, kinds: list[int], pieces: list[bytes | None]) -> pa.Array:
    """Literals of one column from its descriptors and bytes, row by row."""
    each = lambda f: [None if v is None else f(v) for v in pieces]
    if c.type == R.BIT:
        return pa.array([None if v is None else "1" if k == BIT_SET else "0" for k, v in zip(kinds, pieces, strict=True)], pa.string())
    if c.type == R.SQL_VARIANT:
        return pa.nulls(len(pieces), pa.string())
    if c.type in (R.DECIMAL, R.NUMERIC):
        return pa.array(each(lambda v: vardecimal(v, c.scale)), pa.string())
    if c.type == R.TINYINT:
        raw = each(lambda v: v[:1] or b"\0")
    elif c.type == R.MONEY:  # in one piece here, with the high half first in the plain form
        raw = each(lambda v: (w := _whole(v, 8)) and w[4:] + w[:4])
    elif c.type in INT_LIKE:
        raw = each(lambda v: _whole(v, INT_LIKE[c.type]))
    elif c.type in (R.REAL, R.FLOAT):
        raw = each(lambda v: v.rjust(R.fixed_size(c), b"\0") if len(v) <= R.fixed_size(c) else None)
    elif c.type in DAY_LIKE:
        raw = each(lambda v: v.ljust(R.fixed_size(c), b"\0"))
    elif c.type == R.BINARY:
        raw = each(lambda v: v.ljust(c.length, b"\0"))
    elif c.type in (R.NCHAR, R.NVARCHAR, R.NTEXT):

        def text(v):
            try:
                return expand_unicode(v).decode("utf-16-le", "replace").rstrip(" \0").encode("utf-16-le") if c.type == R.NCHAR or v[:1] != b"\0" else None
            except ValueError:
                return None

        raw = each(text)
    elif c.type in (R.VARCHAR, R.TEXT):
        raw = each(lambda v: None if v[:1] == b"\0" else v)
    else:
        raw = pieces
    return values.of_bytes(c, raw)


def decode_told(spec: R.TableSpec, column: pa.Array) -> tuple[list, pa.Array, list[list[str]]]:
    """(error or None of each row, array<string> of literals, names of the columns whose bytes gave no value and are NULL in the literals); the layout is
    that of the physical columns, the result that of the columns."""
    physical = spec.physical or spec.columns
    rows = [split(image, len(physical)) for image in column.to_pylist()]
    err, out, lost = [r[0] for r in rows], [], [[] for _ in rows]
    where = {c.id: i for i, c in enumerate(physical) if not c.dropped}
    for c in spec.columns:
        i = where.get(c.id)
        if i is None:
            out.append(pa.nulls(len(rows), pa.string()))
            continue
        pieces = [r[2][i] if r[0] is None else None for r in rows]
        made = column_literals(c, [r[1][i] if r[0] is None else 0 for r in rows], pieces)
        for k in np.flatnonzero(made.is_null().to_numpy(zero_copy_only=False)):
            if pieces[k] is not None:
                lost[k].append(c.name)
        out.append(made)
    return err, values.interleaved(out, np.array([e is not None for e in err], bool)), lost


def decode_images(spec: R.TableSpec, column: pa.Array) -> tuple[list, pa.Array]:
    """(error or None of each row, array<string> of literals), as `decode_told` has them."""
    return decode_told(spec, column)[:2]


def decode(df: DataFrame, spec: R.TableSpec, image: str, out: str) -> DataFrame:
    """df with struct<err, vals>; vals is null after an error."""

    def run(images):
        return R.decoded(*decode_images(spec, images))

    return df.withColumn(out, R.arrow_function(run, R.DECODED)(F.col(image)))
