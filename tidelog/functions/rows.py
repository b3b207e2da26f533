"""Row images as columns: the uncompressed row format, read by Arrow batches and written by SQL expressions.

A TableSpec gives the layout; `encode_sql` builds an image from plain columns, `decode` adds
struct<err string, vals array<string>>: for each column its T-SQL literal, or null. Layout: 4 header bytes (the last two: end of the fixed part),
fixed columns, column count, null bitmap, count of variable columns and their end offsets (bit 15: stored off the row), their data.
Reading bytes as numbers has no compiled expression in Spark SQL (hex text and conv, within interpreted lambdas, took 12 times as long), so
decoding is one Arrow function over the binary column.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import values
from .types import *  # noqa: F403
from .types import CHAR, DATETIME2, DECIMAL, INTEGERS, MONEY, NTEXT, NUMERIC, NVARCHAR, BIT, TableSpec, fixed_size

DECODED = "struct<err:string,vals:array<string>>"


def arrow_function(fn: Callable, kind: str) -> Callable[..., Column]:
    """fn(pa.Array, ...) -> pa.Array as a scalar Arrow function."""
    fn.__annotations__ = dict.fromkeys(fn.__code__.co_varnames[: fn.__code__.co_argcount], pa.Array) | {"return": pa.Array}
    return F.arrow_udf(fn, kind)


def decoded(err: list, vals: pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(err, pa.string()), vals], ["err", "vals"])


def decode(df: DataFrame, spec: TableSpec, image: str, out: str) -> DataFrame:
    """df with struct<err string, vals array<string>> of the column `image`; vals is null after an error."""

    def run(images):
        return decoded(*values.decode_images(spec, images))

    return df.withColumn(out, arrow_function(run, DECODED)(F.col(image)))


def by_name(spec: TableSpec, vals: Column) -> Column:
    """map<string, string> of column names and literals; null for no values."""
    return F.map_from_arrays(F.array(*[F.lit(c.name) for c in spec.columns]), vals)


# ---- writing, as SQL text: b is a binary expression, at a 1-based position ----------------------------------------------------------


def _let(value: str, name: str, body: str) -> str:
    """body with `name` standing for value, which is worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _le(b: str, at: str, n: int, kind: str = "bigint") -> str:
    """Unsigned little-endian number of n bytes."""
    if n == 1:
        return f"cast(conv(hex(substring({b}, {at}, 1)), 16, 10) as {kind})"
    parts = ", ".join(f"substring(h_, {2 * k + 1}, 2)" for k in reversed(range(n)))
    return _let(f"hex(substring({b}, {at}, {n}))", "h_", f"cast(conv(concat({parts}), 16, 10) as {kind})")


def _bytes(value: str, n: int) -> str:
    """n little-endian bytes of an integer expression (two's complement)."""
    parts = ", ".join(f"substring(x_, {2 * k + 1}, 2)" for k in reversed(range(n)))
    return _let(f"lpad(right(hex(cast({value} as bigint)), {2 * n}), {2 * n}, '0')", "x_", f"unhex(concat({parts}))")


def encode_sql(spec: TableSpec, values: dict[str, str], nulls: dict[str, str] | None = None, stored: int | None = None) -> str:
    """The image of a row, from SQL expressions by column name: integers and floats as such, texts as strings, datetime2 as timestamps.

    `nulls` has conditions for null columns; `stored` keeps only the first columns, as rows do that are older than the table."""
    nulls, n = nulls or {}, stored or len(spec.columns)
    kept = spec.columns[:n]
    fixed, var = [], []
    bits: dict[int, list[str]] = {}
    for c in kept:
        place, x = spec.places[c.id], values[c.name]
        if place[0] == "bit":
            bits.setdefault(place[1], []).append(f"cast({x} as int) * {1 << place[2]}")
    written = set()
    for c in kept:
        place, x = spec.places[c.id], values[c.name]
        if place[0] == "bit":
            if place[1] not in written:
                written.add(place[1])
                fixed.append(_bytes(" + ".join(bits[place[1]]), 1))
        elif place[0] == "fix":
            if c.type in INTEGERS:
                fixed.append(_bytes(f"coalesce({x}, 0)", place[2]))
            elif c.type == DATETIME2:
                n_time = place[2] - 3
                micros = f"(unix_micros(cast({x} as timestamp)))"
                fixed.append(f"concat({_bytes(f'pmod({micros}, 86400000000) div {10 ** (6 - c.scale)}', n_time)}, {_bytes(f'floor({micros} / 86400000000) + 719162', 3)})")
            elif c.type == CHAR:
                fixed.append(f"cast(rpad({x}, {place[2]}, ' ') as binary)")
            elif c.type in (DECIMAL, NUMERIC):
                m = f"cast(abs({x}) * {10**c.scale}BD as decimal(38,0))"
                fixed.append(f"concat(if({x} < 0, X'00', X'01'), {_bytes(f'cast({m} as bigint)', min(place[2] - 1, 8))}{', X' + repr('00' * (place[2] - 9)) if place[2] > 9 else ''})")
            elif c.type == MONEY:
                u = f"cast(round({x} * 10000) as bigint)"
                fixed.append(f"concat({_bytes(f'shiftright({u}, 32)', 4)}, {_bytes(f'({u} & 4294967295)', 4)})")
            else:
                fixed.append(f"cast({x} as binary)")  # given as bytes, floats among them
        else:
            null = nulls.get(c.name, "false")
            text = f"encode({x}, 'UTF-16LE')" if c.type in (NVARCHAR, NTEXT) else f"cast({x} as binary)"
            var.append(f"if({null} or {x} is null, X'', {text})")
    size = sum(fixed_size(c) if c.type != BIT else 0 for c in kept if not c.variable) + len(written)
    bitmap = []
    for k in range((n + 7) // 8):
        bitmap.append(_bytes(" + ".join(f"if({nulls.get(c.name, 'false')}, {1 << i}, 0)" for i, c in enumerate(kept[8 * k : 8 * k + 8])), 1))
    base = 4 + size + 2 + len(bitmap) + 2 + 2 * len(var)
    ends = [_bytes(f"({base} + " + " + ".join(f"length({v})" for v in var[: k + 1]) + ")", 2) for k in range(len(var))]
    parts = ["X'3000'", _bytes(str(4 + size), 2), *fixed, _bytes(str(n), 2), *bitmap] + ([_bytes(str(len(var)), 2), *ends, *var] if var else [])
    return "concat(" + ", ".join(parts) + ")"
