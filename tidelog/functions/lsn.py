"""Log sequence numbers, times and names, as columns; small parameters, as Python helpers."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def lsn_decimal(lsn: Column) -> Column:
    """file * 2^48 + block * 2^16 + slot of a text of three hex parts; null for another shape."""
    parts = F.split(lsn, ":")
    part = lambda i: F.conv(F.element_at(parts, i), 16, 10).cast("decimal(20,0)")
    value = part(1) * F.lit(1 << 48).cast("decimal(20,0)") + part(2) * F.lit(1 << 16).cast("decimal(20,0)") + part(3)
    return F.when(lsn.rlike("^[0-9a-fA-F]+:[0-9a-fA-F]+:[0-9a-fA-F]+$"), value.cast("decimal(25,0)"))


def lsn_short(lsn: Column) -> Column:
    """The first two parts without leading zeros; ? for an empty one."""
    strip = lambda c: F.when(F.ltrim(c, F.lit("0")) == "", "0").otherwise(F.ltrim(c, F.lit("0")))
    parts = F.split(lsn, ":")
    return F.when(F.coalesce(lsn, F.lit("")) == "", "?").when(F.size(parts) < 2, lsn).otherwise(F.concat_ws(":", strip(parts[0]), strip(parts[1])))


def log_time(text: Column, zone: str = "UTC") -> Column:
    """YYYY/MM/DD HH:MM:SS:mmm in the agent's zone -> UTC timestamp; without or with bad milliseconds the seconds; else null."""
    whole = F.try_to_timestamp(F.substring(text, 1, 19), F.lit("yyyy/MM/dd HH:mm:ss"))
    fine = F.try_to_timestamp(F.concat(F.substring(text, 1, 19), F.lit("."), F.substring(text, 21, 3)), F.lit("yyyy/MM/dd HH:mm:ss.SSS"))
    return F.to_utc_timestamp(F.coalesce(F.when((F.length(text) == 23) & (F.substring(text, 20, 1) == ":"), fine), whole), zone)


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def operation_of(op: Column) -> Column:
    return F.when(op == "LOP_INSERT_ROWS", "INSERT").when(op == "LOP_DELETE_ROWS", "DELETE").when(op.isin("LOP_MODIFY_ROW", "LOP_MODIFY_COLUMNS"), "UPDATE")


def split_table(name: Column) -> tuple[Column, Column]:
    """(schema, table) of a name with or without brackets; dbo without a schema."""
    plain = F.regexp_replace(name, r"[\[\]]", "")
    dot = F.instr(plain, ".")
    return F.when(dot > 0, F.substring_index(plain, ".", 1)).otherwise(F.lit("dbo")), F.when(dot > 0, plain.substr(dot + 1, F.length(plain))).otherwise(plain)


def canonical_decimal(text: Column) -> Column:
    """Without trailing zeros and dot, if there is a dot."""
    return F.when(F.instr(text, ".") > 0, F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def key_probe(log2: Column) -> Column:
    """Hex of the key in the second log row: by its first byte, without head and tail bytes."""
    h, n = F.hex(log2), F.length(log2)
    return F.when((F.substring(h, 1, 2) == "16") & (n > 5), h.substr(F.lit(3), 2 * (n - 5))).when((F.substring(h, 1, 2) == "36") & (n > 8), h.substr(F.lit(17), 2 * (n - 8))).otherwise("")


#: Units of durations, in seconds.
UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "μs": 1e-6, "ms": 1e-3, "s": 1, "m": 60, "h": 3600}
_PART = re.compile(r"(\d+\.?\d*|\.\d+)(ns|us|µs|μs|ms|s|m|h)")


def duration(text: str) -> timedelta:
    """A sum of numbers with units, in any order, with a sign or none: 1h30m, 500ms, 1m1h, -1.5h; 0 needs no unit."""
    sign, rest = (-1 if text[:1] == "-" else 1), text.removeprefix("-") if text[:1] == "-" else text.removeprefix("+")
    if rest == "0":
        return timedelta()
    if not rest or _PART.sub("", rest):
        raise ValueError(f"not a duration: {text!r}")
    return sign * timedelta(seconds=sum(float(n) * UNITS[u] for n, u in _PART.findall(rest)))


def parse_since(text: str, now: datetime | None = None) -> datetime | None:
    """'' and all: no bound; now; <n>d; or a duration. Anything else is an error."""
    now, text = now or datetime.now(UTC), text.strip().lower()
    if text in ("", "all"):
        return None
    if text == "now":
        return now
    if text.endswith("d"):
        if re.fullmatch(r"\+?\d+d", text) and int(text[:-1]) > 0:
            return now - timedelta(days=int(text[:-1]))
        raise ValueError(f"not a time window: {text!r}")
    return now - duration(text)


def includes_history(text: str) -> bool:
    return text.strip().lower() != "now"


def positive(text, default: int) -> int:
    """A whole number over zero, or the default."""
    try:
        return n if (n := int(text)) > 0 else default
    except (TypeError, ValueError):
        return default
