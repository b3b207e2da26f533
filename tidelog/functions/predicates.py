"""Predicates on log records and events, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S


def is_data_op(op: Column) -> Column:
    return op.isin(*S.DATA_OPS)


def is_base_row(context: Column) -> Column:
    """Rows of the table itself, not of its other indexes."""
    return context.isin(*S.BASE_CONTEXTS)


def is_internal_transaction(name: Column) -> Column:
    trimmed = F.trim(name)
    return F.coalesce(trimmed.isin(*S.INTERNAL_TRANSACTIONS) | trimmed.startswith(S.BACKUP_PREFIX), F.lit(False))


def is_cleanup_delete(op: Column, contents: Column) -> Column:
    """A physical clean-up of 15 bytes: a marker 07 or 4E, then eight zero bytes; it is no row image."""
    head = F.hex(F.substring(contents, 1, 9))
    return F.coalesce((op == S.DELETE) & (F.length(contents) == 15) & head.isin("07" + "0" * 16, "4E" + "0" * 16), F.lit(False))


def is_executable(sql: Column) -> Column:
    trimmed = F.trim(sql)
    return F.coalesce((trimmed != "") & ~trimmed.startswith("--"), F.lit(False))


def is_tombstone(operation: Column, status: Column, row_hex: Column) -> Column:
    """A stored clean-up delete that could not be parsed."""
    return F.coalesce((operation == "DELETE") & (status == "compressed_row_parse_failed") & (F.length(row_hex) == 30) & F.lower(F.substring(row_hex, 1, 2)).isin("07", "4e"), F.lit(False))


def is_url_device(path: Column) -> Column:
    return F.lower(F.trim(path)).rlike("^(s3|https?)://")


def is_other_index(alloc_unit_name: Column, base_index: Column) -> Column:
    """A three-part name whose index is known and not the table's own."""
    parts = F.split(alloc_unit_name, r"\.", 3)
    return F.coalesce((F.size(parts) == 3) & (base_index != "") & (F.lower(F.element_at(parts, -1)) != F.lower(base_index)), F.lit(False))
