"""T-SQL statements of row changes, forward and inverse, from decoded values (arrays of literals in the order of a table's columns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.rows import IMAGE, NTEXT, RANGES, ROWVERSION, TEXT, XML, TableSpec


def _lit(text: str) -> Column:
    return F.lit(text)


def _value(vals: Column, i: int) -> Column:
    return F.coalesce(vals[i], _lit("NULL"))


def where_clause(spec: TableSpec, vals: Column, assign: str = " = ", skip_large: bool = False) -> Column:
    """Key columns, else all of them (skip_large: without large objects and row versions), in column order."""
    large = {TEXT, NTEXT, IMAGE, XML, ROWVERSION}
    chosen = [i for i, c in enumerate(spec.columns) if c.id in spec.key] or [i for i, c in enumerate(spec.columns) if not skip_large or (c.type not in large and c.length >= 0)]
    parts = [F.when(vals[i].isNull(), _lit(f"[{spec.columns[i].name}] IS NULL")).otherwise(F.concat(_lit(f"[{spec.columns[i].name}]{assign}"), vals[i])) for i in chosen]
    return F.concat_ws(" AND ", *parts)


def insert_sql(spec: TableSpec, vals: Column) -> Column:
    names = ", ".join(f"[{c.name}]" for c in spec.columns)
    return F.concat(_lit(f"INSERT INTO {spec.full_name} ({names}) VALUES ("), F.concat_ws(", ", *[_value(vals, i) for i in range(len(spec.columns))]), _lit(");"))


def delete_sql(spec: TableSpec, vals: Column) -> Column:
    return F.concat(_lit(f"DELETE FROM {spec.full_name} WHERE "), where_clause(spec, vals), _lit(";"))


def changed_set(spec: TableSpec, before: Column, after: Column, assign: str = " = ", sep: str = ", ") -> Column:
    """SET list of the columns whose printed values differ; row versions never do."""
    parts = [F.when(~before[i].eqNullSafe(after[i]), F.concat(_lit(f"[{c.name}]{assign}"), _value(after, i))) for i, c in enumerate(spec.columns) if c.type != ROWVERSION]
    return F.concat_ws(sep, *parts)


def update_sql(spec: TableSpec, before: Column, after: Column) -> tuple[Column, Column]:
    """(forward, inverse) of a full before and after image; a comment in both when nothing changed."""
    there, back = changed_set(spec, before, after), changed_set(spec, after, before)
    none = _lit(f"-- no decoded column of {spec.full_name} changed")
    make = lambda s, v: F.when(there == "", none).otherwise(F.concat(_lit(f"UPDATE {spec.full_name} SET "), s, _lit(" WHERE "), where_clause(spec, v), _lit(";")))
    return make(there, before), make(back, after)


def redo_undo(spec: TableSpec, before: Column, after: Column) -> tuple[Column, Column]:
    """One-row updates: redo finds the old key, undo the new one; null when nothing changed."""
    make = lambda a, b: F.concat(_lit(f"update top(1) {spec.full_name} set "), changed_set(spec, a, b, "=", ","), _lit(" where "), where_clause(spec, a, "=", True), _lit(";"))
    same = changed_set(spec, before, after) == ""
    return F.when(~same, make(before, after)), F.when(~same, make(after, before))


def diff(spec: TableSpec, before: Column, after: Column) -> Column:
    """array<struct<column, before, after>> of the columns that changed."""
    items = [F.when(~before[i].eqNullSafe(after[i]), F.struct(_lit(c.name).alias("column"), before[i].alias("before"), after[i].alias("after"))) for i, c in enumerate(spec.columns) if c.type != ROWVERSION]
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def invalid_key(spec: TableSpec, vals: Column) -> Column:
    """Why the key cannot be right (a null in a column without nulls, or out of its type's range); null if it can."""
    out = F.lit(None).cast("string")
    for i, c in reversed(list(enumerate(spec.columns))):
        if c.id in spec.key:
            if c.type in RANGES:
                low, high = RANGES[c.type]
                out = F.when(~F.try_cast(vals[i], "bigint").between(low, high), _lit(f"{c.name} is out of range")).otherwise(out) if hasattr(F, "try_cast") else F.when(~vals[i].cast("bigint").between(low, high), _lit(f"{c.name} is out of range")).otherwise(out)
            if not c.nullable:
                out = F.when(vals[i].isNull(), _lit(f"{c.name} is NULL")).otherwise(out)
    return out


def generated(spec: TableSpec, operation: Column, before: Column, after: Column) -> dict[str, Column]:
    """sql_stmt, rollback_sql, status, confidence of a change. before and after are structs (err, vals) of `rows.decode`; an INSERT has only after,
    a DELETE only before. Rows that cannot be decoded give comments and a status, never statements."""
    err = F.when(operation == "INSERT", after["err"]).when(operation == "DELETE", before["err"]).otherwise(F.coalesce(before["err"], after["err"]))
    status = F.when(err == "compressed_row", "compressed_row_parse_failed").when(err == "schema_mismatch", "schema_mismatch").when(err == "off_row_lob", "off_row_lob_not_supported").when(err.isNotNull(), "decode_error")
    bad_key = F.when(operation == "DELETE", invalid_key(spec, before["vals"]))
    there, back = update_sql(spec, before["vals"], after["vals"])
    forward = F.when(operation == "INSERT", insert_sql(spec, after["vals"])).when(operation == "DELETE", delete_sql(spec, before["vals"])).otherwise(there)
    inverse = F.when(operation == "INSERT", delete_sql(spec, after["vals"])).when(operation == "DELETE", insert_sql(spec, before["vals"])).otherwise(back)
    note = F.concat(_lit(f"-- {spec.full_name}: "), status)
    return {
        "sql_stmt": F.when(err.isNotNull(), note).when(bad_key.isNotNull(), F.concat(_lit("-- compressed_key_decode_invalid: "), bad_key)).otherwise(forward),
        "rollback_sql": F.when(err.isNotNull(), note).otherwise(inverse),
        "status": F.coalesce(status, F.when(bad_key.isNotNull(), "compressed_key_decode_invalid")),
        "confidence": F.when(err.isNotNull() | bad_key.isNotNull(), "low").when(F.lit(bool(spec.key)), "high").otherwise("medium"),
    }
