"""Structured analysis of updates: images, diff, redo and undo with a status and a confidence, one row per update record.

`analyze` is for one table, as expressions over its columns; `analyze_many` for a stream of records of all tables of a catalog, with row images from pages for what the fold
could not tell."""

from __future__ import annotations

import json
from datetime import datetime, timedelta
from decimal import Decimal

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import rows
from ..functions import types as T
from ..sources.catalog import Catalog
from . import generate, images, statements

#: What an analysis can end in.
STATUSES = (
    "ok", "mr1_not_found", "patch_not_found", "ambiguous_patch_location", "variable_length_patch_required", "decode_failed", "where_not_buildable", "unsupported_modify_columns_format", "no_changed_columns",
)
_FROM_FOLD = {
    "no_image": "mr1_not_found", "no_offset": "patch_not_found", "not_verified": "patch_not_found", "not_found": "patch_not_found", "ambiguous": "ambiguous_patch_location", "length_change": "variable_length_patch_required",
    "columns_not_decoded": "unsupported_modify_columns_format",
}


def analyze(folded: DataFrame, spec: rows.TableSpec) -> DataFrame:
    """Updates with before_image, after_image and fold_path (of images.fold) -> status, confidence, strategy, changed, before_json, after_json, redo, undo as further columns.

    Confidence: high with a key, medium by the full row, low for anything that is not ok."""
    d = rows.decode(rows.decode(folded, spec, "before_image", "_b"), spec, "after_image", "_a")
    b, a = F.col("_b.vals"), F.col("_a.vals")
    status = F.lit(None).cast("string")
    for path, name in _FROM_FOLD.items():
        status = F.when(F.col("fold_path") == path, name).otherwise(status)
    status = F.coalesce(status, F.when(F.col("_b.err").isNotNull() | F.col("_a.err").isNotNull(), "decode_failed"))
    d = d.withColumn("changed", F.when(status.isNull(), statements.diff(spec, b, a)))
    findable = bool(_where_columns(spec)[0])
    d = d.withColumn("status", F.coalesce(status, F.when(F.size("changed") == 0, "no_changed_columns"), F.lit("ok" if findable else "where_not_buildable")))
    for name, vals in (("before_json", b), ("after_json", a)):
        d = d.withColumn(name, F.to_json(rows.by_name(spec, vals), {"ignoreNullFields": "false"}))
    redo, undo = statements.redo_undo(spec, b, a)
    good = F.col("status") == "ok"
    strategy = "primary_key" if spec.key else "full_row"
    return (
        d.withColumn("redo", F.when(good, redo)).withColumn("undo", F.when(good, undo)).withColumn("strategy", F.when(good, strategy))
        .withColumn("confidence", F.when(~good, "low").otherwise("high" if spec.key else "medium")).drop("_b", "_a")
    )


# ---- records of many tables -----------------------------------------------------------------------------------------------------------

_LARGE = (T.TEXT, T.NTEXT, T.IMAGE, T.XML)
_NUMBERS, _FLOATS = (T.DECIMAL, T.NUMERIC, T.MONEY, T.SMALLMONEY), (T.REAL, T.FLOAT)


def _where_columns(spec: rows.TableSpec) -> tuple[list[int], str]:
    """Places of the columns that find a row: the key, else all but row versions and large objects."""
    key = [i for i, c in enumerate(spec.columns) if c.id in spec.key]
    return (key, "primary_key") if key else ([i for i, c in enumerate(spec.columns) if c.type != T.ROWVERSION and c.type not in _LARGE and c.length >= 0], "full_row")


def same_value(kind: int, a: str | None, b: str | None) -> bool:
    """Whether two printed values of a type are one value: 1.50 and 1.5, a moment in two time zones."""
    if a is None or b is None or a == b:
        return a is None and b is None or a == b
    try:
        if kind in _NUMBERS:
            return Decimal(a) == Decimal(b)
        if kind in _FLOATS:
            return float(a) == float(b)
        if kind == T.DATETIMEOFFSET:
            return _moment(a) == _moment(b)
    except (ArithmeticError, ValueError):
        return False
    return False


def _moment(text: str) -> tuple[datetime, str]:
    """The whole second in UTC, and the fraction, of 'YYYY-MM-DD hh:mm:ss.fffffff +hh:mm'."""
    at, zone = text.strip("'").rsplit(" ", 1)
    whole, _, part = at.partition(".")
    minutes = int(zone[1:3]) * 60 + int(zone[4:6])
    return datetime.strptime(whole, "%Y-%m-%d %H:%M:%S") - timedelta(minutes=-minutes if zone[0] == "-" else minutes), part.rstrip("0")


def diff_values(spec: rows.TableSpec, before: list, after: list) -> list[int]:
    """Places of the columns whose values differ; row versions are left out."""
    return [i for i, c in enumerate(spec.columns) if c.type != T.ROWVERSION and not same_value(c.type, before[i], after[i])]


def _update(spec: rows.TableSpec, there: list, back: list, changed: list[int], where: list[int]) -> str:
    names = [c.name for c in spec.columns]
    sets = ",".join(f"[{names[i]}]={'NULL' if there[i] is None else there[i]}" for i in changed)
    found = " AND ".join(f"[{names[i]}] IS NULL" if back[i] is None else f"[{names[i]}]={back[i]}" for i in where)
    return f"update top(1) {spec.full_name} set {sets} where {found};"


FOUND = "struct<status:string,source:string,before:binary,after:binary>"
ANALYSIS = "struct<status:string,confidence:string,strategy:string,changed:array<struct<column:string,type:string,before:string,after:string>>,before_json:string,after_json:string,redo:string,undo:string>"


def update_images(operation: pa.Array, new: pa.Array, old: pa.Array, before: pa.Array, after: pa.Array, path: pa.Array, page: pa.Array) -> pa.Array:
    """FOUND: both images of an update: of the fold, else from the row's current image on its page, in which the new bytes must stand once."""
    status, source, b, a = [], [], [], []
    for op, n, o, x, y, how, image in zip(*(c.to_pylist() for c in (operation, new, old, before, after, path, page)), strict=True):
        if x is not None and y is not None:
            row = (None, "cache", x, y)
        elif image is None:
            row = (_FROM_FOLD.get(how, "mr1_not_found"), "none", None, None)
        else:
            back, why = images.reverse_patch(image, n or b"", o or b"") if n else (None, "not_found")
            # Where the place is the question, the length is no matter yet.
            if why == "length_change":
                why = "not_found" if image.count(n) == 0 else "ambiguous" if image.find(n, image.find(n) + 1) >= 0 else why
            row = (None, "page_reader", back, image) if why == "ok" else ("unsupported_modify_columns_format" if op == S.MODIFY_COLUMNS else _FROM_FOLD[why], "page_reader", None, image)
        for column, v in zip((status, source, b, a), row, strict=True):
            column.append(v)
    return pa.StructArray.from_arrays([pa.array(status, pa.string()), pa.array(source, pa.string()), pa.array(b, pa.binary()), pa.array(a, pa.binary())], ["status", "source", "before", "after"])


def analyses(catalog: Catalog):
    """Function of Arrow arrays (object_id, status so far, values before, values after; both of generate.image_reader) -> ANALYSIS."""
    specs = catalog.specs

    def one(table, status, before, after):
        spec, blank = specs.get(table), (None, [], None, None, None, None)
        if status is None and (spec is None or before is None or after is None or before["status"] or after["status"] or before["vals"] is None or after["vals"] is None):
            status = "decode_failed"
        if status is not None:
            return (status, "low", *blank)
        b, a = before["vals"], after["vals"]
        changed = diff_values(spec, b, a)
        text = lambda v: json.dumps(dict(zip([c.name for c in spec.columns], v, strict=True)), ensure_ascii=False)
        told = [{"column": spec.columns[i].name, "type": T.type_name(spec.columns[i]), "before": b[i], "after": a[i]} for i in changed]
        where, strategy = _where_columns(spec)
        if not changed or not where:
            return ("where_not_buildable" if changed else "no_changed_columns", "low", None, told, text(b), text(a), None, None)
        return ("ok", "high" if strategy == "primary_key" else "medium", strategy, told, text(b), text(a), _update(spec, a, b, changed, where), _update(spec, b, a, changed, where))

    def run(object_id, status, before, after):
        made = [one(*x) for x in zip(*(c.to_pylist() for c in (object_id, status, before, after)), strict=True)]
        names = ("status", "confidence", "strategy", "changed", "before_json", "after_json", "redo", "undo")
        change = pa.list_(pa.struct([(n, pa.string()) for n in ("column", "type", "before", "after")]))
        columns = list(zip(*made, strict=True)) or [()] * len(names)
        return pa.StructArray.from_arrays([pa.array(c, change if n == "changed" else pa.string()) for n, c in zip(names, columns, strict=True)], list(names))

    return run


def update_reader(catalog: Catalog):
    """Arrow function (object_id, partition_id, compression, and the arguments of update_images) -> struct<found: FOUND, told: ANALYSIS>. Images, their values
    and what is told of them are worked out in one pass, so that values do not go back and forth between Python and the JVM."""
    read, tell = generate.image_reader(catalog), analyses(generate._light(catalog))

    def run(object_id, partition_id, compression, operation, new, old, before, after, path, page):
        found = update_images(operation, new, old, before, after, path, page)
        status = found.field("status")
        value = lambda c: read(object_id, partition_id, compression, pc.if_else(pc.is_null(status), found.field(c), pa.scalar(None, pa.binary())))
        told = tell(object_id, status, value("before"), value("after"))
        return pa.StructArray.from_arrays([found, told], ["found", "told"])

    return rows.arrow_function(run, f"struct<found:{FOUND},told:{ANALYSIS}>")


def analyze_many(folded: DataFrame, catalog: Catalog, pages: DataFrame | None = None, new: str = "contents0", old: str = "contents1") -> DataFrame:
    """The updates among folded records of all tables (of generate.resolved and images.fold), with table names, before_image, after_image, image_source, and the fields of ANALYSIS.

    An image that the fold knows is taken; else the page's, in which the bytes of column `new` are searched and those of `old` put back."""
    updates = folded.where(F.col("operation").isin(S.MODIFY_ROW, S.MODIFY_COLUMNS))
    if pages is not None:
        updates = images.with_page_images(updates, pages)
    elif "page_image" not in updates.columns:
        updates = updates.withColumn("page_image", F.lit(None).cast("binary"))
    args = ("object_id", "partition_id", "compression", "operation", new, old, "before_image", "after_image", "fold_path", "page_image")
    d = updates.withColumn("_read", update_reader(catalog)(*map(F.col, args)))
    names = generate.resolve.small(generate.table_rows(catalog)).select("object_id", F.col("_t.schema").alias("schema_name"), F.col("_t.name").alias("table_name"))
    kept = [c for c in updates.columns if c not in ("before_image", "after_image", "page_image")]
    d = d.join(names, "object_id", "left")
    return d.select(*kept, "schema_name", "table_name", F.col("_read.found.before").alias("before_image"), F.col("_read.found.after").alias("after_image"), F.col("_read.found.source").alias("image_source"), "_read.told.*")
