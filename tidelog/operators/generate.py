"""From log records of many tables to events: resolve, fold row images, decode each image by its own table, put statements together.

The shuffles are those of its parts (transactions, slots); tables travel as small joined rows and with the decoding function. Decoding
goes by table within each Arrow batch; statements are expressions over arrays, the same for every table."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import compressed, values
from ..functions import rows as R
from ..functions.lsn import operation_of
from ..functions.predicates import is_base_row, is_data_op
from ..functions.types import RANGES, ROWVERSION, TableSpec
from ..sources import catalog_history
from ..sources.catalog import Catalog
from . import deltas, images, resolve, transactions

ROUTED = "struct<status:string,used:string,vals:array<string>,lost:array<string>>"
#: What an image that cannot be decoded ends in, by the error of the decoder.
PLAIN_STATUS = {"off_row_lob": "OFF_ROW_LOB_NOT_SUPPORTED", "schema_mismatch": "SCHEMA_MISMATCH", "truncated": "DECODE_ERROR", "compressed_row": "compressed_row_parse_failed"}
PACKED_STATUS = {"truncated": "compressed_row_parse_failed", "not_compressed": "compressed_row_parse_failed", "parse_failed": "compressed_row_parse_failed", "tail_parse_failed": "compressed_tail_parse_failed", "page_dictionary": "page_dictionary_required"}
NO_METADATA = "schema_compression_metadata_missing"


#: What events need of a record once its epoch and its table are known; the fold cannot leave out columns by itself.
TOLD = (
    "db_name", "lsn", "operation", "context", "transaction_id", "alloc_unit_id", "partition_id", "page_id", "slot_id", "contents0", "contents1", "contents2", "contents3", "contents4", "log_record",
    "offset_in_row", "modify_size", "object_id", "compression", "begin_at", "end_at",
)


def decode_routed(spec: TableSpec, compression: str, column: pa.Array) -> tuple[list, list, pa.Array, list]:
    """(status, compression that was used, literals, columns whose bytes gave no value) of one table's images under its compression.

    A row that the compressed form refuses and whose header lacks the mark of that form is read in the plain one: catalogs lag behind partitions.
    A row that the plain form finds to be compressed gets the status that the compressed one would give it, but never values."""
    n = len(column)
    if compression in ("NONE", "COLUMNSTORE"):
        err, vals = values.decode_images(spec, column)
        status = [PLAIN_STATUS.get(e) for e in err]
        packed = [i for i, e in enumerate(err) if e == "compressed_row"]
        if packed:
            why = compressed.decode_images(spec, column.take(pa.array(packed)))[0]
            for i, e in zip(packed, why, strict=True):
                status[i] = PACKED_STATUS.get(e, "compressed_row_parse_failed")
        return status, [compression] * n, vals, [None] * n
    if compression in ("ROW", "PAGE"):
        err, vals, lost = compressed.decode_told(spec, column)
        status, used = [PACKED_STATUS.get(e) for e in err], [compression] * n
        plain = [i for i, s in enumerate(status) if s == "compressed_row_parse_failed" and (raw := column[i].as_py()) and not raw[0] & 0x20]
        if plain:
            again, more = values.decode_images(spec, column.take(pa.array(plain)))
            good = {i: k for k, i in enumerate(plain) if again[k] is None}
            for i in good:
                status[i], used[i] = None, "NONE"
            vals = pa.concat_arrays([vals, more]).take(pa.array([n + good[i] if i in good else i for i in range(n)]))
        return status, used, vals, lost
    return [NO_METADATA] * n, [compression] * n, pa.nulls(n, pa.list_(pa.string())), [None] * n


def _by_table(catalog: Catalog, object_id: pa.Array, partition_id: pa.Array, *more: pa.Array):
    """(spec, *more as values, row numbers) of the rows that share a table and the further values."""
    groups: dict = {}
    parts = [p if p in catalog.stored else None for p in partition_id.to_pylist()]
    for i, key in enumerate(zip(object_id.to_pylist(), parts, *[m.to_pylist() for m in more], strict=True)):
        groups.setdefault(key, []).append(i)
    for (table, part, *rest), rows in groups.items():
        yield catalog.spec(table, part), rest, pa.array(rows)


def _light(catalog: Catalog) -> Catalog:
    """Without frames, so that it can travel with a function."""
    return Catalog(catalog.specs, catalog.stored, None, None, None, catalog.by)


def image_values(catalog: Catalog):
    """Arrow function (object_id, partition_id, compression, image) -> struct<status, used, vals, lost>; all null without an image."""
    return R.arrow_function(image_reader(catalog), ROUTED)


def image_reader(catalog: Catalog):
    """What image_values runs, as a function of Arrow arrays."""
    catalog = _light(catalog)

    def run(object_id, partition_id, compression, image):
        order, status, used, vals, lost = [], [], [], [], []
        for spec, (how, there), rows in _by_table(catalog, object_id, partition_id, compression, pc.is_valid(image)):
            order.append(rows)
            if spec is None or not there:
                parts = [None] * len(rows), [None] * len(rows), pa.nulls(len(rows), pa.list_(pa.string())), [None] * len(rows)
            else:
                parts = decode_routed(spec, how, image.take(rows))
            status += parts[0]
            used += parts[1]
            vals.append(parts[2].cast(pa.list_(pa.string())))
            lost += parts[3]
        back = pa.array(np.argsort(np.concatenate([np.asarray(o) for o in order]))) if order else pa.array([], pa.int64())
        flat = pa.concat_arrays(vals) if vals else pa.array([], pa.list_(pa.string()))
        return pa.StructArray.from_arrays([pa.array(status, pa.string()).take(back), pa.array(used, pa.string()).take(back), flat.take(back), pa.array(lost, pa.list_(pa.string())).take(back)], ["status", "used", "vals", "lost"])

    return run


def fragment_values(catalog: Catalog):
    """Arrow function (object_id, fragment, offset) -> array<string>; null without a fragment."""
    catalog = _light(catalog)

    def run(object_id, fragment, offset):
        order, vals = [], []
        for spec, (there,), rows in _by_table(catalog, object_id, pa.nulls(len(object_id), pa.int64()), pc.and_(pc.is_valid(fragment), pc.is_valid(offset))):
            order.append(rows)
            found = values.fragment_values(spec, fragment.take(rows), offset.take(rows).to_numpy(zero_copy_only=False).astype(np.int64)) if spec is not None and there else pa.nulls(len(rows), pa.list_(pa.string()))
            vals.append(found.cast(pa.list_(pa.string())))
        back = pa.array(np.argsort(np.concatenate([np.asarray(o) for o in order]))) if order else pa.array([], pa.int64())
        return pa.concat_arrays(vals).take(back) if vals else pa.array([], pa.list_(pa.string()))

    return R.arrow_function(run, "array<string>")


# ---- statements, for whatever table a row is of -------------------------------------------------------------------------------------


def table_rows(catalog: Catalog) -> DataFrame:
    """object_id and _t, a struct of what statements need of a table."""
    rows = []
    for i, s in catalog.specs.items():
        low, high = zip(*[RANGES.get(c.type, (None, None)) for c in s.columns], strict=True) if s.columns else ((), ())
        rows.append((i, (s.schema, s.name, s.full_name, [c.name for c in s.columns], [c.id in s.key for c in s.columns], bool(s.key), [c.type == ROWVERSION for c in s.columns], [c.nullable for c in s.columns], list(low), list(high))))
    return catalog.tables.sparkSession.createDataFrame(rows, "object_id int, _t struct<schema string, name string, full string, names array<string>, key array<boolean>, keyed boolean, version array<boolean>, nullable array<boolean>, low array<bigint>, high array<bigint>>")


def _where(v: str) -> str:
    """The key columns, else all, in column order."""
    return f"""array_join(filter(zip_with(_t.names, {v}, (n, v) -> if(v is null, concat('[', n, '] IS NULL'), concat('[', n, '] = ', v))), (x, i) -> not _t.keyed or _t.key[i]), ' AND ')"""


def _insert(v: str) -> str:
    return f"concat('INSERT INTO ', _t.full, ' (', array_join(transform(_t.names, n -> concat('[', n, ']')), ', '), ') VALUES (', array_join(transform({v}, v -> coalesce(v, 'NULL')), ', '), ');')"


def _delete(where: str) -> str:
    return f"concat('DELETE FROM ', _t.full, ' WHERE ', {where}, ';')"


def _changed(old: str, new: str) -> str:
    return f"""array_join(filter(transform({new}, (v, i) -> if(v <=> {old}[i] or _t.version[i], null, concat('[', _t.names[i], '] = ', coalesce(v, 'NULL')))), x -> x is not null), ', ')"""


def _told(old: str, new: str, one: str) -> str:
    """[name] = value of the columns that a fragment tells."""
    return f"""filter(transform(_t.names, (n, i) -> if({old}[i] is null and {new}[i] is null, null, concat('[', n, '] = ', coalesce({one}[i], 'NULL')))), x -> x is not null)"""


def _found_by(v: str, only_key: bool) -> str:
    return f"""array_join(filter(transform(_t.names, (n, i) -> if({v}[i] is null{' or not _t.key[i]' if only_key else ''}, null, concat('[', n, '] = ', {v}[i]))), x -> x is not null), ' AND ')"""


def _delta(old: str, new: str) -> str:
    """The statement that leads from a fragment's old values to its new ones; under a line of warning where it tells no key."""
    warn = "concat('-- No key in the fragment at offset ', _at, '; the changed columns may match more rows than one.\\n')"
    sets = f"concat('UPDATE ', _t.full, ' SET ', array_join({_told(old, new, new)}, ', '), ' WHERE ')"
    return f"""case when {_found_by(old, True)} <> '' then concat({sets}, {_found_by(old, True)}, ';') when {_found_by(old, False)} <> '' then concat({warn}, {sets}, {_found_by(old, False)}, ';') else concat({warn}, '-- ', {sets}, '?;') end"""


_BAD_KEY = """array_join(filter(transform(_t.names, (n, i) -> case when not _t.key[i] then null when _b.vals[i] is null then if(_t.nullable[i], null, concat(n, ' is NULL'))
  when not (try_cast(_b.vals[i] as bigint) between coalesce(_t.low[i], -9223372036854775808) and coalesce(_t.high[i], 9223372036854775807)) and _t.low[i] is not null then concat(n, ' is out of range') end), x -> x is not null), ', ')"""


def debug_json(lost: Column) -> Column:
    """The raw fields of a record, and a warning that names the columns lost in decoding, as JSON; absent ones are left out."""
    text = lambda c: F.when(F.length(c) > 0, F.lower(F.hex(c)))
    return F.to_json(F.struct(
        "operation", "context", "page_id", "slot_id", "alloc_unit_id", "partition_id", "offset_in_row", "modify_size", F.col("fold_path").alias("images"),
        *[text(f"contents{k}").alias(f"rowlog{k}_hex") for k in range(5)], text("log_record").alias("raw_log_record_hex"),
        F.when(F.size(lost) > 0, F.concat(F.size(lost).cast("string"), F.lit(" column(s) set to NULL, their bytes cannot be decoded: "), F.array_join(lost, ", "))).alias("warning"),
    ))


def statements(folded: DataFrame, catalog: Catalog) -> DataFrame:
    """Adds schema_name, table_name, sql_stmt, rollback_sql, status, skip_reason, confidence, compression_type, compressed_row_hex, decompressed_debug_json and
    compression_decode_status to data records with before_image, after_image, fold_path, object_id and compression.

    An update is told by both images, else by its fragment at a known offset, else by a whole image and the one it was XORed from, else by the
    fragment at the end of the raw record, else by a comment. Rows that cannot be decoded give comments, never statements.
    A compressed row of which some columns cannot be decoded is told with NULL for them, at medium confidence, and the debug text names them."""
    d = folded.join(resolve.small(table_rows(catalog)), "object_id")
    op = operation_of(F.col("operation"))
    insert, delete = F.col("operation") == S.INSERT, F.col("operation") == S.DELETE
    both = F.col("before_image").isNotNull() & F.col("after_image").isNotNull()
    row = (F.col("operation") == S.MODIFY_ROW) & ~both
    placed, legacy = row & (F.col("offset_in_row") >= 0), row & ~(F.coalesce("offset_in_row", F.lit(-1)) >= 0)
    d = d.withColumn("_how", F.when(insert, "insert").when(delete, "delete").when(both, "images").when(placed, "fragment").when(legacy, "legacy").otherwise("none"))
    d = d.withColumn("_compression", F.when(F.col("_how") == "legacy", "NONE").otherwise(F.col("compression")))
    d = d.withColumn("_before", F.when(delete, F.col("contents0")).when(both, F.col("before_image")).when(legacy, deltas.xor_image("contents0", "contents1")))
    d = d.withColumn("_after", F.when(insert | legacy, F.col("contents0")).when(both, F.col("after_image")))
    read = image_values(catalog)
    args = (F.col("object_id"), F.col("partition_id"), F.col("_compression"))
    # Fragments are read in the same pass as images, so that one Python worker serves both; those of whole images are not looked at.
    piece, raw = fragment_values(catalog), deltas.fragment_offset("log_record", "contents0", "contents1")
    d = d.withColumn("_at", F.when(placed, F.col("offset_in_row")).when(legacy, raw).cast("long"))
    fragment = lambda was, now: piece(F.col("object_id"), F.when(placed, F.col(was)).when(legacy & F.col("_at").isNotNull(), F.col(now)), F.col("_at"))
    d = d.withColumns({"_b": read(*args, F.col("_before")), "_a": read(*args, F.col("_after")), "_old": fragment("contents0", "contents1"), "_new": fragment("contents1", "contents0")})
    # A whole image of which every value is null is no image but a fragment.
    blank = (F.col("_how") == "legacy") & F.col("_a.status").isNull() & ~F.exists("_a.vals", lambda v: v.isNotNull())
    d = d.withColumn("_how", F.when(blank, "raw").otherwise(F.col("_how")))
    # A before image that fails only for its bytes counts as equal to the one after.
    d = d.withColumn("_b", F.when((F.col("_how") == "legacy") & (F.col("_b.status") == "DECODE_ERROR"), F.col("_a")).otherwise(F.col("_b")))
    failed = F.when(F.col("_how").isin("insert", "delete", "images", "legacy"), F.coalesce("_b.status", "_a.status"))
    failed = F.when((F.col("_how") == "images") & failed.isNotNull(), "update_full_image_decode_failed").otherwise(failed)
    failed = F.when(F.col("_how") == "none", "modify_columns_not_decoded").otherwise(failed)
    d = d.withColumn("_failed", failed).withColumn("_key", F.when((F.col("_how") == "delete") & failed.isNull() & F.col("_t.keyed"), F.expr(_BAD_KEY)))
    note = F.concat(F.lit("-- "), F.col("_failed"), F.lit(": "), F.col("_t.full"))
    unsafe = lambda what: F.concat(F.lit(f"-- {what} unsafe: no column finds the row of "), F.col("_t.full"))
    guarded = lambda sql, where, what: F.when(F.expr(f"{where} = ''"), unsafe(what)).otherwise(F.expr(sql))
    whole, read_well = F.col("_how").isin("images", "legacy"), F.col("_failed").isNull()
    # Lambdas over arrays are interpreted: the pieces that several branches of both statements need are put together once a row.
    d = d.withColumns({
        "_there": F.when(read_well & whole, F.expr(_changed("_b.vals", "_a.vals"))), "_back": F.when(read_well & whole, F.expr(_changed("_a.vals", "_b.vals"))),
        "_by_b": F.when(read_well & (whole | (F.col("_how") == "delete")), F.expr(_where("_b.vals"))), "_by_a": F.when(read_well & (whole | (F.col("_how") == "insert")), F.expr(_where("_a.vals"))),
    })
    update = lambda sets, where: f"concat('UPDATE ', _t.full, ' SET ', {sets}, ' WHERE ', {where}, ';')"
    same = F.col("_there") == ""
    unchanged = F.concat(F.lit("-- no decoded column of "), F.col("_t.full"), F.lit(" changed"))
    told = F.expr(f"size({_told('_old', '_new', '_new')}) > 0")
    silent = F.concat(F.lit("-- "), F.col("_t.full"), F.lit(": the log tells no column of this update"))
    bad_key = F.coalesce("_key", F.lit("")) != ""
    forward = (
        F.when(F.col("_failed").isNotNull(), note).when(bad_key, F.concat(F.lit("-- compressed_key_decode_invalid: "), F.col("_t.full"), F.lit(": "), F.col("_key"))).when(F.col("_how") == "insert", F.expr(_insert("_a.vals")))
        .when(F.col("_how") == "delete", guarded(_delete("_by_b"), "_by_b", "DELETE")).when(whole & same, unchanged).when(whole, guarded(update("_there", "_by_b"), "_by_b", "UPDATE"))
        .when(told, F.expr(_delta("_old", "_new"))).otherwise(silent)
    )
    inverse = (
        F.when(F.col("_failed").isNotNull(), note).when(F.col("_how") == "insert", guarded(_delete("_by_a"), "_by_a", "INSERT rollback")).when(F.col("_how") == "delete", F.expr(_insert("_b.vals")))
        .when(whole & same, unchanged).when(whole, guarded(update("_back", "_by_a"), "_by_a", "UPDATE rollback")).when(told, F.expr(_delta("_new", "_old"))).otherwise(silent)
    )
    used = F.coalesce("_a.used", "_b.used")
    packed = F.col("_how").isin("insert", "delete", "images") & F.coalesce(used.isin("ROW", "PAGE"), F.lit(False))
    reason = F.coalesce("_failed", F.when(bad_key, "compressed_key_decode_invalid"))
    partial = reason.isNotNull() & ~F.coalesce(reason.isin("OFF_ROW_LOB_NOT_SUPPORTED", "SCHEMA_MISMATCH", "DECODE_ERROR"), F.lit(False))
    status = F.when(partial, reason).when(packed & reason.isNull(), "ok")
    lost = F.array_distinct(F.concat(*[F.coalesce(f"{c}.lost", F.array().cast("array<string>")) for c in ("_b", "_a")]))
    image = F.coalesce(F.when(F.col("_how") == "images", F.col("after_image")), F.col("contents0"))
    decoding = F.col("_how").isin("insert", "delete", "images")
    out = d.select(
        *folded.columns, op.alias("logical_operation"), F.col("_t.schema").alias("schema_name"), F.col("_t.name").alias("table_name"), forward.alias("sql_stmt"), inverse.alias("rollback_sql"), status.alias("status"), reason.alias("skip_reason"),
        F.when(partial, "low").when(packed & reason.isNull(), F.when(F.size(lost) > 0, "medium").otherwise("high")).alias("confidence"), F.when(status.isNotNull() & decoding, F.coalesce(used, F.col("compression"))).alias("compression_type"),
        F.when(status.isNotNull() & decoding, F.lower(F.hex(image))).alias("compressed_row_hex"), F.when(status.isNotNull(), debug_json(lost)).alias("decompressed_debug_json"), F.when(status.isNotNull() & decoding, status).alias("compression_decode_status"),
    )
    return out


def resolved(records: DataFrame, catalog: Catalog) -> DataFrame:
    """Data records with object_id and compression; object_id is null where no known table is meant."""
    by = catalog.by
    found = resolve.resolve_storage(records, catalog.tables, catalog.partitions.select("object_id", "alloc_unit_id", "partition_id", *by), by)
    return resolve.resolve_compression(found, catalog.partitions.select("alloc_unit_id", "partition_id", "code", *by), catalog.default, by)


def scan_each(records: DataFrame, catalogs: dict[str, Catalog], **options) -> DataFrame:
    """Events of several databases, each read by its own catalog; see `scan`."""
    parts = [scan(records.where(F.col("db_name") == db), catalog, **options) for db, catalog in catalogs.items()]
    return reduce(DataFrame.unionByName, parts)


def scan_history(records: DataFrame, history: list[catalog_history.Version], **options) -> DataFrame:
    """Events of records of any databases, each record read by the catalog that held in its database at its lsn, in one plan; see `scan`. Records from
    before a database's first version are of no known table."""
    spark = records.sparkSession
    return scan(catalog_history.with_version(records, history), catalog_history.merged(spark, history), **options)


def event_columns(made: DataFrame) -> DataFrame:
    """Rows of `statements` over records with begin_at and end_at, as events."""
    return made.select(
        F.xxhash64("db_name", "lsn").alias("id"), "lsn", F.col("transaction_id").cast("string").alias("txn_id"), F.col("logical_operation").alias("operation"), "db_name", "schema_name", "table_name", F.lit(None).cast("string").alias("primary_key"),
        "sql_stmt", "rollback_sql", F.coalesce("begin_at", "end_at").alias("event_time"), F.col("end_at").alias("commit_time"), *S.OPTIONAL_TEXTS, "skip_reason",
    )


def scan(records: DataFrame, catalog: Catalog, pages: DataFrame | None = None, since: datetime | None = None, committed: bool = True, watch: tuple[Observation, Observation] | None = None) -> DataFrame:
    """Events (columns of schemas.LOG_EVENTS, and skip_reason) of the records of all tables of the catalog, of any number of databases that share it.

    Records have the columns of schemas.LOG_RECORDS, seen_at (time of a begin or an end) and cleanup. Row images follow every record that is
    not excluded; events are those of committed transactions (committed=False: of all that are not excluded) that began since then.
    pages: current row images (db_name, page_id, slot_id, image) for changes of several places without a known image.
    The records are counted first: a task sorts some images.ROWS_EACH of them, however many there are.
    watch: two observations that get the counters of the pass itself, of records and of events, once the events are written (see `counters`)."""
    parts = images.parts_for(records.count(), records)
    rows = is_data_op(F.col("operation")) & is_base_row(F.col("context"))
    # Counters are of all records; without them, only those that may become events are shuffled.
    marked = transactions.with_epochs(records, parts=parts, only=None if watch else rows)
    if watch:
        marked = marked.observe(watch[0], *transactions.counters())
    data = marked.where(rows & (F.col("excluded_from").isNull() | (F.col("lsn") < F.col("excluded_from"))))
    wanted = F.col("excluded_from").isNull() & ~F.col("undone")
    if committed:
        wanted &= F.coalesce(F.col("kind") == S.COMMIT, F.lit(False))
    if since is not None:
        wanted &= F.coalesce("begin_at", "end_at") >= F.lit(since)
    known = resolved(data, catalog).where(F.col("object_id").isNotNull()).select(*TOLD, wanted.alias("_wanted"))
    folded = images.fold(images.with_page_images(known, pages) if pages is not None else known, parts)
    events = event_columns(statements(folded.where("_wanted"), catalog))
    return events.observe(watch[1], *transactions.event_counters()) if watch else events
