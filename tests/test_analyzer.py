"""The analyzer: every status from real records of two tables, by the fold's images and by pages; equal values of different print."""

import struct

import pytest

from tidelog.functions import types as T
from tidelog.functions.types import ColumnSpec as C
from tidelog.functions.types import TableSpec
from tidelog.operators import analyzer, generate, images
from tidelog.sources import catalog

STOCK = TableSpec("shop", "stock", (C(1, "shelf", T.INT, nullable=False), C(2, "pieces", T.INT), C(3, "tag", T.INT)), (1,))
NOTES = TableSpec("shop", "notes", (C(1, "body", T.VARCHAR, -1),), ())
RAW = "db_name string, alloc_unit_id long, alloc_unit_name string, partition_id long, page_id string, slot_id int, lsn string, operation string, contents0 binary, contents1 binary, offset_in_row int, contents3 binary, log_record binary"


def stock(shelf, pieces, tag=7):
    return bytes([0x10, 0, 16, 0]) + struct.pack("<iii", shelf, pieces, tag) + struct.pack("<HB", 3, 0)


def note(text):
    return bytes([0x30, 0, 4, 0]) + struct.pack("<HBHH", 1, 0, 1, 4 + 2 + 1 + 2 + 2 + len(text)) + text


def le(n):
    return struct.pack("<i", n)


@pytest.fixture(scope="module")
def analysed(spark):
    known = catalog.of_specs(spark, {31: STOCK, 32: NOTES})
    record = lambda slot, n, op, c0=None, c1=None, at=-1, table="stock": ("d", 0, f"shop.{table}", 0, "p", slot, f"{n:04x}", op, c0, c1, at, None, None)
    row, columns = "LOP_MODIFY_ROW", "LOP_MODIFY_COLUMNS"
    records = [
        record(1, 1, "LOP_INSERT_ROWS", stock(11, 5)), record(1, 2, row, le(5), le(6), 8), record(1, 3, row, le(11), le(12), 4), record(1, 4, row, le(6), le(6), 8), record(1, 5, row, le(99), le(1), 8),
        record(2, 6, row, le(2), le(1)), record(3, 7, row, le(40), le(41)), record(3, 8, row, b"\x28\0\0", b"\x29\0\0\0"), record(4, 9, row, le(40), le(41)), record(5, 10, row, le(3), le(4)), record(6, 11, row, b"\x05", b"\x06"),
        record(7, 12, columns, b"zz", b"yy"), record(8, 13, row, b"abd", b"abc", table="notes"), record(9, 14, row, b"", b"x"), record(10, 15, columns, b"\x2a", b"\x2b"), record(11, 16, row, b"\x10\0\x10\0", b"\x10\0\xff\xff"),
    ]
    pages = {3: stock(21, 40), 4: stock(22, 1), 5: stock(3, 3, 3), 6: stock(5, 6, 8), 7: stock(1, 1), 8: note(b"abd and more"), 9: stock(1, 2), 10: stock(23, 42, 9), 11: stock(24, 1)}
    folded = images.fold(generate.resolved(spark.createDataFrame(records, RAW), known))
    seen = spark.createDataFrame([("d", "p", k, v) for k, v in pages.items()], "db_name string, page_id string, slot_id int, image binary")
    return {int(r.lsn, 16): r for r in analyzer.analyze_many(folded, known, seen).collect()}


def test_statuses(analysed):
    assert {k: r.status for k, r in analysed.items()} == {
        2: "ok", 3: "ok", 4: "no_changed_columns", 5: "patch_not_found", 6: "mr1_not_found", 7: "ok", 8: "variable_length_patch_required", 9: "patch_not_found", 10: "ambiguous_patch_location", 11: "ok",
        12: "unsupported_modify_columns_format", 13: "where_not_buildable", 14: "patch_not_found", 15: "ok", 16: "decode_failed",
    }
    assert {r.status for r in analysed.values()} == set(analyzer.STATUSES)
    assert {k for k, r in analysed.items() if r.image_source == "cache"} == {2, 3, 4} and analysed[6].image_source == "none" and analysed[7].image_source == "page_reader"
    assert all(r.confidence == ("high" if r.status == "ok" else "low") for r in analysed.values())


def test_statements(analysed):
    assert analysed[2].redo == "update top(1) [shop].[stock] set [pieces]=6 where [shelf]=11;" and analysed[2].undo == "update top(1) [shop].[stock] set [pieces]=5 where [shelf]=11;"
    assert analysed[3].redo == "update top(1) [shop].[stock] set [shelf]=12 where [shelf]=11;" and analysed[3].undo == "update top(1) [shop].[stock] set [shelf]=11 where [shelf]=12;"
    # Of a page the image is the one after the change.
    assert analysed[7].redo == "update top(1) [shop].[stock] set [pieces]=40 where [shelf]=21;" and analysed[7].undo == "update top(1) [shop].[stock] set [pieces]=41 where [shelf]=21;"
    assert analysed[13].table_name == "notes" and analysed[13].after_json.startswith('{"body": "') and analysed[13].redo is None
    assert [(c.column, c.type, c.before, c.after) for c in analysed[2].changed] == [("pieces", "int", "5", "6")]


def test_one_table(spark):
    data = [(stock(1, 2), stock(1, 3), "splice"), (stock(4, 2), stock(4, 2), "splice"), (None, None, "no_image"), (None, None, "ambiguous"), (None, None, "columns_not_decoded"), (stock(1, 2), b"\x30", "splice")]
    got = analyzer.analyze(spark.createDataFrame([tuple(bytearray(x) if isinstance(x, bytes) else x for x in r) for r in data], "before_image binary, after_image binary, fold_path string"), STOCK).collect()
    assert [r.status for r in got] == ["ok", "no_changed_columns", "mr1_not_found", "ambiguous_patch_location", "unsupported_modify_columns_format", "decode_failed"]
    assert got[0].redo == "update top(1) [shop].[stock] set [pieces]=3 where [shelf]=1;" and got[0].confidence == "high" and got[1].redo is None


def test_equal_values_of_different_print():
    same = analyzer.same_value
    assert same(T.DECIMAL, "1.50", "1.5") and same(T.MONEY, "-0.0000", "0") and same(T.FLOAT, "1e2", "100") and same(T.DATETIMEOFFSET, "'2024-01-01 10:00:00.0000000 +02:00'", "'2024-01-01 03:00:00.0000000 -05:00'")
    assert not same(T.DECIMAL, "1.51", "1.5") and not same(T.VARCHAR, "'1.50'", "'1.5'") and not same(T.INT, None, "0") and same(T.INT, None, None) and not same(T.DATETIMEOFFSET, "'2024-01-01 10:00:00.0000001 +02:00'", "'2024-01-01 10:00:00.0000000 +02:00'")
