"""Row formats: byte vectors with known values, and round trips."""

import struct

import pytest

from tidelog.functions import compressed, rows, values
from tidelog.functions.rows import ColumnSpec as C
from tidelog.functions.rows import TableSpec
from tidelog.operators import images
from tidelog.scan_queries import _short, pack


def decoded(spark, spec, image, how=rows.decode):
    row = how(spark.createDataFrame([(bytearray(image),)], "image binary"), spec, "image", "row").first()["row"]
    return row.err, row.vals


def table(*columns, key=(1,)):
    return TableSpec("dbo", "T", tuple(C(i + 1, f"c{i + 1}", *c) for i, c in enumerate(columns)), key)


def image(fixed: bytes, n: int, var=(), nulls=0):
    base = 4 + len(fixed)
    out = b"\x30\x00" + struct.pack("<H", base) + fixed + struct.pack("<H", n) + nulls.to_bytes((n + 7) // 8, "little")
    if var:
        at = len(out) + 2 + 2 * len(var)
        ends = []
        for v in var:
            at += len(v)
            ends.append(at)
        out += struct.pack("<H", len(var)) + b"".join(struct.pack("<H", e) for e in ends) + b"".join(var)
    return out


def test_fixed_types(spark):
    spec = table((rows.TINYINT,), (rows.SMALLINT,), (rows.INT,), (rows.BIGINT,), (rows.FLOAT,), (rows.REAL,), (rows.SMALLMONEY,), (rows.DATE,), (rows.SMALLDATETIME,), (rows.DATETIME,), (rows.UNIQUEIDENTIFIER,), (rows.BINARY, 3))
    fixed = struct.pack("<BhiqdfihB", 200, -2, -70000, -(2**62), 1234567.25, 0.1, -12345, 0, 0)[:-3]
    fixed += (738000).to_bytes(3, "little") + struct.pack("<HH", 40000, 61) + struct.pack("<Ii", 300 * 3661 + 1, 40000) + bytes(range(16)) + b"\x01\x02\x03"
    err, vals = decoded(spark, spec, image(fixed, 12))
    assert err is None
    assert vals[:7] == ["200", "-2", "-70000", str(-(2**62)), "1.23456725e+06", "0.10000000149011612", "-1.2345"]
    assert vals[7:] == ["'2021-07-30'", "'2009-07-08 01:01:00.000'", "'2009-07-08 01:01:01.003'", "'03020100-0504-0706-0809-0A0B0C0D0E0F'", "0x010203"]


def test_times_and_decimals(spark):
    spec = table((rows.TIME, 0, 0, 7), (rows.DATETIME2, 0, 0, 3), (rows.DATETIMEOFFSET, 0, 0, 7), (rows.DECIMAL, 0, 18, 4), (rows.DECIMAL, 0, 38, 0), (rows.MONEY,))
    ticks = 10_000_000 * 3723 + 1234567
    fixed = ticks.to_bytes(5, "little") + (3723004).to_bytes(4, "little") + (738000).to_bytes(3, "little") + ticks.to_bytes(5, "little") + (738000).to_bytes(3, "little") + struct.pack("<h", -150)
    fixed += b"\x01" + (98765432).to_bytes(8, "little") + b"\x00" + (10**30).to_bytes(16, "little") + struct.pack("<iI", -1, 2**32 - 5)
    err, vals = decoded(spark, spec, image(fixed, 6))
    assert err is None and vals == ["'01:02:03.1234567'", "'2021-07-30 01:02:03.0040000'", "'2021-07-30 01:02:03.1234567 -02:30'", "9876.5432", "-" + str(10**30), "-0.0005"]


def test_variable_null_and_errors(spark):
    spec = table((rows.INT,), (rows.VARCHAR, 20), (rows.NVARCHAR, 20), (rows.VARBINARY, 20), (rows.BIT,), (rows.BIT,))
    fixed = struct.pack("<iB", 7, 0b10)
    good = image(fixed, 6, (b"O'K", "é".encode("utf-16-le"), b"\xff"))
    assert decoded(spark, spec, good) == (None, ["7", "'O''K'", "N'é'", "0xFF", "0", "1"])
    assert decoded(spark, spec, image(fixed, 6, (b"a", b"", b"\xff"), nulls=0b10)) == (None, ["7", None, "N''", "0xFF", "0", "1"])
    assert decoded(spark, spec, image(fixed, 2, (b"a",))) == (None, ["7", "'a'", None, None, None, None])
    assert decoded(spark, spec, image(fixed, 7, (b"a",)))[0] == "schema_mismatch"
    off = bytearray(image(fixed, 6, (b"a", b"bc", b"d")))
    off[4 + 5 + 2 + 1 + 2 + 1] |= 0x80
    assert decoded(spark, spec, bytes(off))[0] == "off_row_lob"
    assert decoded(spark, spec, b"\x30\x00\x00\x00\x01")[0] == "compressed_row" and decoded(spark, spec, b"\x30")[0] == "truncated"


def test_float_literals():
    cases = {0.0: "0", 1.0: "1", 100000.0: "100000", 1000000.0: "1e+06", 123456789.0: "1.23456789e+08", 0.0001: "0.0001", 0.00001: "1e-05", -2.5: "-2.5", 1e100: "1e+100", 0.5: "0.5"}
    assert {x: values.shortest(x) for x in cases} == cases


def test_compressed(spark):
    spec = table((rows.INT,), (rows.SMALLINT,), (rows.VARCHAR, 20), (rows.MONEY,), (rows.BIT,), (rows.TINYINT,), (rows.BIGINT,), (rows.VARBINARY, 30), (rows.NVARCHAR, 30))
    wide = "Zoë Ω".encode("utf-16-le")
    for number in (0, 1, -1, 127, 128, -128, -129, 40_000, -(2**31), 2**31 - 1):
        parts = [_short(number), _short(number % 200), b"", _short(-25_0000), number % 2 == 0, bytes([number % 256]), _short(number * 2**31), b"0123456789" * 2, None]
        money = "-25.0000"
        want = [str(number), str(number % 200), "''", money, "1" if number % 2 == 0 else "0", str(number % 256), str(number * 2**31), "0x" + (b"0123456789" * 2).hex().upper(), None]
        assert decoded(spark, spec, pack(parts), compressed.decode) == (None, want)
    assert decoded(spark, table((rows.NVARCHAR, 30)), pack([b"plain"]), compressed.decode) == (None, ["N'plain'"])
    assert decoded(spark, table((rows.NVARCHAR, 30)), pack([squeezed(wide)]), compressed.decode) == (None, ["N'Zoë Ω'"])
    two = table((rows.VARCHAR, 90), (rows.INT,), (rows.VARCHAR, 90))
    assert decoded(spark, two, pack([b"first long text", _short(5), b"the second long one's"]), compressed.decode) == (None, ["'first long text'", "5", "'the second long one''s'"])
    assert decoded(spark, two, pack([b"first long text", _short(5), b"the second long"])[:-3], compressed.decode)[0] == "tail_parse_failed"
    assert decoded(spark, two, pack([b"abc", _short(5), b"d"])[:-2], compressed.decode)[0] == "parse_failed"
    assert decoded(spark, two, b"\x30\x00\xcc\x0c", compressed.decode)[0] == "page_dictionary" and decoded(spark, two, b"\x10\x00\x11\x01", compressed.decode)[0] == "not_compressed"


def test_vardecimal():
    for text, scale in (("0.00", 2), ("7", 0), ("123.45", 2), ("-0.0500", 4), ("100000.000", 3), ("-98765432109876543210.5", 1)):
        assert compressed.vardecimal(packed_decimal(text), scale) == text
    assert compressed.vardecimal(packed_decimal("1.239"), 2) == "1.23"


def packed_decimal(text):
    """Sign and exponent, then three digits in ten bits, from the first digit that is not zero."""
    digits = text.lstrip("-").replace(".", "").lstrip("0")
    if not digits:
        return b""
    whole = text.lstrip("-").split(".")[0].lstrip("0")
    exponent = len(whole) if whole else -(len(text.split(".")[1]) - len(text.split(".")[1].lstrip("0")))
    digits += "0" * (-len(digits) % 3)
    bits = "".join(f"{int(digits[i : i + 3]):010b}" for i in range(0, len(digits), 3))
    bits += "0" * (-len(bits) % 8)
    return bytes([(0 if text[0] == "-" else 128) | (63 + exponent)]) + int(bits, 2).to_bytes(len(bits) // 8, "big")


def squeezed(wide):
    """UTF-16LE in the compressed form: one byte below 128, the plain two below 256, else the mark 0E and both bytes, high one first."""
    return b"".join((bytes((lo,)) if 16 < lo < 128 else bytes((lo, 0))) if not hi else bytes((0x0E, hi, lo)) for lo, hi in zip(wide[::2], wide[1::2], strict=True))


def test_unicode_compression():
    for text in ("", "abc", "naïve Ж 日本", "x" * 50):
        assert compressed.expand_unicode(squeezed(text.encode("utf-16-le"))).decode("utf-16-le") == text
    # A lead byte of 1 to 13 and a byte over 127 make one character.
    assert compressed.expand_unicode(bytes([0x05, 0x90])) == bytes([0x90 ^ 0xC0, 0x04])
    with pytest.raises(ValueError):
        compressed.expand_unicode(b"\x0e\x01")


def test_patches():
    assert images.splice(b"abcdef", b"cd", b"XYZ", 2) == b"abXYZef" and images.splice(b"abcdef", b"xx", b"y", 2) is None
    assert images.reverse_patch(b"aaNNbb", b"NN", b"OO") == (b"aaOObb", "ok")
    assert [images.reverse_patch(b"aNaN", x, y)[1] for x, y in ((b"N", b"O"), (b"Z", b"O"), (b"N", b"OO"), (b"", b""))] == ["ambiguous", "not_found", "length_change", "length_change"]


def test_fragments():
    # "one" -> "three" at 4 and "xx" -> "y" at 10 (12 after the first change).
    c0, c1, c3 = struct.pack("<HHHH", 4, 4, 10, 12), struct.pack("<HH", 3, 2), b"MARK"
    record = b"HEADHEAD" + c3 + b"one\0" + b"three\0\0\0" + b"xx\0\0" + b"y"
    parts = images.fragments(c0, c1, c3, record)
    assert parts == [(4, b"one", b"three"), (10, b"xx", b"y")]
    assert images.apply_fragments(b"abc one__ xx!", parts) == b"abc three__ y!"
    assert images.apply_fragments(b"abc two__ xx!", parts) is None
    assert images.step(b"abc one__ xx!", "LOP_MODIFY_COLUMNS", c0, c1, -1, c3, record)[3] == "splice_columns"
    # The same change taken back, also where the row has grown since; not where the new bytes are gone.
    assert images.reversed_columns(b"abc three__ y!", c0, c1, c3, record) == b"abc one__ xx!"
    assert images.reversed_columns(b"abc three__ y! and more", c0, c1, c3, record) == b"abc one__ xx! and more"
    assert images.reversed_columns(b"abc four__ y!", c0, c1, c3, record) is None
    assert images.step(b"abc three__ y!", "LOP_MODIFY_COLUMNS", c0, c1, -1, c3, record)[1:] == (b"abc one__ xx!", b"abc three__ y!", "reverse_columns")
    assert images.step(None, "LOP_MODIFY_COLUMNS", c0, c1, -1, c3, record, b"abc three__ y!")[1:] == (b"abc one__ xx!", b"abc three__ y!", "reverse_page")
    assert images.step(b"zz", "LOP_MODIFY_COLUMNS", c0, c1, -1, c3, record) == (b"zz", None, None, "columns_not_decoded")
    assert images.fragments(c0, c1, b"NONE", record) is None and images.fragments(b"", b"", c3, record) is None


def test_columns_lost_in_decoding():
    """Bytes that give no value are told by the name of their column; null, zero and dropped columns are not lost."""
    import pyarrow as pa

    spec = table((rows.INT,), (rows.SMALLINT,), (rows.NVARCHAR, 30), (rows.FLOAT,))
    images = [pack([_short(7), _short(70000), b"\x0e\x01", b""]), pack([_short(7), _short(7), b"a", None]), None, b"\x30"]
    err, vals, lost = compressed.decode_told(spec, pa.array(images, pa.binary()))
    assert err == [None, None, "truncated", "truncated"] and lost == [["c2", "c3"], [], [], []]
    assert vals.to_pylist()[:2] == [["7", None, None, "0"], ["7", "7", "N'a'", None]]
    assert compressed.decode_told(spec, pa.array([], pa.binary()))[2] == []
