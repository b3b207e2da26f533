"""Types, columns and tables of the source system, and where an uncompressed row keeps its columns."""

from __future__ import annotations

from dataclasses import dataclass, field

# Type ids of the source system.
BIT, TINYINT, SMALLINT, INT, BIGINT, REAL, FLOAT, SMALLMONEY, MONEY, DECIMAL, NUMERIC = 104, 48, 52, 56, 127, 59, 62, 122, 60, 106, 108
SMALLDATETIME, DATETIME, DATE, TIME, DATETIME2, DATETIMEOFFSET, UNIQUEIDENTIFIER = 58, 61, 40, 41, 42, 43, 36
CHAR, NCHAR, BINARY, VARCHAR, TEXT, NVARCHAR, NTEXT, VARBINARY, IMAGE, XML, SQL_VARIANT, ROWVERSION = 175, 239, 173, 167, 35, 231, 99, 165, 34, 241, 98, 189
TYPE_NAMES = {
    BIT: "bit", TINYINT: "tinyint", SMALLINT: "smallint", INT: "int", BIGINT: "bigint", REAL: "real", FLOAT: "float", SMALLMONEY: "smallmoney", MONEY: "money",
    DECIMAL: "decimal", NUMERIC: "numeric", SMALLDATETIME: "smalldatetime", DATETIME: "datetime", DATE: "date", TIME: "time", DATETIME2: "datetime2",
    DATETIMEOFFSET: "datetimeoffset", UNIQUEIDENTIFIER: "uniqueidentifier", CHAR: "char", NCHAR: "nchar", BINARY: "binary", VARCHAR: "varchar", TEXT: "text",
    NVARCHAR: "nvarchar", NTEXT: "ntext", VARBINARY: "varbinary", IMAGE: "image", XML: "xml", SQL_VARIANT: "sql_variant",
}
VARIABLE = {VARCHAR, TEXT, NVARCHAR, NTEXT, VARBINARY, IMAGE, XML, SQL_VARIANT}
INTEGERS = {TINYINT: 1, SMALLINT: 2, INT: 4, BIGINT: 8}
RANGES = {TINYINT: (0, 255), SMALLINT: (-(2**15), 2**15 - 1), INT: (-(2**31), 2**31 - 1)}


@dataclass(frozen=True)
class ColumnSpec:
    id: int
    name: str
    type: int
    length: int = 0
    precision: int = 0
    scale: int = 0
    nullable: bool = True
    identity: bool = False
    dropped: bool = False

    @property
    def variable(self) -> bool:
        return self.type in VARIABLE or self.length < 0


def fixed_size(c: ColumnSpec) -> int:
    """Bytes of a fixed column in the row."""
    if c.type in INTEGERS:
        return INTEGERS[c.type]
    if c.type in (TIME, DATETIME2, DATETIMEOFFSET):
        return (3 if c.scale <= 2 else 4 if c.scale <= 4 else 5) + {TIME: 0, DATETIME2: 3, DATETIMEOFFSET: 5}[c.type]
    if c.type in (DECIMAL, NUMERIC):
        return 5 if c.precision <= 9 else 9 if c.precision <= 19 else 13 if c.precision <= 28 else 17
    return {BIT: 1, REAL: 4, FLOAT: 8, SMALLMONEY: 4, MONEY: 8, SMALLDATETIME: 4, DATETIME: 8, DATE: 3, UNIQUEIDENTIFIER: 16}.get(c.type, c.length)


@dataclass(frozen=True)
class TableSpec:
    schema: str
    name: str
    columns: tuple[ColumnSpec, ...]
    key: tuple[int, ...] = ()
    compression: str = "NONE"
    object_id: int = 0
    base_index: str = ""
    #: Stored columns in their physical order, dropped ones included; compressed rows have one descriptor for each. Empty: the columns.
    physical: tuple[ColumnSpec, ...] = ()
    places: dict = field(default_factory=dict, compare=False, hash=False)

    def __post_init__(self):
        """places: column id -> ("var", index), ("bit", byte, bit) or ("fix", offset, size)."""
        at, var, byte, bit = 0, 0, -1, 8
        for c in self.columns:
            if c.variable:
                self.places[c.id] = ("var", var)
                var += 1
            elif c.type == BIT:
                if bit >= 8:
                    byte, bit, at = at, 0, at + 1
                self.places[c.id] = ("bit", byte, bit)
                bit += 1
            else:
                bit = 8
                self.places[c.id] = ("fix", at, fixed_size(c))
                at += fixed_size(c)

    @property
    def full_name(self) -> str:
        return f"[{self.schema}].[{self.name}]"

    @property
    def fixed_end(self) -> int:
        ends = [p[1] + (p[2] if p[0] == "fix" else 1) for p in self.places.values() if p[0] != "var"]
        return 4 + max(ends, default=0)


def type_name(c: ColumnSpec) -> str:
    """The type as it is declared, with its length, precision or scale; type_<id> for an unknown one."""
    name = TYPE_NAMES.get(c.type, f"type_{c.type}")
    if c.type in (DECIMAL, NUMERIC):
        return f"{name}({c.precision},{c.scale})"
    if c.type in (TIME, DATETIME2, DATETIMEOFFSET):
        return f"{name}({c.scale})"
    if c.type in (CHAR, VARCHAR, BINARY, VARBINARY):
        return f"{name}({'max' if c.length < 0 else c.length})"
    if c.type in (NCHAR, NVARCHAR):
        return f"{name}({'max' if c.length < 0 else c.length // 2})"
    return name
