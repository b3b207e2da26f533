"""Updates known only by a fragment: the fixed columns that lie wholly inside it, the place of the fragment, and statements from them.

Null in before or after means that the fragment does not tell that value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rows as R
from ..functions import values
from .statements import _lit


def fragment_values(df: DataFrame, spec: R.TableSpec, before: str, after: str, offset: str, out: str = "delta") -> DataFrame:
    """Adds struct<before array<string>, after array<string>> from the fragment's old and new bytes, which start at `offset` of the row."""

    def run(fragment, at):
        return values.fragment_values(spec, fragment, at.fill_null(1 << 20).to_numpy(zero_copy_only=False))

    read = R.arrow_function(run, "array<string>")
    at = F.col(offset).cast("long")
    return df.withColumn(out, F.struct(read(F.col(before), at).alias("before"), read(F.col(after), at).alias("after")))


def fragment_offset(record: str, new: str, old: str) -> Column:
    """Where the fragment starts in the row, from the end of the raw record: offset, old length, new length (2 bytes each), old bytes, new bytes.

    null unless the bytes and both lengths are just there."""
    base = f"(length({record}) - length({new}) - length({old}))"
    good = f"""length({new}) > 0 and length({old}) > 0 and {base} >= 6 and substring({record}, {base} + length({old}) + 1, length({new})) = {new} and substring({record}, {base} + 1, length({old})) = {old}
      and {R._le(record, f'({base} - 3)', 2)} = length({old}) and {R._le(record, f'({base} - 1)', 2)} = length({new})"""
    return F.expr(f"if({good}, cast({R._le(record, f'({base} - 5)', 2)} as int), null)")


def xor_image(image: str, delta: str) -> Column:
    """The image with the bytes of delta XORed into its beginning."""
    byte = lambda b: f"cast(conv(hex(substring({b}, k, 1)), 16, 10) as int)"
    n = f"least(length({image}), length({delta}))"
    mixed = f"unhex(array_join(transform(sequence(1, {n}), k -> lpad(hex({byte(image)} ^ {byte(delta)}), 2, '0')), ''))"
    return F.expr(f"if({delta} is null or coalesce({n}, 0) = 0, {image}, concat({mixed}, substring({image}, {n} + 1, length({image}))))")


def delta_update(spec: R.TableSpec, delta: Column, offset: Column) -> tuple[Column, Column]:
    """(forward, inverse). With a key column in the fragment it makes the WHERE; else the told columns do, under a line that warns of it."""
    before, after = delta["before"], delta["after"]
    told = [before[i].isNotNull() | after[i].isNotNull() for i in range(len(spec.columns))]
    names = [f"[{c.name}] = " for c in spec.columns]
    sets = lambda v: F.concat_ws(", ", *[F.when(told[i], F.concat(_lit(n), F.coalesce(v[i], _lit("NULL")))) for i, n in enumerate(names)])
    where = lambda v, only: F.concat_ws(" AND ", *[F.when(v[i].isNotNull(), F.concat(_lit(n), v[i])) for i, n in enumerate(names) if not only or spec.columns[i].id in spec.key])
    warn = F.concat(_lit("-- No key in the fragment at offset "), offset.cast("string"), _lit("; the changed columns may match more rows than one.\n"))
    nothing = F.concat(_lit(f"-- {spec.full_name}: the fragment at offset "), offset.cast("string"), _lit(" tells no column"))

    def statement(new: Column, old: Column) -> Column:
        plain = lambda w: F.concat(_lit(f"UPDATE {spec.full_name} SET "), sets(new), _lit(" WHERE "), w, _lit(";"))
        open_ = F.concat(warn, _lit(f"-- UPDATE {spec.full_name} SET "), sets(new), _lit(" WHERE ?;"))
        by_key, by_all = where(old, True), where(old, False)
        return F.when(by_key != "", plain(by_key)).when(by_all != "", F.concat(warn, plain(by_all))).otherwise(open_)

    any_told = told[0]
    for t in told[1:]:
        any_told = any_told | t
    return F.when(any_told, statement(after, before)).otherwise(nothing), F.when(any_told, statement(before, after)).otherwise(nothing)
