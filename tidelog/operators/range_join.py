"""Points joined with the ranges that hold them, by a plane sweep over range partitions.

The axis is cut at quantiles of points and range starts. A part gets its points and every range that reaches into it: a range is a row
for each border that it crosses, so ranges stay active over the borders of parts, however long they are. A part with many points (a hot value, too)
is shared by several tasks, each with all of the part's ranges. In a task, points and ranges come in order of the axis; the ranges still
open are held, and each batch of points meets them by two binary searches a range. Time follows points, ranges and pairs, not their product.

Null points and ranges with a null end meet nothing. Numbers have up to 38 digits and are not negative; both ends of a range belong to it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rows as R
from ..storage import durable

DIGITS = 38


def _key(c: Column) -> Column:
    """Text in the order of the numbers."""
    return F.lpad(c.cast(f"decimal({DIGITS},0)").cast("string"), DIGITS, "0")


def _name(c: str) -> Column:
    return F.col("`" + c.replace("`", "``") + "`")


def _parts_of(borders: np.ndarray):
    """Arrow function: the number of borders at or below a number. Rounding to double keeps order, so a point lies in no other part than ranges that hold it."""

    def run(x):
        return pa.array(np.searchsorted(borders, x.to_numpy(zero_copy_only=False), "right").astype(np.int32))

    return R.arrow_function(run, "int")


def sweep_join(points: DataFrame, ranges: DataFrame, at: str, first: str, last: str, most: int | None = None, order: str | None = None, parts: int | None = None) -> DataFrame:
    """Columns of points and of ranges for each pair with first <= at <= last; with `most`, a point's first so many ranges by `order`.

    The two sides must not share a column name. parts: of the axis; by default as many as shuffle partitions, so that the number grows with the setting."""
    spark = points.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    points, ranges = points.where(_name(at).isNotNull()), ranges.where(_name(first).isNotNull() & (_name(last) >= _name(first)))
    axis = points.select(_name(at).cast("double").alias("x")).unionByName(ranges.select(_name(first).cast("double").alias("x")))
    found = axis.agg(F.percentile_approx("x", [k / parts for k in range(1, parts)] or [0.5], F.lit(20 * parts)).alias("e")).first()["e"] or []
    part = _parts_of(np.unique(np.asarray(found, float)))

    put = durable(points.select(F.struct(*map(_name, points.columns)).alias("point"), part(_name(at).cast("double")).alias("part"), _key(_name(at)).alias("a")))
    # One number for each part: into how many tasks its points go.
    counts = {r.part: r["count"] for r in put.groupBy("part").count().collect()}
    fair = max(1, sum(counts.values()) // parts)
    shares = np.ones(max(counts, default=0) + 2, np.int32)
    for k, n in counts.items():
        shares[k] = max(1, n // (2 * fair))
    width = lambda c: R.arrow_function(lambda x: pa.array(shares[np.minimum(x.to_numpy(zero_copy_only=False), len(shares) - 1)]), "int")(c)
    put = put.select("part", F.pmod(F.xxhash64("point"), width(F.col("part"))).cast("int").alias("share"), "a", F.lit(None).cast("string").alias("b"), F.lit(1).alias("kind"), "point", F.lit(None).cast(ranges.select(F.struct(*map(_name, ranges.columns))).schema[0].dataType).alias("range"))
    reach = ranges.select(F.struct(*map(_name, ranges.columns)).alias("range"), _key(_name(first)).alias("a"), _key(_name(last)).alias("b"), F.explode(F.sequence(part(_name(first).cast("double")), part(_name(last).cast("double")))).alias("part"))
    reach = reach.withColumn("share", F.explode(F.sequence(F.lit(0), width(F.col("part")) - 1)))
    reach = reach.select("part", "share", "a", "b", F.lit(0).alias("kind"), F.lit(None).cast(put.schema["point"].dataType).alias("point"), "range")
    ready = put.unionByName(reach).repartition(parts, "part", "share").sortWithinPartitions("part", "share", "a", "kind")
    return ready.mapInArrow(_sweep(most, order), ready.select("point", "range").schema).select("point.*", "range.*")


def _sweep(most: int | None, order: str | None):
    def pairs(points: pa.Table, held: pa.Table) -> Iterator[pa.RecordBatch]:
        """Points and open ranges of one part and share, both in order of their first number."""
        x = _texts(points["a"])
        lo, hi = np.searchsorted(x, _texts(held["a"]), "left"), np.searchsorted(x, _texts(held["b"]), "right")
        n = np.maximum(hi - lo, 0)
        which = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        if most is not None and len(at):
            by = held["range"].combine_chunks().field(order).to_numpy(zero_copy_only=False)[which]
            place = np.lexsort((by, at))
            at, which = at[place], which[place]
            begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            nth = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
            at, which = at[nth < most], which[nth < most]
        for k in range(0, len(at), 10_000):  # a point may lie in many ranges
            cut = slice(k, k + 10_000)
            yield pa.table({"point": points["point"].take(pa.array(at[cut])), "range": held["range"].take(pa.array(which[cut]))}).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, where = None, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            place = np.stack([table["part"].to_numpy(), table["share"].to_numpy()], 1)
            cuts = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]).any(1)])) if len(place) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(place)], strict=True):
                rows, here = table.slice(lo, hi - lo), tuple(place[lo])
                if here != where:
                    held, where = None, here
                kind = rows["kind"].to_numpy()
                new = rows.filter(pa.array(kind == 0))
                held = new if held is None else pa.concat_tables([held, new])
                points = rows.filter(pa.array(kind == 1))
                if points.num_rows and held.num_rows:
                    yield from pairs(points, held)
                if held.num_rows:  # what ended before the last row meets no later one
                    held = held.filter(pa.array(_texts(held["b"]) >= _texts(rows["a"])[-1])).combine_chunks()

    return run


def _texts(column: pa.ChunkedArray) -> np.ndarray:
    return np.array(column.to_pylist(), f"S{DIGITS}")
