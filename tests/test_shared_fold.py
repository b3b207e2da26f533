"""Folding a slot's history in many tasks equals the walk, on random histories with records that do not fit."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators import images, shared_fold

SCHEMA = "db_name string, alloc_unit_id long, page_id string, slot_id int, lsn string, operation string, contents0 binary, contents1 binary, offset_in_row int, contents3 binary, log_record binary, page_image binary, more string"


def history(seed, n, slots=3):
    """Changes of few slots; most splices fit their row, some do not, some rows are unknown at first."""
    rng, state, rows = random.Random(seed), {}, []
    some = lambda k: bytes(rng.choice(b"abc") for _ in range(k))
    for i in range(n):
        slot = rng.choice([*range(slots), 0, 0, None])
        page = "p" if slot is not None else rng.choice(["p", None])
        image = state.get(slot) or b""
        what = rng.random()
        row = [None, None, None, None, None, None]
        if slot is not None and (what < 0.01 or (not image and what < 0.3)):
            row[:2], state[slot] = ["LOP_INSERT_ROWS", new := some(rng.randint(0, 30))], None
            state[slot] = new or image
        elif what < 0.02:
            row[:2], state[slot] = ["LOP_DELETE_ROWS", image or some(4)], b""
        elif what < 0.93:
            at = rng.randint(0, max(len(image), 1))
            old = image[at : at + rng.randint(0, 3)] if rng.random() < 0.9 else some(2)
            new = some(rng.randint(0, 3)) if len(image) < 40 else b""
            row[:4] = "LOP_MODIFY_ROW", old, new, at if rng.random() < 0.98 else -1
            state[slot] = images.step(image or None, *row[:4])[0] or b""
        else:
            at, old, new = rng.randint(0, max(len(image) - 1, 0)), b"", some(2)
            old = image[at : at + 2] if rng.random() < 0.7 else some(2)
            u16 = lambda x: x.to_bytes(2, "little")
            mark = b"\xaa\xbb\xcc\xdd"
            row = ["LOP_MODIFY_COLUMNS", u16(at) * 2, u16(len(old)), None, mark, bytes(8) + mark + old + bytes(-len(old) % 4) + new]
            state[slot] = images.step(image or None, *row)[0] or b""
        rows.append(("d", 5, page, slot, f"{i:08x}", row[0], row[1], row[2], row[3], row[4], row[5], some(8) if rng.random() < 0.02 else None, "x"))
    return rows


def as_set(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


@pytest.mark.parametrize(("seed", "slots", "parts"), [(1, 1, 4), (2, 3, 6), (3, 40, 5)])
def test_equals_the_walk(spark, seed, slots, parts):
    df = spark.createDataFrame(history(seed, 1500, slots), SCHEMA)
    assert as_set(shared_fold.fold(df, parts)) == as_set(images.fold(df))


def test_patches_compose():
    """A patch of a stretch gives what its records give, for every start that has what it needs; for others it says so."""
    rng = random.Random(9)
    applied = 0
    for _ in range(300):
        start = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12)))
        records = [(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 2))), bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 2))), rng.randint(0, 12)) for _ in range(rng.randint(1, 6))]
        patch, image = shared_fold.Patch(), start
        for old, new, at in records:
            patch.splice(old, new, at)
            done = images.splice(image, old, new, at)
            image = image if done is None else done
        out = shared_fold.Patch.load(patch.dump()).apply(start)
        assert out is None or out == image
        applied += out is not None
    assert applied > 30


def test_one_slot_fills_all_partitions(spark):
    """No stretch is walked twice when every change fits, and all partitions work."""
    n = 20_000
    i = F.col("id")
    df = spark.range(n).select(
        F.lit("d").alias("db_name"), F.lit(5).cast("long").alias("alloc_unit_id"), F.lit("p").alias("page_id"), F.lit(1).alias("slot_id"), F.format_string("%010x", i).alias("lsn"), F.when(i == 0, "LOP_INSERT_ROWS").otherwise("LOP_MODIFY_ROW").alias("operation"),
        F.when(i == 0, F.lit(b"xx00000000yy")).otherwise(F.format_string("%08x", i - 1).cast("binary")).alias("contents0"), F.when(i > 0, F.format_string("%08x", i).cast("binary")).alias("contents1"), F.when(i > 0, F.lit(2)).otherwise(-1).alias("offset_in_row"),
    )
    out = shared_fold.fold(df, 8)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * n / 8
    assert out.where("fold_path = 'splice'").count() == n - 1
    last = out.orderBy(F.desc("lsn")).first()
    assert bytes(last.after_image) == b"xx%08xyy" % (n - 1)


def test_one_slot_query_numbers_over_sampled_ranges(spark, tmp_path):
    """Range partitions are cut by a sample that differs from run to run; the numbers are of one cut."""
    from tidelog import source_queries

    n, was = 30_000, spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.range(n).select((F.col("id") * 2 + 1).alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = source_queries.fold_one_slot(spark, str(tmp_path))
        assert out.where("path = 'splice' and k = 2 * nth - 1").count() == n
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
