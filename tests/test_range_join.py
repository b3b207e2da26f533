"""The sweep join of points and ranges against brute force, with long, equal, empty and null ranges and hot points."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidelog.operators.range_join import sweep_join

BIG = 2**48


def tables(spark, seed, n=400, m=150):
    rng = random.Random(seed)
    number = lambda: rng.randint(30, 60) * BIG + rng.randint(0, 30) * 65536
    points = [(i, Decimal(x)) for i, x in enumerate([number() for _ in range(n)] + [45 * BIG] * n)] + [(-1, None), (-2, Decimal(0))]
    ranges = []
    for j in range(m):
        a = number()
        ranges.append((j, Decimal(a), Decimal(a + rng.choice([0, 1, 65536, BIG, 3 * BIG]))))
    ranges += [(900, Decimal(0), Decimal(90 * BIG)), (901, Decimal(30 * BIG), Decimal(60 * BIG)), (902, None, Decimal(5)), (903, Decimal(5), None), (904, Decimal(9), Decimal(8)), (905, Decimal(45 * BIG), Decimal(45 * BIG)), (905, Decimal(45 * BIG), Decimal(45 * BIG))]
    return points, ranges, spark.createDataFrame(points, "id long, `a.t` decimal(25,0)"), spark.createDataFrame(ranges, "backup long, low decimal(25,0), high decimal(25,0)")


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_equals_brute_force(spark, parts):
    for seed in (1, 2):
        points, ranges, p, r = tables(spark, seed)
        got = sorted((x["id"], x["backup"]) for x in sweep_join(p, r, "a.t", "low", "high", parts=parts).collect())
        want = sorted((i, j) for i, x in points for j, a, b in ranges if None not in (x, a, b) and a <= x <= b)
        assert got == want
        first = {}
        for i, j in want:
            first.setdefault(i, []).append(j)
        got = sorted((x["id"], x["backup"]) for x in sweep_join(p, r, "a.t", "low", "high", 2, "backup", parts).collect())
        assert got == sorted((i, j) for i, js in first.items() for j in js[:2])


def test_no_rows(spark):
    _, _, p, r = tables(spark, 3)
    assert sweep_join(p.limit(0), r, "a.t", "low", "high").count() == 0 and sweep_join(p, r.limit(0), "a.t", "low", "high").count() == 0


def test_a_hot_point_is_shared(spark):
    """Half of the points are one number: they go to several tasks."""
    p = spark.range(20_000).select("id", F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).cast("decimal(25,0)").alias("t"))
    r = spark.range(50).select(F.col("id").alias("backup"), F.lit(0).cast("decimal(25,0)").alias("low"), F.col("id").cast("decimal(25,0)").alias("high"))
    out = sweep_join(p, r, "t", "low", "high", parts=16)
    sizes = [x["count"] for x in out.where("t = 7").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 10_001 * 43 and len(sizes) >= 3 and max(sizes) < 0.6 * sum(sizes)
