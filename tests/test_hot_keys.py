"""Hot transactions and records without a slot are spread over all partitions, with AQE off and nothing broadcast."""

import pytest
from pyspark.sql import functions as F

from tidelog.operators import images, transactions


@pytest.fixture
def plain(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    for k, v in zip(old, ("false", "-1", "16"), strict=True):
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def log(spark, n):
    """Half of the data records are of one transaction; it commits at the end."""
    i = F.col("id")
    rows = spark.range(n + 2).select(
        F.lit("db").alias("db_name"), F.format_string("%08x:%08x:%04x", F.lit(1), i * 16, F.lit(1)).alias("lsn"),
        F.when(i == 0, "LOP_BEGIN_XACT").when(i == n + 1, "LOP_COMMIT_XACT").otherwise("LOP_MODIFY_ROW").alias("operation"),
        F.when((i % 2 == 0) | (i == n + 1), "0000:0001").otherwise(F.format_string("0001:%08x", i)).alias("transaction_id"), F.lit("user").alias("transaction_name"),
        F.timestamp_seconds(i).alias("seen_at"), F.lit(False).alias("cleanup"), F.lit(7).alias("alloc_unit_id"), F.lit(None).cast("string").alias("page_id"), F.lit(None).cast("int").alias("slot_id"),
        F.lit(b"a").alias("contents0"), F.lit(b"b").alias("contents1"), F.lit(0).alias("offset_in_row"),
    )
    return rows.repartition(8)


def test_one_transaction_is_spread(plain):
    n = 40_000
    marked = transactions.with_epochs(log(plain, n))
    sizes = [r["count"] for r in marked.where("transaction_id = '0000:0001'").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 3 * sum(sizes) / 16
    assert {(r.kind, r["count"]) for r in marked.where("transaction_id = '0000:0001'").groupBy("kind").count().collect()} == {("LOP_COMMIT_XACT", n // 2 + 2)}


def test_records_without_a_slot_are_spread(plain):
    out = images.fold(log(plain, 40_000).where("operation = 'LOP_MODIFY_ROW'"))
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * sum(sizes) / 16
    assert out.where("fold_path <> 'no_image'").count() == 0
