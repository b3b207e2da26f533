"""Counters observed in the pass of a scan equal those counted apart."""

from pyspark.sql import Observation

from tidelog.operators import generate, transactions
from tidelog.scan_queries import _catalog, _records

SF = "/root/testdata/sf0.001"


def test_counters_of_the_pass(spark, tmp_path):
    records = _records(spark, SF).where("transaction_id in ('o1', 'o2', 'o7', 'o11', 'c1', 'c9', 'b9')").coalesce(2)
    seen, made = Observation("records"), Observation("events")
    generate.scan(records, _catalog(spark), watch=(seen, made)).write.parquet(str(tmp_path / "events"))
    assert seen.get == transactions.scan_counters(records).first().asDict()
    events = spark.read.parquet(str(tmp_path / "events"))
    assert made.get == events.agg(*transactions.event_counters()).first().asDict() and made.get["generated"] == events.count() > 3
