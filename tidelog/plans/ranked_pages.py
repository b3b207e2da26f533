"""Pages of a sort order kept on disk: events in range partitions of that order, each row with its place, and the rows of each partition counted.

A page is found by adding up counts, one number for each partition, and read from the one or two partitions that hold it; OFFSET would gather and sort all rows
before it in one task. With a filter the rows that it keeps are counted by partition first, in one pass that reads only the filter's columns.

Ties in the order go by id, as in `log_queries.ordered`; rows equal in both follow each other in an order that stays. Null keys come last."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import log_queries as Q


class RankedPages:
    """The order of events by a column, written once to a path with `build`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.counts = {r.part: r.n for r in spark.read.parquet(f"{path}/counts").collect()}

    @classmethod
    def build(cls, events: DataFrame, path: str, by: str = "event_time", direction: str = "desc", rows_each: int = 1_000_000) -> RankedPages:
        by = by if by in Q.SORTABLE else "event_time"
        up = direction.lower() == "asc"
        order = [F.col(by).asc_nulls_last() if up else F.col(by).desc_nulls_last(), F.col("id").asc() if up else F.col("id").desc()]
        parts = max(1, -(-events.count() // rows_each))
        dealt = events.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()).sortWithinPartitions("part", *order)
        placed = dealt.withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
        placed.write.partitionBy("part").parquet(f"{path}/rows")
        written = events.sparkSession.read.schema(placed.schema).parquet(f"{path}/rows")
        written.groupBy("part").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/counts")
        events.limit(0).write.parquet(f"{path}/none")
        return cls(events.sparkSession, path)

    def _rows(self, parts: list[int]) -> DataFrame:
        if not parts:
            return self.spark.read.parquet(f"{self.path}/none").withColumns({"part": F.lit(0), "at": F.lit(0).cast("long")})
        return self.spark.read.option("basePath", f"{self.path}/rows").parquet(*[f"{self.path}/rows/part={p}" for p in parts])

    def page(self, where: Q.LogFilter = Q.LogFilter(), page: int = 1, limit: int = 200) -> DataFrame:
        """The rows of a page in their order, as `log_queries.logs` gives them."""
        every = not where.terms()
        counts = self.counts if every else {r.part: r.n for r in where.apply(self._rows(sorted(self.counts))).groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
        first, last, before, starts = (page - 1) * limit, page * limit, 0, {}
        for p in sorted(counts):
            if before < last and before + counts[p] > first:
                starts[p] = before
            before += counts[p]
        rows = where.apply(self._rows(list(starts))).orderBy("part", "at")
        if every and starts:  # a row's place is its number, so row groups without a row of the page are left out
            rows = rows.where(reduce(Column.__or__, [(F.col("part") == p) & F.col("at").between(first - n, last - n - 1) for p, n in starts.items()]))
        else:
            rows = rows.offset(first - min(starts.values(), default=first)).limit(limit)
        return Q._page(rows)
