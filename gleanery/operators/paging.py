"""Any page of a stored result at one price: an order-statistics index over its pages."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import work_dir
from .search import newest_first, page_bounds

#: Rows of a slice aimed at; a page opens the one or two slices it lies in.
SLICE_ROWS = 20_000


class PageIndex:
    """A result in page order, cut into slices by sampled split keys, with the number of rows before each slice.

    Building it costs one range shuffle. From then on the position of a page says which slices hold
    it, so no rows before it are ranked or read, however deep it lies.
    """

    def __init__(self, spark: SparkSession, path: str, counts: dict[int, int], schema) -> None:
        self.spark, self.path, self.schema = spark, path, schema
        self.slices = sorted(counts)
        self.before = [0, *accumulate(counts[s] for s in self.slices)]

    @classmethod
    def build(cls, found: DataFrame, slice_rows: int = SLICE_ROWS) -> PageIndex:
        """Stores the result; rows that are equal in page order, ids included, may come in any order."""
        spark = found.sparkSession
        path = work_dir(spark, "pages")
        parts = max(1, -(-found.count() // slice_rows))
        ranged = found.repartitionByRange(parts, *newest_first()).sortWithinPartitions(*newest_first())
        ranged.withColumn("_tranche", F.spark_partition_id()).write.partitionBy("_tranche").parquet(path)
        stored = spark.read.schema(T.StructType([*found.schema.fields, T.StructField("_tranche", T.IntegerType())])).parquet(path)
        counts = {r["_tranche"]: r["n"] for r in stored.groupBy("_tranche").agg(F.count("*").alias("n")).collect()}
        return cls(spark, path, counts, found.schema)

    @property
    def total(self) -> int:
        return self.before[-1]

    def page(self, page: object = None, limit: object = None) -> DataFrame:
        """The page, as :func:`search.page` gives it."""
        number, size = page_bounds(page, limit)
        start = (number - 1) * size
        stop = min(start + size, self.total)
        if start >= stop:
            return self.spark.createDataFrame([], self.schema)
        first, last = bisect_right(self.before, start) - 1, bisect_right(self.before, stop - 1) - 1
        paths = [f"{self.path}/_tranche={s}" for s in self.slices[first : last + 1]]
        rows = self.spark.read.schema(self.schema).parquet(*paths)
        return rows.orderBy(*newest_first()).offset(start - self.before[first]).limit(stop - start)
