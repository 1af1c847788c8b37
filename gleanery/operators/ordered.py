"""Ordered windows over a whole table, in many tasks: ranges with a few carried-over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import work_dir

#: Rows of a range aimed at.
RANGE_ROWS = 1_000_000


def over_last_rows(rows: DataFrame, order: str, n: int, aggregate: Column, name: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` with ``name``: the aggregate over the last ``n`` rows up to each, by ``order``, whose values are distinct.

    A window without a key would put the table into one task. Here the rows are stored in ranges of the order, and
    each range is given the ``n - 1`` rows before it; what is put in order in one place are these few rows per range.
    """
    spark = rows.sparkSession
    path = work_dir(spark, "ranges")
    parts = max(1, -(-rows.count() // range_rows))
    ranged = rows.repartitionByRange(parts, order).withColumn("_range", F.spark_partition_id())
    ranged.write.partitionBy("_range").parquet(path)
    schema = T.StructType([*rows.schema.fields, T.StructField("_range", T.IntegerType())])
    stored = spark.read.schema(schema).parquet(path).withColumn("_carried", F.lit(False))
    if n > 1:
        stored = stored.unionByName(_carried(stored.drop("_carried"), rows.columns, order, n - 1))
    window = Window.partitionBy("_range").orderBy(order).rowsBetween(1 - n, 0)
    return stored.withColumn(name, aggregate.over(window)).where(~F.col("_carried")).drop("_range", "_carried")


def _carried(stored: DataFrame, columns: list[str], order: str, n: int) -> DataFrame:
    """The ``n`` rows before each range, under its number. A range may hold fewer, so they may come from several."""
    from_end = F.row_number().over(Window.partitionBy("_range").orderBy(F.desc(order)))
    tails = stored.withColumn("_from_end", from_end).where(F.col("_from_end") <= n)
    # At most n rows per range from here on.
    along = Window.orderBy(order)
    held = F.collect_list(F.struct(*columns)).over(along.rowsBetween(1 - n, 0))
    ends = tails.withColumn("_last", held).where(F.col("_from_end") == 1)
    before = ends.select("_range", F.lag("_last").over(along).alias("_last"))
    return before.select("_range", F.inline("_last"), F.lit(True).alias("_carried"))
